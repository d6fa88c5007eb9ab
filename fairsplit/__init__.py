"""Checks for controlled experiments, as Spark jobs."""

from .errors import DataError, ExperimentError, RoutingError, StatisticsError
from .operators.correction import adjust_p_values
from .operators.metrics import apply_cuped, metric_test, metric_tests
from .operators.srm import srm_check
from .operators.verdict import decide_verdict
from .plans.analyze import analyze
from .plans.psm import propensity_score_match
from .plans.storage import release_scratch
from .sources.csv import load_experiment_csv
from .sources.uplift import adapt_uplift

__all__ = [
    "DataError", "ExperimentError", "RoutingError", "StatisticsError", "adapt_uplift",
    "adjust_p_values", "analyze", "apply_cuped", "decide_verdict", "load_experiment_csv",
    "metric_test", "metric_tests", "propensity_score_match", "release_scratch", "srm_check",
]
