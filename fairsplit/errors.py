"""Exceptions raised on the driver, after the deciding aggregate is known."""


class ExperimentError(Exception):
    """Base of every error this package raises on purpose."""


class DataError(ExperimentError):
    """The input cannot be read, or holds no usable assignment or metric."""


class StatisticsError(ExperimentError):
    """A check cannot be computed on this data (too small, no overlap, ...)."""


class RoutingError(ExperimentError):
    """Column roles cannot be inferred, or an override contradicts the data."""
