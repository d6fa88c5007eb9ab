"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairsplit.functions.intervals import cohens_h, newcombe, relative_lift, wilson
from fairsplit.operators import clean, effects, matching, propensity
from fairsplit.operators.correction import adjust_p_values
from fairsplit.operators.design import complete_cases, design_matrix, feature_stats, pooled_scale, standardise
from fairsplit.operators.metrics import (apply_cuped, arm_moments, compare_arms, cuped_stats,
                                         mann_whitney_test, shift_table, significant)
from fairsplit.operators.profile import profile_table
from fairsplit.operators.levels import Levels, sparse_design
from fairsplit.operators.logistic import Block, fit_groups
from fairsplit.operators.profile_store import merged_profile, sketch_load
from fairsplit.operators.roles import classify
from fairsplit.operators.srm import plans_from_json, srm_by_plan, srm_check
from fairsplit.operators.verdict import decide_verdict
from fairsplit.plans.attach import attach
from fairsplit.plans.analyze import analyze
from fairsplit.plans.ordered import bucket_splits, midranks, with_buckets
from fairsplit.plans.psm import propensity_score_match
from fairsplit.plans.storage import materialize, scratch_path
from fairsplit.sources.csv import scan_csv
from fairsplit.sources.sinks import write_table
from fairsplit.sources.uplift import OUTPUT_COLUMNS, adaptation_stats, map_uplift, sample_rows

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
CONTROL, TREATMENT = "control", "treatment"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
# Small buckets let the ordered scans work on several buckets on small tables too.
BUCKET_ROWS = 2_500


def rounded(col: str | Column, digits: int) -> Column:
    """Rounded double without a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rounded_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: rounded(c, d) for c, d in digits.items()})


# --- scan, sinks ----------------------------------------------------------------

def _csv_scan(spark: SparkSession, sf_dir: str):
    path = scratch_path(spark, "csv_input")
    inputs.csv_lines(spark, sf_dir).write.csv(
        path, header=True, sep="\u0001", quote="", escapeQuotes=False)
    return scan_csv(spark, path)


def a1_csv_scan(spark, sf_dir):
    rows = clean.blank_missing(_csv_scan(spark, sf_dir).rows)
    return rows.select(F.col("user_id").try_cast("bigint").alias("user_id"), "variant",
                       F.col("pre_value").try_cast("double").alias("pre_value"), "device", "note")


def a2_malformed_count(spark, sf_dir):
    scan = _csv_scan(spark, sf_dir)
    return spark.createDataFrame([(scan.parsed, scan.malformed)], "parsed bigint, malformed bigint")


def a3_na_tokens(spark, sf_dir):
    return clean.blank_missing(inputs.raw_events(spark, sf_dir)).select(
        "event_id", "signal", "gap", "suffixed")


def a4_sinks(spark, sf_dir):
    levels = srm_check(inputs.units(spark, sf_dir), "device", on_issue="keep").levels
    levels = levels.select("level", "observed")
    back = []
    for fmt in ("parquet", "json", "csv"):
        path = scratch_path(spark, f"sink_{fmt}")
        write_table(levels, path, fmt)
        read = spark.read.schema(levels.schema)
        table = read.csv(path, header=True) if fmt == "csv" else read.format(fmt).load(path)
        back.append(table.select(F.lit(fmt).alias("format"), "level", "observed"))
    return back[0].unionByName(back[1]).unionByName(back[2])


# --- cleaning and profiling --------------------------------------------------------

def b1_identifier(spark, sf_dir):
    tables = {
        "orders": inputs.units(spark, sf_dir).select("variant", "user_id"),
        "double_logged": inputs.double_logged(spark, sf_dir).select("user_id", "variant"),
        "events": inputs.raw_events(spark, sf_dir).select("user_id", "event_id"),
    }
    found = [(name, *_identifier(df)) for name, df in tables.items()]
    return spark.createDataFrame(found, "source string, identifier string, repeats bigint")


def _identifier(df):
    found = clean.find_identifier(df)
    return found.column, found.repeats


def b2_dedupe(spark, sf_dir):
    kept = clean.drop_double_logged(inputs.double_logged(spark, sf_dir), "user_id")
    return kept.select(F.col("user_id").cast("bigint").alias("user_id"), "variant", "pre_value",
                       F.col(clean.ROW_ID).alias("row_id"))


def _facts(spark, sf_dir):
    return clean.column_facts(clean.blank_missing(inputs.raw_events(spark, sf_dir)))


def b3_all_null(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in _facts(spark, sf_dir).empty()], "dropped string")


def b4_coerce(spark, sf_dir):
    events = clean.blank_missing(inputs.raw_events(spark, sf_dir))
    facts = clean.column_facts(events)
    chosen = facts.mostly_numeric()
    coerced = clean.coerce_numeric(events, chosen)
    totals = coerced.agg(*[F.sum(F.col(c).try_cast("double")).alias(c)
                           for c in ("signal", "gap", "suffixed")])
    rows = spark.createDataFrame(
        [(c, facts.filled[c], facts.numeric[c], c in chosen) for c in ("signal", "gap", "suffixed")],
        "column string, filled bigint, numeric bigint, coerced boolean")
    sums = totals.unpivot([], ["signal", "gap", "suffixed"], "column", "total")
    # Without coercion the column is still text; its numbers are not a total.
    return rows.join(sums, "column").withColumn(
        "total", F.when(F.col("coerced"), rounded("total", 2)))


def b5_missingness(spark, sf_dir):
    shares = _facts(spark, sf_dir).missing()
    return spark.createDataFrame(list(shares.items()), "column string, share double") \
        .withColumn("share", rounded("share", 8))


def b6_quality(spark, sf_dir):
    _, quality = clean.repair(inputs.double_logged(spark, sf_dir))
    table = quality.table(spark)
    return table.select(
        "rows_in_file", "rows_loaded", "malformed", "duplicates",
        F.array_join("dropped_all_null", ",").alias("dropped"),
        F.array_join("coerced", ",").alias("coerced"),
        F.array_join(F.transform("missing", lambda m: m["column"]), ",").alias("missing_columns"),
        rounded(F.aggregate("missing", F.lit(0.0), lambda a, m: a + m["share"]), 8)
        .alias("missing_total"), "has_issues")


def b7_profile(spark, sf_dir):
    profile = profile_table(inputs.experiment(spark, sf_dir))
    return profile.table(spark).select(
        "column", "is_numeric", "is_binary_candidate", F.array_join("levels", ",").alias("levels"),
        rounded("missing_frac", 8).alias("missing_frac"))


def b7_merged(spark, sf_dir):
    """Three loads sketched one by one, then the profile of all of them from the stored sketches."""
    rows = materialize(inputs.experiment(spark, sf_dir), "loads")
    sketched = [sketch_load(rows.where(F.col("user_id") % 3 == i), f"load {i}") for i in range(3)]
    stored = materialize(sketched[0].unionByName(sketched[1]).unionByName(sketched[2]), "sketches")
    return merged_profile(stored).select(
        "column", "is_numeric", "n_rows", "filled", rounded("missing_frac", 8).alias("missing_frac"),
        rounded("low", 4).alias("low"), rounded("high", 4).alias("high"))


def b8_roles(spark, sf_dir):
    profile = profile_table(inputs.experiment(spark, sf_dir))
    return classify(profile.table(spark)).select("column", "name_class", "role")


# --- filters, projections ------------------------------------------------------------

def c1_arm_filter(spark, sf_dir):
    moments = arm_moments(inputs.experiment(spark, sf_dir), ["basket", "converted"],
                          "variant_conf", ["device"])
    compared = compare_arms(moments, CONTROL, TREATMENT, ["device"])
    return compared.select("device", "metric", "n_control", "n_treatment",
                           F.col("issue").isNull().alias("testable"))


def c2_complete_cases(spark, sf_dir):
    rows = complete_cases(inputs.experiment(spark, sf_dir), "variant", CONTROL, TREATMENT,
                          ["basket", "pre_value", "device"])
    return rows.select("user_id", "variant", "basket")


def c3_design_matrix(spark, sf_dir):
    return design_matrix(inputs.units(spark, sf_dir), ["pre_value", "device", "o_orderstatus"],
                         ["user_id"])


def _shops(spark, sf_dir) -> DataFrame:
    """Units with a covariate of thousands of levels: the customer and the priority."""
    rows = inputs.units(spark, sf_dir)
    return rows.withColumn("shop", F.concat_ws("/", F.col("o_custkey").cast("string"), "device"))


def c3_wide(spark, sf_dir):
    """Sparse design rows: a number, and the cell of one of thousands of levels (none for the first)."""
    rows, _ = sparse_design(_shops(spark, sf_dir), ["pre_value", "shop"], ["user_id"])
    return rows.select("user_id", F.size("indices").alias("cells"), F.get("indices", F.lit(1)).alias("level_index"),
                       F.col("values")[0].alias("pre_value"), F.get("values", F.lit(1)).alias("level_value"))


def c4_cuped_column(spark, sf_dir):
    adjusted, _ = apply_cuped(inputs.experiment(spark, sf_dir), "revenue", "pre_value",
                              on_issue="keep")
    return adjusted.select("user_id", rounded("revenue__cuped", 2).alias("revenue__cuped"))


def c5_adapt(spark, sf_dir):
    mapped = map_uplift(inputs.uplift(spark, sf_dir))
    return mapped.groupBy("variant", "conversion", "visit").agg(
        F.count(F.lit(1)).alias("n"),
        *[rounded(F.sum(c), 2).alias(c) for c in OUTPUT_COLUMNS[3:]])


def c6_sample(spark, sf_dir):
    """Sizes of an exact sample, drawn over all rows and in the proportion of the arms."""
    raw = inputs.uplift(spark, sf_dir)
    arm = F.when(F.col("treatment") == 1, 1).otherwise(0)
    plain = sample_rows(raw, 20_000).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("plain").alias("mode"), F.lit(None).cast("int").alias("arm"), "n")
    strata = sample_rows(raw, 20_000, stratified=True).groupBy(arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("stratified").alias("mode"), "arm", "n")
    return plain.unionByName(strata)


def _nation_srm(spark, sf_dir):
    """Allocation over the five priorities in every nation: one test per nation."""
    nation = inputs.read(spark, sf_dir, "nation")
    region = inputs.read(spark, sf_dir, "region")
    customer = inputs.read(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey"))
    orders = inputs.units(spark, sf_dir).join(
        customer, F.col("o_custkey") == F.col("c_custkey"))
    return srm_check(orders, "device", by=["r_name", "n_name"], on_issue="keep").summary


def c7_significance(spark, sf_dir):
    adjusted = adjust_p_values(_nation_srm(spark, sf_dir), "bh", by=["r_name"], p_column="p_value")
    return adjusted.select(
        "n_name", (F.col("p_value") < 0.05).alias("raw"),
        significant("p_value").alias("significant"))


# --- aggregate tests ---------------------------------------------------------------------

def d1_srm(spark, sf_dir):
    found = srm_check(inputs.units(spark, sf_dir), "variant_conf", inputs.PLAN,
                      by=["device"], on_issue="keep").summary
    return found.select("device", "n", "k", rounded("chi2", 6).alias("chi2"),
                        rounded("p_value", 8).alias("p_value"), "srm_detected")


def d1_srm_uniform(spark, sf_dir):
    return _nation_srm(spark, sf_dir).select(
        "r_name", "n_name", "n", "k", "df", rounded("chi2", 6).alias("chi2"),
        rounded("p_value", 8).alias("p_value"), "srm_detected")


def d1_srm_many_arms(spark, sf_dir):
    """One arm per part and one overfilled arm: far more degrees and a far larger statistic than usual."""
    arm = F.when(F.col("l_linenumber") == 1, F.lit("first")).otherwise(F.col("l_partkey").cast("string"))
    found = srm_check(inputs.read(spark, sf_dir, "lineitem").select(arm.alias("arm")), "arm").summary
    return found.select("n", "k", "df", rounded("chi2", 4).alias("chi2"), rounded("p_value", 8).alias("p_value"),
                        "srm_detected")


def d1_srm_plans(spark, sf_dir):
    """Every nation has a plan of its own for the priorities, given as JSON; one nation has none."""
    orders = inputs.read(spark, sf_dir, "orders").join(
        inputs.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(inputs.read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    nations = inputs.read(spark, sf_dir, "nation").where("n_nationkey != 7")
    tilt = F.col("n_nationkey") % 5
    shares = F.map_from_entries(F.array(*[
        F.struct(F.lit(name), F.lit(0.2) + (F.lit(i) - 2) * tilt / 500) for i, name in enumerate(PRIORITIES)]))
    plans = plans_from_json(nations.select("n_name", F.to_json(shares).alias("plan")), ["n_name"])
    found = srm_by_plan(orders, "o_orderpriority", plans, ["n_name"]).summary
    return found.select("n_name", "n", "k", rounded("chi2", 6).alias("chi2"), rounded("p_value", 8).alias("p_value"),
                        "srm_detected", F.col("issue").isNotNull().alias("has_issue"))


def d1_srm_levels(spark, sf_dir):
    levels = srm_check(inputs.units(spark, sf_dir), "variant_conf", inputs.PLAN,
                       on_issue="keep").levels
    return levels.withColumn("observed_ratio", rounded("observed_ratio", 8))


def _compared(spark, sf_dir, metrics):
    moments = arm_moments(inputs.experiment(spark, sf_dir), metrics, "variant_conf", ["device"])
    return compare_arms(moments, CONTROL, TREATMENT, ["device"])


def d2_kind(spark, sf_dir):
    lines = inputs.uplift(spark, sf_dir).withColumn("variant", F.col("visit").cast("string"))
    metrics = ["conversion", "f0", "f2", "f4", "exposure"]
    return compare_arms(arm_moments(lines, metrics, "variant"), "0", "1").select(
        "metric", "kind", "n_control", "n_treatment")


def d3_chi_square(spark, sf_dir):
    return shift_table(_compared(spark, sf_dir, ["converted"]), ["device"]).select(
        "device", "n_control", "n_treatment", rounded("control_mean", 8).alias("control_mean"),
        rounded("treatment_mean", 8).alias("treatment_mean"), rounded("chi2", 6).alias("chi2"),
        rounded("primary_p_value", 8).alias("p_value"))


def d4_wilson(spark, sf_dir):
    arms = arm_moments(inputs.experiment(spark, sf_dir), ["converted"], "variant_conf", ["device"])
    low, high = wilson(F.col("total"), F.col("n"))
    return arms.select("device", "arm", "n", rounded(low, 8).alias("low"),
                       rounded(high, 8).alias("high"))


def d5_newcombe(spark, sf_dir):
    low, high = newcombe(F.col("control_total"), F.col("n_control"),
                         F.col("treatment_total"), F.col("n_treatment"))
    return _compared(spark, sf_dir, ["converted"]).select(
        "device", rounded(low, 8).alias("ci_low"), rounded(high, 8).alias("ci_high"))


def d6_effect_size(spark, sf_dir):
    c, t = F.col("control_mean"), F.col("treatment_mean")
    return _compared(spark, sf_dir, ["converted"]).select(
        "device", rounded(cohens_h(c, t), 8).alias("cohens_h"),
        rounded(relative_lift(t - c, c), 8).alias("relative_lift"))


def d7_welch(spark, sf_dir):
    return shift_table(_compared(spark, sf_dir, ["revenue"]), ["device"]).select(
        "device", rounded("t", 6).alias("t"), rounded("t_df", 3).alias("t_df"),
        rounded("primary_p_value", 8).alias("p_value"), rounded("ci_low", 3).alias("ci_low"),
        rounded("ci_high", 3).alias("ci_high"), rounded("effect_size", 8).alias("cohens_d"),
        rounded("relative_diff", 8).alias("relative_diff"))


def d8_cuped(spark, sf_dir):
    return cuped_stats(inputs.experiment(spark, sf_dir), "basket", "pre_value", ["device"]).select(
        "device", "n", rounded("theta", 8).alias("theta"),
        rounded("covariate_mean", 4).alias("covariate_mean"),
        rounded("variance_reduction", 8).alias("variance_reduction"))


def d9_mann_whitney(spark, sf_dir):
    lines = inputs.uplift(spark, sf_dir).withColumn("variant", F.col("treatment").cast("string"))
    tested = mann_whitney_test(lines, ["f0", "f1", "f9"], "variant", "0", "1",
                               rows_per_bucket=BUCKET_ROWS)
    return tested.select("metric", rounded("u", 1).alias("u"), rounded("u_z", 6).alias("u_z"),
                         rounded("u_p", 8).alias("u_p"))


def _features():
    return {"pre_value": F.col("pre_value"), "urgent": F.col("urgent")}


def d10_balance(spark, sf_dir):
    found = effects.arm_balance(inputs.scored_units(spark, sf_dir), _features())
    return found.withColumn("smd", rounded("smd", 8))


def d11_naive(spark, sf_dir):
    naive = effects.naive_effects(inputs.scored_units(spark, sf_dir),
                                  {"revenue": "revenue", "converted": "converted"})
    return naive.withColumn("naive_effect", rounded("naive_effect", 4))


PAYLOAD = ["revenue", "converted", "pre_value", "urgent"]
DIFFS = {"revenue": "d_revenue", "converted": "d_converted"}


def _match(spark, sf_dir):
    """Match on the deterministic score, in many buckets and with hot logits."""
    scored = inputs.scored_units(spark, sf_dir)
    support = propensity.common_support(scored)
    caliper = 0.2 * support.logit_sd
    inside = scored.where(support.inside()).drop("p")
    splits = bucket_splits(inside, ["logit"], support.treated + support.control, BUCKET_ROWS)
    nearest = materialize(matching.nearest_controls(inside, splits["logit"], PAYLOAD), "nearest")
    counts = matching.match_counts(nearest, caliper)
    pairs = matching.matched_pairs(inside, matching.within_caliper(nearest, caliper),
                                   counts["matched"], counts["largest"], hot_rows=8)
    pairs = pairs.withColumns({d: F.col(m) - F.col(f"c_{m}") for m, d in DIFFS.items()})
    return scored, pairs, counts


def d12_att(spark, sf_dir):
    scored, pairs, _ = _match(spark, sf_dir)
    naive = effects.naive_effects(scored, {"revenue": "revenue", "converted": "converted"})
    att = effects.matched_effect(pairs, DIFFS).join(naive, "metric")
    ratio = effects.effect_ratio(F.col("psm_att"), F.col("naive_effect"))
    return att.select("metric", "n_matched_pairs", rounded("psm_att", 4).alias("psm_att"),
                      rounded("psm_se_paired_t", 4).alias("psm_se_paired_t"),
                      rounded(ratio, 6).alias("att_ratio"))


def d13_adapt_stats(spark, sf_dir):
    raw = inputs.uplift(spark, sf_dir)
    return adaptation_stats(raw, map_uplift(raw)).drop("malformed_rows")


# --- ranks, multiple testing -------------------------------------------------------------

def e1_midrank(spark, sf_dir):
    events = inputs.read(spark, sf_dir, "events")
    splits = bucket_splits(events, ["value"], events.count(), BUCKET_ROWS)
    rows = with_buckets(events, splits, {"value": "bucket"})
    return midranks(rows, ["event_type"]).select("event_type", "value", "n", "midrank")


def e2_bh(spark, sf_dir):
    tests = materialize(_nation_srm(spark, sf_dir), "tests")
    adjusted = adjust_p_values(tests, "bh", by=["r_name"], p_column="p_value")
    return adjusted.select("r_name", "n_name", rounded("p_value", 8).alias("p_value"),
                           rounded("adjusted_p_value", 8).alias("adjusted_p_value"),
                           "adjustment_method")


def e2_bh_fleet(spark, sf_dir):
    """One allocation test per part, three arms each, adjusted as one family in several buckets."""
    rows = inputs.read(spark, sf_dir, "lineitem").select(
        "l_partkey", (F.col("l_orderkey") % 3).cast("string").alias("arm"))
    tests = srm_check(rows, "arm", by=["l_partkey"], on_issue="keep").summary.where("k = 3 AND issue IS NULL")
    tests = materialize(tests.select("l_partkey", "chi2", "p_value"), "fleet")
    adjusted = adjust_p_values(tests, "bh", p_column="p_value", rows_per_bucket=BUCKET_ROWS // 5, hot_rows=20)
    return adjusted.select("l_partkey", rounded("p_value", 8).alias("p_value"),
                           rounded("adjusted_p_value", 8).alias("adjusted_p_value"))


def e3_bonferroni(spark, sf_dir):
    tests = materialize(_nation_srm(spark, sf_dir), "tests")
    out = []
    for method in ("bonferroni", "none"):
        table = adjust_p_values(tests, method, p_column="p_value")
        out.append(table.select(F.lit(method).alias("method"), "n_name",
                                rounded("adjusted_p_value", 8).alias("adjusted_p_value")))
    return out[0].unionByName(out[1])


# --- propensity matching --------------------------------------------------------------------

def f1_standardise(spark, sf_dir):
    rows = design_matrix(inputs.units(spark, sf_dir), ["pre_value", "o_orderstatus"], ["user_id"])
    columns = [c for c in rows.columns if c != "user_id"]
    scaled = standardise(rows, columns)
    return rounded_columns(scaled, {c: 6 for c in columns})


def _model(spark, sf_dir):
    design = inputs.units(spark, sf_dir).select(
        F.col("user_id").alias(matching.UNIT), F.col("pre_value").alias("v0"),
        (F.col("variant_conf") == TREATMENT).cast("int").alias("treated"))
    design = materialize(design, "design")
    means, scales = pooled_scale(feature_stats(design, [F.col("v0")]))
    return propensity.fit_propensity(design, [F.col("v0")], means, scales)


def f2_propensity_model(spark, sf_dir):
    model = _model(spark, sf_dir)
    return spark.createDataFrame([("intercept", model.intercept), ("pre_value", model.weights[0])],
                                 "term string, weight double").withColumn("weight", rounded("weight", 5))


def f2_by_device(spark, sf_dir):
    """One model per device, all in the same passes."""
    rows = inputs.units(spark, sf_dir).withColumn("treated", (F.col("variant_conf") == TREATMENT).cast("int"))
    found = fit_groups(rows, "treated", [F.col("pre_value")], ["device"])
    return found.select("device", "n", rounded("intercept", 5).alias("intercept"),
                        rounded(F.col("weights")[0], 5).alias("weight"))


def f2_wide(spark, sf_dir):
    """A model with a number and a covariate of thousands of levels, whose weights stay in a table."""
    rows = _shops(spark, sf_dir).withColumn("treated", (F.col("variant_conf") == TREATMENT).cast("int"))
    levels = Levels.of(rows, F.col("shop"))
    design = materialize(levels.number(rows, F.col("shop"), "k").select("treated", F.col("pre_value").alias("v0"), "k"), "design")
    means, scales = pooled_scale(feature_stats(design, [F.col("v0")]))
    block = Block("k", levels.table.select("k", "n"), levels.size, levels.total, levels.largest)
    model = propensity.fit_propensity(design, [F.col("v0")], means, scales, [block])
    beta = F.col("beta")
    return model.level_weights[0].agg(F.count(beta).alias("levels"), F.sum(beta).alias("total"), F.sum(beta * beta).alias("squares"),
                                      F.min(beta).alias("least"), F.max(beta).alias("most")).select(
        "levels", *[rounded(c, 4).alias(c) for c in ("total", "squares", "least", "most")],
        rounded(F.lit(model.intercept), 4).alias("intercept"), rounded(F.lit(model.weights[0]), 4).alias("weight"))


def f3_logit(spark, sf_dir):
    model = _model(spark, sf_dir)
    p = model.probability([F.col("pre_value")])
    steep = 1 / (1 + F.exp(-(F.col("pre_value") - 250000.0) / 15000.0))
    rows = inputs.units(spark, sf_dir).select(
        "device", p.alias("p"), propensity.logit(p).alias("logit"),
        propensity.logit(steep).alias("clipped"))
    return rows.groupBy("device").agg(
        rounded(F.avg("p"), 4).alias("mean_p"), rounded(F.avg("logit"), 4).alias("mean_logit"),
        rounded(F.stddev_samp("logit"), 4).alias("sd_logit"),
        rounded(F.avg("clipped"), 4).alias("mean_clipped"),
        rounded(F.max("clipped"), 4).alias("max_clipped"),
        rounded(F.min("clipped"), 4).alias("min_clipped"))


def _support_row(spark, sf_dir):
    return propensity.common_support(inputs.scored_units(spark, sf_dir))


def f4_support(spark, sf_dir):
    s = _support_row(spark, sf_dir)
    return spark.createDataFrame(
        [(s.low, s.high, s.treated, s.control, s.trimmed_treated, s.trimmed_control)],
        "low double, high double, treated bigint, control bigint, trimmed_treated bigint, "
        "trimmed_control bigint").withColumns({"low": rounded("low", 8), "high": rounded("high", 8)})


def f5_caliper(spark, sf_dir):
    s = _support_row(spark, sf_dir)
    return spark.createDataFrame([(0.2 * s.logit_sd,)], "caliper double") \
        .withColumn("caliper", rounded("caliper", 8))


def f6_match(spark, sf_dir):
    _, pairs, _ = _match(spark, sf_dir)
    return pairs.select(F.col(matching.UNIT).alias("treated_id"), "control_id",
                        rounded("gap", 6).alias("gap"), rounded("d_revenue", 4).alias("d_revenue"),
                        "d_converted")


RESAMPLES = 20


def f7_bootstrap(spark, sf_dir):
    _, pairs, counts = _match(spark, sf_dir)
    pairs = materialize(pairs.select(matching.UNIT, *DIFFS.values()), "pairs")
    drawn = effects.bootstrap_effects(pairs, DIFFS, RESAMPLES, 7, counts["matched"],
                                      word=effects.digest_word)
    found = effects.bootstrap_summary(
        drawn, effects.matched_effect(pairs, DIFFS).select("metric", "psm_att"))
    return found.select(
        "metric", "resamples", rounded("psm_se_bootstrap", 4).alias("se"),
        rounded("psm_ci_low", 4).alias("ci_low"), rounded("psm_ci_high", 4).alias("ci_high"),
        rounded("psm_p_value", 6).alias("p_value"))


def f7_bootstrap_hashed(spark, sf_dir):
    """The default generator at the full number of resamples."""
    _, pairs, counts = _match(spark, sf_dir)
    pairs = materialize(pairs.select(matching.UNIT, *DIFFS.values()), "pairs")
    drawn = effects.bootstrap_effects(pairs, DIFFS, 500, 0, counts["matched"])
    found = effects.bootstrap_summary(drawn, effects.matched_effect(pairs, DIFFS).select("metric", "psm_att"))
    return found.select("metric", "resamples", "psm_att", rounded("psm_se_bootstrap", 4).alias("se"),
                        rounded("psm_ci_low", 4).alias("ci_low"), rounded("psm_ci_high", 4).alias("ci_high"),
                        rounded("psm_p_value", 6).alias("p_value"))


def f8_rosenbaum(spark, sf_dir):
    _, pairs, counts = _match(spark, sf_dir)
    pairs = materialize(pairs.select(*DIFFS.values()), "pairs")
    sizes = pairs.select(*[F.abs(d).alias(f"d{i}") for i, d in enumerate(DIFFS.values())])
    splits = bucket_splits(sizes, sizes.columns, counts["matched"], BUCKET_ROWS)
    totals = effects.signed_rank_totals(pairs, DIFFS, splits)
    return effects.rosenbaum_bounds(totals).select(
        "metric", "gamma", rounded("z", 6).alias("z"), rounded("upper_p", 8).alias("upper_p"))


def f9_psm(spark, sf_dir):
    return propensity_score_match(
        inputs.experiment(spark, sf_dir), ["revenue", "basket"], "variant_conf", CONTROL,
        TREATMENT, ["pre_value", "device"], row_id="user_id").result


def f9_psm_numeric(spark, sf_dir):
    """One numeric covariate, so that the fitted match can be repeated in SQL."""
    found = propensity_score_match(
        inputs.experiment(spark, sf_dir), ["revenue", "converted"], "variant_conf", CONTROL, TREATMENT,
        ["pre_value"], row_id="user_id").result
    return found.select(
        "metric", "n_treated", "n_control_pool", "n_matched_pairs", "discarded_treated", "trimmed_treated",
        "trimmed_control", "bootstrap_resamples", rounded("caliper", 5).alias("caliper"),
        rounded("naive_effect", 4).alias("naive_effect"), rounded("psm_att", 4).alias("psm_att"),
        rounded("psm_se_paired_t", 4).alias("se"))


# --- decision layer ---------------------------------------------------------------------------

def _stratified_effects(rows: DataFrame) -> DataFrame:
    """Effect per scenario adjusted by price strata, with a normal interval."""
    arm = F.col("variant") == TREATMENT
    y = F.col("outcome")
    strata = rows.groupBy("scenario", F.floor(F.col("pre_value") / 10000).alias("stratum")).agg(
        F.count_if(arm).alias("n_t"), F.count_if(~arm).alias("n_c"),
        F.avg(F.when(arm, y)).alias("m_t"), F.avg(F.when(~arm, y)).alias("m_c"),
        F.var_samp(F.when(arm, y)).alias("v_t"), F.var_samp(F.when(~arm, y)).alias("v_c"),
    ).where("n_t > 1 AND n_c > 1")
    n, diff = F.col("n_t"), F.col("m_t") - F.col("m_c")
    error = n * n * (F.col("v_t") / n + F.col("v_c") / F.col("n_c"))
    adjusted = strata.groupBy("scenario").agg(
        (F.sum(n * diff) / F.sum(n)).alias("psm_att"),
        (F.sqrt(F.sum(error)) / F.sum(n)).alias("_se"))
    naive = effects.naive_effects(
        rows.select("scenario", arm.cast("int").alias("treated"), "outcome"),
        {"outcome": "outcome"}, ["scenario"])
    return adjusted.join(naive, "scenario").select(
        "scenario", "metric", "naive_effect", "psm_att",
        (F.col("psm_att") - 1.96 * F.col("_se")).alias("psm_ci_low"),
        (F.col("psm_att") + 1.96 * F.col("_se")).alias("psm_ci_high"))


def g1_verdict(spark, sf_dir):
    rows = materialize(inputs.scenarios(spark, sf_dir), "scenarios")
    by = ["scenario"]
    srm = srm_check(rows.where("scenario IN ('a', 'b', 'c')"), "variant", by=by,
                    on_issue="keep").summary
    planned = srm_check(rows.where("scenario IN ('d', 'e')"), "variant", inputs.PLAN, by=by,
                        on_issue="keep").summary
    tests = shift_table(compare_arms(arm_moments(rows, ["outcome"], "variant", by),
                                     CONTROL, TREATMENT, by), by)
    verdicts = decide_verdict(srm.unionByName(planned), tests, _stratified_effects(rows),
                              "outcome", by=by)
    return verdicts.select("scenario", "verdict", "rule", F.size("reasons").alias("n_reasons"))


def g2_balance_table(spark, sf_dir):
    scored, pairs, _ = _match(spark, sf_dir)
    names = list(_features())
    sides = F.array(*[F.struct(F.lit(t).alias("treated"), *[F.col(f"{p}{c}").alias(c) for c in names])
                      for t, p in ((1, ""), (0, "c_"))])
    stacked = pairs.select(F.explode(sides).alias("_s")).select("_s.*")
    table = effects.balance_table(effects.arm_balance(scored, _features()),
                                  effects.arm_balance(stacked, _features()), ["covariate"])
    return rounded_columns(table, {"smd_before": 8, "smd_after": 8})


def g3_analyze(spark, sf_dir):
    tables = analyze(
        inputs.experiment(spark, sf_dir), variant_column="variant_conf", control_label=CONTROL,
        treatment_label=TREATMENT, primary_metric="revenue", secondary_metrics=["converted"],
        covariates=["pre_value", "device"], expected_ratio=inputs.PLAN, row_id="user_id",
        store_input=True)
    return tables["verdict"]


def g3_numeric(spark, sf_dir):
    """The whole analysis with one numeric covariate, so that SQL can repeat it to the verdict."""
    tables = analyze(
        inputs.experiment(spark, sf_dir), variant_column="variant_conf", control_label=CONTROL,
        treatment_label=TREATMENT, primary_metric="revenue", secondary_metrics=["converted"],
        covariates=["pre_value"], expected_ratio=inputs.PLAN, row_id="user_id", store_input=True)
    primary = tables["psm"].where("metric = 'revenue'").select(
        "n_matched_pairs", rounded("naive_effect", 4).alias("naive_effect"), rounded("psm_att", 4).alias("psm_att"))
    srm = tables["srm"].select(rounded("chi2", 6).alias("chi2"), "srm_detected")
    verdict = tables["verdict"].select("verdict", "rule", F.size("reasons").alias("n_reasons"))
    return attach(attach(verdict, srm), primary)


def flagship(spark, sf_dir):
    """Verdict of the confounded experiment, roles given."""
    return g3_analyze(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        a1_csv_scan, a2_malformed_count, a3_na_tokens, a4_sinks,
        b1_identifier, b2_dedupe, b3_all_null, b4_coerce, b5_missingness, b6_quality, b7_profile, b7_merged,
        b8_roles,
        c1_arm_filter, c2_complete_cases, c3_design_matrix, c3_wide, c4_cuped_column, c5_adapt, c6_sample,
        c7_significance,
        d1_srm, d1_srm_uniform, d1_srm_many_arms, d1_srm_plans, d1_srm_levels, d2_kind, d3_chi_square, d4_wilson, d5_newcombe,
        d6_effect_size, d7_welch, d8_cuped, d9_mann_whitney, d10_balance, d11_naive, d12_att,
        d13_adapt_stats,
        e1_midrank, e2_bh, e2_bh_fleet, e3_bonferroni,
        f1_standardise, f2_propensity_model, f2_by_device, f2_wide, f3_logit, f4_support, f5_caliper, f6_match,
        f7_bootstrap, f7_bootstrap_hashed, f8_rosenbaum, f9_psm, f9_psm_numeric,
        g1_verdict, g2_balance_table, g3_analyze, g3_numeric,
    )
}
