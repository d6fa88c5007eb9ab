"""Experiment tables derived from the test tables.

The unit is an order. ``variant`` is a balanced assignment, ``variant_conf``
one that leans on the price and the priority of the order, so that a naive
comparison of revenue is confounded. The SQL text states the same tables for
the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairsplit.operators.clean import ROW_ID
from fairsplit.sources.uplift import FEATURES

PLAN = {"control": 0.38, "treatment": 0.62}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def assignment() -> tuple[Column, Column]:
    """Balanced and confounded assignment of an order."""
    draw = F.col("o_orderkey") * 7919 % 1000
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 100).otherwise(0)
    lean = F.least(F.lit(950.0), 300 + 0.0012 * F.col("o_totalprice") + urgent)
    arm = "treatment", "control"
    return (F.when(draw < 500, arm[0]).otherwise(arm[1]),
            F.when(draw < lean, arm[0]).otherwise(arm[1]))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level columns that need no line items."""
    variant, confounded = assignment()
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("user_id"), variant.alias("variant"),
        confounded.alias("variant_conf"), F.col("o_totalprice").alias("pre_value"),
        F.col("o_orderpriority").alias("device"), "o_orderstatus", "o_custkey")


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with their outcomes; ``basket`` is missing without line items."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("basket"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"))
    base = units(spark, sf_dir)
    joined = base.join(lines, base.user_id == lines.l_orderkey, "left")
    return joined.select(
        "user_id", "variant", "variant_conf", "pre_value", "device",
        F.coalesce("returned", F.lit(0)).alias("converted"),
        F.round(F.coalesce("basket", F.lit(0.0)) + 0.15 * F.col("pre_value"), 4).alias("revenue"),
        F.round("basket", 4).alias("basket"))


EXPERIMENT_SQL = """
li AS (
  SELECT l_orderkey, SUM(l_extendedprice * (1 - l_discount)) AS basket,
         MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
  FROM lineitem GROUP BY l_orderkey),
experiment AS (
  SELECT o.o_orderkey AS user_id,
         CASE WHEN (o.o_orderkey * 7919) % 1000 < 500
              THEN 'treatment' ELSE 'control' END AS variant,
         CASE WHEN (o.o_orderkey * 7919) % 1000 < LEAST(CAST(950 AS DOUBLE),
                300 + CAST(0.0012 AS DOUBLE) * o.o_totalprice
                + CASE WHEN o.o_orderpriority = '1-URGENT' THEN 100 ELSE 0 END)
              THEN 'treatment' ELSE 'control' END AS variant_conf,
         o.o_totalprice AS pre_value, o.o_orderpriority AS device,
         o.o_orderstatus, o.o_custkey,
         COALESCE(li.returned, 0) AS converted,
         ROUND(COALESCE(li.basket, 0) + CAST(0.15 AS DOUBLE) * o.o_totalprice, 4) AS revenue,
         ROUND(li.basket, 4) AS basket
  FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey)"""


# --- deterministic score: matching steps can be checked without a model --------

def linear_score() -> Column:
    """Coarse linear function of the price: ties, and a wide overlap."""
    return F.floor(F.col("pre_value") / 100.0) / F.lit(1000.0) - 2.0


def scored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(_row_id, treated, p, logit, pre_value, urgent, revenue, converted)``."""
    score = linear_score()
    return experiment(spark, sf_dir).select(
        F.col("user_id").alias(ROW_ID),
        (F.col("variant_conf") == "treatment").cast("int").alias("treated"),
        (1 / (1 + F.exp(-score))).alias("p"), score.alias("logit"),
        "pre_value", (F.col("device") == "1-URGENT").cast("double").alias("urgent"),
        "revenue", F.col("converted").cast("double").alias("converted"))


SCORED_SQL = EXPERIMENT_SQL + """,
scored AS (
  SELECT user_id, CASE WHEN variant_conf = 'treatment' THEN 1 ELSE 0 END AS treated,
         1 / (1 + EXP(-(FLOOR(pre_value / 100) / CAST(1000 AS DOUBLE) - 2))) AS p,
         FLOOR(pre_value / 100) / CAST(1000 AS DOUBLE) - 2 AS logit,
         pre_value, CAST(CASE WHEN device = '1-URGENT' THEN 1 ELSE 0 END AS DOUBLE) AS urgent,
         revenue, CAST(converted AS DOUBLE) AS converted
  FROM experiment),
bounds AS (
  SELECT MIN(p) FILTER (WHERE treated = 1) AS low, MAX(p) FILTER (WHERE treated = 0) AS high
  FROM scored),
inside AS (SELECT scored.* FROM scored, bounds WHERE p BETWEEN low AND high),
caliper AS (SELECT 0.2 * STDDEV_SAMP(logit) AS width FROM inside),
treated_levels AS (SELECT DISTINCT logit FROM inside WHERE treated = 1),
control_levels AS (
  SELECT logit, MIN(user_id) AS control_id FROM inside WHERE treated = 0 GROUP BY logit),
below AS (
  SELECT t.logit, c.logit AS c_logit, c.control_id
  FROM treated_levels t ASOF JOIN control_levels c ON t.logit >= c.logit),
above AS (
  SELECT t.logit, c.logit AS c_logit, c.control_id
  FROM treated_levels t ASOF JOIN control_levels c ON t.logit <= c.logit),
nearest AS (
  SELECT t.logit,
         CASE WHEN b.c_logit IS NULL OR a.c_logit - t.logit <= t.logit - b.c_logit
              THEN a.control_id ELSE b.control_id END AS control_id,
         CASE WHEN b.c_logit IS NULL OR a.c_logit - t.logit <= t.logit - b.c_logit
              THEN a.c_logit - t.logit ELSE t.logit - b.c_logit END AS gap
  FROM treated_levels t LEFT JOIN below b ON b.logit = t.logit
       LEFT JOIN above a ON a.logit = t.logit),
pairs AS (
  SELECT t.user_id, n.control_id, n.gap, t.revenue - c.revenue AS d_revenue,
         t.converted - c.converted AS d_converted, t.pre_value AS t_pre, c.pre_value AS c_pre,
         t.urgent AS t_urgent, c.urgent AS c_urgent
  FROM inside t JOIN nearest n ON n.logit = t.logit
       JOIN inside c ON c.user_id = n.control_id, caliper
  WHERE t.treated = 1 AND n.gap <= caliper.width)"""


# --- raw string tables for the repair steps ----------------------------------

def double_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw strings; pending orders are logged again with a late price.

    The row number puts the repeats after all first lines. ``notes`` is never
    filled; ``pre_value`` carries a dirty token, ``device`` missing tokens.
    """
    variant, _ = assignment()
    orders = read(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    first = orders.select(
        F.col("o_orderkey").alias(ROW_ID), F.col("o_orderkey").cast("string").alias("user_id"),
        variant.alias("variant"),
        F.when(F.col("o_totalprice") < 20000, "ERROR").otherwise(price).alias("pre_value"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_orderpriority"))
        .alias("device"),
        F.lit("").alias("notes"), (F.col("o_totalprice") > 300000).cast("int").cast("string")
        .alias("converted"), "o_orderstatus")
    again = first.where("o_orderstatus = 'P'").withColumns({
        ROW_ID: F.col(ROW_ID) + 1_000_000_000_000, "pre_value": F.lit("1.00")})
    return first.unionByName(again).drop("o_orderstatus")


DOUBLE_LOGGED_SQL = """
first_lines AS (
  SELECT o_orderkey AS row_id, o_orderkey AS user_id,
         CASE WHEN (o_orderkey * 7919) % 1000 < 500
              THEN 'treatment' ELSE 'control' END AS variant,
         CASE WHEN o_totalprice < 20000 THEN 'ERROR'
              ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS pre_value,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS device,
         CAST(NULL AS VARCHAR) AS notes,
         CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS converted, o_orderstatus
  FROM orders),
raw AS (
  SELECT * FROM first_lines
  UNION ALL
  SELECT row_id + 1000000000000, user_id, variant, '1.00', device, notes, converted, o_orderstatus
  FROM first_lines WHERE o_orderstatus = 'P'),
deduplicated AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY row_id) AS rn FROM raw)
  WHERE rn = 1)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with tokens in text columns; ``signal`` is dirty, ``gap`` missing."""
    value = F.col("value").cast("decimal(12,2)").cast("string")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.when(kind == "error", "ERROR").when(kind == "view", "NULL").otherwise(value).alias("signal"),
        F.when(kind == "signup", "n/a").when(kind == "click", "").otherwise(value).alias("gap"),
        F.when((kind == "error") & (F.col("value") < 5), "1.0d").otherwise(value).alias("suffixed"),
        F.lit(None).cast("string").alias("never"))


RAW_EVENTS_SQL = """
raw_events AS (
  SELECT user_id, event_id,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN NULL
              ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS signal,
         CASE WHEN event_type IN ('signup', 'click') THEN NULL
              ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS gap,
         CASE WHEN event_type = 'error' AND value < 5 THEN '1.0d'
              ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS suffixed,
         CAST(NULL AS VARCHAR) AS never
  FROM events)"""


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV text of the orders; its one column is named like the header line.

    Open orders quote a comma, finished ones leave the last field out, and
    pending ones of two priorities have one or two fields too many.
    """
    variant, _ = assignment()
    head = F.concat_ws(",", F.col("o_orderkey").cast("string"), variant,
                       F.col("o_totalprice").cast("decimal(12,2)").cast("string"), "o_orderpriority")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    line = (F.when(status == "O", F.concat(head, F.lit(',"open, still"')))
            .when(status == "F", head)
            .when(priority == "1-URGENT", F.concat(head, F.lit(",pending,,more")))
            .when(priority == "5-LOW", F.concat(head, F.lit(",pending,more")))
            .otherwise(F.concat(head, F.lit(",pending"))))
    return read(spark, sf_dir, "orders").select(line.alias("user_id,variant,pre_value,device,note"))


KEPT_LINES_SQL = """
kept AS (
  SELECT o_orderkey AS user_id,
         CASE WHEN (o_orderkey * 7919) % 1000 < 500
              THEN 'treatment' ELSE 'control' END AS variant,
         CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS pre_value,
         o_orderpriority AS device,
         CASE o_orderstatus WHEN 'O' THEN 'open, still' WHEN 'P' THEN 'pending' END AS note
  FROM orders
  WHERE NOT (o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW')))"""


# --- uplift-shaped table -------------------------------------------------------

def uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an uplift table; heavily taxed items lack a treatment."""
    draw = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 100
    shapes = {
        "f0": F.col("l_quantity"), "f1": F.col("l_extendedprice"), "f2": F.col("l_discount"),
        "f3": F.col("l_tax"), "f4": F.col("l_linenumber").cast("double"),
        "f5": F.col("l_partkey").cast("double"), "f6": F.col("l_suppkey").cast("double"),
        "f7": F.col("l_quantity") * F.col("l_linenumber"),
        "f8": F.col("l_orderkey").cast("double"),
        "f9": F.year("l_shipdate").cast("double"), "f10": F.month("l_shipdate").cast("double"),
        "f11": F.dayofmonth("l_shipdate").cast("double"),
    }
    return read(spark, sf_dir, "lineitem").select(
        *[shapes[f].alias(f) for f in FEATURES],
        F.when(F.col("l_tax") < 0.08, F.when(draw < 85, 1).otherwise(0)).alias("treatment"),
        (F.col("l_returnflag") == "R").cast("int").alias("conversion"),
        (F.col("l_linestatus") == "O").cast("int").alias("visit"),
        (F.col("l_returnflag") == "A").cast("int").alias("exposure"))


UPLIFT_SQL = """
uplift AS (
  SELECT l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
         CAST(l_linenumber AS DOUBLE) AS f4, CAST(l_partkey AS DOUBLE) AS f5,
         CAST(l_suppkey AS DOUBLE) AS f6, l_quantity * l_linenumber AS f7,
         CAST(l_orderkey AS DOUBLE) AS f8, CAST(YEAR(l_shipdate) AS DOUBLE) AS f9,
         CAST(MONTH(l_shipdate) AS DOUBLE) AS f10, CAST(DAY(l_shipdate) AS DOUBLE) AS f11,
         CASE WHEN l_tax < CAST(0.08 AS DOUBLE) THEN
           CASE WHEN (l_orderkey * 7919 + l_partkey * 104729) % 100 < 85 THEN 1 ELSE 0 END
         END AS treatment,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS conversion,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS visit
  FROM lineitem)"""


# --- scenarios: one experiment per launch rule -----------------------------------

def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five experiments over all units: ``(scenario, variant, pre_value, outcome)``.

    a no effect, b true lift, c allocation off, d confounded without effect,
    e confounded with a harmful effect.
    """
    base = experiment(spark, sf_dir)
    lift = F.when(F.col("variant") == "treatment", 8000).otherwise(0)
    harm = F.when(F.col("variant_conf") == "treatment", 8000).otherwise(0)
    cases = [("a", "variant", F.col("revenue")), ("b", "variant", F.col("revenue") + lift),
             ("c", "variant_conf", F.col("revenue")), ("d", "variant_conf", F.col("revenue")),
             ("e", "variant_conf", F.col("revenue") - harm)]
    entry = F.array(*[F.struct(F.lit(name).alias("scenario"), F.col(arm).alias("variant"),
                               outcome.alias("outcome")) for name, arm, outcome in cases])
    return base.select("pre_value", F.explode(entry).alias("_s")).select("pre_value", "_s.*")


SCENARIOS_SQL = EXPERIMENT_SQL + """,
scenarios AS (
  SELECT 'a' AS scenario, variant, pre_value, revenue AS outcome FROM experiment UNION ALL
  SELECT 'b', variant, pre_value,
         revenue + CASE WHEN variant = 'treatment' THEN 8000 ELSE 0 END FROM experiment UNION ALL
  SELECT 'c', variant_conf, pre_value, revenue FROM experiment UNION ALL
  SELECT 'd', variant_conf, pre_value, revenue FROM experiment UNION ALL
  SELECT 'e', variant_conf, pre_value,
         revenue - CASE WHEN variant_conf = 'treatment' THEN 8000 ELSE 0 END FROM experiment)"""
