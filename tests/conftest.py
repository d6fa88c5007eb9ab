"""Shared session and small experiments."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "4g")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.codegen.cache.maxEntries", "2000")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ORDERS = "/root/testdata/sf0.01/orders.parquet"


def draw(name: str) -> Column:
    """A share between 0 and 1 from a hash of the order's number."""
    return F.pmod(F.xxhash64(F.lit(name), "o_orderkey"), F.lit(1 << 31)) / F.lit(2.0**31)


def units(spark) -> DataFrame:
    """The first 5,000 orders as units; the price before the experiment is the covariate."""
    orders = spark.read.parquet(ORDERS).orderBy("o_orderkey").limit(5_000)
    return orders.withColumns({
        "user_id": F.col("o_orderkey"), "pre_value": F.round(F.col("o_totalprice") / 1000, 2),
        "device": F.when(F.col("o_orderpriority") < "3", "desktop").otherwise("mobile")})


@pytest.fixture(scope="session")
def balanced(spark):
    """Arms by hash, so nothing is confounded; treatment raises both outcomes."""
    treated = draw("arm") < 0.5
    lift = treated.cast("int")
    bought = draw("buy") < 0.1 + 0.0003 * F.col("pre_value") + 0.06 * lift
    spent = F.round(18 + F.col("pre_value") / 12 + 7 * lift + 25 * draw("spend"), 2)
    return units(spark).select(
        "user_id", F.when(treated, "treatment").otherwise("control").alias("variant"), "pre_value", "device",
        bought.cast("int").alias("converted"), F.when(bought, spent).otherwise(0.0).alias("revenue")).cache()


@pytest.fixture(scope="session")
def uneven(spark):
    """Three fifths are treated although half was planned; no effect."""
    return units(spark).select(
        "user_id", F.when(draw("arm") < 0.6, "treatment").otherwise("control").alias("variant"),
        (draw("buy") < 0.13).cast("int").alias("converted"), (F.col("o_custkey") % 3).alias("tier")).cache()


@pytest.fixture(scope="session")
def confounded(spark):
    """Dear orders are treated more often and bring more revenue; treatment itself does nothing."""
    # A trace of the order number keeps any two neighbours from being equally near.
    price = F.col("o_totalprice") / 1000 + F.col("o_orderkey") * 1e-9
    treated = draw("arm") < F.least(F.lit(0.9), 0.15 + price / 500)
    return units(spark).select(
        "user_id", F.when(treated, "treatment").otherwise("control").alias("variant"), price.alias("pre_value"),
        F.round(12 + 0.2 * price + 30 * draw("spend"), 2).alias("revenue")).cache()


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
