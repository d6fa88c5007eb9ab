"""Merged sketches of loads against the whole table."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairsplit.operators.profile_store import merged_profile, sketch_load
from fairsplit.plans.storage import materialize


def test_loads_merge_to_the_whole(spark):
    rows = spark.range(6_000).select(
        (F.col("id") * 7 % 5000).alias("k"), F.when(F.col("id") % 4 != 0, F.col("id") / 3).alias("x"),
        F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5)).alias("gap"),
        F.concat(F.lit("s"), F.col("id") % 700).alias("s"), F.lit(None).cast("double").alias("never"))
    # Loads of unlike size, one of them empty.
    loads = [rows.where("k < 400"), rows.where("k >= 400"), rows.limit(0)]
    stored = materialize(reduce(DataFrame.unionByName, [sketch_load(d, f"load {i}") for i, d in enumerate(loads)]), "sketches")
    assert stored.count() == 15
    got = {r["column"]: r for r in merged_profile(stored).collect()}
    frame = rows.toPandas()
    for name, r in got.items():
        values = frame[name].dropna()
        assert (r.n_rows, r.filled) == (6_000, len(values)) and r.missing_frac == pytest.approx(1 - len(values) / 6_000)
        assert r.approx_distinct == pytest.approx(values.nunique(), rel=0.06)
        if name in ("k", "x"):
            assert (r.low, r.high) == (values.min(), values.max())
            for q, share in zip(r.quartiles, (0.25, 0.5, 0.75)):
                assert (values <= q).mean() == pytest.approx(share, abs=0.03)
    assert got["s"].low is None and got["s"].quartiles is None
    assert got["never"].filled == 0 and got["never"].quartiles is None and got["never"].approx_distinct == 0
