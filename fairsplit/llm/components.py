"""Connected components of a link table, as DataFrame operations only.

Alternating star contraction: every node's neighbours are tied to its smallest
neighbour, first the larger ones, then the smaller ones, until nothing changes.
Each round is two aggregates with map-side combining and two joins; the links
are written to the shared folder between rounds. Few links (a counted, fixed bound)
lie in one partition and are joined by broadcast, so that a round shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard
from .common import stored

#: So many links at most lie in one partition and have their least neighbours broadcast; more are shuffled.
BROADCAST_LINKS = 250_000


def _large_star(links: DataFrame, few: bool) -> DataFrame:
    # Not a union, which would not keep few links in their one partition.
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = links.select(F.explode(ways).alias("way")).select("way.u", "way.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(_side(least, few), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(_side(least, few), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Links that are repeated are no more than the round began with, and go when their nodes are tied to the smallest.
    both = moved.unionAll(least.select("u", F.col("m").alias("v")))
    return both if few else both.distinct()


def _side(least: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(least) if few else least


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that is not its own component.

    ``links`` holds undirected links between numbers; self-links, repeated links and links with a null
    end change nothing. A node that is the smallest of its component has no row.
    """
    now = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (new.n, new.s) == mark or new.n == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = (new.n, new.s)
        few = new.n <= BROADCAST_LINKS
        one = now.coalesce(1) if few else now
        moved = _small_star(_large_star(one, few), few)
        old, now = now, stored(moved.coalesce(1) if few else moved, "links")
        discard(old)
