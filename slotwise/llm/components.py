"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stored

#: Rounds after which something is wrong; star contraction needs about log(n).
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node in links(a, b), component its smallest reachable node; nodes without links are absent.

    Each round points every node's larger neighbours at its smallest neighbour (large star), then its smaller ones
    (small star), until the links are stars. Minima are partial aggregates, so a hub is no group in any task; every
    round is written to the shared folder, which cuts lineage.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        seen = Observation()  # taken while the round is written
        last, links = links, stored(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
        discard(last)
        state = seen.get
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    hubs = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct().unionByName(hubs)
