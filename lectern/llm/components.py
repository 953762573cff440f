"""Connected components of an edge table, by randomized contraction.

Each round every node picks, in its closed neighbourhood, the node of least hash (another hash in
each round) and merges into it; a constant share of nodes goes in each round, whatever the shape of
the graph, so chains take a logarithmic number of rounds. Picks are made by min_by, which combines
before the shuffle, so a hub costs no more than its edges. Once at most ``finish`` edges are left (a
checked count) one task ends the job by union-find.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
        a, b = top(u), top(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": list(up), "rep": [top(x) for x in up]}, dtype="int64")


def components(edges: DataFrame, tables: Tables, name: str, finish: int = 20_000) -> DataFrame:
    """(node, comp): a row for each node of edges (u, v: long); comp is the same for nodes that are linked, a node's id.

    Rows with nulls and loops are left out, repeated rows count once. No edges: no rows.
    """
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left, rounds = tables.keep(pairs, f"{name}-0"), []
    while (n := left.count()) > finish:
        k = len(rounds)
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pick = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), F.col("v").alias("rep"))).alias("m"))
        own = F.struct(F.xxhash64("u", F.lit(k)).alias("h"), F.col("u").alias("rep"))
        rounds.append(tables.keep(pick.select(F.col("u").alias("node"), F.least("m", own)["rep"].alias("rep")), f"{name}-r{k}"))
        a, b = rounds[-1].toDF("u", "a"), rounds[-1].toDF("v", "b")
        left = tables.keep(left.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}-{k + 1}")
    spark = edges.sparkSession
    found = left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_union_find, "node long, rep long") if n else spark.createDataFrame([], "node long, rep long")
    for reps in reversed(rounds):
        nxt = found.toDF("rep", "to")
        found = reps.join(nxt, "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
    return found.select("node", F.col("rep").alias("comp"))
