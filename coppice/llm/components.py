"""Connected components of an edge table: more than SMALL edges are never gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

#: So many edges are united by one task: rounds of joins cost dozens of stages, however few edges there are.
SMALL = 100_000


def united(edges: DataFrame) -> DataFrame:
    """The stars (u, v) of edges that are all in one partition: union-find, the least node is the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        schema = None
        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(u), root(v)
                up[max(a, b)] = min(a, b)
        if up:
            hung = [x for x in up if root(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(hung, schema.field("u").type), pa.array([root(x) for x in hung], schema.field("v").type)], names=["u", "v"])

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that an edge (a, b) names; root: the least node reachable.

    Each round links larger neighbours to the least one (large star, then small star) until the
    edges are stars; the number of rounds grows with the logarithm of a component's size. Nodes
    with very many edges are pre-aggregated before each shuffle and split by the skew join.
    At most SMALL edges skip the rounds: one task unites them. Nulls are dropped; equal and repeated edges make no difference.
    """
    now = tx.settled(_tidy(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    mark = _mark(now)
    few = mark[0] <= SMALL
    if few and mark[0]:
        now = tx.settled(united(now.coalesce(1)))
    while mark[0] and not few:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = tx.settled(both.groupBy("u").agg(F.min("v").alias("m")))  # settled: the join can then split a node with many edges
        large = _tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        large = tx.settled(large)
        small = tx.settled(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = tx.settled(_tidy(hung.unionByName(small.withColumnRenamed("m", "v"))))
        was, mark = mark, _mark(now)
        if was == mark:
            break
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum: alike for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
