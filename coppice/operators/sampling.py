"""Splits and bags by portable hashes: no state, and the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import hashed


def stratified_split(df: DataFrame, key: str, strata: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: of each stratum max(1, floor(n * test)) rows, those of lowest hash."""
    marked = df.withColumn("_hash", hashed(F.col(key), F.lit(seed))).withColumn("_cell", F.shiftright("_hash", 16))
    cells = marked.groupBy(strata, "_cell").agg(F.count("*").alias("_n"))  # at most 65,536 a stratum
    per = Window.partitionBy(strata)
    upto = F.sum("_n").over(per.orderBy("_cell"))
    wanted = F.greatest(F.lit(1), F.floor(F.sum("_n").over(per) * test))
    cells = cells.select(F.col(strata).alias("_stratum"), F.col("_cell").alias("_at"), (wanted - (upto - F.col("_n"))).alias("_left"))
    place = F.row_number().over(Window.partitionBy(strata, "_cell").orderBy("_hash", key))  # a cell is a small part of a stratum
    joined = marked.withColumn("_place", place).join(cells, F.col(strata).eqNullSafe(F.col("_stratum")) & (F.col("_cell") == F.col("_at")))
    return joined.withColumn("is_test", F.col("_place") <= F.col("_left")).select(*df.columns, "is_test")


def random_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test where the hash is below the share: row by row, without a shuffle."""
    return df.withColumn("is_test", hashed(F.col(key), F.lit(seed)) < int(test * 2**32))


def group_split(df: DataFrame, group: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test by the hash of the group: all rows of a group fall on one side."""
    return random_split(df, group, test, seed)


#: Of a Poisson(1) variable: the chances of at most 0, 1, 2, ... 8.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974020]


def multiplicity(key, tree, seed: int) -> F.Column:
    """How often a row is in a tree's bag: Poisson(1), as in bootstraps of large tables, by hash."""
    u = hashed(key, tree, F.lit(seed)) / float(2**32)
    return sum(((u >= p).cast("int") for p in POISSON), F.lit(0))


def bags(df: DataFrame, key: str, trees: int, seed: int = 42) -> DataFrame:
    """(tree_id, key, multiplicity); 0: out of bag."""
    return df.select(key, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id")).withColumn("multiplicity", multiplicity(F.col(key), F.col("tree_id"), seed))


def out_of_bag(bag: DataFrame) -> DataFrame:
    return bag.where("multiplicity = 0").drop("multiplicity")
