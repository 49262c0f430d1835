"""Best-split search: quantile thresholds, label counts by prefix sums, gains for all features at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.impurity import EPSILON, entropy, gini, share
from ..sources.shared import settled
from .running import bucket_of, running_sums

#: Thresholds of a feature, unless another number is asked for.
MOST = 64
#: At most so many thresholds are broadcast.
SMALL_GRID = 500_000
CRITERIA = ("entropy", "gini", "gain_ratio", "chi_square")


def unpivot(df: DataFrame, features: list[str], label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., label, feature, value), rows without label or value left out."""
    long = df.select(*keep, F.col(label).alias("label"), *(F.col(f).cast("double").alias(f) for f in features)).unpivot([*keep, "label"], features, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("label").isNotNull())


def grid_size(n: int) -> int:
    """Number of thresholds for n rows."""
    return min(MOST, max(16, n // 20))


def fractions(n: int) -> list[float]:
    """n evenly spaced fractions from 0.05 to 0.95."""
    return [0.05 + 0.9 * i / (n - 1) for i in range(n)]


def _n(weight: str | None) -> F.Column:
    return (F.count("*") if weight is None else F.sum(F.col(weight).cast("long"))).alias("n")


def ranked_cells(long: DataFrame, by: tuple[str, ...], weight: str | None) -> DataFrame:
    """by, value, n, last (rows up to the value), next (the value after it) and total of a group's distinct values."""
    cells = long.groupBy(*by, "value").agg(_n(weight))  # equal values meet before they are sorted
    return running_sums(cells, by, "value", ("n",)).withColumnsRenamed({"upto_n": "last", "total_n": "total"})


def packed_grid(grid: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row per group, its thresholds in an array: to be broadcast where the grid has at most SMALL_GRID rows."""
    packed = grid.groupBy(*by).agg(F.array_sort(F.collect_list("threshold")).alias("grid"))
    return F.broadcast(packed) if grid.limit(SMALL_GRID + 1).count() <= SMALL_GRID else packed


def threshold_grid(long: DataFrame, size: int | None = None, by: tuple[str, ...] = ("feature",), approximate: bool = False, weight: str | None = None) -> DataFrame:
    """by, j (0-based) and threshold: distinct quantiles; a row counts weight times.

    The exact ones are interpolated between neighbours in the order of a group's distinct values, which are
    sorted range by range; approximate merges sketches of bounded size instead. It takes no weights.
    """
    if size is None:
        size = grid_size(long.groupBy(*by).agg(_n(weight)).agg(F.max("n")).first()[0] or 0)
    at = fractions(size)
    if approximate:
        if weight is not None:
            raise ValueError("sketches don't take weights")
        values = long.groupBy(*by).agg(F.percentile_approx("value", F.array(*map(F.lit, at)), 10_000).alias("values"))
    else:
        ranked = ranked_cells(long, by, weight)
        # a cell covers the positions from last - n up to, but without, last; the one at last is the next cell's.
        # Few cells cover any: the range of the fractions that may lie in a cell is computed, then each is tested exactly.
        near = lambda p: (F.try_divide(p.cast("double"), F.col("total") - 1) - at[0]) / (at[-1] - at[0]) * (size - 1)
        low = F.greatest(F.lit(0), F.coalesce(F.ceil(near(F.col("last") - F.col("n")) - 1e-6).cast("int"), F.lit(0)))
        high = F.least(F.lit(size - 1), F.coalesce(F.floor(near(F.col("last")) + 1e-6).cast("int"), F.lit(size - 1)))
        some = ranked.withColumns({"low": low, "high": high}).where("low <= high").withColumn("i", F.explode(F.sequence("low", "high")))
        some = some.withColumn("p", F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1) * (F.col("total") - 1))
        some = some.where((F.col("p") >= F.col("last") - F.col("n")) & (F.col("p") < F.col("last")))
        p = F.col("p")
        value = F.when(p <= F.col("last") - 1, F.col("value")).otherwise((F.ceil(p) - p) * F.col("value") + (p - F.floor(p)) * F.col("next"))
        values = some.groupBy(*by).agg(F.collect_set(value).alias("values"))  # at most `size` per group
    return values.select(*by, F.posexplode(F.array_sort(F.array_distinct("values"))).alias("j", "threshold"))


def class_weights(df: DataFrame, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """by, label, n and weight = N / (K * n): balanced weights."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return n.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def side_counts(long: DataFrame, grid: DataFrame, by: tuple[str, ...] = ("feature",), weight: str | None = None, most: int = MOST) -> DataFrame:
    """Per candidate (by, j, threshold) and label: n, and left (value <= threshold).

    A row falls into the bucket of the number of thresholds below its value; buckets are counted in one
    pass, and summed up to each threshold. The grid has at most `most` rows per group.
    """
    packed = packed_grid(grid, by)
    block, bucket = bucket_of("grid", "value", most)
    counted = long.join(packed, list(by)).withColumn("_block", block).groupBy(*by, "label", bucket.alias("bucket")).agg(_n(weight))
    summed = counted.groupBy(*by, "label").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bucket", "n")).alias("buckets"))
    left = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.when(b["bucket"] <= F.col("j"), b["n"]).otherwise(0))
    return grid.join(summed, list(by)).select(*by, "j", "threshold", "label", "n", left.alias("left"))


def gains(sides: DataFrame, criterion: str = "entropy", weighted: bool | str = True, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """by, j, threshold, n_left, n_right and gain of each candidate. weighted: "mixed" weighs the classes inside each side, but the sides by their rows."""
    per = Window.partitionBy(*by, "j")
    classes = F.count("*").over(per)
    total = F.sum("n").over(per)
    rows = sides.withColumn("w", total / (classes * F.col("n")) if weighted else F.lit(1.0))
    rows = rows.withColumns({"l": F.col("left") * F.col("w"), "r": (F.col("n") - F.col("left")) * F.col("w"), "a": F.col("n") * F.col("w")})
    rows = rows.withColumns({"tl": F.sum("l").over(per), "tr": F.sum("r").over(per), "ta": F.sum("a").over(per), "nl": F.sum("left").over(per), "nn": total, "k": classes})
    grouped = rows.groupBy(*by, "j", "threshold")
    measure = gini if criterion == "gini" else entropy
    parts = [F.max("nl").alias("n_left"), F.max("nn").alias("nn")]
    if criterion == "chi_square":
        expected = lambda side: F.col("n") * side / F.col("nn")
        el, er = expected(F.col("nl")), expected(F.col("nn") - F.col("nl"))
        term = lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0)
        chi = F.sum(term(F.col("left"), el) + term(F.col("n") - F.col("left"), er))
        out = grouped.agg(*parts, (chi / (F.max("nn") * F.greatest(F.max("k") - 1, F.lit(1)) + EPSILON)).alias("gain"))
    else:
        left, right, both = (measure(share(F.col(x), F.col(y))) for x, y in (("l", "tl"), ("r", "tr"), ("a", "ta")))
        part_l, part_r = (F.max("nl") / F.max("nn"), 1 - F.max("nl") / F.max("nn")) if weighted == "mixed" else (F.max("tl") / F.max("ta"), F.max("tr") / F.max("ta"))
        gain = both - part_l * left - part_r * right
        out = grouped.agg(*parts, gain.alias("gain"))
        if criterion == "gain_ratio":
            p = F.col("n_left") / F.col("nn")
            info = -p * F.log2(p + EPSILON) - (1 - p) * F.log2(1 - p + EPSILON)
            out = out.withColumn("gain", F.when(info < EPSILON, F.col("gain")).otherwise(F.col("gain") / info))
    return out.withColumn("gain", F.when((F.col("n_left") > 0) & (F.col("n_left") < F.col("nn")), F.col("gain")).otherwise(0.0)).select(*by, "j", "threshold", "n_left", (F.col("nn") - F.col("n_left")).alias("n_right"), "gain")


def best(candidates: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """The candidate of highest gain, the lowest threshold on ties; the middle threshold with gain 0 if none is positive."""
    g = F.round("gain", 9)
    order = Window.partitionBy(*by).orderBy(F.when(g > 0, g).otherwise(0.0).desc(), F.when(g > 0, F.col("threshold")), F.abs(F.col("j") - F.floor((F.max("j").over(Window.partitionBy(*by)) + 1) / 2)))
    top = candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "j")
    return top.withColumn("gain", F.greatest(g, F.lit(0.0)))


def best_splits(long: DataFrame, criterion: str = "entropy", weighted: bool | str = True, by: tuple[str, ...] = ("feature",), size: int | None = None, weight: str | None = None, approximate: bool = False) -> DataFrame:
    """One row per feature: threshold, n_left, n_right, gain. A row counts weight times."""
    grid = settled(threshold_grid(long, size, by, approximate, weight))  # at most `size` rows per group, used twice
    return best(gains(side_counts(long, grid, by, weight, size or MOST), criterion, weighted, by), by)


def best_variance_splits(long: DataFrame, size: int | None = None, by: tuple[str, ...] = ("feature",), digits: int = 9) -> DataFrame:
    """The same for a numeric label: reduction of the population variance. Gains that agree to so many decimals are ties.

    Labels are shifted by their mean before they are squared.
    """
    grid = settled(threshold_grid(long, size, by))  # at most 64 rows per group, used twice
    centre = long.agg(F.avg("label")).first()[0] or 0.0
    packed = packed_grid(grid, by)
    block, bucket = bucket_of("grid", "value", size or MOST)
    y = F.col("label").cast("double") - F.lit(float(centre))
    counted = long.join(packed, list(by)).withColumn("_block", block).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    summed = counted.groupBy(*by).agg(F.collect_list(F.struct("bucket", "n", "s", "q")).alias("buckets"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("double").alias("s"), F.lit(0).cast("double").alias("q"))
    # the few buckets are added in order
    ordered = F.array_sort("buckets")

    def upto(inside):
        return F.aggregate(ordered, zero, lambda a, b: F.struct(*((a[x] + F.when(inside(b["bucket"]), b[x].cast("long" if x == "n" else "double")).otherwise(0)).alias(x) for x in ("n", "s", "q"))))

    rows = grid.join(summed, list(by)).withColumns({"l": upto(lambda b: b <= F.col("j")), "r": upto(lambda b: b > F.col("j")), "t": upto(lambda b: F.lit(True))})
    var = lambda m: F.col(m)["q"] / F.col(m)["n"] - (F.col(m)["s"] / F.col(m)["n"]) * (F.col(m)["s"] / F.col(m)["n"])
    gain = var("t") - (F.col("l.n") * var("l") + F.col("r.n") * var("r")) / F.col("t.n")
    ok = (F.col("l.n") > 0) & (F.col("r.n") > 0)
    return best(rows.select(*by, "j", "threshold", F.col("l.n").alias("n_left"), F.col("r.n").alias("n_right"), F.round(F.when(ok, gain).otherwise(0.0), digits).alias("gain")), by)


def class_shares(counts: DataFrame, by: list[str], weights: DataFrame | None = None, label: str = "label") -> DataFrame:
    """by, majority and purity from rows (by, label, n): the label of most (weighted) rows, the least on ties, and its share. weights: (label, weight); a label without one weighs 1."""
    rows = counts.withColumn("_w", F.col("n").cast("double")) if weights is None else counts.join(weights.select(label, "weight"), label, "left").withColumn("_w", F.col("n") * F.coalesce("weight", F.lit(1.0)))
    top = F.min(F.struct((-F.round("_w", 9)).alias("minus"), F.col(label).alias("label"))).alias("_x")
    return rows.groupBy(*by).agg(top, F.max("_w").alias("_m"), F.sum("_w").alias("_s")).select(*by, F.col("_x.label").alias("majority"), F.coalesce(F.try_divide(F.col("_m"), F.col("_s")), F.lit(0.0)).alias("purity"))


def imbalance(df: DataFrame, targets: list[str], positive: int = 1) -> DataFrame:
    """(target, n, positive_percent) over the rows with a label of each target."""
    long = df.select(*(F.col(t).cast("double").alias(t) for t in targets)).unpivot([], targets, "target", "label").where(F.col("label").isNotNull() & ~F.isnan("label"))
    return long.groupBy("target").agg(F.count("*").alias("n"), (100.0 * F.avg((F.col("label") == positive).cast("double"))).alias("positive_percent"))


def node_conditions(df: DataFrame, nodes: DataFrame, strategy: str = "median") -> DataFrame:
    """(node, feature, operator, threshold) for nodes (node, feature; null for nodes that stand for none): the feature's median or mean. Features without values have no condition."""
    names = [r["feature"] for r in nodes.where("feature is not null").select("feature").distinct().collect() if r["feature"] in df.columns]  # at most the table's width
    if strategy not in ("median", "quartile", "mean"):
        raise ValueError(f"unknown strategy: {strategy}")
    of = F.avg if strategy == "mean" else F.median  # the quartile asked for is the second
    x = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    at = df.agg(*(of(x(c)).alias(c) for c in names)).unpivot([], names, "feature", "threshold") if names else None
    if at is None:
        return nodes.where("false").select("node", "feature", F.lit("<=").alias("operator"), F.lit(0.0).alias("threshold"))
    return nodes.join(at.where("threshold is not null"), "feature").select("node", "feature", F.lit("<=").alias("operator"), "threshold")
