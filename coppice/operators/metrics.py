"""Model metrics as single aggregations, by group or over grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sums


def _ratio(a, b) -> F.Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_columns(label: str = "label", predicted: str = "predicted") -> list[F.Column]:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return [count(y & p).alias("tp"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"), count(~y & ~p).alias("tn")]


def with_rates(df: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 and balanced_accuracy to tp, fp, fn, tn."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return df.withColumns({"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall), "balanced_accuracy": (recall + _ratio(tn, tn + fp)) / 2})


def confusion(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", predicted: str = "predicted") -> DataFrame:
    return with_rates(df.where(F.col(label).isNotNull()).groupBy(*by).agg(*confusion_columns(label, predicted)))


def by_score(df: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score, highest first: positives and negatives there (p, n), from there up (tp, fp), and in all (all_p, all_n). Scores are counted before they are ordered, range by range; rows without a score are left out."""
    counted = df.where(F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    counted = counted.where("score is not null").withColumn("_down", -F.col("score").cast("double"))
    summed = running_sums(counted, by, "_down", ("p", "n")).withColumnsRenamed({"upto_p": "tp", "upto_n": "fp", "total_p": "all_p", "total_n": "all_n"})
    return summed.drop("_down", "next")


def roc_auc(df: DataFrame, by: tuple[str, ...] = (), **columns) -> DataFrame:
    """Area under the ROC curve, ties count half; null if there is one class only."""
    s = by_score(df, by=by, **columns)
    wins = F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") / 2
    return s.groupBy(*by).agg(F.try_divide(F.sum(wins).cast("double"), (F.max("all_p") * F.max("all_n")).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, by: tuple[str, ...] = (), **columns) -> DataFrame:
    s = by_score(df, by=by, **columns)
    step = F.try_divide(F.col("p").cast("double"), F.col("all_p").cast("double")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return s.groupBy(*by).agg(F.sum(step).alias("average_precision"))


def youden(df: DataFrame, by: tuple[str, ...] = (), **columns) -> DataFrame:
    """The score from which on TPR - FPR is highest (the highest such score), and that difference."""
    s = by_score(df, by=by, **columns)
    j = F.round(_ratio(F.col("tp"), F.col("all_p")) - _ratio(F.col("fp"), F.col("all_n")), 9)
    top = F.max(F.struct(j.alias("j"), F.col("score").alias("threshold"))).alias("x")
    return s.groupBy(*by).agg(top).select(*by, F.col("x.threshold").alias("threshold"), F.col("x.j").alias("youden_j"))


def regression(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", predicted: str = "predicted") -> DataFrame:
    """mae, rmse and r2 (0 for a constant target)."""
    e = F.col(label) - F.col(predicted)
    total = F.var_pop(label) * F.count(label)
    out = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_res"), total.alias("_tot"))
    return out.withColumn("r2", F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).otherwise(0.0)).drop("_res", "_tot")


def weighted_f1(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """F1 of each class, weighted by its number of rows."""
    pairs = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    true = pairs.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("said"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), (F.col("support") + F.coalesce("said", F.lit(0))).cast("double")), F.lit(0.0))
    return true.join(said, "c", "left").agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def macro_average(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Mean and population deviation of each value by group and over all (group "ALL")."""
    aggregates = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))]
    return rows.rollup(by).agg(F.count("*").alias("n"), *aggregates, F.grouping(by).alias("_all")).withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def composite(rows: DataFrame) -> DataFrame:
    """Trial score: 0.6 * F1 + 0.3 * balanced accuracy + 0.1 * AUC, averaged over validation tasks."""
    score = 0.6 * F.col("f1") + 0.3 * F.col("balanced_accuracy") + 0.1 * F.coalesce("roc_auc", F.lit(0.5))
    return rows.agg(F.avg("f1").alias("mean_f1"), F.avg("balanced_accuracy").alias("mean_balanced_accuracy"), F.avg("roc_auc").alias("mean_auc"), F.avg(score).alias("composite"))
