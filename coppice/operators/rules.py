"""Rules (rule_id, tree_id, conditions, prediction, ...): matching, statistics, voting, validation.

A rule set is small and its size is checked: up to MAX_INLINE conditions are compiled into one
projection over the rows, so a table is scanned once, without a join. More rules are matched in
runs of that many, each in a projection of its own over the same scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_INLINE = 400

RULE = "rule_id int, tree_id int, conditions array<struct<feature: string, operator: string, threshold: double, info_gain: double>>, prediction double"
COUNTS = "array<struct<rule_id: int, tree_id: int, prediction: double, coverage: bigint, tp: bigint, fn: bigint, tn: bigint>>"


def rule_table(spark, rules: list[tuple]) -> DataFrame:
    """rules: (rule_id, tree_id, [(feature, operator, threshold[, gain])], prediction)."""
    return spark.createDataFrame([(i, t, [(*c, 0.0)[:4] for c in cs], float(p)) for i, t, cs, p in rules], RULE)


def condition(columns: list[str], feature: str, operator: str, threshold: float) -> F.Column:
    """One comparison; a missing column, null or NaN matches nothing."""
    if feature not in columns:
        return F.lit(False)
    x = F.col(feature).cast("double")
    test = {"<=": x <= threshold, ">": x > threshold, "<": x < threshold, ">=": x >= threshold, "==": x == threshold}[operator]
    return F.coalesce(test & ~F.isnan(x), F.lit(False))


def mask(columns: list[str], conditions) -> F.Column:
    return reduce(lambda a, b: a & b, (condition(columns, c["feature"], c["operator"], c["threshold"]) for c in conditions), F.lit(True))


def _listed(rules: DataFrame) -> list[list]:
    """The rules on the driver, in runs of at most MAX_INLINE conditions."""
    runs, size = [[]], 0
    for r in rules.orderBy("rule_id").collect():
        if size and size + len(r["conditions"]) > MAX_INLINE:
            runs.append([])
            size = 0
        runs[-1].append(r)
        size += max(1, len(r["conditions"]))
    return runs


def matches(df: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., and one row per rule that a row fulfils: rule_id, tree_id, prediction."""
    out = None
    for run in _listed(rules):
        hits = F.array_compact(F.array(*(F.when(mask(df.columns, r["conditions"]), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["tree_id"]).alias("tree_id"), F.lit(r["prediction"]).alias("prediction"))) for r in run)))
        one = df.select(*keep, F.explode(hits).alias("m")).select(*keep, "m.*") if run else df.select(*keep).where("false").withColumns({"rule_id": F.lit(0), "tree_id": F.lit(0), "prediction": F.lit(0.0)})
        out = one if out is None else out.unionByName(one)
    return out


def statistics(df: DataFrame, rules: DataFrame, label: str) -> DataFrame:
    """Per rule: coverage, hits, accuracy, f1 and balanced accuracy of predicting its class where it matches, class counts, fitness; no rows without rules. One scan, no join."""
    y = F.col(label).cast("double")
    out = None
    for run in _listed(rules):
        sums = []
        for r in run:
            m, p = mask(df.columns, r["conditions"]) & y.isNotNull(), r["prediction"]
            n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
            yes = y == p
            sums.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["tree_id"]).alias("tree_id"), F.lit(p).alias("prediction"), n(m).alias("coverage"), n(m & yes).alias("tp"), n(y.isNotNull() & ~m & yes).alias("fn"), n(y.isNotNull() & ~m & ~yes).alias("tn")))
        one = df.agg((F.array(*sums) if sums else F.array().cast(COUNTS)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fn, tn, n = map(F.col, ("tp", "fn", "tn", "coverage"))
    precision, recall = part(tp, n), part(tp, tp + fn)
    out = out.withColumns({"accuracy": precision, "f1": part(2 * precision * recall, precision + recall), "balanced_accuracy": (recall + part(tn, tn + n - tp)) / 2})
    return out.withColumn("fitness", fitness(F.col("f1"), F.col("accuracy"), n))


def fitness(f1, accuracy, coverage) -> F.Column:
    return F.when(f1 > 0, f1).otherwise(0.01 * accuracy) * F.log1p(coverage)


def class_counts(df: DataFrame, rules: DataFrame, label: str) -> DataFrame:
    """rule_id, label and n: the classes among the rows that a rule matches."""
    return matches(df.where(F.col(label).isNotNull()), rules, [label]).groupBy("rule_id", "tree_id", F.col(label).alias("label")).agg(F.count("*").alias("n"))


def first_match(df: DataFrame, rules: DataFrame, default: float) -> DataFrame:
    """df with rule_id and predicted: of the first rule (by rule_id) that matches, else null and the default."""
    out = df.withColumns({"rule_id": F.lit(None).cast("int"), "predicted": F.lit(None).cast("double")})
    for run in _listed(rules):
        pick = F.coalesce(*(F.when(mask(df.columns, r["conditions"]), F.struct(F.lit(r["rule_id"]).alias("i"), F.lit(r["prediction"]).alias("p"))) for r in run), F.lit(None).cast("struct<i: int, p: double>"))
        out = out.withColumn("_m", pick).withColumns({"predicted": F.coalesce("predicted", "_m.p"), "rule_id": F.coalesce("rule_id", "_m.i")}).drop("_m")
    return out.withColumn("predicted", F.coalesce("predicted", F.lit(float(default))))


def leaf_probabilities(df: DataFrame, rules: DataFrame, label: str, weights: dict[float, float] | None = None) -> DataFrame:
    """rule_id, tree_id, proba: class-weighted share of label 1 among the rows that a rule matches (null without rows)."""
    w = F.lit(1.0) if not weights else F.coalesce(F.element_at(F.create_map(*(F.lit(float(x)) for kv in weights.items() for x in kv)), F.col("label").cast("double")), F.lit(1.0))
    counted = class_counts(df, rules, label)
    return counted.groupBy("rule_id", "tree_id").agg(F.try_divide(F.sum(F.when(F.col("label") == 1, F.col("n") * w).otherwise(0.0)), F.sum(F.col("n") * w)).alias("proba"))


def forest_probability(df: DataFrame, rules: DataFrame, leaves: list[tuple[int, float]], base_rate: float) -> DataFrame:
    """df with probability (mean over the trees with a matching rule, of the first one of each; else the base rate) and n_trees. leaves: (rule_id, proba)."""
    return _forest(df, rules, dict(leaves), base_rate, None)


def weighted_vote(df: DataFrame, rules: DataFrame, leaves: list[tuple[int, float]], weights: dict[int, float], base_rate: float) -> DataFrame:
    """The same with tree weights, at least 0.01 each (out-of-bag accuracies)."""
    return _forest(df, rules, dict(leaves), base_rate, {t: max(w, 0.01) for t, w in weights.items()})


def _forest(df: DataFrame, rules: DataFrame, proba: dict, base_rate: float, weights: dict | None) -> DataFrame:
    trees: dict[int, list] = {}
    for run in _listed(rules):
        for r in run:
            if proba.get(r["rule_id"]) is not None:
                trees.setdefault(r["tree_id"], []).append(r)
    out, votes = df, []
    for t, members in sorted(trees.items()):
        votes.append(F.struct(F.coalesce(*(F.when(mask(df.columns, r["conditions"]), F.lit(float(proba[r["rule_id"]]))) for r in members), F.lit(None).cast("double")).alias("p"), F.lit(1.0 if weights is None else weights.get(t, 0.01)).alias("w")))
    out = out.withColumn("_v", F.filter(F.array(*votes), lambda v: v["p"].isNotNull()) if votes else F.array().cast("array<struct<p: double, w: double>>"))
    total = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v["w"])
    summed = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v["w"] * v["p"])
    return out.withColumns({"probability": F.coalesce(F.try_divide(summed, total), F.lit(float(base_rate))), "n_trees": F.size("_v")}).drop("_v")


def rule_key() -> F.Column:
    """Conditions at four decimals, sorted, and the prediction: what makes rules the same."""
    return F.concat(F.array_join(F.array_sort(F.transform("conditions", lambda c: F.format_string("%s%s%.4f", c["feature"], c["operator"], c["threshold"]))), "&"), F.lit("=>"), F.col("prediction").cast("string"))


def dedupe(rules: DataFrame) -> DataFrame:
    """Of equal rules the one of highest fitness (least rule_id on ties)."""
    return rules.withColumn("_n", F.row_number().over(Window.partitionBy(rule_key()).orderBy(F.desc("fitness"), "rule_id"))).where("_n = 1").drop("_n")


def importance(rules: DataFrame) -> DataFrame:
    """feature, importance: fitness times gain, summed over conditions, over the number of rules; share: of all features."""
    n = rules.agg(F.count("*").alias("rules"))
    per = rules.select("fitness", F.explode("conditions").alias("c")).groupBy(F.col("c.feature").alias("feature")).agg(F.sum(F.col("fitness") * F.col("c.info_gain")).alias("s"))
    per = per.crossJoin(F.broadcast(n)).select("feature", (F.col("s") / F.col("rules")).alias("importance"))  # one row
    return per.withColumn("share", F.coalesce(F.try_divide(F.col("importance"), F.sum("importance").over(Window.partitionBy())), F.lit(0.0)))


def contradictions(rules: DataFrame) -> DataFrame:
    """rule_id, feature, low, high of conditions that nothing can fulfil: the greatest lower bound is not below the least upper one."""
    c = rules.select("rule_id", F.explode("conditions").alias("c")).select("rule_id", "c.*")
    low = F.max(F.when(F.col("operator").isin(">", ">=", "=="), F.col("threshold")))
    high = F.min(F.when(F.col("operator").isin("<=", "<", "=="), F.col("threshold")))
    strict = F.max(F.when(F.col("operator").isin(">", "<"), 1).otherwise(0)) == 1
    b = c.groupBy("rule_id", "feature").agg(low.alias("low"), high.alias("high"), strict.alias("strict"))
    return b.where((F.col("low") > F.col("high")) | ((F.col("low") == F.col("high")) & F.col("strict"))).drop("strict")


def inheritance_violations(paths: DataFrame, closed: DataFrame) -> DataFrame:
    """rule_id, position, node, next of raw paths (rule_id, raw_path) in which a class is followed by an ancestor of its."""
    steps = paths.select("rule_id", F.posexplode("raw_path").alias("position", "node"))
    pairs = steps.withColumn("next", F.lead("node").over(Window.partitionBy("rule_id").orderBy("position"))).where("next is not null")
    up = closed.where("dist >= 1").select("node", F.col("ancestor").alias("next"))
    return pairs.join(up, ["node", "next"], "left_semi").select("rule_id", "position", "node", "next")


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """metric, first, second, difference of two metric tables (metric, value); a metric that one lacks counts 0."""
    a, b = one.toDF("metric", "first"), two.toDF("metric", "second")
    joined = a.join(b, "metric", "full_outer").select("metric", F.coalesce("first", F.lit(0.0)).alias("first"), F.coalesce("second", F.lit(0.0)).alias("second"))
    return joined.withColumn("difference", F.col("second") - F.col("first"))


def forest_summary(rules: DataFrame) -> DataFrame:
    """One row of counts, means and deviations of a rule set with its statistics."""
    return rules.agg(F.count("*").alias("n_rules"), F.countDistinct("tree_id").alias("n_trees"), F.avg("coverage").alias("coverage_mean"), F.stddev_pop("coverage").alias("coverage_std"), F.avg("fitness").alias("fitness_mean"), F.stddev_pop("fitness").alias("fitness_std"), F.avg(F.size("conditions")).alias("length_mean"))
