"""Candidate predicates over list-valued properties and class hierarchies: generation, validation, evaluation.

Individuals are rows (id, property, value) of a long table, where value names a class, or rows
(id, property, size or number). Predicates are rows (ref_type, property, operator, value, concept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concept_candidates(h: DataFrame, centre: str) -> DataFrame:
    """The direct subclasses of the centre class."""
    return h.where(F.col("parent") == centre).select(F.col("child").alias("concept")).distinct()


def cardinality_candidates(sizes: DataFrame) -> DataFrame:
    """(property, operator, value) "more than": the distinct sizes of each property but the greatest."""
    d = sizes.select("property", F.col("size").cast("long").alias("value")).distinct()
    top = F.max("value").over(Window.partitionBy("property"))
    return d.withColumn("top", top).where("value < top").select("property", F.lit(">").alias("operator"), "value")


def domain_candidates(numbers: DataFrame, most: int = 10) -> DataFrame:
    """(property, operator, value) "at most": the quartiles of the distinct values if there are more than `most`, else all but the greatest."""
    d = numbers.where("value is not null").select("property", F.col("value").cast("double").alias("value")).distinct()
    per = d.groupBy("property").agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("value").alias("top"))
    many = per.where(F.col("n") > most).select("property", F.explode(F.array_distinct("q")).alias("value"))
    few = d.join(per.where(F.col("n") <= most), "property").where("value < top").select("property", "value")
    return many.unionByName(few).select("property", F.lit("<=").alias("operator"), "value")


def qualification_candidates(values: DataFrame, closed: DataFrame, relevant: list[str], k: int = 50) -> DataFrame:
    """(property, concept, rank): observed classes and their ancestors; relevant names first, then by name; k of each property."""
    seen = values.select("property", F.col("value").alias("node")).distinct().join(closed.select("node", "ancestor"), "node").select("property", F.col("ancestor").alias("concept")).distinct()
    name = F.lower("concept")
    hit = F.lit(False)
    for r in relevant:
        hit = hit | F.contains(name, F.lit(r.lower())) | F.contains(F.lit(r.lower()), name)
    rank = F.row_number().over(Window.partitionBy("property").orderBy(F.desc(hit), "concept"))
    return seen.withColumn("rank", rank).where(F.col("rank") <= k)


def conjunction_candidates(concepts: DataFrame, disjoint: DataFrame, k: int = 50) -> DataFrame:
    """Pairs (a, b), a < b, of the first k concepts by name that aren't declared disjoint."""
    first = concepts.select("concept").distinct().orderBy("concept").limit(k)
    pairs = first.toDF("a").join(first.toDF("b"), F.col("a") < F.col("b"))
    apart = disjoint.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(apart, ["a", "b"], "left_anti")


def has_value_of(values: DataFrame, closed: DataFrame, prop: str, concept: str) -> DataFrame:
    """The ids with some value of the property that is the concept or below it."""
    below = closed.where(F.col("ancestor") == concept).select(F.col("node").alias("value"))
    return values.where(F.col("property") == prop).join(below, "value", "left_semi").select("id").distinct()


def satisfies(instances: DataFrame, values: DataFrame, closed: DataFrame, predicates: list[dict]) -> DataFrame:
    """instances with one boolean column p0, p1, ... per predicate. All qualifications share one pass over the values.

    Kinds: concept (column `type`), cardinality (column n_<property>), domain (column of that name), qualification, conjunction (of: list of kinds before).
    """
    wanted = sorted({(p["property"], p["concept"]) for q in predicates for p in q.get("of", [q]) if p["type"] == "qualification"})
    names = {w: f"_q{i}" for i, w in enumerate(wanted)}
    out = instances
    if wanted:
        classes = closed.where(F.col("ancestor").isin([c for _, c in wanted])).groupBy(F.col("node").alias("value")).agg(F.collect_set("ancestor").alias("above"))
        flags = [F.max((F.col("property") == p) & F.array_contains("above", c)).alias(names[p, c]) for p, c in wanted]
        out = out.join(values.join(classes, "value").groupBy("id").agg(*flags), "id", "left")
    concepts = sorted({p["concept"] for q in predicates for p in q.get("of", [q]) if p["type"] == "concept"})
    if concepts:
        kinds = closed.where(F.col("ancestor").isin(concepts)).groupBy(F.col("node").alias("type")).agg(F.collect_set("ancestor").alias("_types"))
        out = out.join(kinds, "type", "left")
    for i, q in enumerate(predicates):
        test = F.lit(True)
        for p in q.get("of", [q]):
            test = test & _test(p, names)
        out = out.withColumn(f"p{i}", test)
    return out.drop("_types", *names.values())


def _test(p: dict, names: dict) -> F.Column:
    if p["type"] == "concept":
        test = F.array_contains("_types", p["concept"])
    elif p["type"] == "qualification":
        test = F.col(names[p["property"], p["concept"]])
    else:
        x, v = F.col(f"n_{p['property']}" if p["type"] == "cardinality" else p["property"]), p["value"]
        test = {">": x > v, "<": x < v, ">=": x >= v, "<=": x <= v, "==": x == v}[p["operator"]]
    return F.coalesce(test, F.lit(False))


def valid(flags: DataFrame, columns: list[str]) -> DataFrame:
    """predicate, n_true, n of the predicates that are true for some rows and false for others: one aggregation for all."""
    sums = flags.agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in columns))
    return sums.unpivot(["n"], columns, "predicate", "n_true").where("n_true > 0 and n_true < n")


def relevance_order(names: DataFrame, relevant: list[str]) -> DataFrame:
    """(name, relevant): relevant ones first, then by name."""
    hit = F.lit(False)
    for r in relevant:
        hit = hit | F.contains(F.lower("name"), F.lit(r.lower())) | F.contains(F.lit(r.lower()), F.lower("name"))
    return names.withColumn("relevant", hit).orderBy(F.desc("relevant"), "name")


def keyword_concepts(names: DataFrame, keywords: dict[str, str], k: int) -> DataFrame:
    """(topic, name, rank): names that contain one of a topic's keywords (a regular expression), the first k by name."""
    every = F.array(*(F.when(F.rlike(F.lower("name"), F.lit(rx)), F.lit(t)) for t, rx in keywords.items()))
    met = names.select("name", F.explode(F.array_compact(every)).alias("topic")).distinct()
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy("name"))).where(F.col("rank") <= k)
