"""Writers: rules in four formats, run results with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_text(conditions="conditions", prediction="prediction") -> F.Column:
    """IF [feature op threshold] AND ... THEN predict=value."""
    parts = F.transform(F.col(conditions), lambda c: F.format_string("[%s %s %.4f]", c["feature"], c["operator"], c["threshold"]))
    return F.concat(F.lit("IF "), F.when(F.size(conditions) > 0, F.array_join(parts, " AND ")).otherwise("TRUE"), F.lit(" THEN predict="), F.col(prediction).cast("string"))


def export_rules(rules: DataFrame, path: str, kind: str = "json", top_k: int | None = None) -> None:
    """Writes rules, best fitness first; top_k is a report's length."""
    ranked = rules if top_k is None else rules.orderBy(F.desc("fitness"), "rule_id").limit(top_k)
    if kind == "json":
        ranked.write.mode("overwrite").json(path)
    elif kind == "csv":
        ranked.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in ranked.dtypes)).write.mode("overwrite").csv(path, header=True)
    elif kind in ("md", "txt"):
        line = F.concat(F.lit("- " if kind == "md" else ""), rule_text())
        ranked.orderBy(F.desc("fitness"), "rule_id").select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks that have no result yet; keys should hold a hash of the parameters, too."""
    return tasks.join(done.select(*keys), keys, "left_anti")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def triples_of(edges: DataFrame) -> DataFrame:
    """Edges as lines of N-Triples."""
    return edges.select(F.format_string("<%s> <%s> <%s> .", "src", "predicate", "dst").alias("value"))
