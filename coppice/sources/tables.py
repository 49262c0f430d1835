"""Readers: engine tables, labelled datasets, triples, rules and keyed caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE_SCHEMA = "tree_id int, rule_rank int, conditions array<struct<feature: string, operator: string, threshold: double, info_gain: double>>, prediction double, coverage bigint, accuracy double, raw_path array<string>, total_info_gain double, leaf_class_dist map<int, bigint>, f1_score double, balanced_accuracy double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(*parts) -> F.Column:
    """A 32-bit number from the md5 of the parts joined by "|": the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def load_dataset(df: DataFrame, target: str, kind: str = "double", max_samples: int | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """The rows with a label, the label cast; at most max_samples of them, chosen by hash of the key."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r}; there are {df.columns}")
    out = df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).withColumn(target, F.col(target).cast(kind))
    return out if max_samples is None else out.orderBy(hashed(F.col(key), F.lit(seed)), key).limit(max_samples)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def binary_labels(df: DataFrame, column: str) -> DataFrame:
    """-1 and null are missing; 0 and 1 stay; anything else is an error when it is read."""
    x = F.col(column).cast("double")
    value = F.when(x.isNull() | F.isnan(x) | (x == -1), F.lit(None).cast("int")).when(x.isin(0.0, 1.0), x.cast("int")).otherwise(F.raise_error(F.concat(F.lit("label is not binary: "), F.col(column).cast("string"))).cast("int"))
    return df.withColumn(column, value)


#: Suffix -> how to read it.
FORMATS = {"owl": "xml", "rdf": "xml", "xrdf": "xml", "xml": "xml", "ttl": "turtle", "nt": "nt", "ntriples": "nt", "n3": "n3", "jsonld": "json-ld", "json": "json", "parquet": "parquet", "csv": "csv"}

#: The predicates that make edges between classes.
_PREDICATES = {
    "http://www.w3.org/2000/01/rdf-schema#subClassOf": "subClassOf",
    "http://www.w3.org/2002/07/owl#equivalentClass": "equivalentClass",
    "http://www.w3.org/2002/07/owl#disjointWith": "disjointWith",
    "http://www.w3.org/2000/01/rdf-schema#domain": "domain",
    "http://www.w3.org/2000/01/rdf-schema#range": "range",
}
_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def guess_format(path: str) -> str:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown suffix: {path}")
    return FORMATS[suffix]


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, literal) of an N-Triples file, of the classes and object properties of an RDF/XML file, or of a table in these columns (Parquet, JSON, CSV).

    Turtle and N3 files are read as far as they are N-Triples, which is a part of both: a line that isn't is an error, and so is JSON-LD.
    """
    kind = guess_format(path)
    if kind in ("parquet", "json", "csv"):
        schema = "s string, p string, o string, literal boolean"
        return spark.read.parquet(path).select("s", "p", "o", "literal") if kind == "parquet" else spark.read.json(path, schema=schema, mode="FAILFAST") if kind == "json" else read_csv(spark, path, schema)
    if kind == "json-ld":
        raise ValueError(f"JSON-LD isn't read; convert {path} to N-Triples")
    if kind in ("nt", "turtle", "n3"):
        line = F.col("value")
        part = lambda i: F.regexp_extract(line, r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"\S*|(_:\S+))\s*\.\s*$', i)
        either = lambda *i: F.coalesce(*(F.nullif(part(k), F.lit("")) for k in i))
        said = F.trim("value")
        strict = F.lit(kind != "nt") & (said != "") & ~F.startswith(said, F.lit("#")) & (part(3) == "")
        rows = spark.read.text(path).where(~F.when(strict, F.raise_error(F.concat(F.lit("not a triple on a line of its own: "), said)).cast("boolean")).otherwise(False)).select(either(1, 2).alias("s"), part(3).alias("p"), either(4, 6, 5).alias("o"), (part(5) != "").alias("literal"))
        return rows.where(F.col("p") != "")
    out = None
    short = {uri: ("owl:" if "/owl#" in uri else "rdfs:") + name for uri, name in _PREDICATES.items()}
    for tag, links in (("owl:Class", ("subClassOf", "equivalentClass", "disjointWith")), ("owl:ObjectProperty", ("domain", "range"))):
        wanted = [(uri, short[uri]) for uri, name in _PREDICATES.items() if name in links]
        schema = "`_rdf:about` string, `rdfs:label` array<struct<_VALUE: string>>, " + ", ".join(f"`{x}` array<struct<`_rdf:resource`: string>>" for _, x in wanted)
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).where("`_rdf:about` is not null")
        s = F.col("`_rdf:about`").alias("s")
        parts = [rows.select(s, F.explode(f"`{x}`").alias("x")).select("s", F.lit(uri).alias("p"), F.col("x.`_rdf:resource`").alias("o"), F.lit(False).alias("literal")) for uri, x in wanted]
        parts.append(rows.select(s, F.explode("`rdfs:label`").alias("x")).select("s", F.lit(_LABEL).alias("p"), F.col("x._VALUE").alias("o"), F.lit(True).alias("literal")))
        for one in parts:
            one = one.where("o is not null")
            out = one if out is None else out.unionByName(one)
    return out


def short_label(uri) -> F.Column:
    return F.regexp_extract(uri, r"([^#/]+)$", 1)


def graph_of(triples: DataFrame, object_properties: bool = False, default_pheromone: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label, uri) and edges (src, dst, predicate, pheromone, static) of a triple table; a node's id is its label, or the last part of its URI."""
    names = triples.where(F.col("p") == _LABEL).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("label"))
    known = F.create_map(*(F.lit(x) for pair in _PREDICATES.items() for x in pair))
    links = triples.where(~F.col("literal") & ~F.col("p").isin(_LABEL, _TYPE)).withColumn("predicate", F.try_element_at(known, F.col("p")))
    if object_properties:
        links = links.withColumn("predicate", F.coalesce("predicate", short_label(F.col("p"))))
    links = links.where("predicate is not null").select("s", "predicate", "o").distinct()
    uris = links.select(F.col("s").alias("uri")).union(links.select("o")).union(names.select("uri")).distinct()
    nodes = uris.join(names, "uri", "left").select(F.coalesce("label", short_label(F.col("uri"))).alias("node_id"), "label", "uri")
    ids = nodes.select("uri", "node_id")
    edges = links.join(ids.toDF("s", "src"), "s").join(ids.toDF("o", "dst"), "o").where("src != dst")
    return nodes, edges.select("src", "dst", "predicate", F.lit(default_pheromone).alias("pheromone"), F.lit(False).alias("static")).distinct()


def first_triples(edges: DataFrame, n: int) -> DataFrame:
    """At most n hierarchy edges, in order of names: the cap is the feature."""
    return edges.where("predicate = 'subClassOf'").orderBy("src", "dst").limit(n)


def placeholder(spark: SparkSession, pairs: list[tuple[str, str]], allow: bool = False) -> DataFrame:
    """A literal hierarchy in place of a missing file; only if it is asked for."""
    if not allow:
        raise FileNotFoundError("the hierarchy is missing; pass allow=True to use the placeholder")
    return spark.createDataFrame(pairs, "child string, parent string")


def route(config: dict[str, list[str]], dataset: str, override: str | None = None, extra: tuple[str, ...] = ()) -> list[str]:
    """The hierarchies of a dataset: its own or the override, then the extra ones, each once."""
    return list(dict.fromkeys([*([override] if override else config[dataset]), *extra]))


def compose(graphs: list[tuple[str, DataFrame]]) -> DataFrame:
    """The union of edge tables; where two have the same edge the later one's attributes win. Adds source_ontology."""
    every = None
    for i, (name, edges) in enumerate(graphs):
        one = edges.withColumns({"source_ontology": F.lit(name), "_order": F.lit(i)})
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("_order")))).where("_n = 1").drop("_n", "_order")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path, schema=RULE_SCHEMA.replace("map<int,", "map<string,"), mode="FAILFAST")
    return rows.withColumn("leaf_class_dist", F.transform_keys("leaf_class_dist", lambda k, _: k.cast("int")))


def cached(keys: DataFrame, cache: DataFrame, key: str, version: int) -> DataFrame:
    """keys with what the cache has of them, in this version."""
    return keys.join(cache.where(F.col("_version") == version).drop("_version"), key, "left")


def merge_cache(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with new rows in place of the old ones of their keys."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def merged_config(defaults: dict, chosen: dict | None) -> dict:
    """Defaults overlaid by what is set; a value of None is not set, 0 and "" are."""
    out = dict(defaults)
    for k, v in (chosen or {}).items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged_config(out[k], v)
        elif v is not None:
            out[k] = v
    return out
