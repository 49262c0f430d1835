"""Individuals, classes and properties as triples (s, p, o, literal), and candidate predicates as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import _LABEL, _TYPE, read_csv

_SUB = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
_OWL = "http://www.w3.org/2002/07/owl#"

#: Data properties of an individual: property, descriptor column, range.
PROPERTIES = (
    ("hasMolecularWeight", "molecular_weight", "float"),
    ("hasNumAtoms", "num_atoms", "int"),
    ("hasNumHeavyAtoms", "num_heavy_atoms", "int"),
    ("hasNumRotatableBonds", "num_rotatable_bonds", "int"),
    ("hasNumHBA", "num_hba", "int"),
    ("hasNumHBD", "num_hbd", "int"),
    ("hasNumRings", "num_rings", "int"),
    ("hasNumAromaticRings", "num_aromatic_rings", "int"),
    ("hasAromaticity", "has_aromatic", "bool"),
    ("hasLogP", "logp", "float"),
    ("hasTPSA", "tpsa", "float"),
    ("obeysLipinski", "obeys_lipinski", "bool"),
    ("hasMWCategory", "mw_category", "str"),
    ("hasLogPCategory", "logp_category", "str"),
    ("hasTPSACategory", "tpsa_category", "str"),
    ("hasMolarRefractivity", "molar_refractivity", "float"),
    ("hasNPlusOCount", "n_plus_o_count", "int"),
    ("hasFormalCharge", "formal_charge", "int"),
    ("hasNumHeteroatoms", "num_heteroatoms", "int"),
    ("hasFsp3", "fsp3", "float"),
)
#: List columns whose items become objects of a property.
LISTS = (("functional_groups", "hasFunctionalGroupRel"), ("structural_alerts", "hasFunctionalGroupRel"))
CENTRE = "Molecule"


def schema_table(spark: SparkSession) -> DataFrame:
    """(property, domain, range) of the properties that individuals() writes."""
    rows = [(p, CENTRE, r) for p, _, r in PROPERTIES] + [(p, CENTRE, "FunctionalGroup") for p in dict.fromkeys(p for _, p in LISTS)]
    return spark.createDataFrame(rows, "property string, domain string, range string")


def individuals(df: DataFrame, key: str, label: str | None = None, properties=PROPERTIES, lists=LISTS, centre: str = CENTRE) -> DataFrame:
    """Triples of every row: its type, one for each data property whose column is there and not null, one for each different item of its lists, and its label."""
    s = F.col(key).cast("string")
    there = [(p, c) for p, c, _ in properties if c in df.columns] + ([("hasLabel", label)] if label else [])

    def one(p, o, literal):
        return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"))

    facts = [one(_TYPE, F.lit(centre), False), *(F.when(F.col(c).isNotNull(), one(p, F.col(c).cast("string"), True)) for p, c in there)]
    every = F.array_compact(F.array(*facts))
    for p in dict.fromkeys(p for _, p in lists):
        columns = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c, q in lists if q == p and c in df.columns]
        if columns:
            every = F.concat(every, F.transform(F.array_distinct(F.array_compact(F.concat(*columns))), (lambda p: lambda x: one(p, x, False))(p)))
    return df.where(F.col(key).isNotNull()).select(s.alias("s"), F.inline(every))


def csv_individuals(spark: SparkSession, path: str, schema: str, key: str, label: str | None = None, **options) -> DataFrame:
    """The rows of a CSV file as triples."""
    return individuals(read_csv(spark, path, schema), key, label, **options)


def classes(triples: DataFrame) -> DataFrame:
    """(class): what is declared a class or stands in the subclass relation."""
    declared = triples.where((F.col("p") == _TYPE) & F.col("o").isin(f"{_OWL}Class", "http://www.w3.org/2000/01/rdf-schema#Class")).select("s")
    sub = triples.where(F.col("p") == _SUB)
    return declared.union(sub.select("s")).union(sub.select("o")).toDF("class").distinct()


def instances(triples: DataFrame, cls: str, closed: DataFrame | None = None) -> DataFrame:
    """(s): individuals of a class; with a closure (node, ancestor) those of its subclasses, too."""
    typed = triples.where(F.col("p") == _TYPE)
    if closed is None:
        return typed.where(F.col("o") == cls).select("s").distinct()
    below = closed.where(F.col("ancestor") == cls).select(F.col("node").alias("o"))
    return typed.where(F.col("o") == cls).select("s").union(typed.join(below, "o", "left_semi").select("s")).distinct()


def used_properties(triples: DataFrame) -> DataFrame:
    """(property, kind, n): properties of individuals, object or data, by how often they are used."""
    kind = F.when(F.col("literal"), "data").otherwise("object").alias("kind")
    return triples.where(~F.col("p").isin(_TYPE, _SUB, _LABEL)).groupBy(F.col("p").alias("property"), kind).agg(F.count("*").alias("n"))


REFINEMENT = "ref_type string, property string, operator string, value string, concept string, of array<struct<ref_type: string, property: string, operator: string, value: string, concept: string>>"


def write_refinements(refinements: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Candidates as lines of JSON in REFINEMENT's columns (missing ones are null), each with the metadata."""
    known = [c.split(" ")[0] for c in REFINEMENT.split(", of ")[0].split(", ")] + ["of"]
    more = F.create_map(*(F.lit(str(x)) for kv in (metadata or {}).items() for x in kv)) if metadata else F.lit(None).cast("map<string,string>")
    whole = refinements.sparkSession.createDataFrame([], REFINEMENT).unionByName(refinements.select(*(c for c in refinements.columns if c in known)), allowMissingColumns=True)
    whole.withColumn("metadata", more).write.mode("overwrite").json(path)


def read_refinements(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """What write_refinements() wrote. With `known` (concept): candidates that need a concept which isn't in it are left out."""
    rows = spark.read.json(path, schema=REFINEMENT, mode="FAILFAST")
    if known is None:
        return rows
    needs = F.col("ref_type").isin("concept", "qualification")
    return rows.where(~needs).unionByName(rows.where(needs).join(known.select("concept").distinct(), "concept", "left_semi").select(*rows.columns))
