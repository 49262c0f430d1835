"""Candidate predicates that domain knowledge gives instead of the data: seeds, templates, profiles; and what may be asked of a property.

Candidates are rows (rank, ref_type, property, operator, value, concept); value is a string, so
that numbers, categories and truth values share a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDIDATE = "rank int, ref_type string, property string, operator string, value string, concept string"
GROUP = "hasFunctionalGroupRel"

#: The seed rules of each dataset, in order: a comparison, a functional group, or a class (is).
SEEDS = {
    "bbbp": "hasTPSA < 60.0|hasTPSA < 90.0|hasLogP > 1.0|hasLogP < 4.0|hasLogP > 5.0|hasMolecularWeight > 500.0|hasMolecularWeight > 450.0|hasNumHBD > 3|hasNumHBA > 10|hasNumRotatableBonds > 8|hasNPlusOCount > 5|hasMolarRefractivity > 130.0|hasMolarRefractivity < 40.0|QuaternaryN|is AromaticMolecule",
    "bace": "Amidine|Guanidine|Acylguanidine|Hydroxyethylamine|Iminohydantoin|Amide|Halogen|hasNumAromaticRings > 2|hasNumRings > 3|hasMolecularWeight > 300.0|hasMolecularWeight > 600.0|hasLogP > 2.0|hasTPSA > 100.0|hasNumHBD > 2|Amine",
    "clintox": "MichaelAcceptor|Epoxide|AromaticAmine|AromaticNitro|Quinone|Nitro|Thiophene|Alkylhalide|Hydrazine|Halogen|hasMolecularWeight > 500.0|hasLogP > 5.0|hasNumRotatableBonds > 10|hasTPSA > 140.0|hasNumRings > 4",
    "hiv": "is AromaticMolecule|Imidazole|Amide|Amine|Halogen|MetalChelator|Nucleoside|hasMolecularWeight > 300.0|hasMolecularWeight > 500.0|hasLogP > 2.0|hasLogP > 4.0|hasNumAromaticRings > 2|hasNumHBA > 5|hasTPSA > 90.0|hasNumRings > 3",
    "tox21": "is AromaticMolecule|Nitro|AromaticAmine|MichaelAcceptor|Quinone|Phenol|Imidazole|Triazole|AromaticNitro|Halogen|hasLogP > 3.0|hasTPSA > 80.0|hasMolecularWeight > 400.0|hasNumRings > 3|hasNumHBD > 2",
    "sider": "hasLogP > 4.0|AromaticAmine|Carboxylicacid|MichaelAcceptor|hasTPSA < 90.0|Phenol|Halogen|Sulfonamide|Amine|is AromaticMolecule|hasMolecularWeight > 500.0|hasNPlusOCount > 8|hasMolarRefractivity > 100.0|hasNumAromaticRings > 3|hasNumRotatableBonds > 8",
}
#: Property, operators, values of the templates on descriptors.
TEMPLATES = (
    ("has_aromatic", ("==",), ("true", "false")),
    ("obeys_lipinski", ("==",), ("true", "false")),
    ("mw_category", ("==",), ("Low", "Medium", "High")),
    ("logp_category", ("==",), ("Hydrophilic", "Moderate", "Lipophilic")),
    ("tpsa_category", ("==",), ("Low", "Medium", "High")),
    ("functional_groups", ("contains",), ("Amine", "Alcohol", "Carbonyl", "Carboxyl", "Ether", "Ester", "Amide", "Halogen", "Aromatic", "Sulfur", "Nitro")),
    ("num_rings", ("==", ">"), ("0", "1", "2", "3", "4")),
    ("num_aromatic_rings", ("==", ">"), ("0", "1", "2", "3")),
    ("num_hba", (">=", "<="), ("0", "1", "2", "3", "5", "10")),
    ("num_hbd", (">=", "<="), ("0", "1", "2", "3", "5")),
    ("num_heavy_atoms", (">=", "<="), ("5", "10", "15", "20", "30")),
    ("num_rotatable_bonds", (">=", "<="), ("0", "2", "5", "10")),
)
#: The same on properties of a class hierarchy.
DL_TEMPLATES = (
    ("hasRingCount", (">=", "<="), ("0", "1", "2", "3")),
    ("hasAromaticRingCount", (">=", "<="), ("0", "1", "2")),
    ("hasHBA", (">=", "<="), ("1", "2", "3", "5")),
    ("hasHBD", (">=", "<="), ("0", "1", "2", "3")),
    ("hasRotatableBonds", (">=", "<="), ("2", "5", "10")),
    ("hasNumAtoms", (">=", "<="), ("10", "20", "30")),
    ("hasNumHeavyAtoms", (">=", "<="), ("10", "15", "20")),
    ("hasAromaticRing", ("==",), ("true", "false")),
    ("obeysLipinskiRule", ("==",), ("true", "false")),
)
#: The kinds of candidates under a description-logic profile. The three differ in nothing that is generated here.
KINDS = ("concept", "cardinality", "domain", "qualification", "conjunction")
PROFILES = {"EL": KINDS, "AL": KINDS, "ALC": KINDS}


def seed_rows(dataset: str) -> list[tuple]:
    """The seeds of a dataset; none for one without."""
    out = []
    for rank, rule in enumerate(x for x in SEEDS.get(dataset.strip().lower(), "").split("|") if x):
        parts = rule.split(" ")
        if len(parts) == 3:
            out.append((rank, "domain", *parts, None))
        elif len(parts) == 2:
            out.append((rank, "concept", None, "is_a", None, parts[1]))
        else:
            out.append((rank, "qualification", GROUP, None, None, rule))
    return out


def seed_rules(spark: SparkSession, dataset: str, known: DataFrame | None = None) -> DataFrame:
    """The dataset's seeds; with `known` (concept), those whose concept is in it or that need none."""
    rows = spark.createDataFrame(seed_rows(dataset), CANDIDATE)
    if known is None:
        return rows
    return rows.where("concept is null").unionByName(rows.join(known.select("concept").distinct(), "concept", "left_semi").select(rows.columns))


def template_rows(templates=TEMPLATES) -> list[tuple]:
    return [(i, "value", p, o, v, None) for i, (p, o, v) in enumerate((p, o, v) for p, operators, values in templates for v in values for o in operators)]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), CANDIDATE)


def dl_templates(spark: SparkSession, closed: DataFrame, groups: str = "FunctionalGroup") -> DataFrame:
    """Existential restrictions on every class below `groups`, by name, then the numeric and truth-value templates."""
    below = closed.where((F.col("ancestor") == groups) & (F.col("node") != groups)).select(F.col("node").alias("concept")).distinct()
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("concept")) - 1  # classes of one hierarchy's branch
    some = below.select(rank.alias("rank"), F.lit("existential").alias("ref_type"), F.lit("containsFunctionalGroup").alias("property"), F.lit(None).cast("string").alias("operator"), F.lit(None).cast("string").alias("value"), "concept")
    return some.unionByName(spark.createDataFrame(template_rows(DL_TEMPLATES), CANDIDATE))


def allowed_kinds(profile: str | None) -> tuple[str, ...]:
    """An unknown profile counts as ALC."""
    return PROFILES.get((profile or "ALC").upper(), PROFILES["ALC"])


def of_profile(candidates: DataFrame, profile: str | None) -> DataFrame:
    return candidates.where(F.col("ref_type").isin(*allowed_kinds(profile)))


def first_of_each(candidates: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """Candidates without repetitions: of equal keys (null equals null) the first in order stays."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return candidates.withColumn("_place", place).where("_place = 1").drop("_place")


def feature_predicate(df: DataFrame, feature: str, operator: str, value) -> F.Column:
    """A comparison, or whether a list contains the value; a missing feature or null is false."""
    if feature not in df.columns:
        return F.lit(False)
    x = F.col(feature)
    if operator == "contains":
        test = F.array_contains(x, value)
    else:
        test = {"==": lambda: x == value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value}[operator]()
    return F.coalesce(test, F.lit(False))


def applicable(properties: DataFrame, values: DataFrame, closed: DataFrame, centre: str, allowed: list[str] | None = None) -> DataFrame:
    """Of properties (property, domain; one row per declared domain, null for none) those that may be asked of the centre class.

    A declared domain must be the centre or above it; a property without one must be used by some instance (values: property, ...).
    """
    above = closed.where(F.col("node") == centre).select(F.col("ancestor").alias("domain"))
    fits = properties.join(above, "domain", "left_semi").select("property")
    free = properties.groupBy("property").agg(F.count("domain").alias("n")).where("n = 0").join(values.select("property"), "property", "left_semi").select("property")
    out = fits.union(free).distinct()
    return out.where(F.col("property").isin(allowed)) if allowed else out


def in_range(candidates: DataFrame, ranges: DataFrame, closed: DataFrame) -> DataFrame:
    """Of candidates (property, concept) those whose concept lies in some declared range (property, range) of the property, or whose property declares none."""
    free = candidates.join(ranges.select("property"), "property", "left_anti")
    inside = ranges.join(closed, ranges["range"] == closed["ancestor"]).select("property", F.col("node").alias("concept"))
    return free.unionByName(candidates.join(inside, ["property", "concept"], "left_semi").select(*candidates.columns))


def still_valid(stored: list[dict], rows: DataFrame, evaluate) -> list[dict]:
    """Stored candidates that still split the rows of a node: evaluate(rows, stored) adds p0, p1, ...; one aggregation tests all."""
    from .refinements import valid

    names = [f"p{i}" for i in range(len(stored))]
    if not stored:
        return []
    kept = {r["predicate"] for r in valid(evaluate(rows, stored), names).collect()}  # one row per candidate
    return [x for n, x in zip(names, stored, strict=True) if n in kept]
