"""Sixteen molecular descriptors of a SMILES string, as Column expressions: no Python at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Atomic masses, contributions to logP and to the polar surface, valences.
MASS = {"C": 12.011, "N": 14.007, "O": 15.999, "S": 32.065, "P": 30.974, "F": 18.998, "Cl": 35.453, "Br": 79.904, "I": 126.904, "Si": 28.086, "B": 10.811, "Se": 78.971, "H": 1.008}
LOGP = {"N": -0.7567, "O": -0.3598, "S": 0.6314, "F": 0.4118, "Cl": 0.6895, "Br": 0.8813, "I": 1.05, "P": 0.2836, "H": 0.123}
LOGP_CARBON = {"aromatic": 0.1441, "other": -0.018}
LOGP_AROMATIC_N = -0.3239
TPSA = {"N_aromatic": 12.89, "N_2": 26.02, "N_1": 12.36, "N_0": 3.24, "O_1": 20.23, "O_carbonyl": 17.07, "O_ether": 9.23, "S": 25.3}
VALENCE = {"C": 4, "N": 3, "O": 2, "S": 2, "P": 3, "B": 3, "Si": 4}
HALOGENS = ("F", "Cl", "Br", "I")
DEFAULT_MASS = 12.0

ALLOWED = r"^[CNOSPFIHBcnospb\[\]()=#\-+/\\@%0123456789.lraeKLMgZTdifu]+$"
TOKEN = r"(\[[^\]]*\]|Cl|Br|Si|Se|Na|Li|Ca|Mg|Al|Zn|Cu|Fe|Mn|Co|Ni|Sn|[BCNOSPFI]|[cnospb])"
RING = r"(%\d\d|\d)"


def _lookup(table: dict, key, default: float) -> F.Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def _atoms(s) -> F.Column:
    """Array of (symbol, aromatic, h): h is the number of hydrogens written or, outside brackets, estimated; fixed says which."""
    inside = r"^\[(\d*)([A-Z][a-z]?|[a-z])([^\]]*)\]$"

    def one(t):
        bracket = F.startswith(t, F.lit("["))
        raw = F.when(bracket, F.regexp_extract(t, inside, 2)).otherwise(t)
        aromatic = F.rlike(raw, F.lit("^[a-z]"))
        symbol = F.when(aromatic, F.upper(raw)).otherwise(raw)
        said = F.regexp_extract(F.regexp_extract(t, inside, 3), r"H(\d*)", 1)
        written = F.when(F.contains(F.regexp_extract(t, inside, 3), F.lit("H")), F.coalesce(F.nullif(said, F.lit("")), F.lit("1")).cast("int")).otherwise(0)
        valence = _lookup(VALENCE, symbol, 0).cast("int") - F.when(aromatic, 1).otherwise(0)
        estimated = F.when(symbol.isin(*HALOGENS), 0).otherwise(F.greatest(F.lit(0), valence - 2))
        return F.struct(symbol.alias("symbol"), aromatic.alias("aromatic"), F.when(bracket, written).otherwise(estimated).alias("h"))

    return F.filter(F.transform(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(1)), one), lambda a: a["symbol"] != "")


def _ring_count(s) -> F.Column:
    """Pairs of equal ring numbers outside brackets."""
    digits = F.transform(F.regexp_extract_all(F.regexp_replace(s, r"\[[^\]]*\]", ""), F.lit(RING), F.lit(1)), lambda d: F.regexp_replace(d, "%", "").cast("int"))
    return F.aggregate(F.array_distinct(digits), F.lit(0), lambda n, d: n + F.floor(F.size(F.filter(digits, lambda x: x == d)) / 2).cast("int"))


def describe(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df with valid and the descriptors; a string that can't be read is not valid and has nulls."""
    s = F.trim(F.col(smiles))
    ok = F.coalesce((F.length(s) >= 2) & F.rlike(s, F.lit(ALLOWED)) & (F.regexp_count(s, F.lit(r"\[")) == F.regexp_count(s, F.lit(r"\[[^\]]*\]"))), F.lit(False))
    parts = F.transform(F.split(s, r"\."), lambda x, i: F.struct((-F.length(x)).alias("minus"), i.alias("i"), x.alias("x")))
    out = df.withColumn("_s", F.when(ok, F.array_min(parts)["x"])).withColumn("_a", F.when(F.col("_s").isNotNull(), _atoms(F.col("_s"))))
    out = out.withColumn("valid", F.coalesce(F.size("_a") > 0, F.lit(False))).withColumn("_a", F.when(F.col("valid"), F.col("_a"))).withColumn("num_rings", F.when(F.col("valid"), _ring_count(F.col("_s"))))
    total = lambda f: F.aggregate("_a", F.lit(0.0), lambda t, a: t + f(a))
    count = lambda f: F.size(F.filter("_a", f)) if f else F.size("_a")
    logp = lambda a: F.when(a["symbol"] == "C", F.when(a["aromatic"], LOGP_CARBON["aromatic"]).otherwise(LOGP_CARBON["other"])).when((a["symbol"] == "N") & a["aromatic"], LOGP_AROMATIC_N).otherwise(_lookup(LOGP, a["symbol"], 0.0)) + a["h"] * LOGP["H"]
    double = F.contains("_s", F.lit("="))
    nitrogen = lambda a: F.when(a["aromatic"], TPSA["N_aromatic"]).when(a["h"] >= 2, TPSA["N_2"]).when(a["h"] >= 1, TPSA["N_1"]).otherwise(TPSA["N_0"])
    oxygen = lambda a: F.when(a["h"] >= 1, TPSA["O_1"]).when(double, (TPSA["O_carbonyl"] + TPSA["O_ether"]) / 2).otherwise(TPSA["O_ether"])
    surface = lambda a: F.when(a["symbol"] == "N", nitrogen(a)).when(a["symbol"] == "O", oxygen(a)).when(a["symbol"] == "S", TPSA["S"]).otherwise(0.0)
    polar = lambda a: a["symbol"].isin("N", "O")
    heavy = F.length(F.regexp_replace(F.regexp_replace("_s", r"\[[^\]]*\]", "X"), "[^A-Za-z]", ""))
    bonds = heavy - 1 + F.col("num_rings") - F.regexp_count("_s", F.lit("=")) - F.regexp_count("_s", F.lit("#")) - 2 * F.col("num_rings") - 1
    aromatic = count(lambda a: a["aromatic"])
    carbons = count(lambda a: a["symbol"] == "C")
    out = out.withColumns(
        {
            "molecular_weight": total(lambda a: _lookup(MASS, a["symbol"], DEFAULT_MASS) + a["h"] * MASS["H"]),
            "logp": total(logp),
            "tpsa": total(surface),
            "num_hbd": F.aggregate(F.filter("_a", polar), F.lit(0), lambda t, a: t + a["h"]),
            "num_hba": count(polar),
            "num_rotatable_bonds": F.when(F.col("valid"), F.greatest(F.lit(0), bonds)),
            "num_aromatic_rings": F.when(aromatic == 0, 0).when(aromatic > 0, F.greatest(F.lit(1), F.round(aromatic / 5.5).cast("int"))),
            "num_atoms": count(None),
            "num_heavy_atoms": count(lambda a: a["symbol"] != "H"),
            "num_heteroatoms": count(lambda a: ~a["symbol"].isin("C", "H")),
            "num_carbons": carbons,
            "num_nitrogens": count(lambda a: a["symbol"] == "N"),
            "num_oxygens": count(lambda a: a["symbol"] == "O"),
            "fsp3": F.when(F.col("valid"), F.coalesce(F.try_divide(count(lambda a: (a["symbol"] == "C") & ~a["aromatic"]).cast("double"), carbons.cast("double")), F.lit(0.0))),
            "num_halogens": count(lambda a: a["symbol"].isin(*HALOGENS)),
        }
    )
    counts = [c for c in out.columns if c.startswith("num_")]
    return out.withColumns({c: F.when(F.col("valid"), F.col(c).cast("double")) for c in counts}).drop("_s", "_a")


def batch(df: DataFrame, smiles: str = "smiles", min_valid_ratio: float = 0.5) -> DataFrame:
    """The valid rows with their descriptors; an error if fewer than the given share are valid."""
    out = describe(df, smiles)
    share = out.agg(F.avg(F.col("valid").cast("double"))).first()[0]
    if share is not None and share < min_valid_ratio:
        raise ValueError(f"only {share:.0%} of the strings can be read")
    return out.where("valid").drop("valid")


def lipinski() -> F.Column:
    return (F.col("molecular_weight") <= 500) & (F.col("logp") <= 5) & (F.col("num_hbd") <= 5) & (F.col("num_hba") <= 10)
