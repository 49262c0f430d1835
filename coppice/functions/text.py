"""Scalar functions on strings and categories."""

from __future__ import annotations

from pyspark.sql import functions as F


def words(x) -> F.Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^0-9A-Za-z]+"), lambda w: w != ""))


def fuzzy_ratio(a, b) -> F.Column:
    """100 for equal, 80 for one inside the other, else 100 * Jaccard of the words (case is ignored)."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    jaccard = F.coalesce(F.try_divide(100.0 * F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b))).cast("double")), F.lit(0.0))
    return F.when(x == y, 100.0).when((F.length(x) > 0) & (F.length(y) > 0) & (F.contains(x, y) | F.contains(y, x)), 80.0).otherwise(jaccard)


def category(x, low: float, high: float, names: tuple[str, str, str]) -> F.Column:
    return F.when(x < low, names[0]).when(x < high, names[1]).when(x.isNotNull(), names[2])


def safe_name(x) -> F.Column:
    return F.regexp_replace(F.trim(x), r"[^0-9A-Za-z_]+", "_")


def compact(x, n: int) -> F.Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def rotating_pick(items, selector, k: int) -> F.Column:
    """k items from a list, from position `selector` on, around the end."""
    n = F.size(items)
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(k), n) - 1), lambda i: F.element_at(items, (F.pmod(selector + i, n) + 1).cast("int")))


#: Features up to which they are broadcast to the nodes.
MANY = 10_000


def bridge(features, nodes, synonyms, minimum: int = 3, threshold: float = 60.0, anchor: str = "Thing"):
    """(feature, node, stage): synonym, exact name, substring (labels of `minimum` letters or more), fuzzy, else the anchor. The first stage that fits counts, the best and then least node in it."""
    named = features.join(synonyms, F.lower("feature") == F.lower("synonym"), "left").select("feature", F.coalesce("canonical", "feature").alias("name"), F.col("canonical").isNotNull().alias("known"))
    ratio = fuzzy_ratio(F.col("name"), F.col("node"))
    same = F.lower("name") == F.lower("node")
    inside = (F.length("node") >= minimum) & (F.contains(F.lower("name"), F.lower("node")) | F.contains(F.lower("node"), F.lower("name")))
    stage = F.when(same & F.col("known"), 1).when(same, 2).when(inside, 3).when(ratio >= threshold, 4)
    few = F.broadcast(named) if named.limit(MANY + 1).count() <= MANY else named
    rated = nodes.join(few).withColumns({"stage": stage, "ratio": ratio}).where("stage is not null")  # a stated set of features against all nodes, which stay where they are
    best = rated.groupBy("feature").agg(F.min(F.struct("stage", (-F.col("ratio")).alias("minus"), "node")).alias("x"))
    return features.join(best, "feature", "left").select("feature", F.coalesce("x.node", F.lit(anchor)).alias("node"), F.coalesce("x.stage", F.lit(5)).alias("stage"))


def _any(names: list[str], tests: list) -> F.Column:
    """The names whose tests hold, sorted, each once."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in zip(names, tests, strict=True))))))


def relation_features(df, dataset: str):
    """df with the relation features of a dataset. They read descriptors and lists of groups and alerts (functional_groups, structural_alerts); never a label or a task's outcome.

    A missing column counts as 0 or an empty list. Datasets whose relations come from labels alone have none.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    items = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in df.columns else F.array().cast("array<string>")
    alerts, groups = items("structural_alerts"), items("functional_groups")
    alert = lambda *names: F.arrays_overlap(alerts, F.array(*map(F.lit, names)))
    mass, polar, oxygen_nitrogen, logp = (number(c) for c in ("molecular_weight", "tpsa", "n_plus_o_count", "logp"))
    #: Names, thresholds and groups of each dataset's relations.
    if dataset == "bbbp":
        new = {
            "transporter_substrates": _any(["PgpSubstrate", "LAT1_Substrate_Mimic"], [(oxygen_nitrogen >= 8) & (mass > 400), alert("AlphaAminoAcid")]),
            "physicochemical_risks": _any(["HighMW_Risk", "HighTPSA_Risk", "HighNO_Risk"], [mass > 500, polar > 120, oxygen_nitrogen >= 10]),
        }
    elif dataset == "bace":
        pair = alert("Amidine", "Acylguanidine", "Hydroxyethylamine")
        new = {
            "interacts_residues": _any(["Asp32", "Asp228", "Gly230"], [pair, pair, alert("Guanidine")]),
            "selectivity_class": F.when(alert("PeptideLike") & (mass > 600), "Low_Selectivity_Inhibitor").when(F.size(items("binding_cores")) > 0, "AsparticProtease_Active").otherwise(""),
        }
    elif dataset == "clintox":
        toxic = ["MichaelAcceptor", "Epoxide", "Quinone", "Hydrazine", "StrongElectrophile_Mustard"]
        new = {
            "edt_class": F.when(alert("MichaelAcceptor", "StrongElectrophile_Mustard"), "EDT_Class_VI").when(alert("Epoxide", "Quinone"), "EDT_Class_V").when(alert("Hydrazine"), "EDT_Class_IV").when(alert("AromaticAmine", "AromaticNitro"), "EDT_Class_III").otherwise("EDT_Class_I"),
            "cramer_class": F.when(alert("Alkylhalide", "Acylhalide", "MichaelAcceptor", "Epoxide", "Quinone"), "Cramer_Class_III").when(alert("AromaticAmine"), "Cramer_Class_II").otherwise("Cramer_Class_I"),
            "reactive_toxicophores": _any(toxic, [alert(x) for x in toxic]),
        }
    elif dataset == "hiv":
        protease = alert("Hydroxyethylamine", "Acylguanidine", "Guanidine", "Amidine") | F.array_contains(groups, "Amide")
        tests = {"Reverse_Transcription": alert("Nucleoside"), "Integration": alert("MetalChelator"), "Maturity": protease, "Assembly": F.array_contains(groups, "Halogen") & (logp > 2.0)}
        none = ~(tests["Reverse_Transcription"] | tests["Integration"] | tests["Maturity"] | tests["Assembly"])
        new = {"inhibits_steps": _any([*tests, "Replication"], [*tests.values(), none]), "targets_proteins": _any(["RT", "IN", "PR"], [alert("Nucleoside") | none, alert("MetalChelator"), protease])}
    elif dataset == "tox21":
        new = {"pathway_terms": _any(["MMP_Disruptor", "AhR_Ligand"], [alert("LipophilicCation") | (logp > 3) & (number("formal_charge") > 0), alert("PlanarPAH")])}
    else:
        new = {}
    return df.withColumns(new) if new else df


#: Groups and alerts that show in the notation itself, as regular expressions over a SMILES string.
#: A group written in another way than here isn't found: that needs a chemistry library.
GROUPS = {
    "Halogen": r"F|Cl|Br|I(?!n|r)",
    "Aromatic": r"c|n|o|s(?![a-z])",
    "Sulfur": r"S(?!i|n|e)|s(?![a-z])",
    "Nitro": r"N\(=O\)=O|\[N\+\]\(=O\)\[O-\]|O=N\(=O\)|\[O-\]\[N\+\]\(=O\)",
    "Carbonyl": r"C\(=O\)|C=O|O=C",
    "Carboxyl": r"C\(=O\)O(?:$|[).])|OC\(=O\)(?:$|[.])|C\(O\)=O",
    "Amide": r"C\(=O\)N|NC\(=O\)|NC=O|O=CN",
    "Epoxide": r"C1OC1|C1CO1|O1CC1",
    "Thiophene": r"c1ccsc1|c1cccs1|s1cccc1",
    "Imidazole": r"c1cnc\[nH\]1|c1c\[nH\]cn1|\[nH\]1ccnc1",
    "Triazole": r"c1nnn\[nH\]1|c1cn\[nH\]n1|c1nc\[nH\]n1",
    "StrongElectrophile_Mustard": r"ClCCN|N\(?CCCl",
    "QuaternaryN": r"\[N\+\](?!\(=O\)\[O-\]|\()|\[N\+\]\(C",
    "Sulfonamide": r"S\(=O\)\(=O\)N|NS\(=O\)\(=O\)|S\(N\)\(=O\)=O",
    "Steroid": r"C1CCC2C\(C1\)CCC1C2CCC2CCCCC12",
}


def notation_groups(smiles) -> F.Column:
    """The GROUPS whose notation stands in the string, sorted; null for null."""
    return F.when(smiles.isNotNull(), _any(list(GROUPS), [F.rlike(smiles, F.lit(rx)) for rx in GROUPS.values()]))


def ordered_tasks(tasks, order: list[str]):
    """tasks (dataset, target, ...) with `place`: by the given order of datasets, the others after them by name."""
    from pyspark.sql import Window

    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("dataset")), F.lit(0)), F.lit(len(order) + 1))
    return tasks.withColumn("place", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(rank, "dataset")))  # as many rows as datasets
