"""Queries on candidates from domain knowledge, relations, individuals and node statistics, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import candidates, hierarchy, metrics, sampling, splits
from ..operators import colony_forest as cf
from ..sources import ontology
from ..sources.tables import table
from . import graphs, numeric

_Q = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


# -- candidates


def q76(s, d):
    known = table(s, d, "part").select(F.lit("AromaticMolecule").alias("concept")).distinct().union(s.createDataFrame([("Halogen",), ("Amine",)], "concept string"))
    out = None
    for name in candidates.SEEDS:
        one = candidates.seed_rules(s, name, known).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _q76_sql():
    rows = [(name, *r) for name in candidates.SEEDS for r in candidates.seed_rows(name)]
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) else _Q(x) for x in r) + ')' for r in rows)}) t(dataset, rank, ref_type, property, operator, value, concept) WHERE concept IS NULL OR concept IN ('AromaticMolecule', 'Halogen', 'Amine')"


Q77_SQL = """WITH t(property, operators, values) AS (VALUES
  ('has_aromatic', ['=='], ['true', 'false']), ('obeys_lipinski', ['=='], ['true', 'false']), ('mw_category', ['=='], ['Low', 'Medium', 'High']),
  ('logp_category', ['=='], ['Hydrophilic', 'Moderate', 'Lipophilic']), ('tpsa_category', ['=='], ['Low', 'Medium', 'High']),
  ('functional_groups', ['contains'], ['Amine', 'Alcohol', 'Carbonyl', 'Carboxyl', 'Ether', 'Ester', 'Amide', 'Halogen', 'Aromatic', 'Sulfur', 'Nitro']),
  ('num_rings', ['==', '>'], [CAST(x AS VARCHAR) FOR x IN range(5)]), ('num_aromatic_rings', ['==', '>'], [CAST(x AS VARCHAR) FOR x IN range(4)]),
  ('num_hba', ['>=', '<='], ['0', '1', '2', '3', '5', '10']), ('num_hbd', ['>=', '<='], ['0', '1', '2', '3', '5']),
  ('num_heavy_atoms', ['>=', '<='], ['5', '10', '15', '20', '30']), ('num_rotatable_bonds', ['>=', '<='], ['0', '2', '5', '10'])),
v AS (SELECT property, operators, unnest(values) AS value FROM t) SELECT property, operator, value FROM (SELECT property, value, unnest(operators) AS operator FROM v)"""


def q78(s, d):
    t = graphs.taxonomy(s, d)
    return candidates.dl_templates(s, hierarchy.closure(t), "R:1").where("ref_type = 'existential'").select("rank", "property", "concept")


def _declared(s, d):
    names = table(s, d, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("property"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("N:"), "n_nationkey")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("R:"), "n_regionkey")).alias("domain"))
    used = table(s, d, "customer").select(F.concat(F.lit("p"), "c_nationkey").alias("property")).where("property in ('p2', 'p5')")
    return names, used


def q79(s, d):
    names, used = _declared(s, d)
    return candidates.applicable(names, used, hierarchy.closure(graphs.taxonomy(s, d)), "N:6")


def q80(s, d):
    t = graphs.taxonomy(s, d)
    asked = t.where("parent like 'N:%'").select(F.lit("lives").alias("property"), F.col("child").alias("concept")).unionByName(t.where("parent = 'Thing'").select(F.lit("free"), F.col("child")).toDF("property", "concept"))
    ranges = s.createDataFrame([("lives", "R:2"), ("lives", "N:1")], "property string, range string")
    return candidates.in_range(asked, ranges, hierarchy.closure(t)).groupBy("property").agg(F.count("*").alias("n"))


def q81(s, d):
    rows = s.createDataFrame(candidates.template_rows(), candidates.CANDIDATE)
    again = rows.withColumn("rank", F.col("rank") + 1000).unionByName(rows)
    return candidates.first_of_each(again, ["ref_type", "property", "operator", "value", "concept"]).groupBy("property").agg(F.count("*").alias("n"), F.max("rank").alias("last"))


def q82(s, d):
    p = table(s, d, "part").withColumn("groups", F.split("p_type", " "))
    tests = [("groups", "contains", "PROMO"), ("p_size", ">=", 25), ("p_retailprice", "<", 1200.0), ("p_brand", "==", "Brand#11"), ("missing", "==", 1)]
    return p.select("p_partkey", *(candidates.feature_predicate(p, *t).alias(f"t{i}") for i, t in enumerate(tests)))


# -- node statistics


def q83(s, d):
    counts = numeric.lines(s, d).groupBy("l_linenumber", F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))
    weights = splits.class_weights(table(s, d, "lineitem").where("l_quantity > 10"), "l_returnflag").select("label", "weight")
    plain = splits.class_shares(counts, ["l_linenumber"]).toDF("l_linenumber", "majority", "purity")
    return plain.join(splits.class_shares(counts, ["l_linenumber"], weights).toDF("l_linenumber", "weighted_majority", "weighted_purity"), "l_linenumber").select("l_linenumber", "majority", F.round("purity", 9).alias("purity"), "weighted_majority", F.round("weighted_purity", 9).alias("weighted_purity"))


Q83_SQL = """WITH n AS (SELECT l_linenumber, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT l_returnflag AS label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
x AS (SELECT *, n * coalesce(weight, 1.0) AS w FROM n LEFT JOIN w USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY n DESC, label) AS a, row_number() OVER (PARTITION BY l_linenumber ORDER BY round(w, 9) DESC, label) AS b FROM x)
SELECT l_linenumber, max(CASE WHEN a = 1 THEN label END) AS majority, round(max(n) / sum(n), 9) AS purity, max(CASE WHEN b = 1 THEN label END) AS weighted_majority, round(max(w) / sum(w), 9) AS weighted_purity FROM r GROUP BY l_linenumber"""


def q84(s, d):
    t = graphs.taxonomy(s, d)
    zone = hierarchy.reach(t.select(F.col("child").alias("src"), F.col("parent").alias("dst")), s.createDataFrame([("R:0",), ("R:1",), ("N:2",)], "start string"), 1)
    return hierarchy.zone_entropy(zone.select(F.col("start").alias("zone"), "node")).select(F.round("entropy", 9).alias("entropy"))


def q85(s, d):
    return splits.imbalance(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), ["quality", "toxic"]).select("target", "n", F.round("positive_percent", 9).alias("positive_percent"))


def q86(s, d):
    nodes = s.createDataFrame([("Mass", "l_quantity"), ("Price", "l_extendedprice"), ("Thing", None), ("Unknown", "no_such")], "node string, feature string")
    out = None
    for strategy in ("median", "mean"):
        one = splits.node_conditions(table(s, d, "lineitem"), nodes, strategy).select("node", "feature", "operator", F.round("threshold", 4).alias("threshold"), F.lit(strategy).alias("strategy"))
        out = one if out is None else out.unionByName(one)
    return out


def q87(s, d):
    tasks = table(s, d, "nation").select(F.col("n_name").alias("dataset"), F.col("n_nationkey").alias("target"))
    return text.ordered_tasks(tasks, ["NATION_7", "NATION_3"]).select("dataset", "target", F.col("place").cast("long").alias("place"))


def q88(s, d):
    df = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    long = splits.unpivot(df.withColumn("y", F.col("n_chars") / (F.col("n_chars") + 2000)), ["n_chars"], "y")
    return numeric._rounded(splits.best_variance_splits(long, 16))


Q88_SQL = f"""WITH long AS (SELECT 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value, n_chars / (n_chars + 2000) AS label FROM documents WHERE n_chars IS NOT NULL),
grid AS (SELECT feature, unnest(list_sort(list_distinct({numeric._grid_sql(16)}))) AS threshold FROM long GROUP BY feature),
g AS (SELECT feature, threshold, row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS j FROM grid),
gains AS (SELECT feature, j, threshold, count(*) FILTER (value <= threshold) AS n_left, count(*) FILTER (value > threshold) AS n_right,
  var_pop(label) - (coalesce(var_pop(label) FILTER (value <= threshold), 0) * count(*) FILTER (value <= threshold) + coalesce(var_pop(label) FILTER (value > threshold), 0) * count(*) FILTER (value > threshold)) / count(*) AS gain FROM g JOIN long USING (feature) GROUP BY ALL),
{numeric._BEST}"""


def _mixed_sql():
    return numeric.split_sql(numeric._long_sql(), "entropy").replace("max(tl) / max(ta)", "max(nl) / max(nn)").replace("max(tr) / max(ta)", "(max(nn) - max(nl)) / max(nn)")


# -- relations, individuals


def described(s, d):
    """Parts that stand for molecules: descriptors and alerts by arithmetic."""
    alerts = ["AlphaAminoAcid", "MichaelAcceptor", "Epoxide", "AromaticAmine", "Nucleoside", "MetalChelator", "Guanidine", "Amidine", "PlanarPAH", "Hydrazine"]
    p = table(s, d, "part")
    chosen = F.array_compact(F.array(*(F.when(F.col("p_partkey") % (i + 3) == 0, F.lit(a)) for i, a in enumerate(alerts))))
    groups = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.lit("Halogen")), F.when(F.col("p_size") % 5 == 0, F.lit("Amide"))))
    return p.select("p_partkey", (F.col("p_retailprice") / 3).alias("molecular_weight"), (F.col("p_size") * 4).alias("tpsa"), (F.col("p_size") % 13).alias("n_plus_o_count"), (F.col("p_partkey") % 7 - 1).alias("logp"), (F.col("p_partkey") % 2).alias("formal_charge"), chosen.alias("structural_alerts"), groups.alias("functional_groups"))


_ALERTS = ["AlphaAminoAcid", "MichaelAcceptor", "Epoxide", "AromaticAmine", "Nucleoside", "MetalChelator", "Guanidine", "Amidine", "PlanarPAH", "Hydrazine"]
_DESCRIBED = "p AS (SELECT p_partkey, p_retailprice / 3 AS mw, p_size * 4 AS tpsa, p_size % 13 AS no, p_partkey % 7 - 1 AS logp, p_partkey % 2 AS charge, list_filter([" + ", ".join(f"CASE WHEN p_partkey % {i + 3} = 0 THEN '{a}' END" for i, a in enumerate(_ALERTS)) + "], lambda x: x IS NOT NULL) AS al, list_filter([CASE WHEN p_size % 2 = 0 THEN 'Halogen' END, CASE WHEN p_size % 5 = 0 THEN 'Amide' END], lambda x: x IS NOT NULL) AS fg FROM part)"


def q89(s, d):
    df = described(s, d)
    out = None
    for name in ("bbbp", "clintox", "hiv", "tox21"):
        new = text.relation_features(df, name)
        added = [c for c in new.columns if c not in df.columns]
        kinds = dict(new.dtypes)
        said = F.concat_ws("|", *(F.array_join(c, ",") if kinds[c].startswith("array") else F.col(c) for c in added))
        one = new.groupBy(F.lit(name).alias("dataset"), said.alias("said")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def _q89_sql():
    has = lambda *names: "list_has_any(al, [" + ", ".join(f"'{x}'" for x in names) + "])"
    join = lambda *pairs: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in pairs) + "], lambda x: x IS NOT NULL)), ',')"
    protease = f"({has('Hydroxyethylamine', 'Acylguanidine', 'Guanidine', 'Amidine')} OR list_contains(fg, 'Amide'))"
    assembly = "(list_contains(fg, 'Halogen') AND logp > 2)"
    none = f"NOT ({has('Nucleoside')} OR {has('MetalChelator')} OR {protease} OR {assembly})"
    said = {
        "bbbp": join(("PgpSubstrate", "no >= 8 AND mw > 400"), ("LAT1_Substrate_Mimic", has("AlphaAminoAcid"))) + " || '|' || " + join(("HighMW_Risk", "mw > 500"), ("HighTPSA_Risk", "tpsa > 120"), ("HighNO_Risk", "no >= 10")),
        "clintox": f"CASE WHEN {has('MichaelAcceptor')} THEN 'EDT_Class_VI' WHEN {has('Epoxide', 'Quinone')} THEN 'EDT_Class_V' WHEN {has('Hydrazine')} THEN 'EDT_Class_IV' WHEN {has('AromaticAmine', 'AromaticNitro')} THEN 'EDT_Class_III' ELSE 'EDT_Class_I' END || '|' || CASE WHEN {has('MichaelAcceptor', 'Epoxide')} THEN 'Cramer_Class_III' WHEN {has('AromaticAmine')} THEN 'Cramer_Class_II' ELSE 'Cramer_Class_I' END || '|' || " + join(*((x, has(x)) for x in ("MichaelAcceptor", "Epoxide", "Hydrazine"))),
        "hiv": join(("Reverse_Transcription", has("Nucleoside")), ("Integration", has("MetalChelator")), ("Maturity", protease), ("Assembly", assembly), ("Replication", none)) + " || '|' || " + join(("RT", f"({has('Nucleoside')} OR {none})"), ("IN", has("MetalChelator")), ("PR", protease)),
        "tox21": join(("MMP_Disruptor", "logp > 3 AND charge > 0"), ("AhR_Ligand", has("PlanarPAH"))),
    }
    return f"WITH {_DESCRIBED} " + " UNION ALL ".join(f"SELECT '{name}' AS dataset, {x} AS said, count(*) AS n FROM p GROUP BY 2" for name, x in said.items())


def q90(s, d):
    df = s.createDataFrame(list(enumerate(graphs.SMILES)), "id int, smiles string")
    return df.select("id", F.array_join(text.notation_groups(F.trim("smiles")), ",").alias("groups"))


def _q90_sql():
    rows = ", ".join(f"({i}, {_Q(x.strip())})" for i, x in enumerate(graphs.SMILES))
    # the same notations as plain substrings, where the strings above have no lookalikes
    has = {"Amide": "contains(x, 'C(=O)N') OR contains(x, 'NC(=O)')", "Aromatic": "regexp_matches(x, '[cno]|s')", "Carbonyl": "contains(x, 'C(=O)') OR contains(x, 'C=O') OR contains(x, 'O=C')", "Carboxyl": "regexp_matches(x, 'C[(]=O[)]O$') OR regexp_matches(x, 'C[(]=O[)]O[).]')", "Halogen": "contains(x, 'F') OR contains(x, 'Cl') OR contains(x, 'Br')", "Sulfonamide": "contains(x, 'S(N)(=O)=O')", "Sulfur": "regexp_matches(x, 'S') OR regexp_matches(x, 's([^a-z]|$)')"}
    return f"WITH t(id, x) AS (VALUES {rows}) SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {_Q(n)} END' for n, c in has.items())}], lambda g: g IS NOT NULL), ',') AS groups FROM t"


def q91(s, d):
    return ontology.individuals(described(s, d), "p_partkey").groupBy(F.regexp_extract("p", "[^#]+$", 0).alias("p"), "literal").agg(F.count("*").alias("n"), F.countDistinct("o").alias("different"), F.sum(F.col("s").cast("long")).alias("key_sum"))


_TRIPLES = f"""{_DESCRIBED}, t AS (
  SELECT p_partkey AS s, 'type' AS p, 'Molecule' AS o, FALSE AS literal FROM p
  UNION ALL SELECT p_partkey, 'hasMolecularWeight', CAST(mw AS VARCHAR), TRUE FROM p UNION ALL SELECT p_partkey, 'hasTPSA', CAST(tpsa AS VARCHAR), TRUE FROM p
  UNION ALL SELECT p_partkey, 'hasNPlusOCount', CAST(no AS VARCHAR), TRUE FROM p UNION ALL SELECT p_partkey, 'hasLogP', CAST(logp AS VARCHAR), TRUE FROM p
  UNION ALL SELECT p_partkey, 'hasFormalCharge', CAST(charge AS VARCHAR), TRUE FROM p
  UNION ALL SELECT DISTINCT p_partkey, 'hasFunctionalGroupRel', g, FALSE FROM (SELECT p_partkey, unnest(list_concat(fg, al)) AS g FROM p))"""


def q92(s, d):
    triples = ontology.individuals(described(s, d), "p_partkey")
    typed = ontology.instances(triples, "Molecule").agg(F.count("*").alias("n")).select(F.lit("instances").alias("what"), "n")
    used = ontology.used_properties(triples).select(F.concat_ws(":", "kind", "property").alias("what"), "n")
    return typed.unionByName(used)


# -- the assembled forest


def q75(s, d):
    """Rules of a colony forest, fitted on training rows: what they say of the split's other side."""
    df = numeric.lines(s, d).select("l_orderkey", "is_r", *numeric.FEATURES).withColumn("y", (F.col("l_quantity") + 200 * F.col("l_discount") > 34).cast("int"))
    rows = sampling.random_split(df, "l_orderkey", 0.25, seed=1)
    forest = cf.fit(rows.where("not is_test"), "l_orderkey", numeric.FEATURES, "y", trees=2, generations=2, ants=3, steps=2)
    out = forest.predict(rows.where("is_test"))
    return numeric._nine(metrics.confusion(out.withColumn("predicted", (F.col("probability") >= forest.threshold).cast("int")), label="y"))


QUERIES = {
    "q75_colony_forest": (q75, None),
    "q76_seed_rules": (q76, _q76_sql()),
    "q77_templates": (lambda s, d: candidates.templates(s).select("property", "operator", "value"), Q77_SQL),
    "q78_dl_templates": (q78, "SELECT CAST(row_number() OVER (ORDER BY concept) - 1 AS INTEGER) AS rank, 'containsFunctionalGroup' AS property, concept FROM (SELECT 'N:' || n_nationkey AS concept FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'C:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)"),
    "q79_applicable_properties": (q79, "WITH p AS (SELECT 'p' || n_nationkey AS property, CASE WHEN n_nationkey % 3 = 0 THEN 'N:' || n_nationkey WHEN n_nationkey % 3 = 1 THEN 'R:' || n_regionkey END AS domain FROM nation) SELECT property FROM p WHERE domain IN ('N:6', 'Thing') OR domain = (SELECT 'R:' || n_regionkey FROM nation WHERE n_nationkey = 6) OR domain IS NULL AND property IN ('p2', 'p5') AND property IN (SELECT 'p' || c_nationkey FROM customer)"),
    "q80_range_check": (q80, "SELECT 'lives' AS property, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 OR n_nationkey = 1 UNION ALL SELECT 'free', count(*) FROM region"),
    "q81_first_of_each": (q81, f"WITH t AS ({Q77_SQL}), n AS (SELECT property, count(*) AS n FROM t GROUP BY property), o(property, i) AS (VALUES " + ", ".join(f"('{p}', {i})" for i, (p, _, _) in enumerate(candidates.TEMPLATES)) + ") SELECT property, n, CAST(sum(n) OVER (ORDER BY i) - 1 AS INTEGER) AS last FROM n JOIN o USING (property)"),
    "q82_feature_predicate": (q82, "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'PROMO') AS t0, p_size >= 25 AS t1, p_retailprice < 1200 AS t2, p_brand = 'Brand#11' AS t3, FALSE AS t4 FROM part"),
    "q83_majority_purity": (q83, Q83_SQL),
    "q84_zone_entropy": (q84, f"WITH RECURSIVE {graphs._TAX}, b AS (SELECT child AS x, parent AS y FROM h UNION SELECT parent, child FROM h), z AS (SELECT x AS zone, y AS node FROM b WHERE x IN ('R:0', 'R:1', 'N:2') UNION SELECT v, v FROM (VALUES ('R:0'), ('R:1'), ('N:2')) t(v)), n AS (SELECT zone, count(DISTINCT node) AS n FROM z GROUP BY zone) SELECT round(sum(-(n / t) * log2(n / t)), 9) AS entropy FROM n, (SELECT sum(n) AS t FROM n)"),
    "q85_imbalance": (q85, "SELECT target, count(*) AS n, round(100.0 * avg(CAST(label = 1 AS INTEGER)), 9) AS positive_percent FROM (SELECT 'quality' AS target, quality AS label FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', toxic FROM documents JOIN labels USING (doc_id)) WHERE label IS NOT NULL GROUP BY target"),
    "q86_node_conditions": (q86, "SELECT 'Mass' AS node, 'l_quantity' AS feature, '<=' AS operator, round(median(l_quantity), 4) AS threshold, 'median' AS strategy FROM lineitem UNION ALL SELECT 'Price', 'l_extendedprice', '<=', round(median(l_extendedprice), 4), 'median' FROM lineitem UNION ALL SELECT 'Mass', 'l_quantity', '<=', round(avg(l_quantity), 4), 'mean' FROM lineitem UNION ALL SELECT 'Price', 'l_extendedprice', '<=', round(avg(l_extendedprice), 4), 'mean' FROM lineitem"),
    "q87_task_order": (q87, "SELECT n_name AS dataset, n_nationkey AS target, dense_rank() OVER (ORDER BY CASE n_name WHEN 'NATION_7' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 3 END, n_name) AS place FROM nation"),
    "q88_variance_small_labels": (q88, Q88_SQL),
    "q89_relation_features": (q89, _q89_sql()),
    "q90_notation_groups": (q90, _q90_sql()),
    "q91_individuals": (q91, f"WITH {_TRIPLES} SELECT p, literal, count(*) AS n, count(DISTINCT o) AS different, CAST(sum(s) AS BIGINT) AS key_sum FROM t GROUP BY p, literal"),
    "q92_enumeration": (q92, f"WITH {_TRIPLES} SELECT 'instances' AS what, count(DISTINCT s) AS n FROM t WHERE p = 'type' UNION ALL SELECT CASE WHEN literal THEN 'data:' ELSE 'object:' END || p, count(*) FROM t WHERE p <> 'type' GROUP BY p, literal"),
    "q93_mixed_weights": (lambda s, d: numeric._rounded(splits.best_splits(numeric.long(s, d), "entropy", "mixed")), _mixed_sql()),
}
