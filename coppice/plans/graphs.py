"""Queries on hierarchies, refinements, the colony's graph and scalar functions, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import impurity, smiles, text
from ..operators import colony, hierarchy, metrics, refinements, rules, sampling, splits, trees
from ..sources.shared import settled
from ..sources.tables import binary_labels, graph_of, load_dataset, table
from . import numeric

_TAX = "h(child, parent) AS (SELECT 'R:' || r_regionkey, 'Thing' FROM region UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer)"
_PARTS = "h(child, parent) AS (SELECT DISTINCT 'T:' || p_type, 'Part' FROM part UNION ALL SELECT DISTINCT 'B:' || p_brand, 'Part' FROM part UNION ALL SELECT 'P:' || p_partkey, 'T:' || p_type FROM part UNION ALL SELECT 'P:' || p_partkey, 'B:' || p_brand FROM part)"


def _closed(tax):
    return f"""WITH RECURSIVE {tax},
w(node, ancestor, dist) AS (SELECT n, n, 0 FROM (SELECT child AS n FROM h UNION SELECT parent FROM h) UNION SELECT w.node, h.parent, w.dist + 1 FROM w JOIN h ON h.child = w.ancestor),
c AS (SELECT node, ancestor, min(dist) AS dist, max(dist) AS longest FROM w GROUP BY ALL),
dep AS (SELECT node, max(dist) + CASE WHEN bool_or(ancestor = 'Thing') THEN 0 ELSE 1 END AS depth FROM w GROUP BY node),
ic AS (SELECT ancestor AS node, count(*) AS descendants, -log2(count(*) / (SELECT count(DISTINCT node) FROM c)) AS ic FROM c GROUP BY ancestor),
ti AS (SELECT node, ic * depth / (SELECT max(depth) FROM dep) AS ti FROM dep JOIN ic USING (node))"""


_C, _CP = _closed(_TAX), _closed(_PARTS)


def taxonomy(spark, d):
    up = lambda t, a, pa, b, pb: table(spark, d, t).select(F.concat(F.lit(pa), a).alias("child"), (F.concat(F.lit(pb), b) if pb else F.lit("Thing")).alias("parent"))
    return up("region", "r_regionkey", "R:", None, None).unionByName(up("nation", "n_nationkey", "N:", "n_regionkey", "R:")).unionByName(up("customer", "c_custkey", "C:", "c_nationkey", "N:"))


def parts(spark, d):
    p = table(spark, d, "part")
    t, b = F.concat(F.lit("T:"), "p_type"), F.concat(F.lit("B:"), "p_brand")
    i = F.concat(F.lit("P:"), "p_partkey")
    top = p.select(t.alias("child")).distinct().union(p.select(b).distinct()).withColumn("parent", F.lit("Part"))
    return top.unionByName(p.select(i.alias("child"), t.alias("parent"))).unionByName(p.select(i.alias("child"), b.alias("parent")))


def _pairs(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("a"), F.col("n_nationkey").alias("i"))
    c = table(spark, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("b"), (F.col("c_custkey") % 25).alias("i"))
    return n.join(c, "i").select("a", "b").unionByName(n.select("a", F.col("a").alias("b")))


_PAIRS = "pairs AS (SELECT 'N:' || n_nationkey AS a, 'C:' || c_custkey AS b FROM nation JOIN customer ON c_custkey % 25 = n_nationkey UNION ALL SELECT 'N:' || n_nationkey, 'N:' || n_nationkey FROM nation)"
_LCA = f"{_PAIRS}, l AS (SELECT a, b, ca.ancestor, depth, row_number() OVER (PARTITION BY a, b ORDER BY depth DESC, ca.ancestor) AS pos FROM pairs JOIN c ca ON ca.node = a JOIN c cb ON cb.node = b AND cb.ancestor = ca.ancestor JOIN dep ON dep.node = ca.ancestor), lca AS (SELECT a, b, ancestor AS lca, depth AS lca_depth FROM l WHERE pos = 1)"
_SIMS = f"{_LCA}, sims AS (SELECT a, b, lca, CASE WHEN a = b THEN 1.0::DOUBLE WHEN da.depth + db.depth = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * lca_depth / (da.depth + db.depth) END AS wu_palmer, CASE WHEN a = b THEN 1.0::DOUBLE WHEN ia.ic + ib.ic = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * il.ic / (ia.ic + ib.ic) END AS lin FROM lca JOIN dep da ON da.node = a JOIN dep db ON db.node = b JOIN ic ia ON ia.node = a JOIN ic ib ON ib.node = b JOIN ic il ON il.node = lca)"


def _kit(spark, d, h=taxonomy):
    t = h(spark, d)
    closed = hierarchy.closure(t)
    return t, closed, hierarchy.depths(t), hierarchy.information_content(t, closed)


def _sims(spark, d, what):
    _, c, dep, ic = _kit(spark, d)
    return hierarchy.similarities(_pairs(spark, d), c, dep, ic).select("a", "b", "lca", F.round(what, 9).alias(what))


#: Concepts that stand for each feature.
SETS = [("l_quantity", "N:1"), ("l_quantity", "N:2"), ("l_quantity", "C:1"), ("l_discount", "R:0"), ("l_tax", "Thing"), ("l_tax", "R:1"), ("l_tax", "N:24"), ("l_extendedprice", "unknown")]
_SETS = "sets(set_id, concept) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SETS) + ")"
_ATI = f"{_SETS}, ati AS (SELECT set_id, avg(coalesce(ti, 0.0)) AS ati FROM sets LEFT JOIN ti ON ti.node = concept GROUP BY set_id)"
_SETSIM = """sp AS (SELECT x.set_id, x.concept AS a, y.concept AS b FROM sets x JOIN sets y ON x.set_id = y.set_id AND x.concept < y.concept),
sl AS (SELECT sp.set_id, a, b, max(lc.depth) AS d FROM sp JOIN c ca ON ca.node = a JOIN c cb ON cb.node = b AND cb.ancestor = ca.ancestor JOIN dep lc ON lc.node = ca.ancestor GROUP BY ALL),
ss AS (SELECT sp.set_id, avg(coalesce(CASE WHEN da.depth + db.depth = 0 THEN 0.0 ELSE 2.0::DOUBLE * sl.d / (da.depth + db.depth) END, 0.0)) AS similarity FROM sp LEFT JOIN sl USING (set_id, a, b) LEFT JOIN dep da ON da.node = a LEFT JOIN dep db ON db.node = b GROUP BY sp.set_id),
setsim AS (SELECT set_id, coalesce(similarity, 1.0::DOUBLE) AS similarity FROM (SELECT DISTINCT set_id FROM sets) LEFT JOIN ss USING (set_id))"""


def _set_table(spark):
    return spark.createDataFrame(SETS, "set_id string, concept string")


def _gain_terms(spark, d):
    _, c, dep, ic = _kit(spark, d)
    best = splits.best_splits(numeric.long(spark, d), "entropy")
    ati = hierarchy.average_information(_set_table(spark), hierarchy.taxonomic_information(dep, ic)).withColumnRenamed("set_id", "feature")
    sim = hierarchy.set_similarity(_set_table(spark), c, dep, ic).withColumnRenamed("set_id", "feature")
    return best.join(ati, "feature").join(sim, "feature").withColumn("gain", numeric._eight("gain"))


def _gain_and_ati(spark, d):
    """The terms without the similarity. Depths and sets' information are settled one after the other: the hierarchy is followed twice, not four times, and not while the splits are counted."""
    t = taxonomy(spark, d)
    up = hierarchy.walks(t)
    dep = settled(hierarchy.depths(t, up))
    ic = hierarchy.information_content(t, hierarchy.closure(t, up), dep)
    ati = settled(hierarchy.average_information(_set_table(spark), hierarchy.taxonomic_information(dep, ic))).withColumnRenamed("set_id", "feature")
    return splits.best_splits(numeric.long(spark, d), "entropy").join(ati, "feature").withColumn("gain", numeric._eight("gain"))


def _gain_sql(expr):
    return f"{_C}, {_ATI}, {_SETSIM}, best AS ({numeric.split_sql(numeric._long_sql(), 'entropy')}) SELECT best.feature, threshold, round({expr}, 8) AS score FROM best JOIN ati ON ati.set_id = best.feature JOIN setsim ON setsim.set_id = best.feature"


def _score(column, terms=None):
    return lambda s, d: (terms or _gain_terms)(s, d).select("feature", F.round("threshold", 6).alias("threshold"), numeric._eight(column()).alias("score"))


def _orders_sizes(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("size"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(n, "id", "left").select("id", F.lit("lines").alias("property"), F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def _values(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("part").alias("property"), F.concat(F.lit("P:"), "l_partkey").alias("value"))


def q43(s, d):
    return refinements.cardinality_candidates(_orders_sizes(s, d))


def _numbers(s, d):
    l = table(s, d, "lineitem")
    return l.select(F.lit("l_discount").alias("property"), F.col("l_discount").alias("value")).unionByName(l.select(F.lit("l_linenumber"), F.col("l_linenumber").cast("double")).toDF("property", "value")).unionByName(l.select(F.lit("l_quantity"), "l_quantity").toDF("property", "value"))


_NUMBERS = "x AS (SELECT DISTINCT 'l_discount' AS property, l_discount AS value FROM lineitem UNION SELECT 'l_linenumber', CAST(l_linenumber AS DOUBLE) FROM lineitem UNION SELECT 'l_quantity', l_quantity FROM lineitem), n AS (SELECT property, count(*) AS n, max(value) AS top, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM x GROUP BY property)"


def q45(s, d):
    v = _values(s, d)
    return refinements.qualification_candidates(v, hierarchy.closure(parts(s, d)), ["B:Brand#1", "t:"]).select("property", "concept", F.col("rank").cast("long").alias("rank"))


DISJOINT = [("N:1", "N:2"), ("N:3", "N:10")]


def q46(s, d):
    names = table(s, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("concept"))
    return refinements.conjunction_candidates(names, s.createDataFrame(DISJOINT, "a string, b string"))


PREDICATES = [
    {"type": "qualification", "property": "part", "concept": "T:{t}"},
    {"type": "qualification", "property": "part", "concept": "B:{b}"},
    {"type": "cardinality", "property": "lines", "operator": ">", "value": 4},
    {"type": "domain", "property": "o_totalprice", "operator": "<=", "value": 100000.0},
    {"type": "domain", "property": "o_totalprice", "operator": ">", "value": -1.0},
    {"type": "concept", "concept": "N:3"},
]


def _evaluated(s, d):
    p = table(s, d, "part").agg(F.min("p_type"), F.min("p_brand")).first()  # two names
    predicates = [q | ({"concept": q["concept"].format(t=p[0], b=p[1])} if "concept" in q else {}) for q in PREDICATES]
    predicates.append({"type": "conjunction", "of": [predicates[0], predicates[2]]})
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C:"), "o_custkey").alias("type"), "o_totalprice")
    n = _orders_sizes(s, d).select("id", F.col("size").alias("n_lines"))
    up = hierarchy.closure(parts(s, d)).unionByName(hierarchy.closure(taxonomy(s, d)))
    return refinements.satisfies(orders.join(n, "id"), _values(s, d), up, predicates)


_EVAL = """t AS (SELECT min(p_type) AS ty, min(p_brand) AS br FROM part),
v AS (SELECT l_orderkey AS id, bool_or(p_type = ty) AS a, bool_or(p_brand = br) AS b, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey, t GROUP BY l_orderkey),
e AS (SELECT o_orderkey AS id, coalesce(a, FALSE) AS p0, coalesce(b, FALSE) AS p1, coalesce(n, 0) > 4 AS p2, o_totalprice <= 100000.0 AS p3, o_totalprice > -1.0 AS p4, coalesce(c_nationkey = 3, FALSE) AS p5, coalesce(a, FALSE) AND coalesce(n, 0) > 4 AS p6 FROM orders LEFT JOIN v ON v.id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)"""
_P = [f"p{i}" for i in range(7)]

#: A small graph: edges with pheromones, some in one direction only, one static, two out of bounds.
EDGES = [("R:0", "R:1", "next", 1.0, False), ("R:1", "R:0", "next", 1.5, False), ("R:1", "R:2", "next", 0.2, False), ("R:2", "R:3", "next", 0.05, False), ("R:3", "R:2", "next", 12.0, False), ("R:3", "R:4", "next", 2.0, True), ("R:4", "R:0", "next", 0.7, False)]
PATHS = [(0, ["R:0", "R:1", "R:2"], 0.9, 1.0, 0.5), (1, ["R:1", "R:2", "R:3", "R:4"], 0.6, 0.0, 0.3), (2, ["R:0", "R:3"], 0.3, 1.0, 0.0), (3, ["R:4"], 0.1, 1.0, 0.2)]


def _graph(s):
    return s.createDataFrame(EDGES, "src string, dst string, predicate string, pheromone double, static boolean")


def _found(s):
    return s.createDataFrame(PATHS, "path_id int, nodes array<string>, fitness double, prediction double, f1 double")


def _edges_out(df):
    return df.select("src", "dst", F.round("pheromone", 9).alias("pheromone"))


_EDGES = "e(src, dst, tau, static) AS (VALUES " + ", ".join(f"('{a}', '{b}', {t}::DOUBLE, {str(x).upper()})" for a, b, _, t, x in EDGES) + ")"
_STEPS = "steps(path_id, src, dst, n, fitness, prediction, f1) AS (VALUES " + ", ".join(f"({p[0]}, '{a}', '{b}', {len(p[1])}, {p[2]}::DOUBLE, {p[3]}::DOUBLE, {p[4]}::DOUBLE)" for p in PATHS for x, y in zip(p[1], p[1][1:]) for a, b in ((x, y), (y, x))) + ")"


def _update_sql(amount, keep, evaporated, low, high):
    return f"WITH {_EDGES}, {_STEPS}, s AS (SELECT src, dst, sum({amount}) AS added FROM steps WHERE {keep} GROUP BY ALL) SELECT src, dst, round(CASE WHEN static THEN tau ELSE least(greatest({evaporated} + coalesce(added, 0.0), {low}), {high}) END, 9) AS pheromone FROM e LEFT JOIN s USING (src, dst)"


def q54(s, d):
    c = _graph(s).select("src", "dst", "pheromone", (1.0 + F.length("dst") / 2).alias("eta"), (F.col("dst") == "R:2").alias("used"))
    return colony.transition(c, 1.0, 2.0).select("src", "dst", F.round("probability", 9).alias("probability"))


def q55(s, d):
    t = taxonomy(s, d)
    pairs = s.createDataFrame([("Thing", "C:1"), ("Thing", "N:3"), ("R:0", "N:0"), ("N:1", "R:1"), ("Thing", "Thing"), ("R:1", "C:7"), ("x", "y")], "src string, dst string")
    return hierarchy.jump_penalty(pairs, hierarchy.closure(t), 1.5, 0.8).select("src", "dst", F.round("penalty", 9).alias("penalty"))


def q56(s, d):
    return numeric._nine(colony.interpret(_found(s).select("path_id", "nodes", "fitness"), _graph(s), 3))


SYNONYMS = [("p_size", "BRAND"), ("p_retailprice", "standard")]


def q57(s, d):
    f = s.createDataFrame([(x,) for x in ("p_size", "p_retailprice", "promo anodized", "economy", "zz", "Part")], "feature string")
    nodes = table(s, d, "part").select(F.lower("p_type").alias("node")).distinct()
    return text.bridge(f, nodes, s.createDataFrame(SYNONYMS, "synonym string, canonical string"))


def q58(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat("p_type", F.lit(" "), "p_name").alias("b"), F.col("p_type").alias("c"))
    return p.select("p_partkey", F.round(text.fuzzy_ratio(F.col("a"), F.col("b")), 6).alias("with_type"), F.round(text.fuzzy_ratio(F.col("a"), F.col("c")), 6).alias("type_only"))


def q59(s, d):
    t = taxonomy(s, d)
    nodes = t.select(F.col("child").alias("node")).union(t.select("parent")).distinct()
    g = hierarchy.gates(nodes, ["r:0", "thing", "molecule"])
    zone = hierarchy.reach(t.select(F.col("child").alias("src"), F.col("parent").alias("dst")), g.where("not created").select("node"), 2)
    return zone.groupBy("start", F.col("dist").cast("long").alias("dist")).agg(F.count("*").alias("n"), F.round(F.max(hierarchy.gate_bonus(F.col("dist"), 0.5)), 9).alias("bonus"))


def q60(s, d):
    t = taxonomy(s, d).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    r = hierarchy.reach(t, s.createDataFrame([("N:0",)], "start string"), 2)
    return hierarchy.induced(t, r.select("node")).select("src", "dst")


def q62(s, d):
    df = numeric.lines(s, d)
    train = sampling.random_split(df, "l_orderkey", 0.25).where("not is_test")
    return colony.pocket(df, train, {"p1": ["l_quantity", "l_discount"], "p2": ["l_tax", "l_extendedprice", "l_quantity"]}).groupBy("p1", "p2").agg(F.count("*").alias("n"))


def q64(s, d):
    raw = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, -1).when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise((F.col("o_orderstatus") == "F").cast("int")).alias("label"))
    return binary_labels(raw, "label").groupBy("label").agg(F.count("*").alias("n"))


#: Strings to describe, some of which can't be read.
SMILES = ["CCOc1ccc2nc(S(N)(=O)=O)sc2c1", "CCN1C(=O)NC(c2ccccc2)C1=O", "CC(=O)Oc1ccccc1C(=O)O", "CC12CCC3C(C1CCC2O)CCC4=CC(=O)CCC34C", "c1ccc(cc1)C(=O)O", "CCCCCCCCCCCCCCCC(=O)O", "invalid_smiles_###", "C%10CCCCC%10", "[NH4+].[Cl-]", "[nH]1cccc1", "C", "  CCO  "]


def q65(s, d):
    df = s.createDataFrame(list(enumerate(SMILES)), "id int, smiles string")
    return numeric._nine(smiles.describe(df))


def q66(s, d):
    lines = table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("name"))
    return refinements.keyword_concepts(lines, {"the": "the ", "caps": "!!", "junk": r"\*\*\*"}, 20).select("topic", "name", F.col("rank").cast("long").alias("rank"))


def q67(s, d):
    p = table(s, d, "part").select("p_partkey", F.array(*(F.lit(f"v{i}") for i in range(7))).alias("items"))
    return p.select("p_partkey", F.array_join(text.rotating_pick(F.col("items"), F.col("p_partkey"), 3), ",").alias("picked"))


def q68(s, d):
    """Rules of a colony: fitted on training rows, rated on the rows of the split's other side."""
    df = numeric.lines(s, d).select("l_orderkey", "is_r", *numeric.FEATURES)
    rows = sampling.random_split(df, "l_orderkey", 0.25, seed=1)
    train, test = rows.where("not is_test"), rows.where("is_test")
    found, _ = colony.colony_fit(train, numeric.FEATURES, "is_r", ants=4, generations=2, steps=2)
    return rules.statistics(test, rules.rule_table(s, found), "is_r")


def q69(s, d):
    """A bagged forest: share of each probability among rows that weren't used to fit it."""
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    df = numeric.lines(s, d).withColumn("row_key", key).select("row_key", "is_r", *numeric.FEATURES)
    rows = sampling.random_split(df, "row_key", 0.25, seed=1)
    forest = trees.fit_forest(rows.where("not is_test"), "row_key", numeric.FEATURES, "is_r", trees=2, depth=2)
    out = trees.forest_predict(rows.where("is_test"), forest)
    return out.groupBy(F.round("probability", 6).alias("probability")).agg(F.count("*").alias("n"), F.sum("is_r").alias("positives"))


def q30(s, d):
    paths = s.createDataFrame([(0, ["Thing", "R:0", "N:0"]), (1, ["N:0", "R:0", "C:1"]), (2, ["N:1", "Thing"]), (3, ["R:1"])], "rule_id int, raw_path array<string>")
    return rules.inheritance_violations(paths, hierarchy.closure(taxonomy(s, d)))


def q72(s, d):
    return load_dataset(table(s, d, "labels"), "toxic", "int", 50, "doc_id").select("doc_id", "toxic")


def q73(s, d):
    t = taxonomy(s, d)
    sub = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    triples = t.select(F.concat(F.lit("http://x/"), "child").alias("s"), F.lit(sub).alias("p"), F.concat(F.lit("http://x/"), "parent").alias("o"), F.lit(False).alias("literal"))
    named = table(s, d, "nation").select(F.concat(F.lit("http://x/N:"), "n_nationkey").alias("s"), F.lit(label).alias("p"), F.col("n_name").alias("o"), F.lit(True).alias("literal"))
    _, edges = graph_of(triples.unionByName(named))
    return edges.select("src", "dst", "predicate")


def q74(s, d):
    f = numeric.lines(s, d)
    task = metrics.confusion(f.select(F.col("is_r").alias("label"), (F.col("l_quantity") > 25).cast("int").alias("predicted"), "l_linestatus"), ("l_linestatus",))
    auc = metrics.roc_auc(f.select(F.col("is_r").alias("label"), F.col("l_quantity").alias("score"), "l_linestatus"), ("l_linestatus",))
    return numeric._nine(metrics.composite(task.join(auc, "l_linestatus")))


_NAT = "SELECT 'N:' || n_nationkey AS concept FROM nation"
_WORDS = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^0-9A-Za-z]+'), lambda w: w <> ''))"


def _fuzzy_sql(a, b):
    x, y, u = f"lower(trim({a}))", f"lower(trim({b}))", f"len(list_distinct(list_concat({_WORDS(a)}, {_WORDS(b)})))"
    return f"round(CASE WHEN {x} = {y} THEN 100.0::DOUBLE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 80.0::DOUBLE WHEN {u} = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * len(list_intersect({_WORDS(a)}, {_WORDS(b)})) / {u} END, 6)"


_Q58 = f"SELECT p_partkey, {_fuzzy_sql('p_name', 'b')} AS with_type, {_fuzzy_sql('p_name', 'p_type')} AS type_only FROM (SELECT *, p_type || ' ' || p_name AS b FROM part)"
_Q74 = f"""WITH s AS (SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS label, CAST(l_quantity > 25 AS INTEGER) AS predicted, l_quantity AS score FROM lineitem), {numeric.confusion_sql('l_linestatus')},
c AS (SELECT l_linestatus, score, sum(label) AS p, count(*) - sum(label) AS n FROM s GROUP BY ALL), u AS (SELECT *, sum(p) OVER w AS tp, sum(p) OVER a AS ap, sum(n) OVER a AS an FROM c WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC), a AS (PARTITION BY l_linestatus)),
auc AS (SELECT l_linestatus, sum(n * (tp - p) + n * p / 2) / (max(ap) * max(an)) AS roc_auc FROM u GROUP BY l_linestatus)
SELECT round(avg(f1), 9) AS mean_f1, round(avg(balanced_accuracy), 9) AS mean_balanced_accuracy, round(avg(roc_auc), 9) AS mean_auc, round(avg(0.6::DOUBLE * f1 + 0.3::DOUBLE * balanced_accuracy + 0.1::DOUBLE * roc_auc), 9) AS composite FROM o JOIN auc USING (l_linestatus)"""

_Q57 = f"""WITH f(feature) AS (VALUES ('p_size'), ('p_retailprice'), ('promo anodized'), ('economy'), ('zz'), ('Part')), s(synonym, canonical) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in SYNONYMS)}),
named AS (SELECT feature, coalesce(canonical, feature) AS name, canonical IS NOT NULL AS known FROM f LEFT JOIN s ON lower(feature) = lower(synonym)),
n AS (SELECT DISTINCT lower(p_type) AS node FROM part),
x AS (SELECT *, {_fuzzy_sql('name', 'node')} AS ratio FROM named, n),
y AS (SELECT *, CASE WHEN lower(name) = lower(node) AND known THEN 1 WHEN lower(name) = lower(node) THEN 2 WHEN length(node) >= 3 AND (contains(lower(name), lower(node)) OR contains(lower(node), lower(name))) THEN 3 WHEN ratio >= 60 THEN 4 END AS stage FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY stage, ratio DESC, node) AS pos FROM y WHERE stage IS NOT NULL)
SELECT feature, coalesce(node, 'Thing') AS node, coalesce(stage, 5) AS stage FROM f LEFT JOIN (SELECT * FROM z WHERE pos = 1) USING (feature)"""


def _case(table, key, default):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default}::DOUBLE END"


def _q65_sql():
    """Strings are cut into atoms, one row each, and the descriptors are aggregates over them."""
    t, halogens = smiles.TPSA, ", ".join(f"'{x}'" for x in smiles.HALOGENS)
    logp = f"CASE WHEN symbol = 'C' AND aromatic THEN {smiles.LOGP_CARBON['aromatic']} WHEN symbol = 'C' THEN {smiles.LOGP_CARBON['other']} WHEN symbol = 'N' AND aromatic THEN {smiles.LOGP_AROMATIC_N} ELSE {_case(smiles.LOGP, 'symbol', 0)} END"
    surface = f"""CASE symbol WHEN 'N' THEN CASE WHEN aromatic THEN {t['N_aromatic']} WHEN h >= 2 THEN {t['N_2']} WHEN h = 1 THEN {t['N_1']} ELSE {t['N_0']} END
 WHEN 'O' THEN CASE WHEN h >= 1 THEN {t['O_1']} WHEN contains(s, '=') THEN ({t['O_carbonyl']}::DOUBLE + {t['O_ether']}) / 2 ELSE {t['O_ether']} END WHEN 'S' THEN {t['S']} ELSE 0 END"""
    number = lambda what, name: f"CAST(count(*) FILTER ({what}) AS DOUBLE) AS {name}"
    return rf"""WITH v(id, smiles) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(SMILES))}),
ok AS (SELECT id, string_split(trim(smiles), '.') AS parts FROM v WHERE length(trim(smiles)) >= 2 AND regexp_matches(trim(smiles), '{smiles.ALLOWED}') AND len(regexp_extract_all(trim(smiles), '\[')) = len(regexp_extract_all(trim(smiles), '\[[^\]]*\]'))),
m AS (SELECT id, arg_max(x, length(x) - i / 1000.0) AS s FROM (SELECT id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM ok) GROUP BY id),
tokens AS (SELECT id, s, unnest(regexp_extract_all(s, '{smiles.TOKEN}')) AS token FROM m),
named AS (SELECT id, s, token, token[1] = '[' AS bracket, CASE WHEN bracket THEN regexp_extract(token, '^\[\d*([A-Z][a-z]?|[a-z])', 1) ELSE token END AS raw, regexp_extract(token, '^\[\d*(?:[A-Z][a-z]?|[a-z])([^\]]*)\]$', 1) AS more FROM tokens),
marked AS (SELECT *, raw = lower(raw) AS aromatic, CASE WHEN raw = lower(raw) THEN upper(raw) ELSE raw END AS symbol FROM named WHERE raw <> ''),
atoms AS (SELECT *, CASE WHEN bracket AND contains(more, 'H') THEN CAST(coalesce(nullif(regexp_extract(more, 'H(\d*)', 1), ''), '1') AS INTEGER) WHEN bracket OR symbol IN ({halogens}) THEN 0 ELSE greatest(0, {_case(smiles.VALENCE, 'symbol', 0)} - CAST(aromatic AS INTEGER) - 2) END AS h FROM marked),
digits AS (SELECT id, CAST(replace(unnest(regexp_extract_all(regexp_replace(s, '\[[^\]]*\]', '', 'g'), '{smiles.RING}')), '%', '') AS INTEGER) AS digit FROM m),
rings AS (SELECT id, CAST(sum(n // 2) AS DOUBLE) AS rings FROM (SELECT id, digit, count(*) AS n FROM digits GROUP BY ALL) GROUP BY id),
d AS (SELECT id, any_value(s) AS s, sum({_case(smiles.MASS, 'symbol', smiles.DEFAULT_MASS)} + h * {smiles.MASS['H']}::DOUBLE) AS molecular_weight, sum({logp} + h * {smiles.LOGP['H']}::DOUBLE) AS logp, sum(({surface})::DOUBLE) AS tpsa,
 CAST(coalesce(sum(h) FILTER (symbol IN ('N', 'O')), 0) AS DOUBLE) AS num_hbd, {number("symbol IN ('N', 'O')", 'num_hba')}, count(*) FILTER (aromatic) AS aromatics, CAST(count(*) AS DOUBLE) AS num_atoms, {number("symbol <> 'H'", 'num_heavy_atoms')}, {number("symbol NOT IN ('C', 'H')", 'num_heteroatoms')},
 {number("symbol = 'C'", 'num_carbons')}, {number("symbol = 'N'", 'num_nitrogens')}, {number("symbol = 'O'", 'num_oxygens')}, {number(f"symbol IN ({halogens})", 'num_halogens')}, count(*) FILTER (symbol = 'C' AND NOT aromatic) AS saturated FROM atoms GROUP BY id)
SELECT id, smiles, d.id IS NOT NULL AS valid, CASE WHEN valid THEN coalesce(rings, 0) END AS num_rings, round(molecular_weight, 9) AS molecular_weight, round(logp, 9) AS logp, round(tpsa, 9) AS tpsa, num_hbd, num_hba,
 CASE WHEN valid THEN CAST(greatest(0, length(regexp_replace(regexp_replace(s, '\[[^\]]*\]', 'X', 'g'), '[^A-Za-z]', '', 'g')) - 2 - coalesce(rings, 0) - len(regexp_extract_all(s, '[=#]'))) AS DOUBLE) END AS num_rotatable_bonds,
 CASE WHEN valid THEN CAST(CASE WHEN aromatics > 0 THEN greatest(1, round(aromatics / 5.5)) ELSE 0 END AS DOUBLE) END AS num_aromatic_rings, num_atoms, num_heavy_atoms, num_heteroatoms, num_carbons, num_nitrogens, num_oxygens,
 CASE WHEN valid THEN round(CASE WHEN num_carbons > 0 THEN saturated / num_carbons ELSE 0.0::DOUBLE END, 9) END AS fsp3, num_halogens
FROM v LEFT JOIN d USING (id) LEFT JOIN rings USING (id)"""


QUERIES = {
    "q30_inheritance_order": (q30, "SELECT * FROM (VALUES " + "(1, 0, 'N:0', 'R:0'), (2, 0, 'N:1', 'Thing')" + ") t(rule_id, position, node, next) WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 0 AND n_regionkey = 0) OR rule_id = 2"),
    "q31_closure": (lambda s, d: hierarchy.closure(parts(s, d)), f"{_CP} SELECT node, ancestor, dist, longest FROM c"),
    "q32_depth": (lambda s, d: hierarchy.depths(taxonomy(s, d)), f"{_C} SELECT node, CAST(depth AS INTEGER) AS depth FROM dep"),
    "q33_ic": (lambda s, d: hierarchy.information_content(taxonomy(s, d)).select("node", "descendants", F.round(F.col("ic") + 0.0, 9).alias("ic")), f"{_C} SELECT node, descendants, round(ic + 0.0, 9) AS ic FROM ic"),
    "q34_lca": (lambda s, d: hierarchy.pair_lca(_pairs(s, d), *_kit(s, d)[1:3]), f"{_C}, {_LCA} SELECT a, b, lca, CAST(lca_depth AS INTEGER) AS lca_depth FROM lca"),
    "q35_wu_palmer": (lambda s, d: _sims(s, d, "wu_palmer"), f"{_C}, {_SIMS} SELECT a, b, lca, round(wu_palmer, 9) AS wu_palmer FROM sims"),
    "q36_lin": (lambda s, d: _sims(s, d, "lin"), f"{_C}, {_SIMS} SELECT a, b, lca, round(lin, 9) + 0.0 AS lin FROM sims"),
    "q37_ati": (lambda s, d: numeric._nine(hierarchy.average_information(_set_table(s), hierarchy.taxonomic_information(*_kit(s, d)[2:]))), f"{_C}, {_ATI} SELECT set_id, round(ati, 9) AS ati FROM ati"),
    "q38_set_similarity": (lambda s, d: numeric._nine(hierarchy.set_similarity(_set_table(s), *_kit(s, d)[1:])), f"{_C}, {_SETS}, {_SETSIM} SELECT set_id, round(similarity, 9) AS similarity FROM setsim"),
    "q39_pig_gain": (_score(lambda: impurity.pig(F.col("gain"), F.col("ati")), _gain_and_ati), _gain_sql("gain * (1 + ln(1 + ati))")),
    "q40_semantic_gain": (_score(lambda: impurity.semantic(F.col("gain"), F.col("similarity"), 0.3)), _gain_sql("0.7::DOUBLE * gain + 0.3::DOUBLE * similarity * greatest(gain, 0.001::DOUBLE)")),
    "q41_pig_semantic": (_score(lambda: impurity.pig_semantic(F.col("gain"), F.col("ati"), F.col("similarity"))), _gain_sql("0.7::DOUBLE * (gain * (1 + ln(1 + ati))) + 0.3::DOUBLE * similarity * greatest(gain * (1 + ln(1 + ati)), 0.001::DOUBLE)")),
    "q42_concept_candidates": (lambda s, d: refinements.concept_candidates(taxonomy(s, d), "R:2"), "SELECT 'N:' || n_nationkey AS concept FROM nation WHERE n_regionkey = 2"),
    "q43_cardinality": (q43, "WITH n AS (SELECT count(l_orderkey) AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT DISTINCT 'lines' AS property, '>' AS operator, value FROM n WHERE value < (SELECT max(value) FROM n)"),
    "q44_domain": (lambda s, d: refinements.domain_candidates(_numbers(s, d)), f"WITH {_NUMBERS} SELECT DISTINCT property, '<=' AS operator, unnest(q) AS value FROM n WHERE n > 10 UNION ALL SELECT property, '<=', value FROM x JOIN n USING (property) WHERE n <= 10 AND value < top"),
    "q45_qualification": (q45, f"{_CP}, seen AS (SELECT DISTINCT ancestor AS concept FROM (SELECT DISTINCT 'P:' || l_partkey AS node FROM lineitem) JOIN c USING (node)), r AS (SELECT 'part' AS property, concept, row_number() OVER (ORDER BY (contains(lower(concept), 'b:brand#1') OR contains('b:brand#1', lower(concept)) OR contains(lower(concept), 't:') OR contains('t:', lower(concept))) DESC, concept) AS rank FROM seen) SELECT property, concept, rank FROM r WHERE rank <= 50"),
    "q46_conjunction": (q46, f"WITH n AS (SELECT concept FROM ({_NAT}) ORDER BY concept LIMIT 50) SELECT a.concept AS a, b.concept AS b FROM n a JOIN n b ON a.concept < b.concept WHERE (a.concept, b.concept) NOT IN (('N:1', 'N:2'), ('N:10', 'N:3'))"),
    "q47_validity_filter": (lambda s, d: refinements.valid(_evaluated(s, d), _P), f"WITH {_EVAL}, u AS (SELECT count(*) AS n, {', '.join(f'CAST(sum(CAST({p} AS INTEGER)) AS BIGINT) AS {p}' for p in _P)} FROM e), x AS (UNPIVOT u ON {', '.join(_P)} INTO NAME predicate VALUE n_true) SELECT n, predicate, n_true FROM x WHERE n_true > 0 AND n_true < n"),
    "q48_refinement_eval": (lambda s, d: _evaluated(s, d).groupBy(*_P).agg(F.count("*").alias("n"), F.sum("id").alias("key_sum")), f"WITH {_EVAL} SELECT {', '.join(_P)}, count(*) AS n, CAST(sum(id) AS BIGINT) AS key_sum FROM e GROUP BY ALL"),
    "q51_evaporate_deposit": (lambda s, d: _edges_out(colony.deposit(colony.evaporate(_graph(s), 0.02, 1e-6), _found(s).select("path_id", "nodes", F.col("fitness").alias("amount")))), _update_sql("fitness", "TRUE", "greatest(tau * 0.98::DOUBLE, 1e-6)", "0.0", "1e308")),
    "q52_elite_update": (lambda s, d: _edges_out(colony.elite_update(_graph(s), _found(s), 0.1, 0.5, 0.1, 10.0)), _update_sql("fitness / n * CASE WHEN prediction = 1 AND f1 > 0 THEN 2 ELSE 1 END", "path_id <= 1", "greatest(tau * 0.9::DOUBLE, 0.1::DOUBLE)", "0.1::DOUBLE", "10.0::DOUBLE")),
    "q53_fixed_rule_injection": (lambda s, d: _edges_out(colony.inject(_graph(s), _found(s).select("path_id", "nodes", F.when(F.col("path_id") != 2, F.col("fitness")).alias("fitness")), 10.0)), _update_sql("CASE WHEN path_id = 2 THEN 1.0::DOUBLE ELSE fitness END / n", "TRUE", "tau", "0.0::DOUBLE", "10.0::DOUBLE")),
    "q54_transition_prob": (q54, f"WITH {_EDGES}, w AS (SELECT src, dst, tau * pow((1.0 + length(dst) / 2) * CASE WHEN dst = 'R:2' THEN 0.5 ELSE 1.0 END, 2) AS w FROM e) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS probability FROM w"),
    "q55_jump_penalty": (q55, f"{_C}, p(src, dst) AS (VALUES ('Thing', 'C:1'), ('Thing', 'N:3'), ('R:0', 'N:0'), ('N:1', 'R:1'), ('Thing', 'Thing'), ('R:1', 'C:7'), ('x', 'y')) SELECT p.src, p.dst, round(CASE WHEN dist >= 2 THEN pow(0.8::DOUBLE, 1.5::DOUBLE * (dist - 1)) ELSE 1.0::DOUBLE END, 9) AS penalty FROM p LEFT JOIN c ON c.ancestor = p.src AND c.node = p.dst"),
    "q56_interpret": (q56, f"WITH {_EDGES}, s(path_id, src, dst, fitness) AS (VALUES " + ", ".join(f"({p[0]}, '{a}', '{b}', {p[2]}::DOUBLE)" for p in PATHS for a, b in zip(p[1], p[1][1:])) + ") SELECT path_id, round(max(fitness), 9) AS fitness, round(avg(coalesce(tau, 0.0)), 9) AS mean_pheromone, round(max(coalesce(tau, 0.0)), 9) AS max_pheromone FROM s LEFT JOIN e USING (src, dst) GROUP BY path_id ORDER BY 3 DESC, 2 DESC, 1 LIMIT 3"),
    "q57_feature_bridge": (q57, _Q57),
    "q58_fuzzy_ratio": (q58, _Q58),
    "q59_gates_zone": (q59, f"WITH RECURSIVE {_TAX}, b AS (SELECT child AS x, parent AS y FROM h UNION SELECT parent, child FROM h), z(start, node, dist) AS (SELECT n, n, 0 FROM (VALUES ('R:0'), ('Thing')) v(n) UNION SELECT start, y, dist + 1 FROM z JOIN b ON b.x = z.node WHERE dist < 2), m AS (SELECT start, node, min(dist) AS dist FROM z GROUP BY ALL) SELECT start, CAST(dist AS BIGINT) AS dist, count(*) AS n, round(max(1 + 0.5 * ln(1 + dist)), 9) AS bonus FROM m GROUP BY start, dist"),
    "q60_bfs": (q60, f"WITH RECURSIVE {_TAX}, b AS (SELECT child AS x, parent AS y FROM h UNION SELECT parent, child FROM h), z(node, dist) AS (SELECT 'N:0', 0 UNION SELECT y, dist + 1 FROM z JOIN b ON b.x = z.node WHERE dist < 2) SELECT child AS src, parent AS dst FROM h WHERE child IN (SELECT node FROM z) AND parent IN (SELECT node FROM z)"),
    "q61_clip": (lambda s, d: colony.clip(table(s, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": (0.0, 5000.0)}).withColumn("c_acctbal", F.round("c_acctbal", 6)), "SELECT c_custkey, round(greatest(0.0, least(5000.0, c_acctbal)), 6) AS c_acctbal FROM customer"),
    "q62_pocket": (q62, "WITH m AS (SELECT median(l_quantity) AS q, median(l_discount) AS di, median(l_tax) AS t, median(l_extendedprice) AS e FROM lineitem WHERE " + numeric._H("l_orderkey", "42") + " >= 1073741824), p AS (SELECT CAST((CAST(l_quantity >= q AS INTEGER) + CAST(l_discount >= di AS INTEGER)) / 2 >= 0.5 AS INTEGER) AS p1, CAST((CAST(l_tax >= t AS INTEGER) + CAST(l_extendedprice >= e AS INTEGER) + CAST(l_quantity >= q AS INTEGER)) / 3 >= 0.5 AS INTEGER) AS p2 FROM lineitem, m) SELECT p1, p2, count(*) AS n FROM p GROUP BY ALL"),
    "q63_categories": (lambda s, d: table(s, d, "part").groupBy(text.category(F.col("p_retailprice"), 1200, 1600, ("Low", "Medium", "High")).alias("category")).agg(F.count("*").alias("n")), "SELECT CASE WHEN p_retailprice < 1200 THEN 'Low' WHEN p_retailprice < 1600 THEN 'Medium' ELSE 'High' END AS category, count(*) AS n FROM part GROUP BY 1"),
    "q64_label_normalise": (q64, "SELECT CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderstatus = 'F' AS INTEGER) END AS label, count(*) AS n FROM orders GROUP BY 1"),
    "q65_smiles_descriptors": (q65, _q65_sql()),
    "q66_concept_keywords": (q66, "WITH n AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS name FROM documents), t(topic, rx) AS (VALUES ('the', 'the '), ('caps', '!!'), ('junk', '\\*\\*\\*')), r AS (SELECT topic, name, row_number() OVER (PARTITION BY topic ORDER BY name) AS rank FROM n JOIN t ON regexp_matches(lower(name), rx)) SELECT topic, name, rank FROM r WHERE rank <= 20"),
    "q67_rotating_pick": (q67, "SELECT p_partkey, 'v' || (p_partkey % 7) || ',v' || ((p_partkey + 1) % 7) || ',v' || ((p_partkey + 2) % 7) AS picked FROM part"),
    "q68_colony_fit": (q68, None),
    "q69_bagged_forest": (q69, None),
    "q72_row_cap": (q72, f"SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL ORDER BY {numeric._H('doc_id', '42')}, doc_id LIMIT 50"),
    "q73_triples_to_graph": (q73, "SELECT DISTINCT CASE WHEN n_name IS NOT NULL THEN n_name ELSE child END AS src, CASE WHEN p_name IS NOT NULL THEN p_name ELSE parent END AS dst, 'subClassOf' AS predicate FROM (SELECT 'R:' || r_regionkey AS child, 'Thing' AS parent FROM region UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer) h LEFT JOIN (SELECT 'N:' || n_nationkey AS k, n_name FROM nation) a ON a.k = child LEFT JOIN (SELECT 'N:' || n_nationkey AS k2, n_name AS p_name FROM nation) b ON b.k2 = parent"),
    "q74_trial_score": (q74, _Q74),
}
