"""Queries on graphs as tables, caches, names and summaries, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import smiles, text
from ..operators import colony, hierarchy, refinements, rules
from ..sources import sinks, tables
from ..sources.tables import table
from . import graphs, numeric

_LINKS = "e AS (SELECT child AS src, parent AS dst FROM h)"


def _edges(s, d):
    return graphs.taxonomy(s, d).toDF("src", "dst")


# -- triples and graphs


def _uri(x):
    return F.concat(F.lit("http://example.org/t#"), x)


def _triples(s, d):
    """Customers in nations: a subclass, a property of their own, a label for every second one, a literal."""
    c = table(s, d, "customer")
    me, there = _uri(F.concat(F.lit("C"), "c_custkey")), _uri(F.concat(F.lit("N"), "c_nationkey"))
    one = lambda p, o, literal, rows: rows.select(me.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"))
    return (
        one("http://www.w3.org/2000/01/rdf-schema#subClassOf", there, False, c)
        .unionByName(one("http://example.org/t#livesIn", there, False, c))
        .unionByName(one("http://www.w3.org/2000/01/rdf-schema#label", F.col("c_name"), True, c.where("c_custkey % 2 = 0")))
        .unionByName(one("http://example.org/t#balance", F.col("c_acctbal").cast("string"), True, c))
    )


def q94(s, d):
    _, edges = tables.graph_of(_triples(s, d), object_properties=True)
    return edges.select("src", "dst", "predicate", "pheromone", "static")


_Q94 = "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'C' || c_custkey END AS src, 'N' || c_nationkey AS dst, predicate, 1.0::DOUBLE AS pheromone, FALSE AS static FROM customer, (VALUES ('subClassOf'), ('livesIn')) p(predicate)"


def q95(s, d):
    _, edges = tables.graph_of(_triples(s, d))
    first = tables.first_triples(edges, 40)
    return sinks.triples_of(first.select("src", "predicate", "dst"))


def q96(s, d):
    e = _edges(s, d)
    one = e.withColumn("pheromone", F.lit(1.0))
    two = e.where("dst like 'R:%'").withColumn("pheromone", F.lit(2.0)).unionByName(s.createDataFrame([("R:0", "Extra", 3.0)], "src string, dst string, pheromone double"))
    return tables.compose([("first", one), ("second", two)]).select("src", "dst", "pheromone", "source_ontology")


_Q96 = f"WITH {graphs._TAX} SELECT child AS src, parent AS dst, CASE WHEN parent LIKE 'R:%' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS pheromone, CASE WHEN parent LIKE 'R:%' THEN 'second' ELSE 'first' END AS source_ontology FROM h UNION ALL SELECT 'R:0', 'Extra', 3.0::DOUBLE, 'second'"


def q97(s, d):
    """Neighbours of some nodes that haven't been visited."""
    at = s.createDataFrame([("R:0",), ("N:3",), ("C:1",)], "node string")
    seen = _edges(s, d).where("src like 'C:%' and substring(src, 3, 9) % 3 = 0").select("src").unionByName(s.createDataFrame([("Thing",)], "src string"))
    return hierarchy.unvisited(_edges(s, d), at, seen).select("node", "neighbour")


_Q97 = f"WITH {graphs._TAX}, b AS (SELECT child AS node, parent AS neighbour FROM h UNION SELECT parent, child FROM h) SELECT node, neighbour FROM b WHERE node IN ('R:0', 'N:3', 'C:1') AND neighbour <> 'Thing' AND NOT (neighbour LIKE 'C:%' AND TRY_CAST(substr(neighbour, 3) AS INTEGER) % 3 = 0)"


def q98(s, d):
    """The root with the universal root and without it, of the whole graph and of the graph between nations and regions."""
    e = _edges(s, d)
    nodes = e.select("src").where("src not like 'C:%'")
    out = [("whole", e), ("without", e.where("dst != 'Thing'")), ("induced", hierarchy.induced(e, nodes))]
    return out[0][1].transform(_root, "whole").unionByName(out[1][1].transform(_root, "without")).unionByName(out[2][1].transform(_root, "induced"))


def _root(edges, name):
    return hierarchy.root_of(edges).select(F.lit(name).alias("graph"), "node")


_Q98 = f"""WITH {graphs._TAX}, g(graph, src, dst) AS (SELECT 'without', child, parent FROM h WHERE parent <> 'Thing' UNION ALL SELECT 'induced', child, parent FROM h WHERE child LIKE 'N:%'),
n AS (SELECT graph, src AS node, dst AS other FROM g UNION SELECT graph, dst, src FROM g), k AS (SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY count(*) DESC, node) AS place FROM n GROUP BY graph, node)
SELECT graph, node FROM k WHERE place = 1 UNION ALL SELECT 'whole', 'Thing'"""


def q99(s, d):
    return hierarchy.sibling_edges(graphs.taxonomy(s, d)).select("parent", "src", "dst")


_Q99 = f"WITH {graphs._TAX}, r AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child) AS i FROM h) SELECT a.parent, a.child AS src, b.child AS dst FROM r a JOIN r b ON b.parent = a.parent AND b.i = a.i + 1"


def q100(s, d):
    t = graphs.taxonomy(s, d)
    degree = hierarchy.neighbours(t.toDF("src", "dst")).groupBy("node").agg(F.count("*").alias("degree"))
    return hierarchy.representatives(degree.join(hierarchy.depths(t), "node"), 4).select("node", "depth", "degree", F.col("rank").cast("long").alias("rank"))


_Q100 = f"""{graphs._C}, b AS (SELECT child AS node, parent AS other FROM h UNION SELECT parent, child FROM h), g AS (SELECT node, count(*) AS degree FROM b GROUP BY node),
r AS (SELECT node, depth, degree, row_number() OVER (PARTITION BY depth ORDER BY degree DESC, node) AS rank FROM g JOIN dep USING (node)) SELECT node, depth, degree, rank FROM r WHERE rank <= 4"""


def q101(s, d):
    """Candidates by region up to a depth: regions without shallow ones keep all."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    some = c.select(F.concat(F.lit("R:"), "n_regionkey").alias("group"), F.concat(F.lit("C:"), "c_custkey").alias("node"), (F.col("c_custkey") % 5 + F.when(F.col("n_regionkey") == 2, 4).otherwise(0)).alias("depth"))
    return hierarchy.filter_candidates(some, 2).groupBy("group").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


_Q101 = "WITH c AS (SELECT 'R:' || n_regionkey AS g, c_custkey % 5 + CASE WHEN n_regionkey = 2 THEN 4 ELSE 0 END AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey), m AS (SELECT g, min(depth) AS least FROM c GROUP BY g) SELECT c.g AS \"group\", count(*) AS n, max(depth) AS deepest FROM c JOIN m ON m.g = c.g WHERE depth <= 2 OR least > 2 GROUP BY c.g"


# -- the colony's graph


def q102(s, d):
    known = s.createDataFrame(colony.chain(["l_quantity", "l_discount", "l_tax"]), "src string, dst string, predicate string, pheromone double, static boolean")
    new = colony.feature_subgraph(s, [*numeric.FEATURES, "p_size"], known, 0.5)
    return known.select("src", "dst", "pheromone", "static").unionByName(new.select("src", "dst", "pheromone", "static"))


def _q102_sql():
    names = ", ".join(f"('{x}')" for x in [*numeric.FEATURES, "p_size"])
    return f"WITH f(x) AS (VALUES {names}), k(src, dst) AS (VALUES ('l_quantity', 'l_discount'), ('l_discount', 'l_quantity'), ('l_discount', 'l_tax'), ('l_tax', 'l_discount')) SELECT src, dst, 1.0::DOUBLE AS pheromone, TRUE AS static FROM k UNION ALL SELECT a.x, b.x, 0.5::DOUBLE, FALSE FROM f a, f b WHERE a.x <> b.x AND NOT EXISTS (SELECT 1 FROM k WHERE src = a.x AND dst = b.x)"


def q103(s, d):
    e = table(s, d, "customer").select(((F.col("c_custkey") % 11) / 8).alias("pheromone"))
    return numeric._nine(colony.pheromone_summary(e, 0.25))


_Q103 = "SELECT count(*) AS edges, round(avg(p), 9) AS mean, round(stddev_pop(p), 9) AS std, round(max(p), 9) AS max, round(avg(CAST(p <= 0.25 AS INTEGER)), 9) AS sparsity FROM (SELECT (c_custkey % 11) / 8 AS p FROM customer)"


def q104(s, d):
    at = lambda k: F.col("p_size") % k == 0
    return table(s, d, "part").groupBy(colony.eta_modifier(at(2), at(3), at(5)).alias("eta")).agg(F.count("*").alias("n"))


def q105(s, d):
    """The classes among the rows of each rule: what trees and summaries count at their leaves."""
    return rules.class_counts(numeric.lines(s, d), numeric.rule_df(s), "l_returnflag").select("rule_id", "label", "n")


_Q105 = " UNION ALL ".join(f"SELECT {i} AS rule_id, l_returnflag AS label, count(*) AS n FROM lineitem WHERE {m} GROUP BY l_returnflag" for i, m in enumerate(numeric.MASKS))


# -- caches and results


def _halves(s, d):
    c = table(s, d, "customer")
    cache = c.where("c_custkey % 3 != 0").select("c_custkey", F.col("c_acctbal").alias("value"), (F.col("c_custkey") % 2 + 1).cast("int").alias("_version"))
    return c.select("c_custkey"), cache


def q106(s, d):
    keys, cache = _halves(s, d)
    return tables.cached(keys, cache, "c_custkey", 2)


def q107(s, d):
    keys, cache = _halves(s, d)
    new = keys.where("c_custkey % 4 = 0").select("c_custkey", F.lit(0.5).alias("value"), F.lit(3).alias("_version"))
    return tables.merge_cache(cache, new, "c_custkey").withColumnRenamed("_version", "version")


def q108(s, d):
    tasks = table(s, d, "orders").select("o_custkey", "o_orderstatus").distinct()
    done = table(s, d, "orders").where("o_totalprice > 200000").select("o_custkey", "o_orderstatus", "o_totalprice")
    return sinks.remaining(tasks, done, ["o_custkey", "o_orderstatus"])


# -- names and descriptors


def q109(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", text.safe_name(F.concat(F.lit(" "), "p_brand", F.lit(" / "), "p_type")).alias("safe"), text.compact(F.col("p_type"), 12).alias("short"))


def q110(s, d):
    names = table(s, d, "part").select(F.col("p_type").alias("name")).distinct()
    return refinements.relevance_order(names, ["promo", "STEEL"])


def q111(s, d):
    df = smiles.batch(s.createDataFrame(list(enumerate(graphs.SMILES)), "id int, smiles string"))
    return df.select("id", smiles.lipinski().alias("lipinski"))


QUERIES = {
    "q94_object_properties": (q94, _Q94),
    "q95_first_triples": (q95, "SELECT '<' || src || '> <subClassOf> <N' || c_nationkey || '> .' AS value FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'C' || c_custkey END AS src, c_nationkey FROM customer ORDER BY src, 'N' || c_nationkey LIMIT 40)"),
    "q96_compose": (q96, _Q96),
    "q97_unvisited": (q97, _Q97),
    "q98_root": (q98, _Q98),
    "q99_siblings": (q99, _Q99),
    "q100_representatives": (q100, _Q100),
    "q101_depth_filter": (q101, _Q101),
    "q102_feature_subgraph": (q102, _q102_sql()),
    "q103_pheromone_summary": (q103, _Q103),
    "q104_eta_modifiers": (q104, "SELECT CASE WHEN p_size % 2 = 0 THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END * CASE WHEN p_size % 5 = 0 THEN 3 ELSE 1 END AS eta, count(*) AS n FROM part GROUP BY 1"),
    "q105_leaf_classes": (q105, _Q105),
    "q106_cache_read": (q106, "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 1 THEN c_acctbal END AS value FROM customer"),
    "q107_cache_merge": (q107, "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.5::DOUBLE ELSE c_acctbal END AS value, CAST(CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE c_custkey % 2 + 1 END AS INTEGER) AS version FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 = 0"),
    "q108_resume": (q108, "SELECT o_custkey, o_orderstatus FROM orders GROUP BY ALL HAVING max(o_totalprice) <= 200000 OR max(o_totalprice) IS NULL"),
    "q109_names": (q109, "SELECT p_partkey, regexp_replace(trim(p_brand || ' / ' || p_type), '[^0-9A-Za-z_]+', '_', 'g') AS safe, CASE WHEN length(p_type) > 12 THEN p_type[1:9] || '...' ELSE p_type END AS short FROM part"),
    "q110_relevance": (q110, "SELECT DISTINCT p_type AS name, contains(lower(p_type), 'promo') OR contains(lower(p_type), 'steel') AS relevant FROM part"),
    "q111_lipinski": (q111, f"SELECT id, molecular_weight <= 500 AND logp <= 5 AND num_hbd <= 5 AND num_hba <= 10 AS lipinski FROM ({graphs._q65_sql()}) WHERE valid"),
}
