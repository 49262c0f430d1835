"""Hand-computed cases, corner cases and invariants of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from coppice.functions import smiles, text
from coppice.operators import candidates, colony, colony_forest, hierarchy, metrics, refinements, rules, running, sampling, splits, trees
from coppice.sources import ontology, sinks, tables
from coppice.streaming import scoring


def toy(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [(i, rng.random(), rng.random(), rng.random()) for i in range(n)]
    return spark.createDataFrame([(i, a, b, c, int(a > 0.5 and b > 0.5)) for i, a, b, c in data], "id long, a double, b double, c double, y int")


def test_gain_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (None, 1), (float("nan"), 0)], "x double, y int")
    long = splits.unpivot(df, ["x"], "y")
    assert long.count() == 4
    for criterion, gain in (("entropy", 1.0), ("gini", 0.5), ("gain_ratio", 1.0), ("chi_square", 1.0)):
        r = splits.best_splits(long, criterion).first()
        assert (r.n_left, r.n_right) == (2, 2) and abs(r.gain - gain) < 1e-6, criterion
    r = splits.best_variance_splits(long).first()
    assert (r.n_left, r.n_right, r.gain) == (2, 2, 0.25)


def test_variance_of_small_labels(spark):
    rng = random.Random(2)
    rows = [(x, 0.15 if x > 0.3 else 0.0) for x in (rng.random() for _ in range(500))]
    r = splits.best_variance_splits(splits.unpivot(spark.createDataFrame(rows, "x double, y double"), ["x"], "y")).first()
    assert abs(r.threshold - 0.3) < 0.03 and r.gain > 0.004
    far = splits.best_variance_splits(splits.unpivot(spark.createDataFrame([(x, y + 1e6) for x, y in rows], "x double, y double"), ["x"], "y")).first()
    assert far.threshold == r.threshold and abs(far.gain - r.gain) < 1e-6


def test_running_sums(spark):
    """Against a plain loop, with few and many ranges, null groups and one group."""
    rng = random.Random(4)
    data = [(g, float(v), rng.randrange(5)) for g in ("a", "b", None) for v in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "g string, v double, n long")
    for ranges in (2, 64):
        got = {(r.g, r.v): (r.upto_n, r.total_n, r.next) for r in running.running_sums(df, ("g",), "v", ("n",), ranges).collect()}
        assert len(got) == 600
        for g in ("a", "b", None):
            mine = sorted((v, n) for x, v, n in data if x == g)
            for i, (v, _) in enumerate(mine):
                assert got[g, v] == (sum(n for _, n in mine[: i + 1]), sum(n for _, n in mine), mine[i + 1][0] if i + 1 < len(mine) else None)
    one = running.running_sums(df.where("g = 'a'"), (), "v", ("n",)).orderBy("v").collect()
    assert [r.upto_n for r in one] == [sum(x.n for x in one[: i + 1]) for i in range(200)]
    assert running.running_sums(df.where("false"), ("g",), "v", ("n",)).count() == 0


def test_weighted_statistics(spark):
    counts = spark.createDataFrame([("x", 0, 80), ("x", 1, 20), ("y", 0, 5), ("y", 1, 5)], "node string, label int, n long")
    weights = spark.createDataFrame([(1, 5.0)], "label int, weight double")
    assert sorted(map(tuple, splits.class_shares(counts, ["node"]).collect())) == [("x", 0, 0.8), ("y", 0, 0.5)]
    got = {r.node: (r.majority, r.purity) for r in splits.class_shares(counts, ["node"], weights).collect()}
    assert got["x"] == (1, 100 / 180) and got["y"][0] == 1
    assert splits.node_conditions(counts, spark.createDataFrame([("a", "zz"), ("b", None)], "node string, feature string")).count() == 0


def test_gain_corner_cases(spark):
    one = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0)], "x double, y int")
    assert splits.best_splits(splits.unpivot(one, ["x"], "y")).first().gain == 0
    flat = spark.createDataFrame([(1.0, 0), (1.0, 1)], "x double, y int")
    assert splits.best_splits(splits.unpivot(flat, ["x"], "y")).first().gain == 0
    assert splits.best_splits(splits.unpivot(flat.where("false"), ["x"], "y")).count() == 0
    three = spark.createDataFrame([(float(i), i // 10) for i in range(30)], "x double, y int")
    assert abs(splits.best_splits(splits.unpivot(three, ["x"], "y")).first().gain - (math.log2(3) - 2 / 3)) < 0.2


def test_labels_do_not_reach_features(spark):
    df = spark.createDataFrame([(1, "CCO", 0), (2, "c1ccccc1O", 1)], "id int, smiles string, y int")
    a = smiles.describe(df).drop("y").orderBy("id").collect()
    b = smiles.describe(df.withColumn("y", 1 - F.col("y"))).drop("y").orderBy("id").collect()
    assert a == b


def test_metrics_corner_cases(spark):
    def one(rows):
        df = spark.createDataFrame(rows, "label int, score double")
        return metrics.roc_auc(df).first()[0], metrics.average_precision(df).first()[0], metrics.youden(df).first()

    assert one([(1, 0.5), (0, 0.5), (1, 0.5)])[0] == 0.5
    assert one([(1, 0.9), (0, 0.1)])[:2] == (1.0, 1.0)
    assert one([(0, 0.9), (1, 0.1)])[0] == 0.0
    assert one([(1, 0.9), (1, 0.1)])[0] is None
    assert one([(1, 0.9), (1, 0.7), (0, 0.2)])[2].threshold == 0.7
    none = metrics.confusion(spark.createDataFrame([(1, 0), (0, 0)], "label int, predicted int")).first()
    assert none["precision"] == 0 and none["f1"] == 0 and none["balanced_accuracy"] == 0.5
    flat = metrics.regression(spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "label double, predicted double")).first()
    assert (flat.mae, flat.rmse, flat.r2) == (1.0, 1.0, 0.0)


def test_splits_are_stable(spark):
    df = toy(spark)
    a = sampling.stratified_split(df, "id", "y", 0.25)
    assert {r.y: r.n for r in a.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {r.y: max(1, r.n // 4) for r in a.groupBy("y").agg(F.count("*").alias("n")).collect()}
    b = sampling.stratified_split(df.repartition(7), "id", "y", 0.25)
    assert {r.id for r in a.where("is_test").collect()} == {r.id for r in b.where("is_test").collect()}
    bag = sampling.bags(df, "id", 5)
    mean = bag.agg(F.avg("multiplicity")).first()[0]
    assert 0.9 < mean < 1.1 and 0.3 < sampling.out_of_bag(bag).count() / bag.count() < 0.44


def test_rules(spark):
    df = toy(spark)
    r = rules.rule_table(spark, [(0, 0, [("a", ">", 0.5), ("b", ">", 0.5)], 1), (1, 0, [], 0), (2, 1, [("nope", ">", 0.0)], 1)])
    s = {x.rule_id: x for x in rules.statistics(df, r, "y").collect()}
    assert s[0].accuracy == 1 and s[0].f1 == 1 and s[2].coverage == 0 and s[1].coverage == 400
    assert abs(s[0].fitness - math.log1p(s[0].coverage)) < 1e-9
    out = rules.first_match(df, r, 0.0)
    assert out.where("predicted != y").count() == 0
    leaves = [(x.rule_id, x.proba) for x in rules.leaf_probabilities(df, r, "y").collect()]
    p = rules.forest_probability(df, r, leaves, 0.5).where("a > 0.5 and b > 0.5")
    assert p.where("probability != 1.0").count() == 0
    nulls = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert rules.matches(nulls, r, ["b"]).count() == 1  # only the rule without conditions
    many = rules.rule_table(spark, [(i, 0, [("a", "<=", i / 900)], 0) for i in range(900)])
    assert rules.matches(df, many, ["id"]).where("id = 0").count() == sum(df.where("id = 0").first().a <= i / 900 for i in range(900))


def test_rule_files(spark, tmp_path):
    r = rules.rule_table(spark, [(0, 0, [("a", ">", 0.5)], 1), (1, 0, [], 0)]).withColumn("fitness", F.col("rule_id") * 1.0)
    sinks.export_rules(r, f"{tmp_path}/j", "json")
    assert {(x.prediction, len(x.conditions)) for x in tables.read_rules(spark, f"{tmp_path}/j").collect()} == {(1.0, 1), (0.0, 0)}
    sinks.export_rules(r, f"{tmp_path}/m", "md", top_k=1)
    assert [x.value for x in spark.read.text(f"{tmp_path}/m").collect()] == ["- IF TRUE THEN predict=0.0"]
    sinks.export_rules(r, f"{tmp_path}/c", "csv")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2
    with pytest.raises(ValueError):
        sinks.export_rules(r, f"{tmp_path}/x", "pdf")
    tasks = spark.createDataFrame([("a", 1), ("b", 1)], "task string, params int")
    assert [x.task for x in sinks.remaining(tasks, tasks.where("task = 'a'"), ["task", "params"]).collect()] == ["b"]


def test_hierarchy(spark):
    h = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("d", "c"), ("d", "r"), ("z", "other")], "child string, parent string")
    c = {(x.node, x.ancestor): (x.dist, x.longest) for x in hierarchy.closure(h).collect()}
    assert c["d", "r"] == (1, 3) and c["c", "r"] == (2, 2) and c["d", "d"] == (0, 0) and ("z", "r") not in c
    assert all((x, z) in c for x, y in c for y2, z in c if y == y2)
    d = {x.node: x.depth for x in hierarchy.depths(h).collect()}
    assert d == {"r": 1, "a": 2, "b": 2, "c": 3, "d": 4, "other": 1, "z": 2}
    ic = hierarchy.information_content(h)
    assert abs({x.node: x.ic for x in ic.collect()}["r"] + math.log2(5 / 7)) < 1e-9
    pairs = spark.createDataFrame([("c", "d"), ("d", "c"), ("a", "b"), ("a", "z"), ("a", "a")], "a string, b string")
    s = {(x.a, x.b): x for x in hierarchy.similarities(pairs, hierarchy.closure(h), hierarchy.depths(h), ic).collect()}
    assert s["c", "d"].wu_palmer == s["d", "c"].wu_palmer == 2 * 3 / 7 and s["a", "b"].lca == "r" and ("a", "z") not in s and s["a", "a"].lin == 1
    hierarchy.check_acyclic(h)
    with pytest.raises(ValueError):
        hierarchy.check_acyclic(h.union(spark.createDataFrame([("r", "d")], "child string, parent string")))
    for rows in ([("a", "b"), ("b", "a")], [("a", "a")], [("x", "a"), ("a", "b"), ("b", "c"), ("c", "a")]):
        loop = spark.createDataFrame(rows, "child string, parent string")
        for follow in (hierarchy.closure, hierarchy.depths, hierarchy.information_content):
            with pytest.raises(Exception, match="has a cycle at"):
                follow(loop).collect()
    line = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "child string, parent string")
    with pytest.raises(Exception, match="more than 60 levels"):
        hierarchy.closure(line).collect()
    assert hierarchy.closure(line.where("child < 'n4'")).count() > 0
    zones = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "4"), ("b", "4"), ("c", None)], "zone string, node string")
    assert hierarchy.zone_entropy(zones).first()[0] == 1.0 and hierarchy.zone_entropy(zones.where("false")).first()[0] == 0.0


def test_hierarchy_larger_than_the_limit_on_recursive_rows(spark):
    h = spark.createDataFrame([(f"n{i}", "r") for i in range(40)] + [("r", "top")], "child string, parent string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")  # 1,000,000 by default
    try:
        assert hierarchy.closure(h).count() == 42 + 41 + 40
        assert hierarchy.depths(h).where("depth = 3").count() == 40
        assert {x.node: x.descendants for x in hierarchy.information_content(h).collect()}["top"] == 42
        with pytest.raises(Exception, match="has a cycle at"):
            hierarchy.closure(h.union(spark.createDataFrame([("top", "n1")], "child string, parent string"))).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_colony_rates_equal_rows_once(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 10), float(i % 7), int(i % 10 > 4)) for i in range(200)], "a double, b double, y int")
    nodes, whole = [], colony.splits.best_splits

    def counted(long, *args, **named):
        nodes.append(long.select(named["by"][0]).distinct().count())
        return whole(long, *args, **named)

    monkeypatch.setattr(colony.splits, "best_splits", counted)
    found, _ = colony.colony_fit(df, ["a", "b"], "y", ants=4, generations=3, steps=1)
    assert nodes == [1]  # four ants and three generations, but one set of rows
    assert ("a", "<=", 4.0) in [(f, o, t) for x in found for f, o, t, _ in x[2]]


def test_statistics_without_rules(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1)], "a double, y int")
    some = rules.statistics(df, rules.rule_table(spark, [(0, 0, [("a", ">", 1.5)], 1)]), "y")
    none = rules.statistics(df, rules.rule_table(spark, []), "y")
    assert none.dtypes == some.dtypes and none.collect() == [] and some.count() == 1


def test_hierarchy_keeps_leaves_out_of_the_recursion(spark):
    h = spark.createDataFrame([(f"n{i}", f"m{i % 3}") for i in range(500)] + [(f"m{i}", "top") for i in range(3)], "child string, parent string")
    met = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "UnionLoopExec":
            met.append(plan.metrics().apply("numOutputRows").value())
        below = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
        for x in [below] if below is not None else [plan.children().apply(i) for i in range(plan.children().size())]:
            walk(x)

    c = hierarchy.closure(h)
    assert len(c.collect()) == 500 * 3 + 3 * 2 + 1
    walk(c._jdf.queryExecution().executedPlan())
    assert met == [7]  # m0, m1, m2 and top at 0, top above three


def test_colony_graph(spark):
    e = spark.createDataFrame([("a", "b", "x", 0.05, False), ("b", "a", "x", 20.0, False), ("b", "c", "x", 1.0, True)], "src string, dst string, predicate string, pheromone double, static boolean")
    paths = spark.createDataFrame([(0, ["a", "b", "c"], 3.0, 1.0, 0.5)], "path_id int, nodes array<string>, fitness double, prediction double, f1 double")
    got = {(x.src, x.dst): x.pheromone for x in colony.elite_update(e, paths, 0.1, 0.3, 0.1, 10.0).collect()}
    assert got == {("a", "b"): pytest.approx(2.1), ("b", "a"): 10.0, ("b", "c"): 1.0}
    p = colony.transition(e.withColumns({"eta": F.lit(1.0), "used": F.lit(False)}), 1.0, 1.0)
    assert all(abs(x.s - 1) < 1e-9 for x in p.groupBy("src").agg(F.sum("probability").alias("s")).collect())
    assert colony.roulette(p, 3).count() == 2
    assert colony.feature_subgraph(spark, ["a", "b", "c"], e).count() == 3
    assert {x.neighbour for x in hierarchy.unvisited(e, spark.createDataFrame([("b",)], "node string"), spark.createDataFrame([("a",)], "node string")).collect()} == {"c"}


def test_learning_the_toy(spark):
    df = toy(spark)
    tree = trees.fit_tree(df, ["a", "b", "c"], "y", depth=2)
    assert trees.predict(df, tree).where("(probability > 0.5) != (y = 1)").count() <= 20
    assert sum(sum(x["counts"].values()) for x in tree if x["feature"] is None) == 400
    r = rules.rule_table(spark, trees.rules_of(tree))
    assert rules.first_match(df, r, 0.0).where("predicted != y").count() <= 20
    found, tau = colony.colony_fit(df, ["a", "b", "c"], "y", ants=4, steps=2)
    assert found and all(0.1 <= t <= 10 for t in tau.values())
    assert found == colony.colony_fit(df.repartition(5), ["a", "b", "c"], "y", ants=4, steps=2)[0]
    best = max(rules.statistics(df, rules.rule_table(spark, found), "y").collect(), key=lambda x: x.accuracy)
    assert best.accuracy > 0.85
    forest = trees.fit_forest(df, "id", ["a", "b", "c"], "y", trees=2, depth=2)
    assert metrics.roc_auc(trees.forest_predict(df, forest).select(F.col("y").alias("label"), F.col("probability").alias("score"))).first()[0] > 0.9
    # without a relation between features and labels there is nothing to learn
    noise = df.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    auc = metrics.roc_auc(trees.predict(df.withColumn("label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")), trees.fit_tree(noise, ["a", "b", "c"], "y")).withColumnRenamed("probability", "score")).first()[0]
    assert 0.35 < auc < 0.65


def test_smiles(spark):
    df = spark.createDataFrame([(x,) for x in ("c1ccc(cc1)C(=O)O", "CCCCCCCCCCCCCCCC(=O)O", "invalid_smiles_###", "C%10CCCCC%10", "[NH4+].[Cl-]", "C", None, "CC[")], "smiles string")
    got = {r.smiles: r for r in smiles.describe(df).collect()}
    b = got["c1ccc(cc1)C(=O)O"]
    assert (b.num_carbons, b.num_oxygens, b.num_rings, b.num_aromatic_rings, b.num_atoms, b.num_hba) == (7, 2, 1, 1, 9, 2) and abs(b.fsp3 - 1 / 7) < 1e-9
    assert got["C%10CCCCC%10"].num_rings == 1 and got["[NH4+].[Cl-]"].num_nitrogens == 1 and got["[NH4+].[Cl-]"].num_hbd == 4
    assert not any(got[x].valid for x in ("invalid_smiles_###", "C", None, "CC["))
    with pytest.raises(ValueError):
        smiles.batch(df, min_valid_ratio=0.9)
    assert smiles.batch(df).count() == 4


def test_text(spark):
    df = spark.createDataFrame([("Mol Weight", "mol weight"), ("weight", "mol weight"), ("a b", "b c"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(F.round(text.fuzzy_ratio(F.col("a"), F.col("b")), 3)).collect()] == [100.0, 80.0, 33.333, 0.0]
    x = spark.createDataFrame([(80.0, 300.0, 4.0)], "tpsa double, molecular_weight double, logp double")
    assert text.relation_features(x, "bbbp").select("transporter_substrates", "physicochemical_risks").first() == ([], [])
    y = spark.createDataFrame([(130.0, 650.0, 9, ["AlphaAminoAcid", "PeptideLike", "Amidine"], None)], "tpsa double, molecular_weight double, n_plus_o_count int, structural_alerts array<string>, functional_groups array<string>")
    r = text.relation_features(y, "bbbp").first()
    assert r.transporter_substrates == ["LAT1_Substrate_Mimic", "PgpSubstrate"] and r.physicochemical_risks == ["HighMW_Risk", "HighTPSA_Risk"]
    r = text.relation_features(y, "bace").first()
    assert r.interacts_residues == ["Asp228", "Asp32"] and r.selectivity_class == "Low_Selectivity_Inhibitor"
    assert text.relation_features(y, "hiv").first().inhibits_steps == ["Maturity"] and text.relation_features(x, "hiv").first().targets_proteins == ["RT"]
    assert text.relation_features(x, "sider").columns == x.columns


def test_refinements(spark):
    sizes = spark.createDataFrame([("p", 1), ("p", 2), ("p", 5), ("q", 3)], "property string, size long")
    assert {(r.property, r.value) for r in refinements.cardinality_candidates(sizes).collect()} == {("p", 1), ("p", 2)}
    flags = spark.createDataFrame([(True, True, False), (False, True, False)], "a boolean, b boolean, c boolean")
    assert [r.predicate for r in refinements.valid(flags, ["a", "b", "c"]).collect()] == ["a"]


def test_sources(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<http://o#B> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://o#A> .\n<http://o#A> <http://www.w3.org/2000/01/rdf-schema#label> "Top"@en .\n# no triple\n<http://o#B> <http://o#likes> <http://o#A> .\n')
    nodes, edges = tables.graph_of(tables.read_triples(spark, f"{tmp_path}/x.nt"), object_properties=True)
    assert {(r.src, r.dst, r.predicate) for r in edges.collect()} == {("B", "Top", "subClassOf"), ("B", "Top", "likes")}
    (tmp_path / "x.owl").write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="http://o#B"><rdfs:label>Bee</rdfs:label><rdfs:subClassOf rdf:resource="http://o#A"/></owl:Class></rdf:RDF>')
    _, edges = tables.graph_of(tables.read_triples(spark, f"{tmp_path}/x.owl"))
    assert {(r.src, r.dst) for r in edges.collect()} == {("Bee", "A")}
    assert tables.first_triples(edges, 1).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.placeholder(spark, [("a", "b")])
    with pytest.raises(ValueError):
        tables.guess_format("x.doc")
    both = tables.compose([("one", edges), ("two", edges.withColumn("pheromone", F.lit(9.0)))])
    assert [(r.source_ontology, r.pheromone) for r in both.collect()] == [("two", 9.0)]
    assert tables.route({"d": ["x"]}, "d", extra=("y", "x")) == ["x", "y"] and tables.route({"d": ["x"]}, "d", override="z") == ["z"]
    assert tables.merged_config({"a": {"b": 1, "c": 2}, "seed": 42}, {"a": {"b": 5}, "seed": 0}) == {"a": {"b": 5, "c": 2}, "seed": 0}
    df = spark.createDataFrame([("1",), ("-1",), (None,), ("0",)], "y string")
    assert sorted(str(r.y) for r in tables.binary_labels(df, "y").collect()) == ["0", "1", "None", "None"]
    with pytest.raises(Exception, match="not binary"):
        tables.binary_labels(spark.createDataFrame([("2",)], "y string"), "y").collect()
    cache = spark.createDataFrame([("a", 1, 2), ("b", 2, 1)], "k string, v int, _version int")
    assert {r.k: r.v for r in tables.cached(spark.createDataFrame([("a",), ("b",)], "k string"), cache, "k", 2).collect()} == {"a": 1, "b": None}
    assert tables.merge_cache(cache, cache.where("k = 'a'").withColumn("v", F.lit(7)), "k").count() == 2
    (tmp_path / "d.csv").write_text("s,y\nCC,1\nCO,\n")
    assert tables.load_dataset(tables.read_csv(spark, f"{tmp_path}/d.csv", "s string, y double"), "y", "int").count() == 1
    with pytest.raises(ValueError):
        tables.load_dataset(df, "nope")


def test_more_sources(spark, tmp_path):
    (tmp_path / "x.ttl").write_text("# comment\n<http://o#B> <http://o#likes> <http://o#A> .\n\n")
    assert [tuple(r) for r in tables.read_triples(spark, f"{tmp_path}/x.ttl").collect()] == [("http://o#B", "http://o#likes", "http://o#A", False)]
    (tmp_path / "y.ttl").write_text("@prefix o: <http://o#> .\no:B o:likes o:A .\n")
    with pytest.raises(Exception, match="not a triple"):
        tables.read_triples(spark, f"{tmp_path}/y.ttl").collect()
    with pytest.raises(ValueError, match="JSON-LD"):
        tables.read_triples(spark, "x.jsonld")
    rows = spark.createDataFrame([("a", "p", "b", False)], "s string, p string, o string, literal boolean")
    for kind in ("parquet", "json", "csv"):
        getattr(rows.write, kind)(f"{tmp_path}/t.{kind}", **({"header": True} if kind == "csv" else {}))
        assert tables.read_triples(spark, f"{tmp_path}/t.{kind}").collect() == rows.collect()
    (tmp_path / "z.owl").write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="http://o#B"><owl:disjointWith rdf:resource="http://o#C"/></owl:Class><owl:ObjectProperty rdf:about="http://o#eats"><rdfs:domain rdf:resource="http://o#B"/><rdfs:range rdf:resource="http://o#C"/></owl:ObjectProperty></rdf:RDF>')
    _, edges = tables.graph_of(tables.read_triples(spark, f"{tmp_path}/z.owl"))
    assert {(r.src, r.dst, r.predicate) for r in edges.collect()} == {("B", "C", "disjointWith"), ("eats", "B", "domain"), ("eats", "C", "range")}


def test_individuals(spark, tmp_path):
    df = spark.createDataFrame([("m1", 300.5, ["Amine", "Amine", None], ["Amine", "Epoxide"], 1), ("m2", None, None, [], 0), (None, 1.0, [], [], 0)], "id string, molecular_weight double, functional_groups array<string>, structural_alerts array<string>, y int")
    got = {(r.s, r.p.split("#")[-1], r.o) for r in ontology.individuals(df, "id", "y").collect()}
    assert got == {("m1", "type", "Molecule"), ("m1", "hasMolecularWeight", "300.5"), ("m1", "hasFunctionalGroupRel", "Amine"), ("m1", "hasFunctionalGroupRel", "Epoxide"), ("m1", "hasLabel", "1"), ("m2", "type", "Molecule"), ("m2", "hasLabel", "0")}
    (tmp_path / "d.csv").write_text("id,logp\nx,1.5\n")
    triples = ontology.csv_individuals(spark, f"{tmp_path}/d.csv", "id string, logp double", "id")
    assert ontology.instances(triples, "Molecule").count() == 1 and {r.property for r in ontology.used_properties(triples).collect()} == {"hasLogP"}
    assert ontology.schema_table(spark).where("property = 'hasLogP'").first().range == "float"
    declared = triples.unionByName(spark.createDataFrame([("http://o#B", ontology._SUB, "http://o#A", False)], "s string, p string, o string, literal boolean"))
    assert {r["class"] for r in ontology.classes(declared).collect()} == {"http://o#A", "http://o#B"}
    refs = candidates.seed_rules(spark, "BBBP ").select("ref_type", "property", "operator", "value", "concept")
    ontology.write_refinements(refs, f"{tmp_path}/refs", {"dataset": "bbbp"})
    assert ontology.read_refinements(spark, f"{tmp_path}/refs").drop("of").exceptAll(refs).count() == 0
    known = spark.createDataFrame([("AromaticMolecule",)], "concept string")
    assert ontology.read_refinements(spark, f"{tmp_path}/refs", known).count() == 14
    assert candidates.seed_rules(spark, "unknown").count() == 0 and all(len(candidates.seed_rows(x)) == 15 for x in candidates.SEEDS)


def test_candidates(spark):
    assert candidates.allowed_kinds("el") == candidates.allowed_kinds(None) == candidates.KINDS
    assert candidates.of_profile(candidates.templates(spark), "ALC").count() == 0
    stored = [{"type": "domain", "property": "x", "operator": ">", "value": v} for v in (0.0, 2.0, 9.0)]
    rows = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "x double")
    evaluate = lambda df, ps: df.select(*((F.col(p["property"]) > p["value"]).alias(f"p{i}") for i, p in enumerate(ps)))
    assert candidates.still_valid(stored, rows, evaluate) == [stored[1]] and candidates.still_valid([], rows, evaluate) == []


def test_colony_forest(spark):
    df = toy(spark, 500)
    forest = colony_forest.fit(df, "id", ["a", "b", "c"], "y", trees=2, generations=2, ants=4, steps=2, fixed=[(0, 0, [("a", ">", 0.9, 0.1), ("b", ">", 0.9, 0.1)], 1)])
    assert {r[1] for r in forest.rules} <= {0, 1, 2} and [r for r in forest.rules if r[1] == 2][0][2][0][:3] == ("a", ">", 0.9)
    assert forest.scores[2] == 1.0 and all(0 <= s <= 1 for s in forest.scores.values()) and len(forest.history) == 2
    assert all(0.1 <= t <= 10 for t in forest.pheromones.values())
    small = [colony_forest.fit(x, "id", ["a", "b"], "y", trees=1, generations=1, ants=3, steps=1) for x in (df, df.repartition(5))]
    assert small[0].rules == small[1].rules and small[0].scores == small[1].scores
    test = toy(spark, 400, seed=2).withColumnRenamed("y", "label")
    out = forest.predict(test)
    assert out.where("probability < 0 or probability > 1").count() == 0
    assert metrics.roc_auc(out.withColumnRenamed("probability", "score")).first()[0] > 0.75
    assert forest.predict(test, weighted=True).columns == out.columns


def test_walks_and_draws():
    edges = {("a", "b"): 1.0, ("b", "c"): 1.0, ("c", "d"): 1.0}
    assert colony_forest.ant_walk(edges, "a", 9, (1,)) == ["a", "b", "c", "d"] and colony_forest.ant_walk(edges, "d", 1, (1,)) == ["d", "c"]
    picks = [colony_forest.draw([1.0, 3.0, 0.0], "x", i) for i in range(2000)]
    assert 0.2 < picks.count(0) / 2000 < 0.3 and not picks.count(2)
    starts = [colony_forest.start_node(["Thing", "f", "n"], ["f"], 1.0, (i,)) for i in range(2000)]
    assert 0.75 < starts.count("f") / 2000 < 0.9 and starts.count("Thing") > starts.count("n") > 0
    assert colony_forest.best_candidate({0: 0.1, 1: 0.5}, {0: 1.0, 1: 1.0, 2: 1.0}) == (1, 0.5) and colony_forest.best_candidate({}, {0: 1.0}) == (None, -1.0)
    assert colony_forest.sweep(lambda c: c["a"] * c["b"], {"a": 1, "b": 2}, {"a": [3], "b": [5]}) == [("a", 3, 6), ("b", 5, 5)]


def test_probe(spark):
    flags = toy(spark, 300).select("id", "y", (F.col("a") > 0.5).alias("p0"), (F.col("c") > 0.5).alias("p1"), (F.col("a") > 5).alias("p2"))
    got = {r.predicate: r.heuristic for r in colony_forest.probe(flags, ["p0", "p1", "p2"], "y", "id").collect()}
    assert got["p0"] > got["p1"] >= got["p2"] == 1e-9


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    r = rules.rule_table(spark, [(0, 0, [("value", ">", 50.0)], 1)])
    stream = scoring.score_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), r, 0.0)
    counted = scoring.windowed_counts(stream, "ts")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {int(x.predicted): x.n for x in spark.sql("SELECT predicted, sum(n) AS n FROM scored GROUP BY predicted").collect()}
    want = {int(x.p): x.n for x in events.groupBy((F.col("value") > 50).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    assert got == want
