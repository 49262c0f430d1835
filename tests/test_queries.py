"""Every query with a SQL counterpart, against DuckDB."""

import duckdb
import pytest

from coppice import catalog

HOME = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{HOME}/{t}.parquet')")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(round(float(r[i]), 6) if isinstance(r[i], float) or hasattr(r[i], "quantize") else r[i] for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, HOME)
    want = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) < 1e-6 * (1 + abs(p)) for p, q in zip(x, y)), (x, y)


def test_gains_are_rounded_as_in_sql(spark, con):
    from coppice.plans import numeric

    gains = [i / 1e9 for i in range(500_005, 700_005, 10)]
    df = spark.createDataFrame([("f", 0.5, 1, 1, g) for g in gains], "feature string, threshold double, n_left long, n_right long, gain double")
    want = con.execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 8))", [gains]).fetchone()[0]
    assert [r.gain for r in numeric._rounded(df).collect()] == want


def test_scores_are_rounded_as_in_sql(spark, con, monkeypatch):
    from coppice.plans import graphs

    gains = [i / 1e8 for i in range(5, 20_000, 10)]  # times 0.7: a 5 in the ninth place
    df = spark.createDataFrame([("f", 0.5, g, 0.0, 1.0) for g in gains], "feature string, threshold double, gain double, ati double, similarity double")
    monkeypatch.setattr(graphs, "_gain_terms", lambda s, d: df)
    for name in ("q40_semantic_gain", "q41_pig_semantic"):
        want = con.execute("SELECT list_transform(?::DOUBLE[], lambda g: round(0.7::DOUBLE * g + 0.3::DOUBLE * 1.0::DOUBLE * greatest(g, 0.001::DOUBLE), 8))", [gains]).fetchone()[0]
        assert [r.score for r in catalog.queries()[name](spark, HOME).collect()] == want


#: Queries over closures of more than 1,000,000 rows once customer and part have some 500,000.
CLOSURES = [
    "q32_depth",
    "q35_wu_palmer",
    "q38_set_similarity",
    "q41_pig_semantic",
    "q48_refinement_eval",
    "q78_dl_templates",
    "q30_inheritance_order",
    "q33_ic",
    "q36_lin",
    "q39_pig_gain",
    "q45_qualification",
    "q55_jump_penalty",
    "q79_applicable_properties",
    "q31_closure",
    "q34_lca",
    "q37_ati",
    "q40_semantic_gain",
    "q47_validity_filter",
]


@pytest.mark.parametrize("name", CLOSURES)
def test_query_past_the_limit_on_recursive_rows(spark, con, name):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")  # 1,000,000 by default
    try:
        test_query(spark, con, name)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def broadcasts(plan):
    """The rows of every broadcast of an executed plan."""
    name = plan.getClass().getSimpleName()
    below = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    mine = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchangeExec" else []
    return mine + [n for x in ([below] if below is not None else [plan.children().apply(i) for i in range(plan.children().size())]) for n in broadcasts(x)]


def test_pig_gain_broadcasts_nothing_that_grows_with_the_leaves(spark, tmp_path, monkeypatch):
    from coppice.operators import hierarchy
    from coppice.plans import graphs
    from coppice.sources import shared

    c, ran = duckdb.connect(), []
    for t in ("region", "nation", "lineitem", "customer"):
        more = "SELECT * REPLACE (c_custkey + 1000 * i AS c_custkey) FROM {}, range(20) r(i)" if t == "customer" else "FROM {}"
        c.execute(f"COPY ({more.format(f"read_parquet('{HOME}/{t}.parquet')")}) TO '{tmp_path}/{t}.parquet'")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")

    def settled(df):
        ran.append(df)
        return shared.settled(df)

    monkeypatch.setattr(hierarchy, "settled", settled)
    monkeypatch.setattr(graphs, "settled", settled, raising=False)
    monkeypatch.setitem(globals(), "HOME", str(tmp_path))
    test_query(spark, c, "q39_pig_gain")
    assert ran and max([n for df in ran for n in broadcasts(df._jdf.queryExecution().executedPlan())], default=0) < 1_000  # of 3,000 customers


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, HOME).count() > 0


def test_colony_fit_without_a_gain(spark, tmp_path):
    """Both flags for every row: no split gains anything, as with many rows whose flag depends on nothing."""
    duckdb.sql(f"COPY (SELECT l.* EXCLUDE (l_returnflag), f.l_returnflag FROM read_parquet('{HOME}/lineitem.parquet') l, (VALUES ('R'), ('A')) f(l_returnflag)) TO '{tmp_path}/lineitem.parquet'")
    got, usual = (catalog.queries()["q68_colony_fit"](spark, d) for d in (str(tmp_path), HOME))
    assert got.dtypes == usual.dtypes and got.collect() == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
