"""Queries on splits, metrics, sampling, rules and trees, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, rules, sampling, splits, trees
from ..sources.sinks import rule_text
from ..sources.tables import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

#: (rule_id, tree_id, conditions, prediction): an ordinary pair, a contradiction, a duplicate, an unknown column, one without rows, one without conditions.
RULES = [
    (0, 0, [("l_quantity", ">", 25.0, 0.04), ("l_discount", "<=", 0.05, 0.02)], 1),
    (1, 0, [("l_quantity", "<=", 10.0, 0.03)], 0),
    (2, 1, [("l_quantity", ">", 5.0, 0.01), ("l_quantity", "<=", 3.0, 0.05)], 1),
    (3, 1, [("l_discount", "<=", 0.05, 0.02), ("l_quantity", ">", 25.0, 0.04)], 1),
    (4, 1, [("no_such_column", ">", 1.0, 0.01)], 0),
    (5, 2, [("l_extendedprice", ">", 1e9, 0.02)], 1),
    (6, 2, [], 0),
    (7, 2, [("l_tax", ">", 0.04, 0.06), ("l_discount", ">", 0.02, 0.01)], 1),
]
MASKS = ["(l_quantity > 25.0::DOUBLE AND l_discount <= 0.05::DOUBLE)", "(l_quantity <= 10.0::DOUBLE)", "(l_quantity > 5.0::DOUBLE AND l_quantity <= 3.0::DOUBLE)", "(l_quantity > 25.0::DOUBLE AND l_discount <= 0.05::DOUBLE)", "FALSE", "(l_extendedprice > 1e9)", "TRUE", "(l_tax > 0.04::DOUBLE AND l_discount > 0.02::DOUBLE)"]
TREE_OF, SAYS = [r[1] for r in RULES], [float(r[3]) for r in RULES]


def lines(spark, d):
    return table(spark, d, "lineitem").withColumn("is_r", (F.col("l_returnflag") == "R").cast("int"))


def long(spark, d, label="is_r", features=FEATURES):
    return splits.unpivot(lines(spark, d), features, label)


def _long_sql(label="CAST(l_returnflag = 'R' AS INTEGER)", features=FEATURES, frm="lineitem"):
    return " UNION ALL ".join(f"SELECT {label} AS label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {frm}" for f in features)


def _grid_sql(size):
    return f"quantile_cont(value, [{', '.join(repr(x) for x in splits.fractions(size))}])"


_BEST = """
b AS (SELECT *, round(gain, 9) AS g, max(j) OVER (PARTITION BY feature) AS top FROM gains),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY CASE WHEN g > 0 THEN g ELSE 0.0 END DESC, CASE WHEN g > 0 THEN threshold END, abs(j - floor((top + 1) / 2))) AS pos FROM b)
SELECT feature, round(threshold, 6) AS threshold, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right, round(greatest(g, 0.0), 8) AS gain FROM r WHERE pos = 1
"""


def split_sql(source, criterion, weighted=True, size=64):
    e = lambda p: f"sum(-({p}) * log2(({p}) + 1e-12))"
    if criterion == "gini":
        e = lambda p: f"(1.0 - sum(({p}) * ({p})))"
    p = lambda x, y: f"CASE WHEN {y} = 0 THEN 0.0 ELSE {x} / {y} END"
    gain = f"{e(p('a', 'ta'))} - max(tl) / max(ta) * {e(p('l', 'tl'))} - max(tr) / max(ta) * {e(p('r', 'tr'))}"
    if criterion == "chi_square":
        t = lambda o, x: f"CASE WHEN {x} > 0 THEN (({o}) - {x}) * (({o}) - {x}) / ({x}) ELSE 0.0 END"
        gain = f"sum({t('lc', '(n * nl / nn)')} + {t('n - lc', '(n * (nn - nl) / nn)')}) / (max(nn) * greatest(max(k) - 1, 1) + 1e-12)"
    ratio = "gain"
    if criterion == "gain_ratio":
        q = "(n_left / nn)"
        info = f"(-{q} * log2({q} + 1e-12) - (1 - {q}) * log2(1 - {q} + 1e-12))"
        ratio = f"CASE WHEN {info} < 1e-12 THEN gain ELSE gain / {info} END"
    return f"""
WITH long AS ({source}),
grid AS (SELECT feature, unnest(list_sort(list_distinct({_grid_sql(size)}))) AS threshold FROM long GROUP BY feature),
g AS (SELECT feature, threshold, row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS j FROM grid),
tot AS (SELECT feature, label, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY ALL),
cells AS (SELECT feature, label, value, count(*) AS c FROM long GROUP BY ALL),
under AS (SELECT g.feature, g.j, cells.label, CAST(sum(c) AS DOUBLE) AS lc FROM g JOIN cells ON cells.feature = g.feature AND cells.value <= g.threshold GROUP BY ALL),
sides AS (SELECT g.*, tot.label, tot.n, coalesce(lc, 0.0) AS lc, sum(n) OVER w AS nn, sum(coalesce(lc, 0.0)) OVER w AS nl, CAST(count(*) OVER w AS DOUBLE) AS k
  FROM g JOIN tot USING (feature) LEFT JOIN under ON under.feature = g.feature AND under.j = g.j AND under.label = tot.label WINDOW w AS (PARTITION BY g.feature, g.j)),
weighted AS (SELECT *, {'nn / (k * n)' if weighted else '1.0::DOUBLE'} AS w FROM sides),
parts AS (SELECT *, lc * w AS l, (n - lc) * w AS r, n * w AS a FROM weighted),
sums AS (SELECT *, sum(l) OVER v AS tl, sum(r) OVER v AS tr, sum(a) OVER v AS ta FROM parts WINDOW v AS (PARTITION BY feature, j)),
raw AS (SELECT feature, j, threshold, max(nl) AS n_left, max(nn) AS nn, {gain} AS gain FROM sums GROUP BY feature, j, threshold),
gains AS (SELECT feature, j, threshold, n_left, nn - n_left AS n_right, CASE WHEN n_left > 0 AND n_left < nn THEN {ratio} ELSE 0.0 END AS gain FROM raw),
{_BEST}"""


def _eight(x):
    """Eight decimals of a value that has nine already, as DuckDB rounds: by the binary product, where Spark's round() takes the digits and always rounds a last 5 up."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 1e8) / 1e8


def _rounded(df):
    return df.select("feature", F.round("threshold", 6).alias("threshold"), "n_left", "n_right", _eight("gain").alias("gain"))


def _split(criterion):
    return lambda spark, d: _rounded(splits.best_splits(long(spark, d), criterion)), split_sql(_long_sql(), criterion)


VARIANCE_SQL = f"""
WITH long AS ({_long_sql("round(l_extendedprice)", ["l_quantity", "l_discount", "l_tax"])}),
grid AS (SELECT feature, unnest(list_sort(list_distinct({_grid_sql(64)}))) AS threshold FROM long GROUP BY feature),
g AS (SELECT feature, threshold, row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS j FROM grid),
x AS (SELECT g.*, count(*) AS n, sum(label) AS s, sum(label * label) AS q, count(*) FILTER (value <= threshold) AS nl, sum(label) FILTER (value <= threshold) AS sl, sum(label * label) FILTER (value <= threshold) AS ql FROM g JOIN long USING (feature) GROUP BY ALL),
gains AS (SELECT feature, j, threshold, nl AS n_left, n - nl AS n_right, round(CASE WHEN nl > 0 AND nl < n THEN q / n - (s / n) * (s / n) - (nl * (ql / nl - (sl / nl) * (sl / nl)) + (n - nl) * ((q - ql) / (n - nl) - ((s - sl) / (n - nl)) * ((s - sl) / (n - nl)))) / n ELSE 0.0 END, 2) AS gain FROM x),
{_BEST}"""


def q09(spark, d):
    df = lines(spark, d).withColumn("y", F.round("l_extendedprice"))
    return _rounded(splits.best_variance_splits(splits.unpivot(df, ["l_quantity", "l_discount", "l_tax"], "y"), 64, digits=2))


def q10(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") == 0).cast("int").alias("label"), F.posexplode("embedding").alias("i", "x"))
    wide = e.select("label", F.format_string("e%02d", "i").alias("feature"), F.col("x").cast("double").alias("value")).where("label is not null and value is not null")
    return _rounded(splits.best_splits(wide, "gini", size=16))


Q10_SQL = split_sql("SELECT CAST(label = 0 AS INTEGER) AS label, printf('e%02d', i) AS feature, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i)", "gini", size=16)


def scored(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "lang", F.round(F.col("n_chars") / (F.col("n_chars") + 2000), 3).alias("score"))
    return docs.join(labels, "doc_id").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_SCORED = "s AS (SELECT lang, toxic AS label, round(n_chars / (n_chars + 2000), 3) AS score, CAST(round(n_chars / (n_chars + 2000), 3) >= 0.5 AS INTEGER) AS predicted FROM documents JOIN labels USING (doc_id))"
_DIV = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


def confusion_sql(by=""):
    g = f"{by}, " if by else ""
    return f"""m AS (SELECT {g}count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label <> 1 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted <> 1) AS fn, count(*) FILTER (label <> 1 AND predicted <> 1) AS tn FROM s {'GROUP BY ' + by if by else ''}),
p AS (SELECT *, {_DIV('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_DIV('tp', 'tp + fp')} AS "precision", {_DIV('tp', 'tp + fn')} AS recall, {_DIV('tn', 'tn + fp')} AS spec FROM m),
o AS (SELECT {g}tp, fp, fn, tn, accuracy, "precision", recall, {_DIV('2 * "precision" * recall', '"precision" + recall')} AS f1, (recall + spec) / 2 AS balanced_accuracy FROM p)"""


def _nine(df, *names):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def q20(spark, d):
    return _nine(metrics.macro_average(metrics.confusion(scored(spark, d), ("lang",)), "lang", ["f1", "recall", "accuracy"]))


_Q20 = ", ".join(f"round(avg({v}), 9) AS {v}_mean, round(stddev_pop({v}), 9) AS {v}_std" for v in ("f1", "recall", "accuracy"))
_CUM = "c AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM s GROUP BY score), u AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c WINDOW w AS (ORDER BY score DESC))"


def q15(spark, d):
    df = lines(spark, d).select((F.col("l_quantity") * 1500).alias("predicted"), F.col("l_extendedprice").alias("label"), "l_linestatus")
    out = metrics.regression(df, ("l_linestatus",))
    return out.select("l_linestatus", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")))


def q16(spark, d):
    s = sampling.stratified_split(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")
    return s.groupBy("o_orderstatus", "is_test").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


_H = lambda *parts: "CAST('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8) AS BIGINT)"


def q17(spark, d):
    return sampling.random_split(table(spark, d, "orders"), "o_orderkey", 0.25).groupBy("is_test").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def q18(spark, d):
    return sampling.group_split(table(spark, d, "orders"), "o_custkey", 0.25).groupBy("is_test").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("groups"), F.sum("o_orderkey").alias("key_sum"))


def q19(spark, d):
    bag = sampling.bags(table(spark, d, "orders"), "o_orderkey", 4)
    return bag.groupBy("tree_id", "multiplicity").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def rule_df(spark):
    return rules.rule_table(spark, RULES)


def q21(spark, d):
    return rules.matches(lines(spark, d), rule_df(spark), ["l_orderkey", "l_returnflag"]).groupBy("rule_id", "tree_id", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


Q21_SQL = " UNION ALL ".join(f"SELECT {i} AS rule_id, {TREE_OF[i]} AS tree_id, l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem WHERE {m} GROUP BY l_returnflag" for i, m in enumerate(MASKS))
_Y = "CAST(l_returnflag = 'R' AS INTEGER)"
_STATS = "st AS (" + " UNION ALL ".join(f"SELECT {i} AS rule_id, {TREE_OF[i]} AS tree_id, {SAYS[i]}::DOUBLE AS prediction, count(*) FILTER ({m}) AS coverage, count(*) FILTER ({m} AND {_Y} = {SAYS[i]}) AS tp, count(*) FILTER (NOT {m} AND {_Y} = {SAYS[i]}) AS fn, count(*) FILTER (NOT {m} AND {_Y} <> {SAYS[i]}) AS tn FROM lineitem" for i, m in enumerate(MASKS)) + f"), pr AS (SELECT *, {_DIV('tp', 'coverage')} AS accuracy, {_DIV('tp', 'tp + fn')} AS recall, {_DIV('tn', 'tn + coverage - tp')} AS spec FROM st), ff AS (SELECT *, {_DIV('2 * accuracy * recall', 'accuracy + recall')} AS f1, (recall + spec) / 2 AS balanced_accuracy FROM pr), fit AS (SELECT rule_id, tree_id, prediction, coverage, tp, fn, tn, accuracy, f1, balanced_accuracy, CASE WHEN f1 > 0 THEN f1 ELSE 0.01 * accuracy END * ln(1 + coverage) AS fitness FROM ff)"


def stats(spark, d):
    return rules.statistics(lines(spark, d), rule_df(spark), "is_r")


def q23(spark, d):
    return rules.first_match(lines(spark, d), rule_df(spark), 0.0).groupBy("rule_id", "predicted").agg(F.count("*").alias("n"), F.sum("is_r").alias("positives"))


Q23_SQL = "WITH f AS (SELECT CASE " + " ".join(f"WHEN {m} THEN {i}" for i, m in enumerate(MASKS)) + f" END AS rule_id, CASE " + " ".join(f"WHEN {m} THEN {SAYS[i]}::DOUBLE" for i, m in enumerate(MASKS)) + f" ELSE 0.0::DOUBLE END AS predicted, {_Y} AS y FROM lineitem) SELECT rule_id, predicted, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM f GROUP BY ALL"


def _leaves(spark, d):
    got = rules.leaf_probabilities(lines(spark, d), rule_df(spark), "is_r").collect()  # one row per rule
    return [(r["rule_id"], r["proba"]) for r in got]


def q24(spark, d):
    out = rules.forest_probability(lines(spark, d), rule_df(spark), _leaves(spark, d), 0.5)
    return out.groupBy(F.round("probability", 9).alias("probability"), "n_trees").agg(F.count("*").alias("n"))


def q25(spark, d):
    out = rules.weighted_vote(lines(spark, d), rule_df(spark), _leaves(spark, d), {0: 0.6, 1: 0.0, 2: 0.3}, 0.5)
    return out.groupBy(F.round("probability", 9).alias("probability"), "n_trees").agg(F.count("*").alias("n"))


def _vote_sql(weights):
    prob = ", ".join(f"avg(CASE WHEN {m} THEN {_Y} END) AS p{i}" for i, m in enumerate(MASKS))
    tree = ", ".join("CASE " + " ".join(f"WHEN {m} AND p{i} IS NOT NULL THEN p{i}" for i, m in enumerate(MASKS) if TREE_OF[i] == t) + f" END AS t{t}" for t in range(3))
    num = " + ".join(f"coalesce(t{t} * {weights[t]}::DOUBLE, 0.0)" for t in range(3))
    den = " + ".join(f"CASE WHEN t{t} IS NULL THEN 0.0::DOUBLE ELSE {weights[t]}::DOUBLE END" for t in range(3))
    n = " + ".join(f"CASE WHEN t{t} IS NULL THEN 0 ELSE 1 END" for t in range(3))
    return f"WITH pp AS (SELECT {prob} FROM lineitem), v AS (SELECT {tree} FROM lineitem, pp), z AS (SELECT {num} AS num, {den} AS den, {n} AS n_trees FROM v) SELECT round(CASE WHEN den = 0 THEN 0.5 ELSE num / den END, 9) AS probability, n_trees, count(*) AS n FROM z GROUP BY ALL"


def with_fitness(spark, d):
    return rule_df(spark).join(stats(spark, d).select("rule_id", "fitness", "coverage"), "rule_id")


_KEYS = {}
for _i, _t, _c, _p in RULES:
    _KEYS[_i] = "&".join(sorted(f"{c[0]}{c[1]}{c[2]:.4f}" for c in _c)) + f"=>{float(_p)}"


def q26(spark, d):
    out = rules.dedupe(with_fitness(spark, d))
    return out.select("rule_id", "tree_id", rules.rule_key().alias("rule_key"), F.round("fitness", 9).alias("fitness"))


Q26_SQL = f"WITH {_STATS}, k(rule_id, rule_key) AS (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in _KEYS.items()) + "), r AS (SELECT rule_id, tree_id, rule_key, round(fitness, 9) AS fitness, row_number() OVER (PARTITION BY rule_key ORDER BY fitness DESC, rule_id) AS pos FROM fit JOIN k USING (rule_id)) SELECT rule_id, tree_id, rule_key, fitness FROM r WHERE pos = 1"


def q27(spark, d):
    return _nine(rules.importance(with_fitness(spark, d)))


Q27_SQL = f"WITH {_STATS}, c(rule_id, feature, gain) AS (VALUES " + ", ".join(f"({r[0]}, '{c[0]}', {c[3]}::DOUBLE)" for r in RULES for c in r[2]) + f"), i AS (SELECT feature, sum(fitness * gain) / {len(RULES)} AS importance FROM fit JOIN c USING (rule_id) GROUP BY feature) SELECT feature, round(importance, 9) AS importance, round(importance / sum(importance) OVER (), 9) AS share FROM i"


def q28(spark, d):
    return rule_df(spark).select("rule_id", rule_text().alias("rule"))


def _text(cs, p):
    return "IF " + (" AND ".join(f"[{c[0]} {c[1]} {c[2]:.4f}]" for c in cs) or "TRUE") + f" THEN predict={float(p)}"


def q29(spark, d):
    return rules.contradictions(rule_df(spark))


def q49(spark, d):
    df = lines(spark, d).withColumn("node", (F.col("l_linenumber") % 3).cast("int"))
    return trees.level_splits(df, FEATURES, "is_r", size=32).select("node", "feature", F.round("threshold", 6).alias("threshold"), "n_left", "n_right", _eight("gain").alias("gain"))


def _q49_sql():
    one = split_sql(f"SELECT {_Y} AS label, CAST(l_linenumber % 3 AS VARCHAR) || ':' || f AS feature, v AS value FROM (UNPIVOT (SELECT l_returnflag, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME f VALUE v)", "entropy", size=32)
    return f"WITH per AS ({one}), n AS (SELECT CAST(split_part(feature, ':', 1) AS INTEGER) AS node, split_part(feature, ':', 2) AS feature, threshold, n_left, n_right, gain FROM per), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature) AS pos FROM n WHERE gain > 0 AND n_left >= 1 AND n_right >= 1) SELECT node, feature, threshold, n_left, n_right, gain FROM r WHERE pos = 1"


#: A fixed tree of depth 2.
TREE = [
    {"id": 0, "feature": "l_quantity", "threshold": 24.0, "counts": {0: 10, 1: 6}},
    {"id": 1, "feature": "l_discount", "threshold": 0.03, "counts": {0: 7, 1: 1}},
    {"id": 2, "feature": None, "threshold": None, "counts": {0: 3, 1: 5}},
    {"id": 3, "feature": None, "threshold": None, "counts": {0: 6}},
    {"id": 4, "feature": None, "threshold": None, "counts": {0: 1, 1: 1}},
]


def q50(spark, d):
    return trees.predict(lines(spark, d), TREE).groupBy("node", "probability").agg(F.count("*").alias("n"), F.sum("is_r").alias("positives"))


def q70(spark, d):
    def rows(ids):
        chosen = rules.rule_table(spark, [r for r in RULES if r[0] in ids])
        one = metrics.confusion(rules.first_match(lines(spark, d), chosen, 0.0).select(F.col("is_r").alias("label"), F.col("predicted").cast("int").alias("predicted")))
        return one.unpivot([], ["accuracy", "precision", "recall", "f1", "balanced_accuracy"], "metric", "value")

    return _nine(rules.compare(rows({0, 1}), rows({7})))


def _q70_sql():
    def one(name, masks):
        pred = "CASE " + " ".join(f"WHEN {MASKS[i]} THEN {int(SAYS[i])}" for i in masks) + " ELSE 0 END"
        body = confusion_sql().replace("m AS", f"{name}m AS").replace("FROM m", f"FROM {name}m").replace("p AS (SELECT *", f"{name}p AS (SELECT *").replace("FROM p)", f"FROM {name}p)").replace("o AS (", f"{name}o AS (").replace("FROM s ", f"FROM {name}s ")
        return f"{name}s AS (SELECT {_Y} AS label, {pred} AS predicted FROM lineitem), {body}, {name}u AS (SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'balanced_accuracy']) AS metric, unnest([accuracy, \"precision\", recall, f1, balanced_accuracy]) AS value FROM {name}o)"

    return f"WITH {one('x', [0, 1])}, {one('y', [7])} SELECT metric, round(coalesce(xu.value, 0.0), 9) AS first, round(coalesce(yu.value, 0.0), 9) AS second, round(coalesce(yu.value, 0.0) - coalesce(xu.value, 0.0), 9) AS difference FROM xu FULL JOIN yu USING (metric)"


def q65b(spark, d):
    """Weighted F1 of the first-match predictions."""
    out = rules.first_match(lines(spark, d), rule_df(spark), 0.0)
    return _nine(metrics.weighted_f1(out.select(F.col("is_r").alias("label"), F.col("predicted").cast("int").alias("predicted"))))


QUERIES = {
    "q01_class_weights": (
        lambda s, d: splits.class_weights(table(s, d, "lineitem"), "l_returnflag").select("label", "n", F.round("weight", 9).alias("weight")),
        "SELECT l_returnflag AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM lineitem GROUP BY l_returnflag",
    ),
    "q02_entropy_by_group": (
        lambda s, d: _impurity(s, d, "entropy"),
        "WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_linestatus, n / sum(n) OVER (PARTITION BY l_linestatus) AS p FROM c) SELECT l_linestatus, round(sum(-p * log2(p + 1e-12)), 9) AS impurity FROM p GROUP BY ALL",
    ),
    "q03_gini_by_group": (
        lambda s, d: _impurity(s, d, "gini"),
        "WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_linestatus, n / sum(n) OVER (PARTITION BY l_linestatus) AS p FROM c) SELECT l_linestatus, round(1 - sum(p * p), 9) AS impurity FROM p GROUP BY ALL",
    ),
    "q04_threshold_grid": (
        lambda s, d: splits.threshold_grid(long(s, d), 64).select("feature", F.col("j").cast("long").alias("j"), F.round("threshold", 6).alias("threshold")),
        f"WITH long AS ({_long_sql()}), grid AS (SELECT feature, unnest(list_sort(list_distinct({_grid_sql(64)}))) AS threshold FROM long GROUP BY feature) SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY threshold) - 1 AS j, round(threshold, 6) AS threshold FROM grid",
    ),
    "q05_best_split_entropy": _split("entropy"),
    "q06_best_split_gini": _split("gini"),
    "q07_best_split_gain_ratio": _split("gain_ratio"),
    "q08_best_split_chi2": _split("chi_square"),
    "q09_best_split_variance": (q09, VARIANCE_SQL),
    "q10_embedding_split": (q10, Q10_SQL),
    "q11_confusion_metrics": (lambda s, d: _nine(metrics.confusion(scored(s, d), ("lang",))), f"WITH {_SCORED}, {confusion_sql('lang')} SELECT lang, tp, fp, fn, tn, round(accuracy, 9) AS accuracy, round(\"precision\", 9) AS \"precision\", round(recall, 9) AS recall, round(f1, 9) AS f1, round(balanced_accuracy, 9) AS balanced_accuracy FROM o"),
    "q12_roc_auc": (lambda s, d: _nine(metrics.roc_auc(scored(s, d))), f"WITH {_SCORED}, {_CUM} SELECT round(sum(n * (tp - p) + n * p / 2) / (max(ap) * max(an)), 9) AS roc_auc FROM u"),
    "q13_average_precision": (lambda s, d: _nine(metrics.average_precision(scored(s, d))), f"WITH {_SCORED}, {_CUM} SELECT round(sum(p / ap * tp / (tp + fp)), 9) AS average_precision FROM u"),
    "q14_youden": (lambda s, d: _nine(metrics.youden(scored(s, d))), f"WITH {_SCORED}, {_CUM} SELECT score AS threshold, round(tp / ap - fp / an, 9) AS youden_j FROM u ORDER BY 2 DESC, 1 DESC LIMIT 1"),
    "q15_regression_metrics": (q15, "SELECT l_linestatus, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(sqrt(avg((l_extendedprice - l_quantity * 1500) * (l_extendedprice - l_quantity * 1500))), 4) AS rmse, round(1 - sum((l_extendedprice - l_quantity * 1500) * (l_extendedprice - l_quantity * 1500)) / (var_pop(l_extendedprice) * count(*)), 4) AS r2 FROM lineitem GROUP BY l_linestatus"),
    "q16_stratified_split": (q16, f"WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H('o_orderkey', '42')}, o_orderkey) <= greatest(1, floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2)) AS is_test FROM orders) SELECT o_orderstatus, is_test, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM r GROUP BY ALL"),
    "q17_random_split": (q17, f"SELECT {_H('o_orderkey', '42')} < 1073741824 AS is_test, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY ALL"),
    "q18_group_split": (q18, f"SELECT {_H('o_custkey', '42')} < 1073741824 AS is_test, count(*) AS n, count(DISTINCT o_custkey) AS groups, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY ALL"),
    "q19_bootstrap_oob": (q19, f"WITH u AS (SELECT o_orderkey, CAST(t AS INTEGER) AS tree_id, {_H('o_orderkey', 't', '42')} / 4294967296.0::DOUBLE AS u FROM orders, range(4) x(t)) SELECT tree_id, {' + '.join(f'CAST(u >= {x!r}::DOUBLE AS INTEGER)' for x in sampling.POISSON)} AS multiplicity, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM u GROUP BY ALL"),
    "q20_macro_average_rollup": (q20, f"WITH {_SCORED}, {confusion_sql('lang')} SELECT lang, count(*) AS n, {_Q20} FROM o GROUP BY lang UNION ALL SELECT 'ALL', count(*), {_Q20} FROM o"),
    "q21_rule_match": (q21, Q21_SQL),
    "q22_rule_stats": (lambda s, d: _nine(stats(s, d)), f"WITH {_STATS} SELECT rule_id, tree_id, prediction, coverage, tp, fn, tn, round(accuracy, 9) AS accuracy, round(f1, 9) AS f1, round(balanced_accuracy, 9) AS balanced_accuracy, round(fitness, 9) AS fitness FROM fit"),
    "q23_first_match": (q23, Q23_SQL),
    "q24_forest_proba": (q24, _vote_sql({0: 1.0, 1: 1.0, 2: 1.0})),
    "q25_weighted_vote": (q25, _vote_sql({0: 0.6, 1: 0.01, 2: 0.3})),
    "q26_rule_dedupe": (q26, Q26_SQL),
    "q27_importance": (q27, Q27_SQL),
    "q28_rule_text": (q28, "SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, '{_text(r[2], r[3])}')" for r in RULES) + ") t(rule_id, rule)"),
    "q29_rule_contradictions": (q29, "SELECT 2 AS rule_id, 'l_quantity' AS feature, 5.0::DOUBLE AS low, 3.0::DOUBLE AS high"),
    "q49_tree_level_split": (q49, _q49_sql()),
    "q50_tree_predict": (q50, f"WITH n AS (SELECT CASE WHEN l_quantity <= 24 THEN CASE WHEN l_discount <= 0.03::DOUBLE THEN 3 ELSE 4 END ELSE 2 END AS node, {_Y} AS y FROM lineitem) SELECT node, CASE node WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN 0.5::DOUBLE ELSE 0.625::DOUBLE END AS probability, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM n GROUP BY ALL"),
    "q70_compare_rule_sets": (q70, _q70_sql()),
    "q71_weighted_f1": (q65b, f"WITH f AS (SELECT {_Y} AS y, CASE " + " ".join(f"WHEN {m} THEN {int(SAYS[i])}" for i, m in enumerate(MASKS)) + " ELSE 0 END AS p FROM lineitem), c AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS said, count(*) FILTER (y = c AND p = c) AS hit FROM f, (VALUES (0), (1)) v(c) GROUP BY c) SELECT round(sum(2.0::DOUBLE * hit / (support + said) * support) / sum(support), 9) AS weighted_f1 FROM c"),
}


def _impurity(spark, d, kind):
    from pyspark.sql import Window

    from ..functions import impurity

    n = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"))
    p = impurity.share(F.col("n"), F.sum("n").over(Window.partitionBy("l_linestatus")))
    return n.withColumn("p", p).groupBy("l_linestatus").agg(F.round(getattr(impurity, kind)(F.col("p")), 9).alias("impurity"))
