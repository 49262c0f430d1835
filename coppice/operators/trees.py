"""Decision trees built level by level: one job scores all nodes of a depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import splits


def level_splits(df: DataFrame, features: list[str], label: str, node: str = "node", criterion: str = "entropy", min_gain: float = 0.0, min_leaf: int = 1, size: int = 32, weight: str | None = None) -> DataFrame:
    """(node, feature, threshold, n_left, n_right, gain): the best split of each node, the first feature by name on ties; nodes without one are missing."""
    long = splits.unpivot(df, features, label, (node, weight) if weight else (node,))
    per = splits.best_splits(long, criterion, by=(node, "feature"), size=size, weight=weight)
    ok = per.where((F.col("gain") > min_gain) & (F.col("n_left") >= min_leaf) & (F.col("n_right") >= min_leaf))
    order = Window.partitionBy(node).orderBy(F.desc("gain"), "feature")
    return ok.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fit_trees(df: DataFrame, features: list[str], label: str, tree: str, trees: int, depth: int = 3, criterion: str = "entropy", min_gain: float = 1e-9, min_leaf: int = 1, size: int = 32, weight: str | None = None) -> list[list[dict]]:
    """Trees 0, 1, ... trees - 1, each on the rows whose column `tree` names it: one job scores the open nodes of a depth in all of them.

    A tree is its nodes (id, feature, threshold, counts); children of i are 2 i + 1 and 2 i + 2. A row counts weight times.
    At most trees * 2^depth rows a label reach the driver per level.
    """
    forest: list[dict[int, dict]] = [{} for _ in range(trees)]
    span = 2 ** (depth + 1)  # a node's number among all trees is tree * span + id
    now = df.select(*dict.fromkeys([*features, label, tree, *([weight] if weight else [])])).where(F.col(label).isNotNull())
    now = settled(now.where(F.col(weight) > 0) if weight else now)  # each level scans it three times
    for level in range(depth + 1):
        low, high = 2**level - 1, 2 ** (level + 1) - 1
        node = F.lit(None).cast("int")
        for t, nodes in enumerate(forest):
            node = F.when(F.col(tree) == t, node_of(nodes)).otherwise(node)
        at = now.withColumn("_id", node).where((F.col("_id") >= low) & (F.col("_id") < high)).withColumn("node", F.col(tree) * span + F.col("_id"))
        for r in at.groupBy("node", F.col(label).alias("y")).agg((F.sum(weight) if weight else F.count("*")).alias("n")).collect():
            t, i = divmod(r["node"], span)
            forest[t].setdefault(i, {"id": i, "feature": None, "threshold": None, "counts": {}})["counts"][r["y"]] = r["n"]
        open_ = [t * span + i for t, nodes in enumerate(forest) for i, x in nodes.items() if low <= i < high and len(x["counts"]) > 1]
        if level == depth or not open_:
            break
        for r in level_splits(at.where(F.col("node").isin(open_)), features, label, criterion=criterion, min_gain=min_gain, min_leaf=min_leaf, size=size, weight=weight).collect():
            t, i = divmod(r["node"], span)
            forest[t][i] |= {"feature": r["feature"], "threshold": r["threshold"], "gain": r["gain"]}
    return [[nodes[i] for i in sorted(nodes)] for nodes in forest]


def fit_tree(df: DataFrame, features: list[str], label: str, depth: int = 3, criterion: str = "entropy", min_gain: float = 1e-9, min_leaf: int = 1, size: int = 32, weight: str | None = None) -> list[dict]:
    """One tree, on all rows."""
    return fit_trees(df.withColumn("_tree", F.lit(0)), features, label, "_tree", 1, depth, criterion, min_gain, min_leaf, size, weight)[0]


def node_of(nodes: dict[int, dict], i: int = 0) -> F.Column:
    """The leaf that a row falls into, as nested CASE; null features go right."""
    x = nodes.get(i)
    if not x or x["feature"] is None:
        return F.lit(i)
    return F.when(F.col(x["feature"]) <= x["threshold"], node_of(nodes, 2 * i + 1)).otherwise(node_of(nodes, 2 * i + 2))


def predict(df: DataFrame, tree: list[dict]) -> DataFrame:
    """df with node and probability (share of label 1 in the leaf; 0.5 for a leaf without rows)."""
    nodes = {x["id"]: x for x in tree}
    share = {i: x["counts"].get(1, 0) / max(1, sum(x["counts"].values())) for i, x in nodes.items()}
    table = F.create_map(*(F.lit(v) for i, p in share.items() for v in (i, float(p)))) if share else F.lit(None).cast("map<int, double>")
    return df.withColumn("node", node_of(nodes)).withColumn("probability", F.coalesce(F.try_element_at(table, F.col("node")), F.lit(0.5)))


def rules_of(tree: list[dict], tree_id: int = 0) -> list[tuple]:
    """The leaves as rules (rule_id, tree_id, conditions, majority class)."""
    nodes, out = {x["id"]: x for x in tree}, []

    def walk(i: int, conditions: list) -> None:
        x = nodes.get(i)
        if not x:
            return
        if x["feature"] is None:
            best = min(x["counts"].items(), key=lambda c: (-c[1], c[0]))[0]
            out.append((len(out), tree_id, conditions, float(best)))
            return
        walk(2 * i + 1, [*conditions, (x["feature"], "<=", x["threshold"], x.get("gain", 0.0))])
        walk(2 * i + 2, [*conditions, (x["feature"], ">", x["threshold"], x.get("gain", 0.0))])

    walk(0, [])
    return out


def binned(df: DataFrame, features: list[str], keep: list[str], size: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """keep and, for each feature, the number of its thresholds below the value (null for no value), written out once; and the thresholds, quantiles over all rows."""
    grid: dict[str, list[float]] = {f: [] for f in features}
    for r in splits.threshold_grid(splits.unpivot(df.withColumn("_y", F.lit(0)), features, "_y"), size).orderBy("feature", "j").collect():  # features * size rows
        grid[r["feature"]].append(r["threshold"])

    def bin_of(f):
        x = F.col(f).cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x), sum(((x > t).cast("int") for t in grid[f]), F.lit(0))).cast("short").alias(f)

    return settled(df.select(*keep, *(bin_of(f) for f in features))), grid


def fit_forest(df: DataFrame, key: str, features: list[str], label: str, trees: int = 3, depth: int = 2, seed: int = 42, size: int = 32, criterion: str = "entropy", min_gain: float = 1e-9) -> list[list[dict]]:
    """Bagged trees; each one's multiplicities come from the hash of (key, tree, seed).

    Features are cut once at the quantiles of all rows. A level is one aggregation of the bins over the
    open nodes of all trees: a row stands once, with its multiplicities in a list, and meets each tree in memory.
    """
    from .sampling import multiplicity

    times = F.array(*(multiplicity(F.col(key), F.lit(t), seed).cast("int") for t in range(trees))).alias("_times")
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_label"), times, *features)
    rows, grid = binned(rows, features, ["_label", "_times"], size)
    table = df.sparkSession.createDataFrame([(f, j, t) for f in features for j, t in enumerate(grid[f])], "feature string, j int, threshold double")
    forest: list[dict[int, dict]] = [{} for _ in range(trees)]
    cuts = {f: {t: j for j, t in enumerate(ts)} for f, ts in grid.items()}
    span = 2 ** (depth + 1)
    for level in range(depth + 1):
        low, high = 2**level - 1, 2 ** (level + 1) - 1
        at = [F.struct((t * span + _bin_node(nodes, cuts)).alias("node"), _bin_node(nodes, cuts).alias("id"), F.col("_times")[t].alias("n")) for t, nodes in enumerate(forest)]
        meets = F.filter(F.array(*at), lambda x: (x["n"] > 0) & (x["id"] >= low) & (x["id"] < high))
        open_rows = rows.select("_label", *features, F.inline(meets))
        bins = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("bucket")) for f in features), F.struct(F.lit(None).cast("string").alias("feature"), F.lit(0).alias("bucket"))))
        counted = settled(open_rows.select("_label", "node", "n", bins).where("bucket is not null").groupBy("node", "feature", F.col("_label").alias("label"), "bucket").agg(F.sum("n").cast("long").alias("n")))
        for r in counted.where("feature is null").collect():  # trees * 2^depth rows a label
            t, i = divmod(r["node"], span)
            forest[t].setdefault(i, {"id": i, "feature": None, "threshold": None, "counts": {}})["counts"][r["label"]] = r["n"]
        if level == depth or not any(low <= i < high and len(x["counts"]) > 1 for nodes in forest for i, x in nodes.items()):
            break
        summed = counted.where("feature is not null").groupBy("node", "feature", "label").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bucket", "n")).alias("buckets"))
        left = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.when(b["bucket"] <= F.col("j"), b["n"]).otherwise(0))
        sides = summed.join(F.broadcast(table), "feature").select("node", "feature", "j", "threshold", "label", "n", left.alias("left"))
        per = splits.best(splits.gains(sides, criterion, by=("node", "feature")), ("node", "feature"))
        order = Window.partitionBy("node").orderBy(F.desc("gain"), "feature")
        for r in per.where(F.col("gain") > min_gain).withColumn("_n", F.row_number().over(order)).where("_n = 1").collect():
            t, i = divmod(r["node"], span)
            forest[t][i] |= {"feature": r["feature"], "threshold": r["threshold"], "gain": r["gain"]}
    return [[nodes[i] for i in sorted(nodes)] for nodes in forest]


def _bin_node(nodes: dict[int, dict], cuts: dict, i: int = 0) -> F.Column:
    """node_of() over bins: a value is at most the j-th threshold if no more than j are below it."""
    x = nodes.get(i)
    if not x or x["feature"] is None:
        return F.lit(i)
    return F.when(F.col(x["feature"]) <= cuts[x["feature"]][x["threshold"]], _bin_node(nodes, cuts, 2 * i + 1)).otherwise(_bin_node(nodes, cuts, 2 * i + 2))


def forest_predict(df: DataFrame, forest: list[list[dict]]) -> DataFrame:
    """df with probability: the mean of the trees'."""
    names = []
    for t, tree in enumerate(forest):
        df = predict(df, tree).withColumnRenamed("probability", f"_p{t}").drop("node")
        names.append(F.col(f"_p{t}"))
    return df.withColumn("probability", sum(names[1:], names[0]) / len(names)).drop(*(f"_p{t}" for t in range(len(forest))))
