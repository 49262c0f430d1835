"""The assembled learner: generations of trees of ants over bags, out-of-bag scores, fixed rules as a further tree.

In each generation every tree sends its ants over its own bag; ants move over a graph of features
and other nodes, and each step at a feature narrows the ant's rows by that feature's best split. All
trees of a generation see the same pheromones (batch mode); the elite of the generation's rules
updates them afterwards. The trees of the last generation form the forest. One job searches
the splits of all ants of all trees at a step, one counts the sides, one rates all rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import metrics, rules as R, splits
from .colony import _unit
from .sampling import multiplicity
from .splits import class_weights

#: Weight of an out-of-bag score that is lower.
LEAST = 0.01


@dataclass
class Forest:
    """rules: (rule_id, tree_id, conditions, prediction); leaves: (rule_id, probability); scores: tree -> out-of-bag accuracy; base: share of label 1."""

    rules: list[tuple]
    leaves: list[tuple]
    scores: dict[int, float]
    pheromones: dict
    base: float
    threshold: float = 0.5
    history: list[dict] = field(default_factory=list)

    def predict(self, df: DataFrame, weighted: bool = False) -> DataFrame:
        """df with probability and n_trees: the mean of the covering trees' leaves, or weighted by their scores."""
        if not self.rules:
            return df.withColumns({"probability": F.lit(self.base), "n_trees": F.lit(0)})
        table = R.rule_table(df.sparkSession, self.rules)
        if weighted:
            return R.weighted_vote(df, table, self.leaves, {t: max(s, LEAST) for t, s in self.scores.items()}, self.base)
        return R.forest_probability(df, table, self.leaves, self.base)


def start_node(nodes: list[str], features: list[str], progress: float, parts: tuple, mode: str = "auto", hub: str = "Thing") -> str:
    """Where an ant starts: at a feature with chance 0.5 + 0.3 * progress, else at the hub with chance 0.67 (if there is one), else anywhere. parts: what the draws are hashes of."""
    pick = lambda names, k: names[min(len(names) - 1, int(_unit("start", k, *parts) * len(names)))]
    if features and (mode == "feature" or mode == "auto" and _unit("feature?", *parts) < 0.5 + 0.3 * progress):
        return pick(features, "f")
    if hub in nodes and (mode == "hub" or mode == "auto" and _unit("hub?", *parts) < 0.67):
        return hub
    return pick(nodes, "n")


def ant_walk(edges: dict[tuple, float], start: str, steps: int, parts: tuple, alpha: float = 1.0, beta: float = 2.0, eta=None, revisit: bool = False) -> list[str]:
    """A walk over neighbours in both directions, by tau^alpha * eta^beta, until no unvisited neighbour is left."""
    near: dict[str, dict[str, float]] = {}
    for (a, b), tau in edges.items():
        near.setdefault(a, {})[b] = tau
        near.setdefault(b, {}).setdefault(a, edges.get((b, a), tau))
    path, seen = [start], {start}
    for step in range(steps):
        options = sorted(n for n in near.get(path[-1], {}) if revisit or n not in seen)
        if not options:
            break
        path.append(options[draw([near[path[-1]][n] ** alpha * (eta(n) if eta else 1.0) ** beta for n in options], "walk", step, *parts)])
        seen.add(path[-1])
    return path


def draw(weights: list[float], *parts) -> int:
    """An index in proportion to the weights; evenly if all are 0."""
    total = sum(weights)
    if total <= 0:
        return min(len(weights) - 1, int(_unit(*parts) * len(weights)))
    u = _unit(*parts) * total
    for i, w in enumerate(weights):
        u -= w
        if u <= 0:
            return i
    return len(weights) - 1


def fit(df: DataFrame, key: str, features: list[str], label: str, trees: int = 3, generations: int = 2, ants: int = 3, steps: int = 3, edges: dict[tuple, float] | None = None, criterion: str = "entropy", alpha: float = 1.0, beta: float = 2.0, rate: float = 0.1, ratio: float = 0.3, low: float = 0.1, high: float = 10.0, min_gain: float = 1e-6, min_leaf: int = 5, random_branch: bool = False, fixed: list[tuple] = (), fixed_fitness: dict[int, float] | None = None, seed: int = 42, size: int = 16) -> Forest:
    """A forest for a 0/1 label.

    edges: (src, dst) -> pheromone between nodes, of which those named like features split rows; all pairs of
    features are connected, too. fixed: rules (rule_id, tree_id, conditions, prediction) that mark their paths at
    the outset and make a tree of their own with score 1. random_branch: the branch is drawn by weighted purity
    instead of the purer one. What is collected: per step a row for each ant and feature, per generation one for each rule.
    """
    spark = df.sparkSession
    tau = {(a, b): 1.0 for a in features for b in features if a != b} | {("Thing", f): 1.0 for f in features} | dict(edges or {})
    nodes = sorted({n for e in tau for n in e})
    for r in fixed:
        deposit(tau, [c[0] for c in r[2]], (fixed_fitness or {}).get(r[0], 1.0) / max(1, len(r[2])), high)
    times = F.array(*(multiplicity(F.col(key), F.lit(t), seed).cast("int") for t in range(trees)))
    base = settled(df.where(F.col(label).isNotNull()).select(*features, F.col(label).cast("int").alias(label), times.alias("_times")))
    share = base.agg(F.avg(label)).first()[0]
    weights = {r["label"]: r["weight"] for r in class_weights(base, label).collect()}
    kept: dict[int, list[dict]] = {}
    history = []
    for g in range(generations):
        progress = g / max(1, generations - 1)
        walkers = []
        for t in range(trees):
            for a in range(ants):
                path = ant_walk(tau, start_node(nodes, features, progress, (seed, g, t, a)), 8 * steps, (seed, g, t, a), alpha, beta, eta=lambda n: 2.0 if n in features else 1.0)
                walkers.append({"id": len(walkers), "tree": t, "walk": [n for n in path if n in features], "nodes": path, "conditions": [], "path": []})
        live = list(walkers)
        for step in range(steps):
            live = [w for w in live if step < len(w["walk"])]
            if live:
                live = advance(base, live, step, features, label, criterion, min_gain, min_leaf, size, weights, random_branch, (seed, g))
        found = rate_rules(spark, base, [w for w in walkers if w["conditions"]], label, trees)
        for e in tau:
            tau[e] = max(low, tau[e] * (1 - rate))
        for x in sorted(found, key=lambda x: (-x["fitness"], x["tree"], x["id"]))[: max(1, math.floor(len(found) * ratio))]:
            deposit(tau, x["nodes"], x["fitness"] / max(1, len(x["nodes"])) * (2.0 if x["prediction"] == 1 and x["f1"] > 0 else 1.0), high)
        kept = {t: distinct([x for x in found if x["tree"] == t]) for t in range(trees)}
        history.append({"generation": g, "rules": len(found), "best": max((x["fitness"] for x in found), default=0.0)})
    every, leaves = [], []
    for t, some in kept.items():
        for x in some:
            leaves.append((len(every), x["probability"]))
            every.append((len(every), t, x["conditions"], x["prediction"]))
    scores = out_of_bag(spark, base, every, label, trees)
    if fixed:
        proba = {r["rule_id"]: r["proba"] for r in R.leaf_probabilities(base, R.rule_table(spark, [(r[0], trees, r[2], r[3]) for r in fixed]), label).collect()}
        for r in fixed:
            leaves.append((len(every), proba.get(r[0])))
            every.append((len(every), trees, list(r[2]), float(r[3])))
        scores[trees] = 1.0
    forest = Forest(every, [x for x in leaves if x[1] is not None], scores, tau, float(share or 0.0), history=history)
    best = metrics.youden(forest.predict(base).select(F.col(label).alias("label"), F.round("probability", 9).alias("score"))).first()
    if best and best["threshold"] is not None and 0 < (share or 0) < 1:
        forest.threshold = float(best["threshold"])
    return forest


def deposit(tau: dict, path: list[str], amount: float, high: float) -> None:
    """Adds to both directions of a path's edges, up to high."""
    for a, b in zip(path, path[1:]):
        for e in ((a, b), (b, a)):
            if e in tau:
                tau[e] = min(high, tau[e] + amount)


def distinct(found: list[dict]) -> list[dict]:
    """Rules by fitness, those of equal conditions (to four decimals) and prediction once."""
    seen: dict = {}
    for x in sorted(found, key=lambda x: (-x["fitness"], x["id"])):
        seen.setdefault((tuple(sorted((f, o, round(t, 4)) for f, o, t, _ in x["conditions"])), x["prediction"]), x)
    return list(seen.values())


def advance(base: DataFrame, live: list[dict], step: int, features: list[str], label: str, criterion: str, min_gain: float, min_leaf: int, size: int, weights: dict, random_branch: bool, parts: tuple) -> list[dict]:
    """One step of all ants: each splits its rows at the feature it stands on. Returns those that may go on."""
    mine = lambda w: R.mask(features, [dict(feature=f, operator=o, threshold=t) for f, o, t, _ in w["conditions"]])
    rows = F.filter(F.array(*(F.struct(F.lit(w["id"]).alias("ant"), F.col("_times")[w["tree"]].alias("times"), F.col(w["walk"][step]).cast("double").alias("value"), mine(w).alias("ok")) for w in live)), lambda x: x["ok"] & (x["times"] > 0) & x["value"].isNotNull() & ~F.isnan(x["value"]))
    long = base.select(F.col(label).alias("label"), F.inline(rows)).drop("ok")
    best = {r["ant"]: r for r in splits.best_splits(long, criterion, by=("ant",), size=size, weight="times").collect()}
    fine = [w for w in live if w["id"] in best and best[w["id"]]["gain"] > min_gain and min(best[w["id"]]["n_left"], best[w["id"]]["n_right"]) >= min_leaf]
    if not fine:
        return []
    cut = F.create_map(*(F.lit(x) for w in fine for x in (w["id"], float(best[w["id"]]["threshold"]))))
    counts: dict = {}
    for r in long.where(F.col("ant").isin([w["id"] for w in fine])).groupBy("ant", (F.col("value") <= cut[F.col("ant")]).alias("left"), "label").agg(F.sum("times").alias("n")).collect():
        counts.setdefault((r["ant"], r["left"]), {})[r["label"]] = r["n"]
    out = []
    for w in fine:
        sides = [counts.get((w["id"], left), {}) for left in (True, False)]
        weighted = lambda c: [n * (weights.get(y, 1.0) if random_branch else 1.0) for y, n in c.items()]
        purity = [max(weighted(c), default=0.0) / max(1e-12, sum(weighted(c))) for c in sides]
        left = draw(purity, "branch", step, w["id"], *parts) == 0 if random_branch else purity[0] >= purity[1]
        w["conditions"].append((w["walk"][step], "<=" if left else ">", best[w["id"]]["threshold"], best[w["id"]]["gain"]))
        w["counts"] = sides[0 if left else 1]
        if len(w["counts"]) > 1:
            out.append(w)
    return out


def rate_rules(spark, base: DataFrame, walkers: list[dict], label: str, trees: int) -> list[dict]:
    """Statistics of the ants' rules on their bags: one pass over the rows for all of them."""
    if not walkers:
        return []
    for w in walkers:
        w["prediction"] = float(min(w["counts"].items(), key=lambda c: (-c[1], c[0]))[0])
    mine = lambda w: R.mask(base.columns, [dict(feature=f, operator=o, threshold=t) for f, o, t, _ in w["conditions"]])
    cells = F.array(*(F.struct(F.lit(w["id"]).alias("id"), mine(w).alias("hit"), F.col("_times")[w["tree"]].alias("times")) for w in walkers))
    stats: dict = {}
    for r in base.select(F.col(label).alias("y"), F.inline(cells)).where("times > 0").groupBy("id", "hit", "y").agg(F.sum("times").alias("n")).collect():
        stats.setdefault(r["id"], {})[r["hit"], r["y"]] = r["n"]
    out = []
    for w in walkers:
        n, says = stats.get(w["id"], {}), int(w["prediction"])
        covered = sum(v for (hit, _), v in n.items() if hit)
        tp = n.get((True, says), 0)
        fn = sum(v for (hit, y), v in n.items() if not hit and y == says)
        accuracy, recall = tp / max(1, covered), tp / max(1, tp + fn)
        f1 = 2 * accuracy * recall / (accuracy + recall) if accuracy + recall else 0.0
        out.append({"id": w["id"], "tree": w["tree"], "conditions": w["conditions"], "nodes": w["nodes"], "prediction": w["prediction"], "f1": f1, "fitness": (f1 if f1 > 0 else 0.01 * accuracy) * math.log1p(covered), "probability": n.get((True, 1), 0) / max(1, covered)})
    return out


def out_of_bag(spark, base: DataFrame, found: list[tuple], label: str, trees: int) -> dict[int, float]:
    """By tree: the share of its out-of-bag rows that its first matching rule gets right, over the rows that a rule covers; 0 if none is."""
    scores = {t: 0.0 for t in range(trees)}
    if not found:
        return scores
    cells = []
    for t in range(trees):
        said = F.coalesce(*(F.when(R.mask(base.columns, [dict(feature=f, operator=o, threshold=x) for f, o, x, _ in c]), F.lit(p)) for _, tree, c, p in found if tree == t), F.lit(None).cast("double"))
        cells.append(F.struct(F.lit(t).alias("tree"), F.when(F.col("_times")[t] == 0, said).alias("said")))
    for r in base.select(label, F.inline(F.array(*cells))).where("said is not null").groupBy("tree").agg(F.avg((F.col("said") == F.col(label)).cast("double")).alias("score")).collect():
        scores[r["tree"]] = r["score"]
    return scores


def best_candidate(gains: dict[int, float], heuristic: dict[int, float], ants: int = 10, iterations: int = 5, alpha: float = 1.0, beta: float = 1.0, rate: float = 0.1, q: float = 1.0, explore: float = 0.1, seed: int = 42, last: int = 10) -> tuple[int | None, float]:
    """A colony's search over candidates: index and gain of the best one met, the first on ties.

    gains: of all candidates, from one job; those missing (they don't split) are met in vain. If no ant meets one that splits, the `last` with most pheromone are tried.
    """
    names = sorted(heuristic)
    if not names:
        return None, -1.0
    tau = {i: 1.0 for i in names}
    best, top = None, -1.0
    for k in range(iterations):
        for a in range(ants):
            if _unit(seed, "explore", k, a) < explore:
                i = names[min(len(names) - 1, int(_unit(seed, "any", k, a) * len(names)))]
            else:
                i = names[draw([max(tau[n], 1e-12) ** alpha * max(heuristic[n], 1e-9) ** beta for n in names], seed, "pick", k, a)]
            if i not in gains:
                continue
            if gains[i] > top:
                best, top = i, gains[i]
            tau[i] += q * max(0.0, gains[i])
        tau = {n: max(x * (1 - rate), 1e-12) for n, x in tau.items()}
    if best is None:
        for i in sorted(names, key=lambda n: (-tau[n], n))[:last]:
            if gains.get(i, -1.0) > top:
                best, top = i, gains[i]
    return best, top


def probe(flags: DataFrame, columns: list[str], label: str, key: str, rows: int = 128, seed: int = 42) -> DataFrame:
    """(predicate, heuristic): the fall of Gini impurity on `rows` rows chosen by hash, times 0.5 + 0.5 * balance of the sides; 1e-9 at least. The probe's size is its feature."""
    from ..sources.tables import hashed

    some = flags.where(F.col(label).isNotNull()).orderBy(hashed(F.col(key), F.lit(seed)), key).limit(rows)
    counts = some.select(F.col(label).alias("y"), *(F.col(c).cast("int").alias(c) for c in columns)).unpivot(["y"], columns, "predicate", "side").groupBy("predicate", "side", "y").agg(F.count("*").alias("n"))
    sides = counts.groupBy("predicate", "side").agg(F.sum("n").alias("n"), (1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"))
    whole = counts.groupBy("predicate", "y").agg(F.sum("n").alias("n")).groupBy("predicate").agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("all"), F.sum("n").alias("total"))
    both = sides.groupBy("predicate").agg(F.count("*").alias("k"), F.sum(F.col("n") * F.col("gini")).alias("inside"), F.min("n").alias("few"), F.max("n").alias("many")).join(whole, "predicate")
    drop = F.greatest(F.lit(0.0), F.col("all") - F.col("inside") / F.col("total")) * (0.5 + 0.5 * F.col("few") / F.col("many"))
    return both.select("predicate", F.when(F.col("k") < 2, 1e-9).otherwise(F.greatest(F.lit(1e-9), drop)).alias("heuristic"))


def sweep(score, base: dict, grid: dict[str, list]) -> list[tuple[str, object, float]]:
    """An ablation: each value of each parameter on its own, the others as in base: (parameter, value, score)."""
    return [(name, value, score(base | {name: value})) for name, values in grid.items() for value in values]
