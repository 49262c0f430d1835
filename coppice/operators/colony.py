"""Ant-colony rule search over a feature graph.

Edges (src, dst, pheromone) are updated with joins and aggregations. A search runs in generations:
all ants of one see the same pheromones (batch mode), which one elite update changes afterwards.
Each step of an ant is a best-split search over the rows that its conditions leave. Every random
choice is a hash of seed, generation, tree, ant and step.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rules as R
from . import splits


def evaporate(edges: DataFrame, rate: float, floor: float) -> DataFrame:
    """pheromone * (1 - rate), at least the floor; static edges keep theirs."""
    return edges.withColumn("pheromone", F.when(F.col("static"), F.col("pheromone")).otherwise(F.greatest(F.col("pheromone") * (1 - rate), F.lit(floor))))


def path_edges(paths: DataFrame) -> DataFrame:
    """(path_id, src, dst, amount) of paths (path_id, nodes, amount): each step in both directions."""
    steps = paths.select("path_id", "amount", F.posexplode("nodes").alias("i", "src"))
    steps = steps.withColumn("dst", F.lead("src").over(Window.partitionBy("path_id").orderBy("i"))).where("dst is not null").select("path_id", "src", "dst", "amount")
    return steps.unionByName(steps.select("path_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "amount"))


def deposit(edges: DataFrame, paths: DataFrame, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Edges with the amounts of the paths that use them added, kept between low and high; steps along no edge are ignored."""
    sums = path_edges(paths).groupBy("src", "dst").agg(F.sum("amount").alias("added"))
    out = edges.join(sums, ["src", "dst"], "left")
    new = F.least(F.greatest(F.col("pheromone") + F.coalesce("added", F.lit(0.0)), F.lit(low)), F.lit(high))
    return out.withColumn("pheromone", F.when(F.col("static"), F.col("pheromone")).otherwise(new)).drop("added").select(*edges.columns)


def elite_update(edges: DataFrame, found: DataFrame, rate: float, ratio: float, low: float, high: float) -> DataFrame:
    """Evaporation, then deposits of the best max(1, floor(n * ratio)) paths (path_id, nodes, fitness, prediction, f1): fitness over length, twice for a positive prediction with f1 above 0."""
    ranked = found.withColumns({"_r": F.row_number().over(Window.orderBy(F.desc("fitness"), "path_id")), "_n": F.count("*").over(Window.partitionBy())})
    top = ranked.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)))
    amount = F.col("fitness") / F.greatest(F.size("nodes"), F.lit(1)) * F.when((F.col("prediction") == 1) & (F.col("f1") > 0), 2.0).otherwise(1.0)
    return deposit(evaporate(edges, rate, low), top.select("path_id", "nodes", amount.alias("amount")), low, high)


def inject(edges: DataFrame, fixed: DataFrame, high: float) -> DataFrame:
    """Deposits of fixed rules' paths (path_id, nodes, fitness): fitness over length, or 1 over length without fitness; at most high."""
    amount = F.coalesce("fitness", F.lit(1.0)) / F.greatest(F.size("nodes"), F.lit(1))
    return deposit(edges, fixed.select("path_id", "nodes", amount.alias("amount")), 0.0, high)


def transition(candidates: DataFrame, alpha: float, beta: float) -> DataFrame:
    """(src, dst, probability) of candidates (src, dst, pheromone, eta, used): tau^alpha * eta^beta, eta halved for used features."""
    w = F.pow("pheromone", F.lit(alpha)) * F.pow(F.col("eta") * F.when(F.col("used"), 0.5).otherwise(1.0), F.lit(beta))
    return candidates.withColumn("w", w).select("src", "dst", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("src"))), F.lit(0.0)).alias("probability"))


def roulette(probabilities: DataFrame, seed: int) -> DataFrame:
    """(src, dst): one draw per src, in proportion: the least -ln(u) / p with u from a hash."""
    from ..sources.tables import hashed

    u = (hashed(F.col("src"), F.col("dst"), F.lit(seed)) + 0.5) / float(2**32)
    race = F.min(F.struct((-F.log(u) / F.col("probability")).alias("t"), "dst")).alias("x")
    return probabilities.where("probability > 0").groupBy("src").agg(race).select("src", F.col("x.dst").alias("dst"))


def interpret(paths: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k paths (path_id, nodes, fitness) with most mean pheromone on their edges, then most fitness: a report of length k."""
    one_way = paths.select("path_id", "fitness", F.posexplode("nodes").alias("i", "src"))
    one_way = one_way.withColumn("dst", F.lead("src").over(Window.partitionBy("path_id").orderBy("i"))).where("dst is not null")
    rated = one_way.join(edges, ["src", "dst"], "left").groupBy("path_id").agg(F.max("fitness").alias("fitness"), F.avg(F.coalesce("pheromone", F.lit(0.0))).alias("mean_pheromone"), F.max(F.coalesce("pheromone", F.lit(0.0))).alias("max_pheromone"))
    return rated.orderBy(F.desc("mean_pheromone"), F.desc("fitness"), "path_id").limit(k)


def pheromone_summary(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.avg("pheromone").alias("mean"), F.stddev_pop("pheromone").alias("std"), F.max("pheromone").alias("max"), F.avg((F.col("pheromone") <= threshold).cast("double")).alias("sparsity"))


def clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns kept inside prior bounds; nulls stay."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), F.col(c)))) for c, (a, b) in bounds.items()})


def chain(names: list[str], level: float = 1.0) -> list[tuple[str, str, str, float, bool]]:
    """Static edges of a chain of classes, both ways."""
    return [(a, b, "chain", level, True) for x, y in zip(names, names[1:]) for a, b in ((x, y), (y, x))]


def feature_subgraph(spark, features: list[str], edges: DataFrame | None = None, pheromone: float = 1.0) -> DataFrame:
    """All ordered pairs of different features that have no edge yet. The number of features is the width of a table."""
    f = spark.createDataFrame([(x,) for x in features], "src string")
    pairs = f.join(f.toDF("dst"), F.col("src") != F.col("dst"))
    pairs = pairs if edges is None else pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return pairs.withColumns({"pheromone": F.lit(pheromone), "static": F.lit(False)})


def pocket(df: DataFrame, fitted: DataFrame, proxies: dict[str, list[str]]) -> DataFrame:
    """Adds a 0/1 column per pocket: 1 if at least half of its proxies reach the medians of the fitted (training) rows."""
    names = sorted({c for cs in proxies.values() for c in cs})
    medians = fitted.agg(*(F.median(c).alias(c) for c in names)).first()  # one row
    reached = lambda c: F.when(F.col(c) >= medians[c], 1.0).otherwise(0.0)
    return df.withColumns({p: F.when(sum((reached(c) for c in cs[1:]), reached(cs[0])) / len(cs) >= 0.5, 1).otherwise(0) for p, cs in proxies.items()})


def eta_modifier(prior, static, is_pocket) -> F.Column:
    return F.when(prior, 1.5).otherwise(1.0) * F.when(static, 2.0).otherwise(1.0) * F.when(is_pocket, 3.0).otherwise(1.0)


def _unit(*parts) -> float:
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def _copies(df: DataFrame, features: list[str], label: str, sets: list) -> DataFrame:
    """(features, label, node): a copy of a row for each set of conditions that it fulfils; node is the set's place."""
    met = F.array(*(F.when(R.mask(features, [dict(feature=f, operator=o, threshold=t) for f, o, t in sorted(c)]), F.lit(i)) for i, c in enumerate(sets)))
    return df.select(*features, label, F.explode(F.array_compact(met)).alias("node"))


def colony_fit(df: DataFrame, features: list[str], label: str, generations: int = 2, ants: int = 3, steps: int = 3, alpha: float = 1.0, beta: float = 2.0, rate: float = 0.1, ratio: float = 0.3, low: float = 0.1, high: float = 10.0, min_gain: float = 1e-6, min_leaf: int = 5, seed: int = 42, tree_id: int = 0) -> tuple[list[tuple], dict]:
    """Rules (rule_id, tree_id, conditions, prediction) of the last generation, deduplicated, and the pheromones.

    All ants of a generation and step share two jobs: one finds the best split of every feature for every ant's rows, one counts the chosen sides.
    Ants under equal conditions share their rows, and rows once rated or counted are not read again in later generations.
    """
    tau = {(a, b): 1.0 for a in ["start", *features] for b in features if a != b}
    found: list[dict] = []
    splits_of: dict = {}  # conditions -> feature -> the best split of the rows that they leave
    sides_of: dict = {}  # (conditions, feature) -> side of that split -> label -> n
    under = lambda w: frozenset((f, o, t) for f, o, t, _ in w["conditions"])
    base = df.select(*features, label).where(F.col(label).isNotNull())
    for g in range(generations):
        walks = [{"ant": a, "at": "start", "conditions": [], "path": ["start"], "used": set()} for a in range(ants)]
        live = list(walks)
        for step in range(steps):
            if not live:
                break
            if new := sorted({under(w) for w in live} - set(splits_of), key=sorted):
                for r in splits.best_splits(splits.unpivot(_copies(base, features, label, new), features, label, ("node",)), "entropy", by=("node", "feature"), size=16).collect():
                    splits_of.setdefault(new[r["node"]], {})[r["feature"]] = r
            gain = {(w["ant"], f): r for w in live for f, r in splits_of.get(under(w), {}).items()}
            chosen = []
            for w in live:
                options = [f for f in features if (w["at"], f) in tau and (w["ant"], f) in gain]
                weights = [tau[w["at"], f] ** alpha * ((2 + 10 * gain[w["ant"], f]["gain"]) * (0.5 if f in w["used"] else 1)) ** beta for f in options]
                if not options:
                    continue
                u, pick = _unit(seed, tree_id, g, w["ant"], step) * sum(weights), options[-1]
                for f, x in zip(options, weights):
                    u -= x
                    if u <= 0:
                        pick = f
                        break
                s = gain[w["ant"], pick]
                if s["gain"] > min_gain and min(s["n_left"], s["n_right"]) >= min_leaf:
                    chosen.append((w, pick, s))
            if not chosen:
                break
            at = {(under(w), f): s["threshold"] for w, f, s in chosen if (under(w), f) not in sides_of}
            if at:
                side = F.coalesce(*(F.when(F.col("node") == i, (F.col(f) <= t).cast("int")) for i, ((_, f), t) in enumerate(at.items())))
                for r in _copies(base, features, label, [c for c, _ in at]).groupBy("node", side.alias("side"), F.col(label).alias("y")).agg(F.count("*").alias("n")).collect():
                    sides_of.setdefault(list(at)[r["node"]], {}).setdefault(r["side"], {})[r["y"]] = r["n"]
            live = []
            for w, f, s in chosen:
                counts = sides_of[under(w), f]
                purity = lambda k, c=counts: max(c.get(k, {0: 0}).values()) / max(1, sum(c.get(k, {}).values()))
                left = purity(1) >= purity(0)  # the purer side; the left one on ties
                w["conditions"].append((f, "<=" if left else ">", s["threshold"], s["gain"]))
                w["path"].append(f)
                w["used"].add(f)
                w["at"] = f
                w["counts"] = counts[int(left)]
                if len(w["counts"]) > 1:
                    live.append(w)
        done = [w for w in walks if w["conditions"]]
        table = [(w["ant"], tree_id, w["conditions"], float(min(w["counts"].items(), key=lambda c: (-c[1], c[0]))[0])) for w in done]
        stats = {r["rule_id"]: r for r in R.statistics(base, R.rule_table(df.sparkSession, table), label).collect()} if table else {}
        found = sorted(({"rule": t, "path": w["path"], "fitness": stats[t[0]]["fitness"], "f1": stats[t[0]]["f1"]} for w, t in zip(done, table)), key=lambda x: (-x["fitness"], x["rule"][0]))
        for e in tau:
            tau[e] = max(low, tau[e] * (1 - rate))
        for x in found[: max(1, math.floor(len(found) * ratio))]:
            amount = x["fitness"] / len(x["path"]) * (2.0 if x["rule"][3] == 1 and x["f1"] > 0 else 1.0)
            for a, b in zip(x["path"], x["path"][1:]):
                for e in ((a, b), (b, a)):
                    if e in tau:
                        tau[e] = min(high, tau[e] + amount)
    unique = {}
    for x in found:
        unique.setdefault((tuple(sorted((f, o, round(t, 4)) for f, o, t, _ in x["rule"][2])), x["rule"][3]), x["rule"])
    return [(i, t, c, p) for i, (_, t, c, p) in enumerate(unique.values())], tau


def random_search(score, space: dict[str, list], trials: int, seed: int = 42) -> tuple[dict, float]:
    """The best of hash-drawn parameter sets by score (of validation rows, never of test rows)."""
    best: tuple[dict, float] = ({}, float("-inf"))
    for i in range(trials):
        chosen = {k: v[int(_unit(seed, i, k) * len(v))] for k, v in sorted(space.items())}
        if (s := score(chosen)) > best[1]:
            best = (chosen, s)
    return best
