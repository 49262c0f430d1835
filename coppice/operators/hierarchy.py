"""Class hierarchies (child, parent): closure, depth, information content, similarity, search.

Closures are recursive queries, read with LIMIT ALL: without it Spark stops them with an error at
spark.sql.cteRecursionRowLimit rows (1,000,000). A walk that comes back to its start is an error
that names the node, raised while the query runs, and so is one of more than `levels` steps: every
operator here that follows the hierarchy does so through walks(). check_acyclic() tests without a
closure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

LEVELS = 60
ROOT = "Thing"


def _view(df: DataFrame, name: str) -> str:
    view = f"coppice_{name}_{id(df)}"
    df.createOrReplaceTempView(view)
    return view


def check_acyclic(h: DataFrame, levels: int = LEVELS) -> None:
    """Raises ValueError on a cycle: nodes without parents are taken away until none is left."""
    left = h.select("child", "parent").distinct()
    for _ in range(levels + 1):
        rest = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent")
        rest = settled(rest)
        if rest.isEmpty():
            return
        left = rest
    raise ValueError(f"the hierarchy has a cycle or more than {levels} levels, e.g. at {left.orderBy('child').first()['child']!r}")


def walks(h: DataFrame, levels: int = LEVELS, bound: int | None = None) -> DataFrame:
    """(node, ancestor, dist): every distance at which an ancestor is met, itself at 0; each once.

    Only nodes with children take part in the recursion; a node without children is one step below its
    parents. So no step holds the leaves, and nothing that grows with them is broadcast.
    """
    stop = levels + 1 if bound is None else bound
    parents = h.select(F.col("parent").alias("node")).distinct()
    inner = settled(parents.join(h.select("child", "parent", F.lit(True).alias("edge")).hint("merge"), F.col("node") == F.col("child"), "left").select("node", "parent", "edge"))
    view = _view(inner, "h")
    above = h.sparkSession.sql(
        f"""WITH RECURSIVE w(node, ancestor, dist) MAX RECURSION LEVEL {levels + 2} AS (
              SELECT n, n, 0 FROM (SELECT DISTINCT node AS n FROM {view})
              UNION ALL
              SELECT DISTINCT w.node,
                CASE WHEN x.parent = w.node THEN raise_error(concat('the hierarchy has a cycle at ', w.node))
                     WHEN w.dist >= {levels} THEN raise_error(concat('the hierarchy has more than {levels} levels above ', w.node))
                     ELSE x.parent END, w.dist + 1
              FROM w JOIN {view} x ON x.node = w.ancestor AND x.edge WHERE w.dist < {stop})
            SELECT node AS met, ancestor, dist FROM (SELECT * FROM w LIMIT ALL)"""
    )
    nodes = inner.select("node").distinct()
    leaf = h.select("child", "parent").join(nodes, F.col("child").eqNullSafe(F.col("node")), "left_anti")
    start = nodes.select("node", F.col("node").alias("at"), F.lit(0).alias("step")).unionByName(leaf.where("child is not null").select(F.col("child").alias("node"), F.col("parent").alias("at"), F.lit(1).alias("step")))
    up = start.join(above.hint("merge"), F.col("at").eqNullSafe(F.col("met"))).where(F.col("dist") + F.col("step") <= stop)
    deep = F.raise_error(F.concat(F.lit(f"the hierarchy has more than {levels} levels above "), "node")).cast("string")
    every = up.select("node", F.when((F.col("step") == 1) & (F.col("dist") >= levels), deep).otherwise(F.col("ancestor")).alias("ancestor"), (F.col("dist") + F.col("step")).alias("dist"))
    return every.unionByName(leaf.select(F.col("child").alias("node"), F.col("child").alias("ancestor"), F.lit(0).alias("dist"))).distinct()


def closure(h: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, dist, longest): every ancestor of every node, itself included, at its least and greatest distance. up: walks(h), if they are there."""
    return (walks(h) if up is None else up).groupBy("node", "ancestor").agg(F.min("dist").alias("dist"), F.max("dist").alias("longest"))


def depths(h: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, depth): the longest path from a root; a root is 1, the universal root 0 (and its children 1). up: walks(h), if they are there."""
    up = (walks(h) if up is None else up).groupBy("node").agg(F.max("dist").alias("up"), F.max((F.col("ancestor") == ROOT).cast("int")).alias("under"))
    return up.select("node", (F.col("up") + F.when(F.col("under") == 1, 0).otherwise(1)).cast("int").alias("depth"))


def information_content(h: DataFrame, closed: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, descendants, ic): -log2 of the share of nodes below (itself included). nodes: a table with a row per node, if one is there."""
    c = closure(h) if closed is None else closed
    n = (c.select("node").distinct() if nodes is None else nodes).agg(F.count("*").alias("total"))
    d = c.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"))
    return d.crossJoin(F.broadcast(n)).select("node", "descendants", (-F.log2(F.col("descendants") / F.col("total"))).alias("ic"))  # one row


def pair_lca(pairs: DataFrame, closed: DataFrame, depth: DataFrame) -> DataFrame:
    """Pairs (a, b) with lca and its depth: the deepest common ancestor, the least name on ties."""
    up = closed.select("node", "ancestor")
    both = pairs.join(up.toDF("a", "ancestor"), "a").join(up.toDF("b", "ancestor"), ["b", "ancestor"])
    best = F.min(F.struct((-F.col("depth")).alias("minus"), F.col("ancestor").alias("lca"))).alias("x")
    return both.join(depth.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("a", "b").agg(best).select("a", "b", F.col("x.lca").alias("lca"), (-F.col("x.minus")).alias("lca_depth"))


def similarities(pairs: DataFrame, closed: DataFrame, depth: DataFrame, ic: DataFrame) -> DataFrame:
    """Pairs with lca, wu_palmer (2 d / (da + db)) and lin (2 ic / (ica + icb)); 1 for a pair of equals, 0 without common ground."""
    x = pair_lca(pairs, closed, depth)
    for side in ("a", "b"):
        x = x.join(depth.toDF(side, f"depth_{side}").hint("merge"), side).join(ic.select(F.col("node").alias(side), F.col("ic").alias(f"ic_{side}")).hint("merge"), side)
    x = x.join(ic.select(F.col("node").alias("lca"), F.col("ic").alias("ic_lca")), "lca")
    part = lambda up, a, b: F.coalesce(F.try_divide(2.0 * up, (a + b).cast("double")), F.lit(0.0))
    same = F.col("a") == F.col("b")
    return x.select("a", "b", "lca", F.when(same, 1.0).otherwise(part(F.col("lca_depth"), F.col("depth_a"), F.col("depth_b"))).alias("wu_palmer"), F.when(same, 1.0).otherwise(part(F.col("ic_lca"), F.col("ic_a"), F.col("ic_b"))).alias("lin"))


def taxonomic_information(depth: DataFrame, ic: DataFrame) -> DataFrame:
    """(node, ti): information content times depth over the greatest depth."""
    top = depth.agg(F.max("depth").alias("top"))
    return depth.join(ic.hint("merge"), "node").crossJoin(F.broadcast(top)).select("node", F.coalesce(F.try_divide(F.col("ic") * F.col("depth"), F.col("top").cast("double")), F.lit(0.0)).alias("ti"))  # one row


def average_information(sets: DataFrame, ti: DataFrame) -> DataFrame:
    """(set_id, ati): mean information of a set's concepts; unknown ones count 0."""
    return sets.join(ti.hint("merge"), sets["concept"] == ti["node"], "left").groupBy("set_id").agg(F.avg(F.coalesce("ti", F.lit(0.0))).alias("ati"))


def set_similarity(sets: DataFrame, closed: DataFrame, depth: DataFrame, ic: DataFrame) -> DataFrame:
    """(set_id, similarity): mean Wu-Palmer over the pairs of a set's concepts; 1 for a set of one. Each distinct pair is rated once."""
    s = sets.distinct()
    pairs = s.toDF("set_id", "a").join(s.toDF("set_id", "b"), "set_id").where("a < b")
    rated = similarities(pairs.select("a", "b").distinct(), closed, depth, ic).select("a", "b", "wu_palmer")
    mean = pairs.join(rated, ["a", "b"], "left").groupBy("set_id").agg(F.avg(F.coalesce("wu_palmer", F.lit(0.0))).alias("similarity"))
    return s.select("set_id").distinct().join(mean, "set_id", "left").select("set_id", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def jump_penalty(pairs: DataFrame, closed: DataFrame, gamma: float, p: float) -> DataFrame:
    """Pairs (src, dst) with penalty p^(gamma * (dist - 1)) where dst lies two or more levels below src, else 1."""
    down = closed.select(F.col("ancestor").alias("src"), F.col("node").alias("dst"), "dist")
    return pairs.join(down, ["src", "dst"], "left").select("src", "dst", F.when(F.col("dist") >= 2, F.pow(F.lit(p), gamma * (F.col("dist") - 1))).otherwise(1.0).alias("penalty"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour): edges in both directions, each once."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(edges.select("dst", "src")).distinct()


def unvisited(edges: DataFrame, at: DataFrame, visited: DataFrame) -> DataFrame:
    """The neighbours of the nodes in `at` that aren't in `visited`."""
    return neighbours(edges).join(at, "node", "left_semi").join(visited.toDF("neighbour"), "neighbour", "left_anti")


def reach(edges: DataFrame, start: DataFrame, bound: int) -> DataFrame:
    """(start, node, dist): breadth-first, undirected, at most `bound` steps. Each front is settled before the next."""
    both, seen = settled(neighbours(edges)), start.toDF("start").withColumns({"node": F.col("start"), "dist": F.lit(0)})
    front = seen
    for k in range(1, bound + 1):
        front = front.select("start", "node").join(both, "node").select("start", F.col("neighbour").alias("node"), F.lit(k).alias("dist")).distinct().join(seen, ["start", "node"], "left_anti")
        front = settled(front)
        seen = seen.unionByName(front)
    return seen


def zone_entropy(zones: DataFrame) -> DataFrame:
    """(entropy): of the sizes of zones (zone, node), in bits; 0 without nodes."""
    size = zones.where("node is not null").groupBy("zone").agg(F.countDistinct("node").alias("n"))
    total = size.agg(F.sum("n").alias("total"))  # one row
    p = F.col("n") / F.col("total")
    return size.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(-p * F.log2(p)), F.lit(0.0)).alias("entropy"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between the nodes given."""
    return edges.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi")


def root_of(edges: DataFrame) -> DataFrame:
    """(node): the universal root if it is there, else the node with most neighbours."""
    degree = neighbours(edges).groupBy("node").agg(F.count("*").alias("degree"))
    return degree.orderBy(F.desc(F.col("node") == ROOT), F.desc("degree"), "node").limit(1).select("node")


def sibling_edges(h: DataFrame) -> DataFrame:
    """Edges between children of one parent that follow each other by name: a chain, not all pairs."""
    after = F.lead("child").over(Window.partitionBy("parent").orderBy("child"))
    return h.select("parent", F.col("child").alias("src"), after.alias("dst")).where("dst is not null")


def representatives(nodes: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest degree of each depth."""
    rank = F.row_number().over(Window.partitionBy("depth").orderBy(F.desc("degree"), "node"))
    return nodes.withColumn("rank", rank).where(F.col("rank") <= k)


def gates(nodes: DataFrame, concepts: list[str]) -> DataFrame:
    """For each gate concept, in order: the first node whose label contains it, or a new one."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(i, c) for i, c in enumerate(concepts)], "gate_depth int, concept string")
    met = wanted.join(nodes.select("node"), F.contains(F.lower("node"), F.lower("concept")), "left")  # few concepts: the build side
    return met.groupBy("gate_depth", "concept").agg(F.min(F.struct(F.length("node").alias("n"), "node")).alias("x")).select("gate_depth", "concept", F.coalesce("x.node", F.concat(F.lit("Gate_"), "concept")).alias("node"), F.col("x.node").isNull().alias("created"))


def gate_bonus(visited, b: float) -> F.Column:
    return 1.0 + b * F.log1p(visited)


def filter_candidates(candidates: DataFrame, max_depth: int) -> DataFrame:
    """Candidates (group, node, depth) up to a depth; all of a group if none would be left."""
    ok = F.col("depth") <= max_depth
    return candidates.withColumn("_any", F.max(ok).over(Window.partitionBy("group"))).where(ok | ~F.col("_any")).drop("_any")
