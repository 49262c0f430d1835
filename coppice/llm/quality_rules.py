"""Quality rules whose cutoffs carry a guarantee: risk-controlled thresholds.

Every rule rejects texts whose statistic is not below a cutoff; a set of cutoffs, one for each
rule, is one step of a stratum's path. One half of a stratum's labelled texts (by hash of the id)
draws the path, from lenient to strict: at its middle, each rule's strictest cutoff that rejects
no good text of this half; before it, the same cutoffs loosened by whole cells of the grid;
after it, those that reject small shares of the good ones. The other half tests the steps in
order: a step is certified while the exact (Clopper-Pearson) upper bound on the share of good
texts that its rules reject together stays within the risk. Testing in a fixed order needs no
correction over the steps. Over strata the error probability is divided and handed on (step-down): strata
whose whole path is certified pass their part to the others. Of the certified steps, the one
that separates the other half's bad texts best is used; all of them hold at once, so choosing is
free. A stratum without certified step uses no rule: it keeps what the base rules keep.

Nulls and empty texts have no words and fail the base rule. Repeated rows are rated one by
one. A null stratum is a stratum of its own. Several labels of one document count as their
minimum; labels of unknown documents and null labels are not used. Without labels only the base rules reject.
Columns of documents other than the id, text and stratum are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

#: Statistics of a text; each rule rejects high values. Parts of: words' characters (1-3), words or lines.
RULES = ("symbol_share", "bang_share", "capital_share", "dup_line_share", "repeat_share")
#: Cutoffs of a rule, from lenient to strict.
GRID = tuple(round(1.0 - i / 64, 6) for i in range(64))
#: A path: cells of the grid by which cutoffs are loosened, then shares of the good texts that a rule may reject.
MARGINS = (32, 24, 16, 12, 8, 6, 4, 3, 2, 1, 0)
SHARES = (0.001, 0.0025, 0.005, 0.01, 0.02)
_SEED = 11
#: Strata with cutoffs up to which these are broadcast; beyond, both sides are shuffled.
BROADCAST = 100_000

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>")).astype(np.uint8)
_BANG = np.isin(np.arange(256), list(b"!?")).astype(np.uint8)
_CAPITAL = ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)
_POINT = (tx.WHITE == 1) & ((np.arange(256) < 128) | (np.arange(256) >= 192))

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bangs long, n_capitals long"


def counts(text: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    data, offsets = tx.raw(text)
    ids, at, _, _ = tx.tokens(data, offsets, tx.WHITE)
    n = np.diff(at)
    out = {"n_words": n, "word_chars": tx.per_row(_POINT[data], offsets), "n_symbols": tx.per_row(_SYMBOL[data], offsets), "n_bangs": tx.per_row(_BANG[data], offsets), "n_capitals": tx.per_row(_CAPITAL[data], offsets)}
    breaks = np.zeros(256, np.uint8)
    breaks[:] = 1
    breaks[10] = 0
    line, per, lines, _ = tx.tokens(data, offsets, breaks)
    worded = np.fromiter((bool(x.split()) for x in lines), bool, len(lines))
    row = tx.rows_of(per)
    full = worded[line] if len(line) else np.zeros(0, bool)
    row, line = row[full], line[full]
    out["n_lines"] = np.bincount(row, minlength=len(n))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(np.unique(row * max(1, len(lines)) + line) // max(1, len(lines)), minlength=len(n))
    covered = np.zeros(len(ids), bool)
    if len(ids) > 2:
        doc = tx.rows_of(at)
        one = np.flatnonzero(doc[2:] == doc[:-2])
        key = (ids[one] << 42) | (ids[one + 1] << 21) | ids[one + 2]  # fewer than 2**21 distinct words in a slice
        if len(ids) and ids.max() >= 1 << 21:
            pair = np.unique(ids[one] * (ids.max() + 1) + ids[one + 1], return_inverse=True)[1]
            key = pair * (ids.max() + 1) + ids[one + 2]
        order = np.lexsort((key, doc[one]))
        k, d = key[order], doc[one][order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(one), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(3):
            covered[one[twice] + i] = True
    out["n_repeat_words"] = tx.per_row(covered, at)
    return out


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per input row: doc_id, stratum and counts, without the text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            got = counts(part.column("text"))
            names = [x.split()[0] for x in _COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), *(pa.array(got[x].astype(np.int64)) for x in names)], names=["doc_id", "stratum", *names])

    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(stratum).cast("string").alias("stratum"))
    return few.mapInArrow(run, f"doc_id {kind}, stratum string, {_COUNTS}")


def with_rules(counted: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds base_failed and the statistics of RULES."""
    part = lambda x, of: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
            "symbol_share": part("n_symbols", "word_chars"),
            "bang_share": part("n_bangs", "word_chars"),
            "capital_share": part("n_capitals", "word_chars"),
            "dup_line_share": part("n_dup_lines", "n_lines"),
            "repeat_share": part("n_repeat_words", "n_words"),
        }
    )


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial below its mean, summed from k down; from the mean on 1, which certifies nothing."""
    if k >= n or k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = term = math.exp(log)
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, total)


def certify(good: list[int], bad: list[int], n_good: int, n_bad: int, risk: float, error: float) -> int | None:
    """Index of the step to use: rejected good and bad labelled texts are given for each step, lenient first."""
    best, gain = None, 0.0
    for i, (g, b) in enumerate(zip(good, bad, strict=True)):
        if not n_good or binomial_cdf(g, n_good, risk) > error:
            break  # the upper bound passes the risk: stricter steps are not tested
        if (now := (b / n_bad if n_bad else 0.0) - g / n_good) > gain + 1e-12:
            best, gain = i, now
    return best


def path_of(cells: Iterable[tuple]) -> list[list[int | None]]:
    """The steps, each by rule an index in GRID or null, from counts (rule, cell, good texts) of one half of a stratum. Empty without good texts."""
    good = [[0] * 65 for _ in RULES]
    for rule, cell, n in cells:
        good[rule][cell] += n
    if not (n_good := sum(good[0])):
        return []
    lost = [[sum(g[: i + 1]) for i in range(64)] for g in good]  # by cutoff: good texts rejected
    strictest = lambda rule, most: max((i for i in range(64) if lost[rule][i] <= most), default=-1)
    firm = [strictest(rule, 0) for rule in range(len(RULES))]
    steps = [[i - m if i >= m else None for i in firm] for m in MARGINS]
    steps += [[i if (i := strictest(rule, x * n_good)) >= 0 else None for rule in range(len(RULES))] for x in SHARES]
    return [x for k, x in enumerate(steps) if any(i is not None for i in x) and (not k or x != steps[k - 1])]


def hardest(good: list[int], n_good: int, risk: float) -> float:
    """The error probability at which a whole path would be certified."""
    return max((binomial_cdf(g, n_good, risk) if n_good else 1.0 for g in good), default=1.0)


def thresholds(ruled: DataFrame, labels: DataFrame, risk: float = 0.03, error: float = 0.05, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One row (stratum, at) for every stratum with labels; at: by rule, the index in GRID of the cutoff that holds, or null.

    risk: share of good texts that all rules together may reject in a stratum; error: the
    probability that any bound fails. Every stratum is tested by its own labels only, and all
    strata with labels count in the correction. Its counts are one row of at most rules * 65 cells.
    """
    marks = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(quality).alias("good"))
    cell = lambda rule: F.greatest(F.lit(0), F.least(F.lit(64), F.ceil((1.0 - F.col(rule)) * 64))).cast("int")  # noqa: E731  # cutoffs from here on reject it
    held = ruled.where(~F.col("base_failed")).select("doc_id", "stratum", F.array(*map(cell, RULES)).alias("cells")).join(marks, "doc_id")
    held = held.select("stratum", "cells", (F.col("good") == 1).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit(_SEED)), F.lit(2)) == 0).alias("draws"))
    # one half draws the paths
    counted = held.select("stratum", F.posexplode("cells").alias("rule", "cell"), (F.col("good") & F.col("draws")).cast("long").alias("n")).groupBy("stratum", "rule", "cell").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("stratum").agg(F.collect_list(F.struct("rule", "cell", "n")).alias("cells"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            paths = [path_of((x["rule"], x["cell"], x["n"]) for x in cells) for cells in part.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("stratum"), pa.array(paths, pa.list_(pa.list_(pa.int32())))], names=["stratum", "path"])

    paths = tx.settled(counted.mapInArrow(draw, "stratum string, path array<array<int>>"))
    n_strata = paths.count()
    # the other half tests them: the first step that rejects a text
    few = paths.withColumnRenamed("stratum", "_stratum")
    few = F.broadcast(few) if n_strata <= BROADCAST else few
    passes = lambda step: ~F.exists(F.zip_with("cells", step, lambda c, i: c <= i), lambda x: F.coalesce(x, F.lit(False)))
    tested = held.where(~F.col("draws")).join(few, F.col("stratum").eqNullSafe(F.col("_stratum")))
    tested = tested.select("stratum", "good", F.size(F.filter("path", passes)).alias("step")).groupBy("stratum", "step").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    tested = tested.groupBy(F.col("stratum").alias("_stratum")).agg(F.collect_list(F.struct("step", "good", "bad")).alias("steps"))
    both = paths.join(tested, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").select("stratum", "path", "steps")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = [_sums(len(path), steps or []) for path, steps in zip(part.column("path").to_pylist(), part.column("steps").to_pylist(), strict=True)]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            worst = pa.array([hardest(good, n, risk) for good, _, n, _ in out], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("stratum"), part.column("path"), *columns, worst], names=["stratum", "path", "good", "bad", "n_good", "n_bad", "worst"])

    rated = tx.settled(both.mapInArrow(rate, "stratum string, path array<array<int>>, good array<long>, bad array<long>, n_good long, n_bad long, worst double"))
    done = 0
    while done < n_strata and (now := rated.where(F.col("worst") <= error / (n_strata - done)).count()) > done:
        done = now
    share = error / max(1, n_strata - done)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = []
            for r in part.to_pylist():
                best = certify(r["good"], r["bad"], r["n_good"], r["n_bad"], risk, share)
                at.append([None] * len(RULES) if best is None else r["path"][best])
            yield pa.RecordBatch.from_arrays([part.column("stratum"), pa.array(at, pa.list_(pa.int32()))], names=["stratum", "at"])

    return tx.settled(rated.mapInArrow(choose, "stratum string, at array<int>"))


def _sums(n: int, steps: list[dict]) -> tuple[list[int], list[int], int, int]:
    """By step of a path of n: good and bad texts rejected; and how many there are. A text's step is the first that rejects it; n: none does."""
    good, bad = [0] * (n + 1), [0] * (n + 1)
    for x in steps:
        good[x["step"]] += x["good"]
        bad[x["step"]] += x["bad"]
    total = lambda x: [sum(x[: i + 1]) for i in range(n)]
    return total(good), total(bad), sum(good), sum(bad)


def verdict(ruled: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds kept: false for base failures and for texts not below a cutoff of their stratum."""
    few = cutoffs.where(F.exists("at", lambda x: x.isNotNull())).select(F.col("stratum").alias("_stratum"), "at")
    if few.count() <= BROADCAST:
        few = F.broadcast(few)
    rejected = F.lit(False)
    for i, rule in enumerate(RULES):
        # the same step as in thresholds(): equal at the grid's edges
        rejected = rejected | F.coalesce(F.ceil((1.0 - F.col(rule)) * 64) <= F.col("at")[i], F.lit(False))
    joined = ruled.join(few, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", "at")


def risk_controlled(docs: DataFrame, labels: DataFrame, risk: float = 0.03, error: float = 0.05, stratum: str = "lang") -> DataFrame:
    """Counts, statistics, base_failed and kept for every row of docs."""
    ruled = with_rules(tx.settled(measure(docs, stratum=stratum)))
    return verdict(ruled, thresholds(ruled, labels, risk, error))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return risk_controlled(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(r, 6).alias(r) for r in RULES))
