"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled by an interpolated Kneser-Ney model over bytes, one for toxic and one for
ordinary texts. The highest orders are counted for each class; the lower orders are counted
once for both (shared continuation counts), so that a word too rare to be known falls back to
its stem and then to evidence that favours neither class. A text's evidence is its
log-likelihood ratio per word, over the whole text and in its most toxic run of words; a
logistic curve turns both into a score from 0 to 1. The curve is fitted on texts scored by
models that had not seen them (two folds).

The models are fitted on a bounded sample of labelled rows: at most max_docs texts, half of
either class, and at most max_chars characters, half for either class, chosen by a hash of the id;
texts of more than a hundredth of max_chars aren't used to fit, so that none crowds out the others. One
task fits them and a model of bounded size is broadcast. No context crosses a word's border: expressions of
several ordinary words are judged by their words (and by runs of words), not as expressions. Labels of rows that `usable` excludes are never read.
Every text is scored whole. Null and empty texts score like a text without evidence. Several
labels of a document count as their maximum. Without labels of both classes all scores are 0.
Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx

ORDER = 6
#: Orders up to this one are counted over both classes together.
SHARED = 3
RUN = 6
_DISCOUNT = 0.75
_START, _END = 2, 3
_CACHE_WORDS = 400_000


def read_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data, offsets = tx.raw(text)
    lowered = np.where(tx.ALNUM[data] == 1, tx.LOWER[data], 32).astype(np.uint8)
    ids, at, vocabulary, _ = tx.tokens(lowered, offsets, tx.WHITE)
    return ids, at, vocabulary


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the last ORDER bytes at each byte of the words and at their ends, and the word of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pad = ORDER - 1
    total = lengths + pad + 1
    at = np.cumsum(total) - total
    flat = np.full(int(total.sum()), _START, np.uint8)
    body = np.frombuffer(b"".join(words), np.uint8)
    inner = np.arange(len(body)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(at, lengths) + pad + inner] = body
    flat[at + total - 1] = _END
    code = np.zeros(len(flat), np.uint64)
    for back in range(ORDER):
        code[back:] |= flat[: len(flat) - back].astype(np.uint64) << np.uint64(8 * back)
    word = np.repeat(np.arange(len(words)), total)
    spelled = (np.arange(len(flat)) - at[word]) >= pad
    return code[spelled], word[spelled]


def _low(code: np.ndarray, order: int) -> np.ndarray:
    return code & np.uint64((1 << (8 * order)) - 1)


def _group(code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their summed weights, a column for each class."""
    kinds, inverse = np.unique(code, return_inverse=True)
    return kinds, np.stack([np.bincount(inverse, weights=w, minlength=len(kinds)) for w in weights])


def fit(words: list[bytes], counts: np.ndarray) -> list[tuple]:
    """Tables of each order: n-grams and their counts, histories and their totals and kinds. counts: toxic and ordinary, by word."""
    code, word = spell(words)
    kinds, seen = _group(code, counts[:, word])
    present = (seen > 0).any(axis=0)
    kinds, seen = kinds[present], seen[:, present]
    tables: list[tuple] = [()] * (ORDER + 1)
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # continuation counts: how many kinds of byte stand before
            kinds, seen = _group(_low(kinds, order), (seen > 0).astype(np.float64))
        use = seen
        if order == SHARED:
            use = seen = seen.sum(axis=0, keepdims=True)
        history, total = _group(kinds >> np.uint64(8), use)
        _, distinct = _group(kinds >> np.uint64(8), (use > 0).astype(np.float64))
        tables[order] = (kinds, use.astype(np.float32), history, total.astype(np.float32), distinct.astype(np.float32))
    return tables


def _find(sorted_codes: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == wanted, values[:, at], 0.0)


def evidence(tables: list[tuple], words: list[bytes]) -> np.ndarray:
    """Per word: log-likelihood as a toxic text's word minus that as an ordinary text's."""
    out = np.zeros(len(words))
    for cut in range(0, len(words), 50_000):
        some = words[cut : cut + 50_000]
        code, word = spell(some)
        kinds, back = np.unique(code, return_inverse=True)
        p = np.full((1, len(kinds)), 1 / 256)
        for order in range(1, ORDER + 1):
            grams, seen, history, total, distinct = tables[order]
            c = _find(grams, _low(kinds, order), seen)
            h = _low(kinds, order) >> np.uint64(8)
            n, t = _find(history, h, total), _find(history, h, distinct)
            p = np.where(n > 0, (np.maximum(c - _DISCOUNT, 0) + _DISCOUNT * t * p) / np.maximum(n, 1e-9), p)
        ratio = np.log(p[0]) - np.log(p[1])
        out[cut : cut + len(some)] = np.bincount(word, weights=ratio[back], minlength=len(some))
    return np.round(out * 2.0**20) / 2.0**20  # sums of these are exact, in whatever order


def features(ids: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Per text: mean evidence of a word, and the highest mean of RUN consecutive words (of all, if fewer)."""
    n = np.diff(at)
    v = value[ids] if len(ids) else np.zeros(0)
    row = tx.rows_of(at)
    v[1:][(ids[1:] == ids[:-1]) & (row[1:] == row[:-1])] = 0  # a word said again at once is no further evidence
    total = np.append(0.0, np.cumsum(v))
    mean = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
    best = mean.copy()
    if len(ids) >= RUN:
        run = (total[RUN:] - total[:-RUN]) / RUN
        inside = row[RUN - 1 :] == row[: len(row) - RUN + 1]
        np.maximum.at(best, row[: len(row) - RUN + 1][inside], run[inside])
    return np.stack([mean, best, np.log1p(n)], axis=1)


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression with a small ridge, by Newton's method."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(b[:-1] / scale, b[-1])


def train(batches: Iterator[pa.RecordBatch]) -> bytes:
    """Fits tables and curve on all rows given: text, toxic (0/1), fold (0/1), weight."""
    index: dict[bytes, int] = {}
    counts = np.zeros((4, 1024))
    kept, labels, folds, weights = [], [], [], []
    for part in tx.slices(batches, "text"):
        ids, at, vocabulary = read_words(part.column("text"))
        local = np.fromiter((index.setdefault(w, len(index)) for w in vocabulary), np.int64, len(vocabulary))
        ids = local[ids] if len(ids) else ids
        if len(index) > counts.shape[1]:
            counts = np.pad(counts, ((0, 0), (0, len(index) * 2 - counts.shape[1])))
        y, fold = (part.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("toxic", "fold"))
        cell = np.repeat(2 * fold + (1 - y), np.diff(at))
        np.add.at(counts, (cell, ids), 1)
        kept.append((ids.astype(np.int32), at))
        labels.append(y)
        folds.append(fold)
        weights.append(part.column("weight").to_numpy(zero_copy_only=False))
    if not kept:
        return b""
    y, fold, weight = (np.concatenate(x) for x in (labels, folds, weights))
    if len({*y}) < 2:
        return b""
    words, counts = list(index), counts[:, : len(index)]
    x = np.zeros((len(y), 3))
    for held in (0, 1):
        by = counts[2 * (1 - held) : 2 * (1 - held) + 2]
        if (by.sum(axis=1) == 0).any():
            by = counts[:2] + counts[2:]
        if (by.sum(axis=1) == 0).any():
            return b""
        value = evidence(fit(words, by), words)
        done = 0
        for ids, at in kept:
            rows = slice(done, done + len(at) - 1)
            done += len(at) - 1
            got = features(ids, at, value)
            x[rows] = np.where((fold[rows] == held)[:, None], got, x[rows])
    return pickle.dumps((fit(words, counts[:2] + counts[2:]), curve(x, y.astype(float), weight)))


def sample(docs: DataFrame, labels: DataFrame, usable, max_docs: int, max_chars: int, seed: int, doc_id: str, text: str, toxic: str) -> DataFrame:
    """The bounded training rows: text, toxic, fold and the weight that restores the classes' shares."""
    marks = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(toxic) > 0).cast("int").alias("toxic"))
    marks = marks.where(usable(F.col("doc_id"))) if usable is not None else marks
    share = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half = max_docs // 2
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = marks.where("toxic = 1").orderBy(order, "doc_id").limit(half).union(marks.where("toxic = 0").orderBy(order, "doc_id").limit(half))
    chosen = chosen.withColumn("weight", F.when(F.col("toxic") == 1, F.lit(max(share.get(1, 0) / half, 1.0))).otherwise(F.lit(max(share.get(0, 0) / half, 1.0))))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # which texts to read is settled without them: at most max_docs ids are broadcast, and at most max_docs lengths gathered
    some = keyed.select("doc_id", "text_hash", F.length(F.coalesce("text", F.lit(""))).alias("n")).join(F.broadcast(chosen), "doc_id").distinct()
    place = (F.xxhash64("doc_id", F.lit(seed + 2)), F.col("doc_id"), F.col("text_hash"))
    some = some.where(F.col("n") <= max_chars // 100).orderBy(*place).limit(max_docs)
    upto = F.sum("n").over(Window.partitionBy("toxic").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    some = tx.settled(some.withColumn("upto", upto).where(F.col("upto") <= max_chars // 2).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "toxic", "weight"))
    rows = keyed.join(F.broadcast(some), (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("hash"))).dropDuplicates(["doc_id", "text_hash"])
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).cast("int")
    return rows.select("text", "toxic", fold.alias("fold"), "weight", F.xxhash64("doc_id", F.lit(seed + 2)).alias("place"), "doc_id", "text_hash").coalesce(1).sortWithinPartitions("place", "doc_id", "text_hash").select("text", "toxic", "fold", "weight")


def toxicity(docs: DataFrame, labels: DataFrame, usable=None, max_docs: int = 12_000, max_chars: int = 40_000_000, seed: int = 5, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """doc_id, score, predicted and the evidence per word of every row of docs. usable: Column of ids -> Column, true where a label may be used."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([train(batches)], pa.binary())], names=["model"])

    got = sample(docs, labels, usable, max_docs, max_chars, seed, doc_id, text, toxic).mapInArrow(run, "model binary").collect()
    model = spark.sparkContext.broadcast(max((bytes(r["model"]) for r in got), key=len, default=b""))
    kind = docs.schema[doc_id].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(model.value) if model.value else None
        known: dict[bytes, float] = {}
        for part in tx.slices(batches, "text"):
            ids, at, vocabulary = read_words(part.column("text"))
            if fitted is None:
                x, score = np.zeros((part.num_rows, 3)), np.zeros(part.num_rows)
            else:
                if len(known) > _CACHE_WORDS:
                    known.clear()
                new = [w for w in vocabulary if w not in known]
                known.update(zip(new, evidence(fitted[0], new).tolist(), strict=True))
                value = np.fromiter((known[w] for w in vocabulary), np.float64, len(vocabulary))
                x = features(ids, at, value)
                score = 1 / (1 + np.exp(-np.clip(x @ fitted[1][:-1] + fitted[1][-1], -30, 30)))
            score = np.round(score, 9)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.round(x[:, 0], 9)), pa.array(np.round(x[:, 1], 9))], names=["doc_id", "score", "predicted", "word_evidence", "run_evidence"])

    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return few.mapInArrow(rate, f"doc_id {kind}, score double, predicted int, word_evidence double, run_evidence double")


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string")) % 5


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = toxicity(docs, labels, usable=lambda i: fold_of(i) != 0)
    return rated.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "word_evidence", "run_evidence")
