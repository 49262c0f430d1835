"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two bag models over hashed n-grams (words and marks, alone and in pairs) are estimated: one
from target texts (labelled as good), one from all raw texts. The log-ratio of the two, summed
over a text's n-grams, is the text's log importance weight; adding Gumbel noise and taking the k
largest keys samples k texts without replacement in proportion to their weights. The noise is a
hash of seed, id and text: reruns agree, whatever the partitioning.

The raw model counts every text. The target model may be fitted on a bounded sample of labelled
rows (max_target rows, chosen by hash): only their ids are broadcast. If no k is given, it is
set from labelled texts that were kept out of the target model (a fifth of the good ones, all
bad ones): k is the number of texts, of all, with keys from the border on that separates these best,
where losing a share of the good ones costs ten times what keeping a share of the bad ones does.
In either case the k-th largest key of all texts is found exactly, and keys from it on are selected.

Null and empty texts have no n-grams and weight 0. Repeated rows are separate candidates; equal
rows have equal keys and are kept or dropped together where k is derived; with a given k the
ties at the border are all kept. Without labels nothing is known and everything is kept.
Labels of unknown documents and null labels are not used. Other columns travel along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

#: Buckets that n-grams are hashed to: the size of either model.
BUCKETS = 16384
_SEED = 7


def grams(text: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts, and their offsets: each token, each pair of neighbours.

    A token repeated at once counts as a mark of its own in place of the pair, so that one bucket gathers repetition of any word.
    """
    data, offsets = tx.raw(text)
    ids, at, vocabulary, _ = tx.tokens(tx.LOWER[data], offsets, tx.WORDPUNCT)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in vocabulary), np.uint64, len(vocabulary))[ids] if len(ids) else np.zeros(0, np.uint64)
    row = tx.rows_of(at)
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    both = tx.mix(hashes[pair] * np.uint64(3) + hashes[pair + 1])
    both[ids[pair] == ids[pair + 1]] = np.uint64(1)
    all_rows = np.concatenate([row, row[pair]])
    out = (np.concatenate([hashes, both]) % np.uint64(buckets)).astype(np.int64)
    return all_rows, out


def count_models(marked: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all texts and of target texts; marked has text and target (boolean). One row per bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in tx.slices(batches, "text"):
            row, gram = grams(part.column("text"), buckets)
            raw += np.bincount(gram, minlength=buckets)
            wanted = part.column("target").to_numpy(zero_copy_only=False).astype(bool)
            target += np.bincount(gram[wanted[row]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    got = marked.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # at most `buckets` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in got:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float = 10.0) -> np.ndarray:
    """Per bucket: log of the target count over the count that the raw model expects, both with `smooth` further occurrences."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    return np.log((target + smooth) / (raw * (target.sum() / raw.sum()) + smooth))


def border_of(good: np.ndarray, bad: np.ndarray, cost: float) -> float:
    """The border that best separates held-out texts, nearer to the bad ones: a rejected share of good ones counts cost times."""
    if not len(bad) or not len(good):
        return float("-inf")
    keys = np.unique(np.concatenate([good, bad]))
    gain = np.searchsorted(np.sort(bad), keys) / len(bad) - cost * np.searchsorted(np.sort(good), keys) / len(good)
    at = int(gain.argmax())
    return float(keys[at - 1] + (keys[at] - keys[at - 1]) / 4) if gain[at] > 0 else float("-inf")


def weigh(docs: DataFrame, ratio, buckets: int, span: int, text: str, names: list[str], added: tuple[str, ...] = ("n_grams", "log_weight")) -> DataFrame:
    """names of docs with n_grams and log_weight (or so named as in added) of the text; the text is passed on only if it is named.

    A text of more than span n-grams weighs as span of them would on average: the models' errors add up, too.
    """
    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[n] for n in names]).add(added[0], "long").add(added[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = ratio.value
        for part in tx.slices(batches, text):
            row, gram = grams(part.column(text), buckets)
            n = part.num_rows
            total = np.bincount(row, weights=values[gram], minlength=n) if len(row) else np.zeros(n)
            size = np.bincount(row, minlength=n).astype(np.int64)
            weight = total * np.minimum(1.0, span / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(size), pa.array(np.round(weight, 9))], names=[*names, *added])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def gumbel(noise) -> F.Column:
    """Standard Gumbel noise from a 64-bit hash."""
    u = (F.shiftrightunsigned(noise, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a double column, exactly: its cell of an even grid is found by counting and cut into a grid again.

    Each round sends at most 32768 counts to the driver; nothing is sorted or gathered.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    left = k
    while low is not None and low < high and (width := (high - low) / 32767) > 0:
        cell = F.least(F.lit(32767), F.floor((F.col(key) - F.lit(low)) / F.lit(width))).cast("int")
        cells = sorted(df.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), key=lambda r: -r["c"])
        for r in cells:
            if left <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            left -= r["n"]
    return low


def fit(docs: DataFrame, labels: DataFrame, k: int | None, cost: float, max_target: int, buckets: int, span: int, seed: int, doc_id: str, text: str, quality: str):
    """The broadcast log-ratios, every text's key (doc_id, n_grams, log_weight, gumbel_key), and the border from which on keys are selected."""
    spark = docs.sparkSession
    marks = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("label_id")).agg(F.min(quality).alias("good"))
    marks = marks.withColumn("held", (F.col("good") != 1) | (F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(5)) == 0))
    # at most max_target ids are broadcast: the sample that the target model is fitted on and k is derived from
    marks = marks.orderBy(F.xxhash64("label_id", F.lit(seed + 1)), "label_id").limit(max_target).select("label_id", "held", "good")
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = some.join(F.broadcast(marks), some["doc_id"] == marks["label_id"], "left").withColumn("target", F.coalesce(~F.col("held"), F.lit(False)))
    raw, target = count_models(marked.select("text", "target"), buckets)
    ratio = spark.sparkContext.broadcast(log_ratio(raw, target))
    hashed = marked.withColumn("row_hash", F.xxhash64("doc_id", "text", F.lit(seed)))
    weighed = weigh(hashed, ratio, buckets, span, "text", ["doc_id", "held", "good", "row_hash"])
    keyed = tx.settled(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("row_hash"))))
    if k is None:
        held = keyed.where("held").select("good", F.col("gumbel_key").alias("key")).distinct().collect()  # texts of at most max_target ids
        of = lambda yes: np.array([r["key"] for r in held if (r["good"] == 1) == yes])
        k = keyed.where(F.col("gumbel_key") >= F.lit(border_of(of(True), of(False), cost))).count()
    border = kth_largest(keyed, "gumbel_key", k) if k > 0 else None
    border = float("inf") if border is None else border
    return ratio, keyed.drop("held", "good", "row_hash"), border


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, cost: float = 10.0, max_target: int = 50_000, buckets: int = BUCKETS, span: int = 256, seed: int = 1, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and selected for every row of docs."""
    _, keyed, border = fit(docs, labels, k, cost, max_target, buckets, span, seed, doc_id, text, quality)
    return keyed.withColumn("selected", F.col("gumbel_key") >= F.lit(border))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None, cost: float = 10.0, max_target: int = 50_000, buckets: int = BUCKETS, span: int = 256, seed: int = 1, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """The rows of docs that resample() selects, with all their columns. Texts are weighed again in place: they are not shuffled."""
    ratio, _, border = fit(docs, labels, k, cost, max_target, buckets, span, seed, doc_id, text, quality)
    names = tx.free_names(docs, "n_grams", "log_weight")
    weighed = weigh(docs, ratio, buckets, span, text, docs.columns, names)
    key = F.col(names[1]) + gumbel(F.xxhash64(doc_id, text, F.lit(seed)))
    return weighed.where(key >= F.lit(border)).select(*docs.columns)


def op3_importance(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels)
