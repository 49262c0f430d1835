"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a run of whole texts that one Python worker holds. Its suffix array holds the word
positions at which a match can start: every word of a matching window occurs in the benchmark,
so a position is left out if an unknown word or the end of the text comes sooner than the
shortest window. The suffixes are sorted as far as the longest benchmark item reaches. Every
benchmark suffix is then binary-searched for its window (10 words, or the whole item if that
is shorter): the range found holds all occurrences. Runs of occurrences that continue each
other are joined to the longest verbatim matches, reported with their locations.

The benchmark is read in blocks of bounded size, each broadcast and searched in a pass of its
own; the texts are never shuffled, and what is found travels in the row. Null and empty texts
have no words; benchmark items without words, or null, have no windows. Repeated rows of
documents are rated one by one; items with equal text all count; rows of one item_id count
as one item; a null item_id is reported as "null". Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

WINDOW = 10
#: Bytes of benchmark text searched in one pass: the bound of what is broadcast.
BLOCK_BYTES = 8_000_000

_NORMAL = np.where(tx.ALNUM == 1, tx.LOWER, 32).astype(np.uint8)


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word ids, word offsets of the texts, and the distinct lower-cased words."""
    data, offsets = tx.raw(text)
    ids, at, vocabulary, _ = tx.tokens(_NORMAL[data], offsets, tx.WHITE)
    return ids, at, vocabulary


class Block:
    """Benchmark items as word ids: all that a pass searches for."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        items = [(str(i) if i is not None else "null", t) for i, t in items]
        ids, at, vocabulary = words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.ids, self.at, self.names = ids + 1, at, [i for i, _ in items]
        length = np.diff(at)
        row = tx.rows_of(at)
        left = at[1:][row] - np.arange(len(ids))
        size = np.minimum(length, window)[row]
        self.starts = np.flatnonzero(left >= size)  # a window at each
        self.size, self.item = size[self.starts], row[self.starts]
        self.shortest = int(self.size.min()) if len(self.starts) else 0
        self.longest = int(length.max()) if len(items) else 0


def suffix_array(ids: np.ndarray, ends: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """The chosen positions, sorted by the words from there to their text's end or as far as depth.

    ends: the end of the text of each position. Prefix doubling; only positions whose order is still open are sorted again.
    """
    n = len(ids)
    rank = np.append(ids, 0).astype(np.int64)  # of every position, by its first `span` words
    span, every = 1, np.arange(n)
    open_ = chosen
    while span < depth and len(open_):
        # positions that are not chosen are needed as continuations: all ranks are refined
        after = every + span
        follow = np.where(after < ends, rank[np.minimum(after, n)], -1) + 1
        key = rank[:n] * (follow.max() + 1) + follow
        _, named = np.unique(key, return_inverse=True)
        rank = np.append(named + 1, 0)
        span *= 2
        order = np.sort(rank[chosen])
        open_ = order[1:][order[1:] == order[:-1]]
    return chosen[np.argsort(rank[chosen], kind="stable")]


def search(ids: np.ndarray, ends: np.ndarray, suffixes: np.ndarray, block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the block, the range of the suffix array whose suffixes begin with it: binary search for all at once."""
    reach = np.arange(window)
    mask = reach[None, :] < block.size[:, None]
    wanted = np.where(mask, block.ids[np.minimum(block.starts[:, None] + reach, len(block.ids) - 1)], 0)

    def bound(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(suffixes), np.int64)
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) // 2
            at = suffixes[middle][:, None] + reach
            there = np.where((at < ends[suffixes[middle]][:, None]) & mask[live], ids[np.minimum(at, len(ids) - 1)], 0)
            differ = there != wanted[live]
            first = differ.argmax(axis=1)
            rows = np.arange(len(live))
            less = there[rows, first] < wanted[live][rows, first]
            if after_equal:
                less |= ~differ.any(axis=1)
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
        return low

    return bound(False), bound(True)


def match(text: pa.Array, block: Block, window: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Number of words per text and, per text with a match: (text, window starts in words, window sizes, items, item positions)."""
    ids, at, vocabulary = words(text)
    n = np.diff(at)
    if not len(ids) or not block.shortest:
        return n, []
    known = np.fromiter((block.vocabulary.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))[ids]
    row = tx.rows_of(at)
    ends = at[1:][row]
    # the run of known words from each position on, within the text
    stop = np.flatnonzero(known == 0)
    where = np.searchsorted(stop, np.arange(len(ids)))
    run = np.minimum(np.append(stop, len(ids))[where], ends) - np.arange(len(ids))
    chosen = np.flatnonzero(run >= block.shortest)
    if not len(chosen):
        return n, []
    # only the words that a chosen suffix can reach are kept, so that sorting costs as much as can match
    reach = np.minimum(run[chosen], block.longest)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, chosen, 1)
    np.add.at(edge, chosen + reach, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    place = np.searchsorted(kept, chosen)
    jump = np.append(np.flatnonzero((np.diff(kept) != 1) | (np.diff(row[kept]) != 0)) + 1, len(kept))
    end = jump[np.searchsorted(jump, np.arange(len(kept)), side="right")]
    suffixes = suffix_array(known[kept], end, place, block.longest)
    low, high = search(known[kept], end, suffixes, block, window)
    hits = high - low
    which = np.repeat(np.arange(len(hits)), hits)
    if not len(which):
        return n, []
    inner = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)
    position = kept[suffixes[low[which] + inner]]
    text_row = row[position]
    order = np.argsort(text_row, kind="stable")
    cuts = np.searchsorted(text_row[order], np.arange(len(n) + 1))
    found = []
    for r in np.unique(text_row):
        o = order[cuts[r] : cuts[r + 1]]
        w = which[o]
        found.append((int(r), position[o] - at[r], block.size[w], block.item[w], block.starts[w]))
    return n, found


def longest(start: np.ndarray, size: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[int, int, int]:
    """The longest verbatim match (words, first word in the text, item) of windows that continue each other; first on ties."""
    order = np.lexsort((start, place - start, item))
    s, i, d = start[order], item[order], (place - start)[order]
    fresh = np.append(True, (np.diff(s) != 1) | (np.diff(i) != 0) | (np.diff(d) != 0))
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(s))) - 1 + size[order][begin]
    best = min(range(len(begin)), key=lambda k: (-length[k], s[begin[k]], i[begin[k]]))
    return int(length[best]), int(s[begin[best]]), int(i[begin[best]])


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark's rows, a bounded number of bytes at a time; the rows of one item stay in order of text."""
    part, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        if part and size + len(r["t"] or "") > limit:
            yield part
            part, size = [], 0
        part.append((r["i"], r["t"]))
        size += len(r["t"] or "")
    yield part


#: What is found of a text; the columns' names have a prefix.
_FOUND = "spans binary, items array<string>, n long, longest int, longest_at int, longest_item string"
PREFIX = "found_"


def _pass(docs: DataFrame, block, window: int, text: str, prefix: str) -> DataFrame:
    """docs with its found columns brought up to date by the items of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for part in tx.slices(batches, text):
            columns = {f.name: part.column(i) for i, f in enumerate(part.schema)}
            n, found = match(columns[text], b, window)
            spans, items = columns[f"{prefix}spans"].to_pylist(), columns[f"{prefix}items"].to_pylist()
            top, top_at, top_item = (columns[prefix + x].to_pylist() for x in ("longest", "longest_at", "longest_item"))
            for r, start, size, item, place in found:
                edges = np.zeros(int(n[r]) + 1, np.int32)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + size, -1)
                old = np.frombuffer(spans[r] or b"", np.int32).reshape(-1, 2)
                np.add.at(edges, old[:, 0], 1)
                np.add.at(edges, old[:, 1], -1)
                inside = np.append(False, np.cumsum(edges) > 0).astype(np.int8)
                change = np.flatnonzero(np.diff(inside))
                spans[r] = change.astype(np.int32).tobytes()
                items[r] = sorted({*(items[r] or ()), *(b.names[k] for k in np.unique(item))})
                length, at, of = longest(start, size, item, place)
                if length > (top[r] or 0):
                    top[r], top_at[r], top_item[r] = length, at, b.names[of]
            new = (("spans", spans, pa.binary()), ("items", items, pa.list_(pa.string())), ("n", n.astype(np.int64), pa.int64()), ("longest", top, pa.int32()), ("longest_at", top_at, pa.int32()), ("longest_item", top_item, pa.string()))
            columns |= {prefix + name: pa.array(x, kind) for name, x, kind in new}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = PREFIX) -> DataFrame:
    """docs with found_n words, found_spans (int32 pairs: hit words, from, to), found_items, and the longest verbatim match with its location.

    One block of the benchmark is on the driver and broadcast at a time: where there is another one, what was found so far is written out and the block let go.
    """
    spark = docs.sparkSession
    if taken := [c for c in docs.columns if c.lower().startswith(prefix)]:
        raise ValueError(f"choose another prefix: docs has {taken}")
    out, held = docs.withColumns({prefix + c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _FOUND.split(", ")}), None
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        if held:
            out = tx.settled(out)
            held.destroy()
        held = spark.sparkContext.broadcast(Block(items, window))
        out = _pass(out, held, window, text, prefix)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit word; their columns are kept as they are, whatever their names."""
    prefix = PREFIX
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return overlaps(docs, benchmark, window=window, prefix=prefix).where(F.col(f"{prefix}items").isNull()).select(*docs.columns)


def report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of overlaps() as counts and a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            hit = [int(np.diff(np.frombuffer(x, np.int32).reshape(-1, 2), axis=1).sum()) if x else 0 for x in part.column("found_spans").to_pylist()]
            items = [x or [] for x in part.column("found_items").to_pylist()]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("found_n"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit]), part.column("found_longest"), part.column("found_longest_at"), part.column("found_longest_item")],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "longest_item"],
            )

    kind = found.schema[doc_id].dataType.simpleString()
    few = found.select(F.col(doc_id).alias("doc_id"), "found_n", "found_spans", "found_items", "found_longest", "found_longest_at", "found_longest_item")
    return few.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match int, longest_at int, longest_item string")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return report(overlaps(docs.select("doc_id", "text"), benchmark)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
