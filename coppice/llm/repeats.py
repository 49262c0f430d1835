"""Removal of repeated strings with sampled suffix arrays and common-prefix interval trees.

A rule says what counts as a repeat: a run of `length` symbols that also starts anywhere else,
in another text or the same one. Symbols are the bytes of the UTF-8 text, or its words
`[^\x20\x09-\x0D]+` (a word stands for the 64-bit hash of its bytes; white space between words
doesn't matter). Strings are judged on the input; matches never cross texts. Several rules are
applied in one pass over the texts.

No machine holds the suffix array of the corpus, so suffixes are sampled by content: an anchor
is the position of the least hashed k-gram in some window of `length` symbols (leftmost on ties).
Equal windows choose equal anchors, so each repeated window contains an anchor whose k-gram
occurs elsewhere, too, with equal surroundings. All occurrences of an anchor's k-gram form a
group; what can matter of each is its context, the symbols from `length` - k before the anchor to
`length` after its start.

1. Occurrences are sorted by k-gram and context. Where two have equal contexts (by hashes of
   62 bits for the k-gram and 64 for the context), every window with the anchor is repeated; nothing else is needed for them. The sorted
   rows are read once, with two rows of state.
2. For anchors with several different contexts, one occurrence of each context is fetched. The
   group's right contexts are sorted: the part of the corpus's suffix array that starts at the
   anchor. A stack scan over the common prefixes of neighbours yields the tree of common-prefix
   intervals. In each interval, of common prefix R, the left contexts are tested for diversity:
   occurrences that agree in at least `length` - R symbols to the left are the occurrences of a
   maximal repeat, which reaches from their common left extension to R.
3. K-grams with a very large share of all anchors (estimated on a sample of the texts: it only
   decides the way taken, either is exact) have their contexts counted by hash, with
   pre-aggregation before the shuffle. Anchors with `hot` different contexts or more (counted,
   not estimated) aren't gathered in a task: the windows around them are hashed and counted.

The union of these spans is exact. repeat_groups() gives the repeats themselves instead: all
occurrences of each, from the nodes of both trees (right contexts, and in each of their intervals
the left contexts).

Null is empty; texts shorter than `length` are never changed.
Repeated rows are copies of each other. An empty table gives an empty result. Other columns travel
along, whatever their names, or are ignored (report).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx


class Rule(NamedTuple):
    """A run of `length` symbols is a repeat; `gram` symbols make an anchor."""

    length: int
    gram: int
    words: bool = False


#: Strings of 400 bytes.
STRINGS = Rule(400, 160)
#: Passages of 50 words.
PASSAGES = Rule(50, 16, words=True)
#: Different contexts of one anchor from which on they aren't gathered in a task, and estimated occurrences from which on they are counted by hash.
HOT = 100_000
#: At most so many anchors are broadcast.
MOST_HOT = 10_000
#: One text in so many is read to find anchors with many occurrences.
SAMPLE = 16
#: The low bits of an anchor's hash hold its rule's number.
RULE_BITS = 3
#: Bytes of a word's hash that contexts hold.
WORD_BYTES = 5

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values: from prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def prefix_sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of symbol * base**position (wrapping) before each position, and the factors that scale a difference back to its start."""
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(symbols)), out=total[1:])
    return total, powers(_INVERSE, len(symbols) + 1)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as 64-bit hashes, the word offsets of the rows, and the bytes at which words start and end."""
    keep = tx.WHITE[data] != 0
    starts, ends = keep.copy(), keep.copy()
    starts[1:] &= ~keep[:-1]
    ends[:-1] &= ~keep[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first], ends[last] = keep[first], keep[last]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total, back = prefix_sums(data)
    return tx.mix((total[to] - total[at]) * back[at]), np.searchsorted(at, offsets), at, to


def anchors_of_windows(symbols: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of at least `length` symbols, and the hashes of all k-grams."""
    total, back = prefix_sums(symbols)
    hashed = tx.mix((total[rule.gram :] - total[: -rule.gram]) * back[: len(symbols) - rule.gram + 1])
    least = sliding_min((hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64), rule.length - rule.gram + 1)
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashed


def anchors(symbols: np.ndarray, offsets: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all texts, in order, and the hashes of their k-grams."""
    length = rule.length
    if len(symbols) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, hashed = anchors_of_windows(symbols, rule)
    size = np.diff(offsets)
    edge = np.zeros(len(symbols) + 1, np.int8)
    full = size >= length
    np.add.at(edge, offsets[:-1][full], 1)
    np.add.at(edge, offsets[1:][full] - length + 1, -1)
    place = place[np.cumsum(edge[: len(place)]) > 0]
    place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
    return place, hashed[place]


def find_anchors(keyed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """kid, kh, pos, a (hash of the k-gram, with the rule's number) and c (hash of the context) of every anchor."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            data, ends = tx.raw(part.column("text"))
            for number, rule in enumerate(rules):
                symbols, offsets = word_symbols(data, ends)[:2] if rule.words else (data, ends)
                place, hashed = anchors(symbols, offsets, rule)
                row = np.searchsorted(offsets, place, side="right") - 1
                low = np.maximum(offsets[row], place - (rule.length - rule.gram))
                high = np.minimum(offsets[row + 1], place + rule.length)
                view, size = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
                context = np.array([digest(view[x * size : y * size], z) for x, y, z in zip(low.tolist(), high.tolist(), (place - low).tolist(), strict=True)], np.uint64)
                kid, kh = (part.column(x).to_numpy(zero_copy_only=False)[row] for x in ("kid", "kh"))
                a = (hashed & ~np.uint64(RULE_BITS)) | np.uint64(number)
                columns = [pa.array(x) for x in (kid, kh, (place - offsets[row]).astype(np.int32), a.view(np.int64), context.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["kid", "kh", "pos", "a", "c"])

    return keyed.select("kid", "kh", "text").mapInArrow(run, "kid long, kh long, pos int, a long, c long")


def frequent_anchors(keyed: DataFrame, rules: Sequence[Rule], hot: int) -> DataFrame:
    """The k-grams (a) that probably occur hot times or more: MOST_HOT rows at most. Rows are drawn one by one, so that copies, or texts under one id, aren't all left out together."""
    some = find_anchors(keyed.where(F.rand(7) < 1 / SAMPLE) if hot > SAMPLE else keyed, rules)
    least = hot // SAMPLE if hot > SAMPLE else hot
    return some.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "a").limit(MOST_HOT).select("a")


def sort_out(found: DataFrame) -> DataFrame:
    """Of anchors, all of a k-gram in one partition and sorted by k-gram and context: those to use, by kind.

    whole: another occurrence has the same context. detail: the first of a context, for k-grams with several contexts.
    """
    names = ("kid", "kh", "pos", "a", "c")

    def batch_of(x: dict, whole: bool) -> pa.RecordBatch:
        n = len(x["a"])
        return pa.RecordBatch.from_arrays([*(pa.array(x[k]) for k in names[:4]), pa.array(np.full(n, whole)), pa.array(np.full(n, not whole))], names=[*names[:4], "whole", "detail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, matched = None, False  # the row before, and whether it has the context of the one before it
        first, several = None, False  # the first row of the group, as long as the group has one context
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            if last is not None:
                x = {k: np.append(last[k], x[k]) for k in names}
            n, old = len(x["a"]), int(last is not None)
            same_a = np.append(False, x["a"][1:] == x["a"][:-1])
            same = same_a & np.append(False, x["c"][1:] == x["c"][:-1])
            group = np.cumsum(~same_a) - 1
            many = np.bincount(group, weights=same_a & ~same) > 0
            many[0] |= bool(old and several)
            same[0] = bool(old and matched)
            whole = same[:-1] | same[1:]
            yield batch_of({k: x[k][:-1][whole] for k in names}, True)
            fresh = ~same & many[group]
            fresh[:old] = False
            yield batch_of({k: x[k][fresh] for k in names}, False)
            if first is not None and many[0]:
                yield batch_of(first, False)
            if many[-1]:
                first = None
            elif group[-1] or not old:
                start = int(np.searchsorted(group, group[-1]))
                first = {k: x[k][start : start + 1].copy() for k in names}
            several, matched = bool(many[-1]), bool(same[-1])
            last = {k: x[k][-1:].copy() for k in names}
        if matched:
            yield batch_of(last, True)

    return found.repartition("a").sortWithinPartitions("a", "c").mapInArrow(run, "kid long, kh long, pos int, a long, whole boolean, detail boolean")


def sort_out_hot(found: DataFrame) -> DataFrame:
    """The same by counting: for k-grams that are too frequent to be gathered."""
    same = found.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("kid", "kh", "pos")).alias("rep"))
    whole = found.join(tx.settled(same.where("n > 1").select("a", "c")), ["a", "c"]).select("kid", "kh", "pos", "a", F.lit(True).alias("whole"), F.lit(False).alias("detail"))
    return whole.unionByName(same.select("rep.*", "a", F.lit(False).alias("whole"), F.lit(True).alias("detail")))


def common(a: bytes, b: bytes, size: int) -> int:
    """Symbols of `size` bytes that two strings have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // size
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // size


def neighbours(strings: list[bytes], width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings, and the common prefix of each with the one before (from the second on), in symbols of `size` bytes."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    flat = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(strings), width)
    full = np.array([len(strings[i]) for i in order])
    differ = flat[1:] != flat[:-1]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.array(order), np.minimum(prefix, np.minimum(full[1:], full[:-1])) // size


def intervals(prefix: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (first, last, length) with a common prefix of at least `least`: stack scan, children before parents."""
    stack = [(0, 0)]  # (first, common prefix)
    for i, p in enumerate([*prefix.tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][1] > p:
            first, length = stack.pop()
            if length >= least:
                yield first, i - 1, length
        if not stack or stack[-1][1] < p:
            stack.append((first, p))


class RangeMin:
    """Minima of ranges of an array, many at once."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 ** len(self.rows) <= len(x):
            half = 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of x[low:high], for high > low."""
        level = np.floor(np.log2(high - low)).astype(np.int64)
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.rows[k][low[some]], self.rows[k][high[some] - 2**k])
        return out


def repeats(left: list[bytes], right: list[bytes], rule: Rule) -> list[tuple[int, int, int]]:
    """(occurrence, symbols to the left, symbols to the right) of the maximal repeats of at least `length` symbols around an anchor; left contexts are given reversed."""
    length, gram, size = rule.length, rule.gram, WORD_BYTES if rule.words else 1
    if len(left) == 2:
        x, y = common(left[0], left[1], size), common(right[0], right[1], size)
        return [(0, x, y), (1, x, y)] if x + y >= length and y >= gram else []
    order, prefix = neighbours(right, length * size, size)
    back, before = neighbours(left, (length - gram) * size, size)
    rank = np.empty(len(left), np.int64)
    rank[back] = np.arange(len(left))
    least = RangeMin(before.astype(np.int64))
    out = []
    for first, last, reach in intervals(prefix, gram):
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        r = rank[members]
        shared = least(r[:-1], r[1:])
        enough = shared >= length - reach
        if not enough.any():  # every two differ too soon to the left
            continue
        best = np.zeros(len(members), np.int64)
        best[1:] = np.where(enough, shared, 0)
        best[:-1] = np.maximum(best[:-1], np.where(enough, shared, 0))
        hit = best >= max(1, length - reach)
        if reach >= length:
            hit = np.append(False, enough) | np.append(enough, False)
        out += [(m, b, reach) for m, b in zip(members[hit].tolist(), best[hit].tolist(), strict=True)]
    return out


def _contexts(texts: DataFrame, rules: Sequence[Rule], kid: str, kh: str, text: str, detail: str, more: Sequence[str] = (), word_bytes: int = WORD_BYTES) -> DataFrame:
    """The contexts of rows (kid, kh, text, detail: array of (a, pos) and, where named in more, further long fields), whatever their other columns."""
    names = ["a", "kid", "kh", "pos", "left", "right", *more]

    def packed(symbols: np.ndarray) -> bytes:
        return symbols.tobytes() if symbols.itemsize == 1 else np.ascontiguousarray(symbols).view(np.uint8).reshape(-1, 8)[:, :word_bytes].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, text, 1_000_000):
            data, ends = tx.raw(part.column(text))
            views = [word_symbols(data, ends)[:2] if rule.words else (data, ends) for rule in rules]
            out: list[list] = [[] for _ in names]
            for r, (i, h, at) in enumerate(zip(*(part.column(x).to_pylist() for x in (kid, kh, detail)), strict=True)):
                whole = [symbols[offsets[r] : offsets[r + 1]] for symbols, offsets in views]
                for x in at:
                    p, rule, symbols = x["pos"], rules[x["a"] & RULE_BITS], whole[x["a"] & RULE_BITS]
                    before = symbols[max(0, p - (rule.length - rule.gram)) : p][::-1]
                    for column, value in zip(out, (x["a"], i, h, p, packed(before), packed(symbols[p : p + rule.length]), *(x[m] for m in more)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *(pa.int64() for _ in more))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    return texts.mapInArrow(run, ", ".join(["a long, kid long, kh long, pos int, left binary, right binary", *(f"{m} long" for m in more)]))


def _spans_of_groups(contexts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Spans (kid, kh, rule, low, high) from contexts, all of an anchor in one partition, together, and equal places next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            anchor, some = None, []
            for batch in batches:
                for row in zip(*(batch.column(x).to_pylist() for x in ("a", "kid", "kh", "pos", "left", "right")), strict=True):
                    if row[0] != anchor:
                        yield anchor, some
                        anchor, some = row[0], []
                    if not some or row[:4] != some[-1][:4]:  # repeated rows give one place many times
                        some.append(row)
            yield anchor, some

        out: list[tuple] = []
        for a, some in groups():
            if len(some) > 1:
                number = a & RULE_BITS
                found = repeats([r[4] for r in some], [r[5] for r in some], rules[number])
                out += {(some[i][1], some[i][2], number, some[i][3] - x, some[i][3] + y) for i, x, y in found}
            if len(out) > 20_000:
                yield _span_batch(out)
                out = []
        if out:
            yield _span_batch(out)

    return contexts.mapInArrow(run, "kid long, kh long, rule int, low int, high int")


def _span_batch(spans: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*spans, strict=True), kinds, strict=True)], names=["kid", "kh", "rule", "low", "high"])


def _spans_of_hot(contexts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Spans of anchors with very many contexts: the windows around each are hashed and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, kid, kh, pos, left, right in zip(*(batch.column(x).to_pylist() for x in ("a", "kid", "kh", "pos", "left", "right")), strict=True):
                number = a & RULE_BITS
                rule, size = rules[number], WORD_BYTES if rules[number].words else 1
                back, after = (np.frombuffer(x, np.uint8).reshape(-1, size) for x in (left, right))
                symbols = np.concatenate([back[::-1], after])
                starts = range(len(symbols) - rule.length + 1)
                hashes = [xxhash.xxh3_128_digest(symbols[i : i + rule.length].tobytes(), number) for i in starts]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([kid] * n, pa.int64()), pa.array([kh] * n, pa.int64()), pa.array([number] * n, pa.int32()), pa.array([pos - len(back) + i for i in starts], pa.int32()), pa.array(hashes, pa.binary())], names=["kid", "kh", "rule", "low", "w"])

    windows = contexts.mapInArrow(run, "kid long, kh long, rule int, low int, w binary")
    place = F.struct("kid", "kh", "low")  # one window can stand around several anchors
    twice = windows.groupBy("w").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one != other").select("w")
    return windows.join(tx.settled(twice), "w").select("kid", "kh", "rule", "low", (F.col("low") + F.element_at(F.array(*(F.lit(r.length) for r in rules)), F.col("rule") + 1)).alias("high"))


def repeated_spans(docs: DataFrame, rules: Sequence[Rule] = (STRINGS,), hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """docs, all columns, and one more, whose name is returned: the repeats (array of (rule, low, high) in symbols, not clipped to the text), or null."""
    kid, kh, detail, found_at = tx.free_names(docs, "row_id", "row_hash", "detail", "spans")
    keyed = docs.withColumns({kid: F.xxhash64(doc_id), kh: F.xxhash64(text)})
    short = keyed.select(F.col(kid).alias("kid"), F.col(kh).alias("kh"), F.col(text).alias("text"))
    found = find_anchors(short, rules)
    frequent = tx.settled(frequent_anchors(short, rules, hot))
    if frequent.count():
        # MOST_HOT rows at most; what has these k-grams is used three times, so it is found once
        counted = tx.settled(found.join(F.broadcast(frequent), "a", "left_semi"))
        used = sort_out(found.join(F.broadcast(frequent), "a", "left_anti")).unionByName(sort_out_hot(counted))
    else:
        used = sort_out(found)
    # a text's own anchors, as a set: bounded by its length
    rule = F.col("a").bitwiseAND(RULE_BITS).cast("int").alias("rule")
    per_text = used.groupBy("kid", "kh").agg(F.collect_set(F.when(F.col("whole"), F.struct(rule, "pos"))).alias("whole"), F.collect_set(F.when(F.col("detail"), F.struct("a", "pos"))).alias("detail"))
    per_text = tx.settled(per_text)
    crowded = tx.settled(per_text.select(F.explode("detail.a").alias("a")).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= hot).select("a"))
    # all columns of the texts go into both joins, so that both read one exchange
    contexts = _contexts(keyed.join(per_text.where(F.size("detail") > 0).select(F.col("kid").alias(kid), F.col("kh").alias(kh), F.col("detail").alias(detail)), [kid, kh]), rules, kid, kh, text, detail)
    if many := crowded.count():
        hottest = F.broadcast(crowded) if many <= MOST_HOT else crowded
        cold = contexts.join(hottest, "a", "left_anti")
    else:
        cold = contexts
    spans = _spans_of_groups(cold.select("a", "kid", "kh", "pos", "left", "right").repartition("a").sortWithinPartitions("a", "kid", "kh", "pos"), rules)
    if many:
        spans = spans.unionByName(_spans_of_hot(contexts.join(hottest, "a", "left_semi").select("a", "kid", "kh", "pos", "left", "right"), rules))
    spans = spans.groupBy("kid", "kh").agg(F.collect_set(F.struct("rule", "low", "high")).alias("spans"))
    reach, back = (F.array(*(F.lit(x(r)) for r in rules)) for x in (lambda r: r.length, lambda r: r.length - r.gram))
    around = F.transform("whole", lambda p: F.struct(p["rule"].alias("rule"), (p["pos"] - F.element_at(back, p["rule"] + 1)).alias("low"), (p["pos"] + F.element_at(reach, p["rule"] + 1)).alias("high")))
    spans = spans.unionByName(per_text.where(F.size("whole") > 0).select("kid", "kh", around.alias("spans")))
    spans = spans.groupBy(F.col("kid").alias(kid), F.col("kh").alias(kh)).agg(F.flatten(F.collect_list("spans")).alias(found_at))
    return keyed.join(spans, [kid, kh], "left").select(*docs.columns, found_at), found_at


def maximal_repeats(left: list[bytes], right: list[bytes], times: list[int], rule: Rule, size: int) -> Iterator[tuple[list[int], int, int]]:
    """(members, symbols to the left, symbols to the right) of every maximal repeat of at least `length` symbols around an anchor.

    Contexts differ from each other; one that occurs several times is a repeat by itself. Left contexts are given reversed.
    """
    for i, n in enumerate(times):
        if n > 1:
            yield [i], len(left[i]) // size, len(right[i]) // size
    if len(left) < 2:
        return
    order, prefix = neighbours(right, rule.length * size, size)
    back, before = neighbours(left, (rule.length - rule.gram) * size, size)
    rank, place = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    rank[back], place[order] = np.arange(len(left)), np.arange(len(left))
    to_left, to_right = RangeMin(before.astype(np.int64)), RangeMin(prefix.astype(np.int64))
    for first, last, reach in intervals(prefix, rule.gram):
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        shared = to_left(rank[members][:-1], rank[members][1:])
        for x, y, ahead in intervals(shared, max(0, rule.length - reach)):
            some = members[x : y + 1]
            low, high = place[some].min(), place[some].max()
            if to_right(np.array([low]), np.array([high]))[0] == reach:  # else they have more in common, and a smaller interval holds them
                yield some.tolist(), ahead, reach


def _groups_of_anchors(contexts: DataFrame, rule: Rule, size: int) -> DataFrame:
    """(repeat_id, a, c, ahead, reach): the contexts that each repeat stands in, from contexts that lie together by anchor.

    Only repeats of which the anchor is the anchor of some window inside them: these have it wherever they occur, so all occurrences are there.
    """
    kind = np.uint64 if rule.words else np.uint8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            anchor, some = None, []
            for batch in batches:
                for row in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "n", "left", "right")), strict=True):
                    if row[0] != anchor:
                        yield anchor, some
                        anchor, some = row[0], []
                    some.append(row)
            yield anchor, some

        out: list[tuple] = []
        for a, some in groups():
            found = maximal_repeats([r[3] for r in some], [r[4] for r in some], [r[2] for r in some], rule, size) if some else ()
            for members, ahead, reach in found:
                before, after = (np.frombuffer(x, kind) for x in some[members[0]][3:])
                symbols = np.concatenate([before[:ahead][::-1], after[:reach]])
                if not (anchors_of_windows(symbols, rule)[0] == ahead).any():
                    continue
                name = xxhash.xxh3_128_hexdigest(symbols.tobytes())
                for i in members:
                    out.append((name, a, some[i][1], ahead, reach))
                    if len(out) >= 20_000:
                        yield _member_batch(out)
                        out = []
        if out:
            yield _member_batch(out)

    return contexts.repartition("a").sortWithinPartitions("a", "c").mapInArrow(run, "repeat_id string, a long, c long, ahead int, reach int")


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["repeat_id", "a", "c", "ahead", "reach"])


def _groups_of_hot(contexts: DataFrame, rule: Rule) -> DataFrame:
    """The same for anchors with very many contexts: each repeated window of `length` symbols whose anchor it is, counted by hash."""
    kind = np.uint64 if rule.words else np.uint8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, c, n, left, right in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "n", "left", "right")), strict=True):
                before, after = (np.frombuffer(x, kind) for x in (left, right))
                symbols, at = np.concatenate([before[::-1], after]), len(before)
                starts = np.flatnonzero(anchors_of_windows(symbols, rule)[0] == at).tolist()
                names = [xxhash.xxh3_128_hexdigest(symbols[i : i + rule.length].tobytes()) for i in starts]
                m = len(starts)
                columns = [pa.array(names, pa.string()), *(pa.array([x] * m, pa.int64()) for x in (a, c)), pa.array([at - i for i in starts], pa.int32()), pa.array([i + rule.length - at for i in starts], pa.int32()), pa.array([n] * m, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["repeat_id", "a", "c", "ahead", "reach", "n"])

    windows = contexts.mapInArrow(run, "repeat_id string, a long, c long, ahead int, reach int, n long")
    twice = windows.groupBy("repeat_id").agg(F.sum("n").alias("n")).where("n > 1").select("repeat_id")
    return windows.drop("n").join(twice, "repeat_id")


def repeat_groups(docs: DataFrame, rule: Rule = STRINGS, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The maximal repeats of docs with all their occurrences: repeat_id (a hash of the repeat's symbols), the id, low and high (in symbols), a row for each occurrence.

    A repeat is maximal if its occurrences differ (or a text ends) before and after it. Contexts bound what is seen of one:
    a repeat that reaches further than `length` - k before or `length` after the start of an anchor is given as one
    piece per anchor; of anchors with `hot` different contexts or more, the repeated windows of `length` symbols are given.
    Either is given with all its occurrences. Occurrences of exact copies meet their group in a join whose large
    partitions are left to adaptive execution; no group is gathered. Repeated rows are occurrences each.
    """
    size = 8 if rule.words else 1
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("kid"), F.xxhash64(text).alias("kh"), F.col(text).alias("text"))
    found = tx.settled(find_anchors(keyed, (rule,)))
    same = found.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("kid", "kh", "pos")).alias("one"))
    by_anchor = tx.settled(same.groupBy("a").agg(F.count("*").alias("contexts"), F.sum("n").alias("all")).where("all > 1"))
    chosen = same.join(by_anchor, "a").select("one.kid", "one.kh", F.struct("a", "one.pos", "c", "n", "contexts").alias("x"))
    detail = chosen.groupBy("kid", "kh").agg(F.collect_list("x").alias("detail"))  # a text's own anchors: bounded by its length
    contexts = tx.settled(_contexts(keyed.dropDuplicates(["kid", "kh"]).join(detail, ["kid", "kh"]).select("kid", "kh", "text", "detail"), (rule,), "kid", "kh", "text", "detail", ("c", "n", "contexts"), size))
    groups = _groups_of_anchors(contexts.where(F.col("contexts") < hot), rule, size)
    if by_anchor.where(F.col("contexts") >= hot).count():
        groups = groups.unionByName(_groups_of_hot(contexts.where(F.col("contexts") >= hot), rule))
    places = groups.join(found, ["a", "c"]).select("repeat_id", "kid", "kh", (F.col("pos") - F.col("ahead")).alias("low"), (F.col("pos") + F.col("reach")).alias("high")).distinct()
    return places.join(keyed.select("doc_id", "kid", "kh"), ["kid", "kh"]).select("repeat_id", F.col("doc_id").alias(doc_id), "low", "high")


def merged(low: np.ndarray, high: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans inside 0..n."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(set(zip(np.maximum(low, 0).tolist(), np.minimum(high, n).tolist(), strict=True))):
        if x >= y:
            continue
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def runs_of(part: pa.RecordBatch, text: str, spans: str, rules: Sequence[Rule]) -> Iterator[tuple[bytes, list[list[tuple[int, int]]], list[int]]]:
    """For each row: its bytes, the runs of bytes that each rule finds, and the number of symbols in them."""
    data, offsets = tx.raw(part.column(text))
    column = part.column(spans)
    of = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    rule, low, high = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
    words = {k: word_symbols(data, offsets) for k, r in enumerate(rules) if r.words and (rule == k).any()}
    for r in range(part.num_rows):
        found, size = [], []
        for k in range(len(rules)):
            some = np.flatnonzero(rule[of[r] : of[r + 1]] == k) + of[r]
            if not len(some):
                runs = []
            elif rules[k].words:
                _, bounds, at, to = words[k]
                runs = merged(low[some], high[some], int(bounds[r + 1] - bounds[r]))
            else:
                runs = merged(low[some], high[some], int(offsets[r + 1] - offsets[r]))
            size.append(sum(y - x for x, y in runs))
            found.append([(int(at[bounds[r] + x] - offsets[r]), int(to[bounds[r] + y - 1] - offsets[r])) for x, y in runs] if runs and rules[k].words else runs)
        yield data[offsets[r] : offsets[r + 1]].tobytes(), found, size


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for low, high in runs:
        kept.append(text[at:low])
        at = high
    return b"".join([*kept, text[at:]])


def report(docs: DataFrame, strings: Rule = STRINGS, passages: Rule = PASSAGES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 by `strings`, then n_passage_words and in_passage by `passages`, of every row of docs."""
    kind, rules = docs.schema["doc_id"].dataType.simpleString(), (strings, passages)
    marked, spans = repeated_spans(docs.select("doc_id", "text"), rules, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            n, count, digest, removed, passage = [], [], [], [], []
            for text, (runs, _), (size, words) in runs_of(part, "text", spans, rules):
                n.append(len(text))
                removed.append(size)
                count.append(len(runs))
                digest.append(hashlib.sha256(without(text, runs)).hexdigest())
                passage.append(words)
            columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(digest, pa.string()), pa.array(passage, pa.int64()), pa.array([x > 0 for x in passage])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "in_passage"])

    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, in_passage boolean")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", rules: Sequence[Rule] = (STRINGS, PASSAGES), hot: int = HOT) -> DataFrame:
    """docs with what any rule finds taken out of the text (bytes of a character that is cut go, too) and n_chars brought up to date. All copies go. No row is dropped; null stays null."""
    marked, spans = repeated_spans(docs, rules, hot, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, text):
            null = part.column(text).is_null().to_pylist()
            new = []
            for r, (old, found, _) in enumerate(runs_of(part, text, spans, rules)):
                every = np.array([x for runs in found for x in runs], np.int64).reshape(-1, 2)
                new.append(None if null[r] else without(old, merged(every[:, 0], every[:, 1], len(old))).decode("utf-8", "ignore"))
            columns = {f.name: part.column(i) for i, f in enumerate(part.schema) if f.name != spans}
            columns[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    cleaned = marked.mapInArrow(run, docs.schema)
    if n_chars not in docs.columns:
        return cleaned
    return cleaned.withColumn(n_chars, F.when(F.col(n_chars).isNotNull(), F.length(text).cast(docs.schema[n_chars].dataType))).select(*docs.columns)


def op9_repeated_strings(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes as the contract has them; besides, the words that stand in passages of 50 words or more which stand elsewhere, too."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
