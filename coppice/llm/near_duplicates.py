"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find.

A text's set holds its distinct shingles of five words (A-Z lower-cased). SuperMinHash draws for
each shingle one random permutation of the registers, and for its j-th register a value from j
to j + 1; a text's signature holds each register's minimum. The draws of a shingle are
correlated, so the estimate varies less than with independent hashes, and drawing stops as soon
as no register can fall any more. Texts that agree in all registers of a band are candidates.

Texts with equal sets are one class from the start: copies are never paired. The least class
of a band key is its centre; all classes that meet a centre in some band form its group. Full
sets are compared in blocks of bounded size: a breadth-first search with removal finds the links
(100 * intersection >= percent * union) that connect classes, each class being compared only
with classes not reached yet, and only a spanning forest of links leaves a block. Two rounds do
this. In the first, each group is cut into blocks (its centre is in all of them): most groups
are one block and done. In the second, groups of several blocks whose classes aren't one
component yet are cut again, every large component into blocks of its own, and each block meets
every other one but those of its own component, which have nothing to add. The components of
both rounds' links are the result: a group of any size is processed whole, in bounded memory,
without writing its pairs, and rows are multiplied only by what is still apart.

Texts with fewer than five words have their whole word sequence as one shingle; null texts and
texts without words have no set and are linked with nothing. Rows with a null doc_id count like
others; a component's id is the least doc_id that isn't null. Repeated rows are copies. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .components import components

SHINGLE = 5
PERCENT = 85
#: 20 bands of 5 registers: a pair of similarity 0.85 is missed with a probability of 8e-6.
BANDS, ROWS = 20, 5
#: Bounds of a block of candidate classes (as hashing fills them).
BLOCK_CLASSES, BLOCK_SHINGLES = 1500, 2_000_000


def shingles(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the text of each."""
    data, offsets = tx.raw(text)
    ids, at, vocabulary, _ = tx.tokens(tx.LOWER[data], offsets, tx.WHITE)
    word = np.fromiter((xxhash.xxh64_intdigest(w, 3) for w in vocabulary), np.uint64, len(vocabulary))
    word = word[ids] if len(ids) else np.zeros(0, np.uint64)
    row, n = tx.rows_of(at), np.diff(at)
    first = np.flatnonzero((row[k - 1 :] == row[: len(row) - k + 1])) if len(row) >= k else np.zeros(0, np.int64)
    hashed = np.full(len(first), k, np.uint64)
    for i in range(k):
        hashed = tx.mix(hashed * np.uint64(0x9E3779B97F4A7C15) + word[first + i])
    short = np.flatnonzero((n > 0) & (n < k))
    alone = np.zeros(len(short), np.uint64)
    for j, r in enumerate(short):
        h = np.uint64(n[r])
        for w in word[at[r] : at[r + 1]]:
            h = tx.mix(np.array([h], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
        alone[j] = h
    rows, all_hashes = np.concatenate([row[first], short]), np.concatenate([hashed, alone])
    order = np.lexsort((all_hashes, rows))
    rows, all_hashes = rows[order], all_hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (all_hashes[1:] != all_hashes[:-1])
    return all_hashes[new], rows[new]


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def superminhash(hashes: np.ndarray, rows: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures of n texts in m registers; texts without shingles keep infinities."""
    signature = np.full(n * m, np.inf)
    place = None  # the permutations drawn so far
    for j in range(m):
        draw = tx.mix(hashes ^ tx.mix(np.array([j + 1], np.uint64)))
        other = j + (_uniform(tx.mix(draw + np.uint64(0x632BE59BD9B4E019))) * (m - j)).astype(np.int64)
        if place is None:
            register = other
        else:
            line = np.arange(len(hashes))
            register = place[line, other].astype(np.int64)
            place[line, other] = place[:, j]
            place[line, j] = register
        np.minimum.at(signature, rows * m + register, j + _uniform(draw))
        # early stop: no later value is below j + 1
        open_ = signature.reshape(n, m).max(axis=1) > j + 1
        live = open_[rows]
        if not live.any():
            break
        if place is None:
            line = np.flatnonzero(live)
            place = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(line), 1))
            place[np.arange(len(line)), 0] = register[line]
            place[np.arange(len(line)), register[line]] = 0
            hashes, rows = hashes[line], rows[line]
        elif not live.all():
            place, hashes, rows = place[live], hashes[live], rows[live]
    return signature.reshape(n, m)


def bands(signature: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), n_bands, n_rows)
    key = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64), (len(signature), 1))
    for i in range(n_rows):
        key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def sign(docs: DataFrame, shingle: int, n_bands: int, n_rows: int) -> DataFrame:
    """doc_id, text_hash, cid (fingerprint of the set, null without set), n_shingles and band keys of rows (doc_id, text, text_hash)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text", 2_000_000):
            hashes, rows = shingles(part.column("text"), shingle)
            n = np.bincount(rows, minlength=part.num_rows).astype(np.int64)
            cuts = np.append(0, np.cumsum(n))
            flat = hashes.tobytes()
            cid = [xxhash.xxh3_128_digest(flat[8 * a : 8 * b]) if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            keys = bands(superminhash(hashes, rows, part.num_rows, n_bands * n_rows), n_bands, n_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n_bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(cid, pa.binary()), pa.array(n), lists], names=["doc_id", "text_hash", "cid", "n_shingles", "keys"])

    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, cid binary, n_shingles long, keys array<long>")


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted sets: breadth-first, each set is compared with those not reached yet."""
    n = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.append(0, np.cumsum(n))
    order = np.argsort(n, kind="stable")
    sizes = n[order]
    left = np.ones(len(sets), bool)  # by place in order
    member = np.zeros(flat.max() + 1, np.int8)
    forest: list[tuple[int, int]] = []
    where = np.argsort(order)
    for seed in range(len(sets)):
        if not left[where[seed]]:
            continue
        left[where[seed]] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            low = np.searchsorted(sizes, -(-percent * n[x] // 100))
            high = np.searchsorted(sizes, 100 * n[x] // percent, side="right")
            near = order[low:high][left[low:high]]
            if not len(near):
                continue
            own = flat[cuts[x] : cuts[x + 1]]
            member[own] = 1
            lengths = n[near]
            starts = np.cumsum(lengths) - lengths
            index = np.repeat(cuts[near] - starts, lengths) + np.arange(lengths.sum())
            common = np.add.reduceat(member[flat[index]], starts, dtype=np.int64)
            member[own] = 0
            got = near[100 * common >= percent * (n[x] + lengths - common)]
            left[where[got]] = False
            queue += got.tolist()
            forest += [(x, int(y)) for y in got]
    return forest


def verify(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows (grp, i, j, cid, shingles), all of a block pair in one partition and together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(x).to_pylist() for x in ("grp", "i", "j", "cid", "shingles")), strict=True)

        for _, members in groupby(rows(), key=lambda r: r[:3]):
            some = {r[3]: r[4] for r in members}
            if len(some) < 2:
                continue
            names = list(some)
            forest = linked([np.frombuffer(some[c], np.uint64) for c in names], percent)
            if forest:
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in forest], pa.binary()), pa.array([names[y] for _, y in forest], pa.binary())], names=["a", "b"])

    return sets.mapInArrow(run, "a binary, b binary")


def blocks_of(n_classes: F.Column, n_shingles: F.Column) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(n_classes / BLOCK_CLASSES), F.ceil(n_shingles / BLOCK_SHINGLES)).cast("int")


def compare(some: DataFrame, placed: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links inside blocks; placed has cid, rep and places (array of (grp, i, j)). Each text is fetched and shingled once."""
    wanted = placed.groupBy("cid").agg(F.first("rep").alias("rep"), F.flatten(F.collect_list("places")).alias("places"))
    wanted = wanted.select("cid", "places", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    texts = some.join(wanted, some["doc_id"].eqNullSafe(wanted["rep_id"]) & (some["text_hash"] == wanted["rep_hash"])).select("cid", "places", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text", 2_000_000):
            hashes, rows = shingles(part.column("text"), shingle)
            cuts = np.append(0, np.cumsum(np.bincount(rows, minlength=part.num_rows)))
            yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("places"), pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["cid", "places", "shingles"])

    sets = texts.mapInArrow(full, "cid binary, places array<struct<grp:binary,i:int,j:int>>, shingles binary")
    sets = sets.select("cid", "shingles", F.explode("places").alias("at")).select("at.*", "cid", "shingles")
    return verify(sets.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j"), percent)


def still_apart(member: DataFrame, large: DataFrame, found: DataFrame) -> DataFrame:
    """cid, rep and places for the second round: groups (large) of several blocks that the components found so far don't unite."""
    held = member.join(large.select("centre"), "centre").join(found, member["cid"] == found["node"], "left")
    held = tx.settled(held.select("cid", "rep", "n", "centre", F.coalesce("root", "cid").alias("component")))
    parts = held.groupBy("centre", "component").agg(F.count("*").alias("classes"), F.sum("n").alias("size"))
    own = F.when((F.col("classes") >= BLOCK_CLASSES) | (F.col("size") >= BLOCK_SHINGLES), F.col("component"))
    parts = tx.settled(parts.withColumn("home", own))
    # a group's homes: its large components, and one for all small ones (null)
    homes = parts.groupBy("centre", "home").agg(blocks_of(F.sum("classes"), F.sum("size")).alias("blocks"), F.count("*").alias("components"))
    group = Window.partitionBy("centre")
    before = group.orderBy("home").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    homes = homes.select("centre", "home", "blocks", (F.sum("blocks").over(before) - F.col("blocks")).cast("int").alias("low"), F.sum("blocks").over(group).cast("int").alias("total"), F.sum("components").over(group).alias("apart")).where("apart > 1")
    homes = homes.withColumnRenamed("centre", "of").withColumnRenamed("home", "own")
    parts = tx.settled(parts.join(homes, (parts["centre"] == homes["of"]) & parts["home"].eqNullSafe(homes["own"])).select("centre", "component", "home", "blocks", "low", "total"))
    block = (F.col("low") + F.pmod(F.xxhash64("cid"), F.col("blocks"))).cast("int")
    rows = held.join(parts, ["centre", "component"]).withColumn("block", block)
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda w: F.col("home").isNull() | (w < F.col("low")) | (w >= F.col("low") + F.col("blocks")))
    places = F.transform(others, lambda w: F.struct(F.col("centre").alias("grp"), F.least("block", w).alias("i"), F.greatest("block", w).alias("j")))
    return rows.select("cid", "rep", places.alias("places"))


def classes(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, n_bands: int = BANDS, n_rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, cid (the class of equal sets) and root (the class that names its component; null without set)."""
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = tx.settled(sign(some, shingle, n_bands, n_rows))
    # classes of equal sets; of equal rows any may stand for the class
    own = signed.where("cid is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.max("n_shingles").alias("n"), F.max("keys").alias("keys"))
    keys = own.select("cid", "rep", "n", F.explode("keys").alias("key"))
    centres = keys.groupBy("key").agg(F.min("cid").alias("centre"), F.max("cid").alias("last")).where("centre != last").select("key", "centre")
    member = tx.settled(keys.join(tx.settled(centres), "key").select("cid", "rep", "n", "centre").distinct())
    groups = tx.settled(member.groupBy("centre").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks")))
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    at = F.when(F.col("cid") == F.col("centre"), all_blocks).otherwise(F.array(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    places = F.transform(at, lambda i: F.struct(F.col("centre").alias("grp"), i.alias("i"), i.alias("j")))
    first = member.join(groups, "centre").select("cid", "rep", places.alias("places"))
    found = components(compare(some, first, percent, shingle))
    large = groups.where("blocks > 1")
    if large.limit(1).count():
        second = compare(some, still_apart(member, large, found), percent, shingle)
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second))
    roots = signed.select("doc_id", "text_hash", "n_shingles", "cid").join(found, signed["cid"] == found["node"], "left")
    return roots.select("doc_id", "text_hash", "n_shingles", "cid", F.coalesce("root", "cid").alias("root"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    found = tx.settled(classes(docs, **options))
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    least = tx.settled(least)  # so that the join can split the rows of a large component
    joined = found.join(least.withColumnRenamed("root", "of"), F.col("root") == F.col("of"), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, n_bands: int = 30, **options) -> DataFrame:
    """docs without near duplicates: of each component the row with the least (doc_id, text hash) stays, once. All columns are kept as they are.

    Rows without a set are no duplicates of anything and all stay.
    """
    found = tx.settled(classes(docs, percent, n_bands=n_bands, **options))
    stays = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep")).select("rep.*")
    stays = stays.unionByName(found.where("root is null").select("doc_id", "text_hash").distinct())
    key, rep, rep_hash = tx.free_names(docs, "text_key", "rep_id", "rep_hash")
    stays = stays.select(F.col("doc_id").alias(rep), F.col("text_hash").alias(rep_hash))
    marked = docs.withColumn(key, F.xxhash64("text"))
    kept = marked.join(stays, F.col("doc_id").eqNullSafe(F.col(rep)) & (F.col(key) == F.col(rep_hash)), "left_semi")
    if found.where("root is not null").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        # a row of documents stands there twice: one of its copies stays
        empty = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) == 0
        kept = kept.where(~empty).dropDuplicates(["doc_id", key]).unionByName(kept.where(empty))
    return kept.select(*docs.columns)


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
