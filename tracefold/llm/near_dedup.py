"""Near-duplicates by HyperMinHash.

A document is the set of its word shingles, and its sketch has a register for each of many buckets: the number of
leading zeros of the least hash in the bucket, and the bits that follow. Bands of registers are keys under which
documents meet. Equal sets take part once, as one node, whose number says nothing about document ids.

Pairs are confirmed in two steps. First each node is compared with one other: the least node of most of its bands. What
these links connect is contracted. Then, in each band where nodes of several components meet, those outside the
component of the band's least node are compared with all others, in tiles of two blocks of bounded size: a pair counts
in the first band that it shares, and only if its nodes are not connected yet. In both steps sizes and sketches are
compared first (the Jaccard similarity estimated from equal registers, less those that agree by chance), full sets move
only for what comes near the threshold, and a tile gives no more links than connect what is connected.

So no group is gathered in one task or paired row by row, a group of near copies costs about one comparison for each of
its members, and every pair that shares a band is either connected already or compared. The chance that a pair at the
threshold shares none is (1 - 0.85^6)^24, about 1 in 100,000.

Edge cases: a null, empty or wordless text links with nothing and is its own component; fewer than five words are one
shingle; equal texts are in one component. Rows are documents, and several rows may have one doc_id: each has the
component of its own text. A row without doc_id links others like any row, and its component_id is that of its
component, null where no row there has an id; kept compares both ids, null equal to null. Other columns are not read by
``near_duplicates`` and pass through ``drop_near_duplicates``, where columns may have any names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import Scratch, blocks, small_batches, texts, thrifty
from tracefold.llm.components import connected
from tracefold.llm.shingles import forget, mix, shingle_set

WORDS = 5
SIMILARITY = (85, 100)
SEEDS, BUCKETS, MANTISSA = 9, 16, 10
ROWS = 6
BANDS = SEEDS * BUCKETS // ROWS
BLOCK = 2 << 20
#: Nodes and shingles in a block of a tile, on average, and rows and shingles in a bundle of tiles.
TILE, TILE_SHINGLES = 1_024, 500_000
BUNDLE, SHINGLES = 4_000, 1_000_000
COLUMNS = 4096
#: Stands for a missing id where rows are told apart.
NO_ID = -(1 << 63)
#: About the share of registers that agree by chance: of two least hashes with the same leading zeros, one in 2^MANTISSA.
CHANCE = 1 / 3 / (1 << MANTISSA)
#: Ids up to this number are broadcast to the scan of the texts; beyond it both sides are shuffled, with the same result.
BROADCAST_IDS = 500_000

_SEEDS = mix(np.arange(1, SEEDS + 1, dtype=np.uint64))
_FILL = mix(np.arange(1, SEEDS * BUCKETS + 1, dtype=np.uint64) << np.uint64(20)).reshape(BUCKETS, SEEDS)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros, then the bits after the leading one."""
    zeros = np.minimum(64 - np.frexp(least.astype(np.float64))[1], 62)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | ((least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set that isn't empty, bucket by bucket and in each by seed.

    A bucket that none of the set's hashes falls into takes the least of other hashes of all of them.
    """
    counts = np.array([*map(len, sets)], np.int64)
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)) * BUCKETS, counts)
    least = np.empty((len(sets), BUCKETS, SEEDS), np.uint64)
    for k, seed in enumerate(_SEEDS):
        h = mix(everything ^ seed)
        low = np.full(len(sets) * BUCKETS, np.iinfo(np.uint64).max)
        np.minimum.at(low, owner + (h >> np.uint64(60)).astype(np.int64), h << np.uint64(4))
        least[:, :, k] = low.reshape(-1, BUCKETS)
    empty = least == np.iinfo(np.uint64).max
    for i in np.flatnonzero(empty.any((1, 2))):
        where = empty[i]
        least[i][where] = mix(sets[i][:, None] ^ _FILL[where]).min(0)
    return _registers(least.reshape(len(sets), -1))


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; its registers are of different seeds."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * _ODD + np.zeros((len(registers), 1), np.uint64)
    for k in range(ROWS):
        key = mix(key + parts[:, :, k] * _ODD)
    return key.astype(np.int64)


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of all pairs of sketches, corrected for registers that agree by chance."""
    same = np.empty((len(left), len(right)))
    for i, row in enumerate(left):
        same[i] = (right == row).mean(1)
    return (same - CHANCE) / (1 - CHANCE)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, s1, s2, sketch): hash of the text, size and 128-bit hash of the set, sketch; nulls for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            sets = [shingle_set(t, WORDS) for t in texts(b, "text")]
            has = np.array([len(s) > 0 for s in sets])
            full = [s for s in sets if len(s)]
            made = iter(sketches(full)) if full else iter(())
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            columns = [
                b.column(0),
                b.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(names[:, 0], mask=~has),
                pa.array(names[:, 1], mask=~has),
                pa.array([next(made).tobytes() if x else None for x in has], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "s1", "s2", "sketch"])
        forget()  # the worker goes on to other work

    return docs.select(*row_key("doc_id", "h"), "text").mapInArrow(thrifty(run), "doc_id long, h long, n long, s1 long, s2 long, sketch binary")


def row_key(doc_id: str, h: str) -> list[Column]:
    """The id and a hash of the text: what tells rows apart, but for those that are alike in both."""
    return [F.col("doc_id").cast("long").alias(doc_id), F.xxhash64(F.coalesce("text", F.lit(""))).alias(h)]


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = band_keys(_registers_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(b.column(k).to_numpy(), BANDS)) for k in (0, 1))], names=["key", "node", "n"])


class Threshold:
    """Which sizes, estimates and full sets count as near for a similarity of part / whole."""

    def __init__(self, similarity: tuple[int, int]):
        self.part, self.whole = similarity
        bound = self.part / self.whole
        self.estimate = bound - 5 * np.sqrt(bound * (1 - bound) / (SEEDS * BUCKETS))

    def sizes(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.whole * np.minimum(n, m) >= self.part * np.maximum(n, m)

    def sets(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.whole * common >= self.part * (n + m - common)


def near_pairs(limit: Threshold):
    """Of pairs (a, b, n, m, x, y) with sizes and sketches, those that may be links, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_registers_of(b.column(4)) == _registers_of(b.column(5))).mean(1)
                near = (same - CHANCE) / (1 - CHANCE) >= limit.estimate
                near &= limit.sizes(b.column(2).to_numpy(), b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])

    return run


def linked_pairs(limit: Threshold):
    """Of pairs (a, b, x, y) with full sets, the links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(bool(limit.sets(common, len(x), len(y))))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return run


def _tiles(rows: pd.DataFrame, limit: Threshold) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Each tile (key, i, j) of a bundle that has pairs to confirm: its rows, and the places of both in them."""
    rows = rows.sort_values(["key", "i", "j", "node"], kind="stable").reset_index(drop=True)
    where = rows[["key", "i", "j"]].to_numpy()
    edges = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
    registers = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), -1)
    block, label, size = (rows[c].to_numpy() for c in ("block", "label", "n"))
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
        key, i, j = where[lo].tolist()
        sides = [lo + np.flatnonzero(block[lo:hi] == k) for k in (i, j)]
        if not len(sides[0]) or not len(sides[1]) or hi - lo < 2:
            continue
        p, q = sides
        open_ = (label[p][:, None] != label[q]) & limit.sizes(size[p][:, None], size[q])
        if i == j:
            open_ &= np.triu(np.ones(open_.shape, bool), 1)
        if not open_.any():
            continue
        open_ &= estimate(registers[p], registers[q]) >= limit.estimate
        x, y = np.nonzero(open_)
        x, y = p[x], q[y]
        if len(x):
            # a pair that shares an earlier band has been met there
            keys = band_keys(registers[lo:hi])
            band = int(np.flatnonzero(keys[x[0] - lo] == key)[0])
            first = ~(keys[x - lo, :band] == keys[y - lo, :band]).any(1)
            x, y = x[first], y[first]
        if len(x):
            yield rows.iloc[lo:hi], x - lo, y - lo


def tile_survivors(limit: Threshold):
    """The rows of a bundle's tiles whose full sets are needed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [own.iloc[np.union1d(x, y)] for own, x, y in _tiles(rows, limit)]
        return pd.concat(found)[_ROW] if found else rows.iloc[:0][_ROW]

    return run


_ROW = ["key", "i", "j", "block", "node", "label", "n", "sketch"]
_ROWS = "key long, i int, j int, block int, node long, label long, n long, sketch binary"


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets, from matrices of the shingles that stand in several."""
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[code]
    owner = np.repeat(np.arange(len(sets)), [*map(len, sets)])[keep]
    column = (np.cumsum(shared) - 1)[code[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[lo:hi], column[lo:hi] - at] = 1
        common += grid @ grid.T
    return common


def tile_links(limit: Threshold):
    """The links of a bundle's tiles, confirmed on full sets, no more than connect what they connect."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parent, found = {}, []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for own, x, y in _tiles(rows, limit):
            used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            x, y = place[: len(x)], place[len(x) :]
            sets = [np.frombuffer(own["shingles"].iloc[k], np.uint64) for k in used]
            size = np.array([*map(len, sets)], np.int64)
            near = limit.sets(intersections(sets)[x, y], size[x], size[y])
            label, nodes = own["label"].to_numpy()[used].tolist(), own["node"].to_numpy()[used].tolist()
            for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                a, b = root(label[p]), root(label[q])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((nodes[p], nodes[q]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text", BLOCK):
        made = [shingle_set(t, WORDS).tobytes() for t in texts(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["node", "shingles"])
    forget()


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) for each of ``nodes`` (node, doc, h), read from a row that has the node's set."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    return source.join(wanted, ["doc", "h"]).select("node", "text").mapInArrow(thrifty(_shingles), "node long, shingles binary").dropDuplicates(["node"])


def bundled(rows: DataFrame, total: int, each: int) -> DataFrame:
    """Tiles dealt to bundles of about ``each`` units of ``total``."""
    return rows.withColumn("bundle", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, -(-total // each)))))


def links(nodes: DataFrame, docs: DataFrame, similarity: tuple[int, int], scratch: Scratch) -> DataFrame:
    """(node, label): nodes that are linked with others, and the least node that each can reach."""
    limit = Threshold(similarity)
    bands = scratch.table(nodes.select("node", "n", "sketch").mapInArrow(thrifty(_bands), "key long, node long, n long"), "bands")
    heads = bands.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last").select("key", "head")
    met = scratch.table(bands.join(heads, "key"), "met")
    scratch.drop("bands")

    # Each node with the head of most of its bands.
    pairs = met.filter("head <> node").groupBy(F.col("node").alias("b")).agg(F.mode("head", True).alias("a"))
    side = lambda node, n, x: nodes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("sketch").alias(x))
    tried = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    tried = scratch.table(tried.mapInArrow(near_pairs(limit), "a long, b long"), "tried")
    places = nodes.select("node", "doc", "h")
    wanted = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    full = scratch.table(full_sets(docs, scratch.table(places.join(wanted, "node"), "wanted")), "full")
    both = tried.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    stars = scratch.table(both.select("a", "b", "x", "y").mapInArrow(thrifty(linked_pairs(limit)), "a long, b long"), "stars")
    component = connected(stars, scratch, "stars")

    # The bands where nodes outside the head's component are left.
    label = component.select("node", F.col("label").alias("_label"))
    of_head = component.select(F.col("node").alias("head"), F.col("label").alias("_major"))
    mixed = met.join(of_head, "head", "left").withColumn("major", F.coalesce("_major", "head")).join(label, "node", "left").withColumn("label", F.coalesce("_label", "node"))
    mixed = scratch.table(mixed.select("key", "node", "n", "label", (F.col("label") != F.col("major")).alias("minor")), "mixed")
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = mixed.groupBy("key").agg(F.count_if(~F.col("minor")).alias("major"), sum_if(~F.col("minor")).alias("major_n"), F.count_if("minor").alias("few"), sum_if(F.col("minor")).alias("few_n"))
    parts = lambda count, n: F.ceil(F.greatest(count / TILE, n / TILE_SHINGLES)).cast("int")
    all_ = parts(F.col("major") + F.col("few"), F.col("major_n") + F.col("few_n"))
    p, q = parts(F.col("major"), F.col("major_n")), parts(F.col("few"), F.col("few_n"))
    counts = counts.filter("few > 0").select("key", F.when(all_ == 1, 0).otherwise(p).alias("p"), F.when(all_ == 1, 1).otherwise(q).alias("q"))
    dealt = mixed.join(counts, "key")
    block = F.when(F.col("p") == 0, 0).when(F.col("minor"), F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).otherwise(F.pmod(F.xxhash64("node"), F.col("p"))).cast("int")
    others = F.sequence(F.when(F.col("minor") | (F.col("p") == 0), 0).otherwise(F.col("p")), F.col("p") + F.col("q") - 1)
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(others)).join(nodes.select("node", "sketch"), "node")
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "n", "sketch")
    dealt = scratch.table(dealt.select(*_ROW), "dealt")
    left = bundled(dealt, dealt.count(), BUNDLE).groupBy("bundle").applyInPandas(tile_survivors(limit), _ROWS)
    left = scratch.table(left, "left")
    total = left.agg(F.sum("n")).first()[0]
    if not total:
        return component
    more = left.select("node").distinct().join(full.select("node"), "node", "left_anti")
    more = scratch.table(full_sets(docs, scratch.table(places.join(more, "node"), "wanted-more")), "full-more")
    left = left.join(full.unionByName(more), "node").select(*_ROW, "shingles")
    found = scratch.table(bundled(left, total, SHINGLES).groupBy("bundle").applyInPandas(tile_links(limit), "a long, b long"), "tiles")
    return connected(stars.unionByName(found), scratch, "components")


def decided(spark: SparkSession, docs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, h, n, label, component_id) for each row; label is null for rows without words."""
    small_batches(spark)
    scratch = Scratch(spark, "near")
    signed = scratch.table(signatures(docs), "signatures")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "h")).alias("one")
    nodes = signed.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), one, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # Numbers that are given once, as the table is written once.
    nodes = scratch.table(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "least", "one.*", "n", "sketch"), "nodes")
    component = links(nodes, docs, similarity, scratch)
    owned = component.join(nodes.select("node", "least"), "node")
    smallest = owned.groupBy("label").agg(F.min("least").alias("_least"))
    owned = scratch.table(component.join(smallest, "label"), "owned")
    labelled = nodes.select("node", "s1", "s2", "least").join(owned, "node", "left")
    labelled = labelled.select("s1", "s2", F.coalesce("label", "node").alias("label"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("_least")).alias("_least"))
    found = signed.drop("sketch").join(labelled, ["s1", "s2"], "left")
    return found.select("doc_id", "h", "n", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text)."""
    found = decided(spark, docs, similarity)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row of each component of ``docs`` stays: that with the smallest doc_id, null last; rows without words stay.

    Rows are told apart by id and text, so a row isn't taken for another that has its id. Of rows alike in both, one stays.
    """
    scratch = Scratch(spark, "stay")
    rows = scratch.table(decided(spark, docs, similarity).filter("label is not null").select("label", F.coalesce("doc_id", F.lit(NO_ID)).alias("_tf_id"), F.col("h").alias("_tf_h")), "rows")
    order = F.struct((F.col("_tf_id") == NO_ID).alias("last"), "_tf_id", "_tf_h")
    first = rows.groupBy("label").agg(F.min(order).alias("first")).select("label", "first._tf_id", "first._tf_h")
    key = ["_tf_id", "_tf_h"]
    gone = rows.select(*key).distinct().join(first.select(*key), key, "left_anti")
    doc, h = row_key(*key)
    keyed = docs.select("*", F.coalesce(doc, F.lit(NO_ID)).alias("_tf_id"), h).join(gone, key, "left_anti")
    twice = scratch.table(rows.groupBy(*key).count().filter("count > 1").select(*key), "twice")
    if twice.limit(1).count():
        keyed = keyed.join(twice, key, "left_anti").unionByName(keyed.join(twice, key, "left_semi").dropDuplicates(key))
    return keyed.select(*docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words
), shingles as (
  select doc_id, len(s) as n, unnest(s) as g from sets
), pairs as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as both_n, count(*) as common
  from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2
), link as (
  select a, b from pairs where 100 * common >= 85 * (both_n - common)
), reach(node, other) as (
  select doc_id, doc_id from sets union select r.node, l.b from reach r join link l on r.other = l.a
)
select s.doc_id, cast(len(s) as bigint) as n_shingles, r.component_id, r.component_id = s.doc_id as kept
from sets s join (select node, min(other) as component_id from reach group by node) r on r.node = s.doc_id
"""
