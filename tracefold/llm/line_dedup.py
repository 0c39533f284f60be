"""Line dedup over reference counts, screened by sharded cuckoo filters.

The state (``Lines``) is three tables that change together. The postings ``(k1, k2, doc_id)`` have one row for each
document and long line key in it. The reference counts are exact. The cuckoo filters, one a shard of the keys, hold the
keys that are common enough to be dropped. Inserting documents adds postings, raises counts and inserts the keys that
become common; deleting documents removes postings, lowers counts and deletes the keys that no longer are. So every
decision can be taken back, and the state after an insertion and a deletion is what it was before.

The filters answer before any posting is shuffled: they let through the postings of common keys and few others, and the
exact counts confirm these. Filters are handed to the tasks in parts of at most ``PART_KEYS`` keys; where there are more
common keys, the postings are written by part, and each part's postings meet that part's filters.

Edge cases: a null or empty text is one empty line; a row without doc_id counts as a document and keeps its lines;
each row counts as one document, so a repeated doc_id counts once for each of its rows; an empty table gives an empty
result; other columns pass through, and columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracefold.llm.common import SPACE, Scratch, blocks, texts, thrifty

MIN_CHARS = 40
MIN_DOCS = 5
BLOCK = 4 << 20
SHARD_KEYS = 50_000
#: Common keys whose filters are in the tasks' memory at once: two bytes each, in tables of at most 2.4 times their load.
PART_KEYS = 3_300_000
_SLOTS, _KICKS = 4, 500


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits of the stripped line in lower case, or None for a short one."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Fingerprints of 16 bits, four to a bucket, two buckets for each key; a key that was inserted can be deleted."""

    def __init__(self, buckets: int, data: bytes | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if data is None else np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy()
        self.full = False

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(1, math.ceil(math.log2(max(1, keys) / (_SLOTS * 0.85) + 1))))

    def places(self, k1, k2):
        """Fingerprint and both buckets of each key."""
        k1, k2 = np.asarray(k1).astype(np.uint64), np.asarray(k2).astype(np.uint64)
        mark = (k1 >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        first = (k2 & np.uint64(self.mask)).astype(np.int64)
        return mark, first, first ^ self._step(mark)

    def _step(self, mark):
        return (np.asarray(mark).astype(np.int64) * 0x5BD1E995) & self.mask

    def insert(self, k1: int, k2: int) -> None:
        mark, a, b = (x.item() for x in self.places(np.int64(k1), np.int64(k2)))
        for at in (a, b):
            if (free := np.flatnonzero(self.table[at] == 0)).size:
                self.table[at, free[0]] = mark
                return
        for turn in range(_KICKS):
            slot = turn % _SLOTS
            mark, self.table[b, slot] = int(self.table[b, slot]), mark
            b = int(b ^ self._step(mark))
            if (free := np.flatnonzero(self.table[b] == 0)).size:
                self.table[b, free[0]] = mark
                return
        self.full = True  # from now on every key counts as present: nothing is lost, the exact table decides

    def contains(self, k1, k2) -> np.ndarray:
        mark, a, b = self.places(k1, k2)
        if self.full:
            return np.ones(mark.shape, bool)
        return (self.table[a] == mark[..., None]).any(-1) | (self.table[b] == mark[..., None]).any(-1)

    def delete(self, k1: int, k2: int) -> bool:
        mark, a, b = (x.item() for x in self.places(np.int64(k1), np.int64(k2)))
        for at in (a, b):
            if (held := np.flatnonzero(self.table[at] == mark)).size:
                self.table[at, held[0]] = 0
                return True
        return False


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document and distinct long line key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                own = {k for x in text.encode().split(b"\n") if (k := line_key(x, min_chars))}
                keys += own
                ids += [doc] * len(own)
            pairs = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(ids, pa.int64())], names=["k1", "k2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(thrifty(run), "k1 long, k2 long, doc_id long")


def reference_counts(rows: DataFrame) -> DataFrame:
    """Exact counts of the postings: (k1, k2, n_docs, last_doc). Partial sums go through the shuffle, never a key's rows."""
    return rows.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard_of(shards: int) -> Column:
    """A key's shard: its first number's upper 48 bits, read as unsigned."""
    return (F.shiftrightunsigned("k1", 16) % F.lit(shards)).cast("long").alias("shard")


_FILTERS = "shard long, buckets long, data binary"


def _packed(shard: int, f: CuckooFilter) -> dict:
    return {"shard": [shard], "buckets": [f.mask + 1], "data": [f.table.tobytes()]}


def _built(keys: list[tuple[int, int]], least: int = 2) -> CuckooFilter:
    f = CuckooFilter(max(least, CuckooFilter.sized(len(keys)).mask + 1))
    for a, b in keys:
        f.insert(a, b)
    return _built(keys, 2 * (f.mask + 1)) if f.full else f


def filters(common: DataFrame, shards: int) -> DataFrame:
    """One cuckoo filter for each shard of the keys (k1, k2), all distinct: (shard, buckets, data)."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_packed(rows["shard"].iloc[0], _built([*zip(rows["k1"].tolist(), rows["k2"].tolist(), strict=True)])))

    return common.select("k1", "k2", shard_of(shards)).groupBy("shard").applyInPandas(build, _FILTERS)


def changed_filters(old: DataFrame, change: DataFrame, shards: int) -> DataFrame:
    """The filters after inserting and deleting the keys of ``change`` (k1, k2, inserted); full: one that overflowed."""

    def update(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        shard = int((keys if len(keys) else held)["shard"].iloc[0])
        f = CuckooFilter(int(held["buckets"].iloc[0]), held["data"].iloc[0]) if len(held) else CuckooFilter.sized(len(keys))
        for a, b, inserted in zip(keys["k1"], keys["k2"], keys["inserted"], strict=True):
            if not inserted:
                f.delete(a, b)
        for a, b, inserted in zip(keys["k1"], keys["k2"], keys["inserted"], strict=True):
            if inserted and not f.full:
                f.insert(a, b)
        return pd.DataFrame(_packed(shard, f) | {"full": [f.full]})

    keyed = change.select("k1", "k2", "inserted", shard_of(shards))
    return keyed.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(update, _FILTERS + ", full boolean")


class Lines(NamedTuple):
    """The state: postings (k1, k2, doc_id), counts (k1, k2, n_docs, last_doc), filters (shard, buckets, data)."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    scratch: Scratch

    @property
    def common(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.min_docs)

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        return self.scratch.table(rows, f"{name}-{uuid.uuid4().hex}")

    def _with(self, postings: DataFrame, counts: DataFrame, change: DataFrame) -> Lines:
        """The state with other postings and counts; ``change`` are the keys that became common or ceased to be."""
        new = self._replace(postings=postings, counts=counts)
        updated = self._kept("filters", changed_filters(self.filters, change, self.shards))
        # a shard that overflowed is built anew, larger, from its keys
        if updated.filter("full").limit(1).count():
            again = new.common.select("k1", "k2", shard_of(self.shards)).join(updated.filter("full").select("shard"), "shard", "left_semi")
            updated = self._kept("filters", updated.filter("not full").drop("full").unionByName(filters(again, self.shards)))
        return new._replace(filters=updated.select("shard", "buckets", "data"))

    def insert(self, docs: DataFrame) -> Lines:
        """The state after adding documents."""
        fresh = self._kept("postings", postings(docs, self.min_chars))
        more = self._kept("more", reference_counts(fresh))
        counts = self.counts.unionByName(more).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        counts = self._kept("counts", counts)
        before = self.counts.select("k1", "k2", F.col("n_docs").alias("_before"))
        now = more.select("k1", "k2").join(counts, ["k1", "k2"]).join(before, ["k1", "k2"], "left")
        change = now.filter((F.col("n_docs") >= self.min_docs) & (F.coalesce("_before", F.lit(0)) < self.min_docs))
        return self._with(self.postings.unionByName(fresh), counts, change.select("k1", "k2", F.lit(True).alias("inserted")))

    def delete(self, doc_ids: DataFrame) -> Lines:
        """The state after deleting documents by doc_id; counts fall back to what they are without them."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        less = self._kept("less", self.postings.join(ids, "doc_id", "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("_less")))
        rest = self._kept("postings", self.postings.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id"))
        last = rest.join(less, ["k1", "k2"]).groupBy("k1", "k2").agg(F.max("doc_id").alias("_last"))
        found = self.counts.join(less, ["k1", "k2"], "left").join(last, ["k1", "k2"], "left")
        left = F.col("n_docs") - F.coalesce("_less", F.lit(0))
        last_doc = F.when(F.col("_less").isNull(), F.col("last_doc")).otherwise(F.col("_last"))
        counts = self._kept("counts", found.select("k1", "k2", left.alias("n_docs"), last_doc.alias("last_doc")).filter("n_docs > 0"))
        change = found.filter((F.col("n_docs") >= self.min_docs) & (left < self.min_docs))
        return self._with(rest, counts, change.select("k1", "k2", F.lit(False).alias("inserted")))

    def screened(self, rows: DataFrame) -> DataFrame:
        """The postings that the filters let through: those of common keys, and few others."""
        spark = rows.sparkSession
        parts = max(1, -(-self.shards * SHARD_KEYS // PART_KEYS))
        if parts > 1:
            rows = self.scratch.table(rows.withColumn("part", shard_of(self.shards) % parts), f"parts-{uuid.uuid4().hex}", by="part")
        out = []
        for part in range(parts):
            held = self.filters.filter(F.col("shard") % parts == part).collect()
            shared = spark.sparkContext.broadcast([(r.shard, r.buckets, bytes(r.data)) for r in held])
            own = rows.filter(F.col("part") == part) if parts > 1 else rows
            out.append(own.select("k1", "k2", "doc_id").mapInArrow(thrifty(_screen(shared, self.shards)), "k1 long, k2 long, doc_id long"))
        return reduce(DataFrame.unionByName, out)


def _screen(shared, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(s, CuckooFilter(n, data)) for s, n, data in shared.value]
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shard = (k1.astype(np.uint64) >> np.uint64(16)).astype(np.int64) % shards
            keep = np.zeros(len(k1), bool)
            for s, f in held:
                own = np.flatnonzero(shard == s)
                keep[own] = f.contains(k1[own], k2[own])
            yield batch.filter(pa.array(keep))

    return run


def index_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> Lines:
    """The state of ``docs``."""
    scratch = Scratch(spark, "lines")
    rows = scratch.table(postings(docs, min_chars), "postings")
    counts = scratch.table(reference_counts(rows), "counts")
    common = counts.filter(F.col("n_docs") >= min_docs)
    shards = max(1, math.ceil(common.count() / SHARD_KEYS))
    return Lines(rows, counts, scratch.table(filters(common, shards), "filters"), shards, min_docs, min_chars, scratch)


def dedup_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, state: Lines | None = None) -> DataFrame:
    """``docs`` with the common lines gone from ``text``, and with n_lines and n_dropped.

    A line goes if its key has ``min_chars`` code points and is in ``min_docs`` documents, except from the largest
    doc_id that holds it. ``state``: kept from earlier runs, ``docs`` inserted; it has the limits. Else ``docs`` alone count.
    """
    if state is None:
        state = index_lines(spark, docs, min_docs, min_chars)
        rows = state.postings
    else:
        min_chars = state.min_chars
        rows = postings(docs, min_chars)
    doomed = (
        state.screened(rows)
        .join(state.common, ["k1", "k2"])
        .filter(F.col("doc_id") < F.col("last_doc"))
        .groupBy(F.col("doc_id").alias("_tf_id"))
        .agg(F.collect_set(F.struct("k1", "k2")).alias("_tf_keys"))
        .withColumn("_tf_none", F.lit(0).cast("long"))
    )
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    fields = [docs.schema[c] for c in kept]
    # rows without an id find nothing, wherever they go; so they are spread
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).cast("long").alias("_tf_none")
    keyed = docs.select(*kept, "text", F.col("doc_id").cast("long").alias("_tf_id"), spread)
    joined = keyed.join(doomed, ["_tf_id", "_tf_none"], "left").drop("_tf_id", "_tf_none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            at = batch.schema.get_field_index("_tf_keys")
            out, lines, gone = [], [], []
            for text, keys in zip(texts(batch, "text"), batch.column(at), strict=True):
                parts = text.encode().split(b"\n")
                stay = parts
                if keys.is_valid:
                    s = keys.values
                    bad = np.stack([s.field(0).to_numpy(), s.field(1).to_numpy()], 1).tobytes()
                    bad = {bad[i : i + 16] for i in range(0, len(bad), 16)}
                    stay = [x for x in parts if line_key(x, min_chars) not in bad]
                out.append(b"\n".join(stay).decode())
                lines.append(len(parts))
                gone.append(len(parts) - len(stay))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*kept, "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(thrifty(run), StructType([*fields, *StructType.fromDDL("text string, n_lines long, n_dropped long").fields]))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(spark, docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc_id, n, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents)
), common as (
  select key, max(doc_id) as last_doc from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select l.doc_id, l.n, l.line, coalesce(l.doc_id < c.last_doc, false) as gone from lines l left join common c using (key)
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
