"""Removal of repeated byte strings, found by suffix sorting of small collections.

Each start of a ``LENGTH``-byte string is classed by the least hash among the string's ``GRAM``-byte substrings, so equal
strings are in one class. A run of starts of one class is a segment (about 80 starts). Classes with one segment, which
holds the hash once, have no repeat and go; where all segments of a class are the same, all of them are repeats.

What is left is cut into pieces by the distance from a start to the class's substring. All strings of a piece share a
core of ``LENGTH - WIDTH + 1`` bytes, at one place relative to that substring, so equal strings meet in pieces of one
core; cores that occur once go. The rest are small collections of strings made of the bytes left of the core, the
core as a single symbol, and the bytes right of it. They are suffix-sorted column by column: each round puts one more
symbol of every string in front, and inserts the new suffixes into the collection's Burrows-Wheeler transform and its
array of common prefixes, which are read and written from beginning to end, as sequential files held in memory: a
bundle of collections has a bounded size. A suffix with a neighbour that shares ``LENGTH`` bytes is a repeat.

Segments and pieces that stand twice as a whole are repeats without more ado, and only one of each kind takes part in
the comparison. Pieces of a core with more than ``MOST`` kinds are cut in halves, whose cores are longer, and so on:
a core of ``LENGTH`` bytes has one kind. So collections are small however many copies there are, and all go the same way.

Segments, cores and pieces are known by 128-bit hashes; what differs within a collection is compared byte by byte.

Edge cases: a null or empty text has no bytes; matches never cross rows; rows that repeat a doc_id are documents of
their own; texts under 200 bytes are left as they are; a null doc_id stays null; an empty table gives an empty result;
other columns pass through, and columns named n_bytes, n_removed, n_spans or kept are replaced. ``text`` becomes the
kept bytes, without what is left of characters that were cut.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracefold.llm.common import Scratch, blocks, texts, thrifty

LENGTH = 200
GRAM = 32
WINDOW = LENGTH - GRAM + 1
WIDTH = 34
#: Kinds of pieces in a collection, at most, and in a bundle of collections, on average.
MOST = 2_000
BUNDLE = 2_000
BLOCK = 4 << 20
STEP = 1 << 20
#: Documents' starts are broadcast up to this size; beyond it both sides are shuffled, with the same result.
BROADCAST_BYTES = 32 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _B
    return h ^ h >> np.uint64(29)


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the ``GRAM`` bytes from each place on; GRAM is a power of two."""
    h, n = _mix(data.astype(np.uint64) + _A), 1
    while n < GRAM:
        h = h[:-n] * _C + (h[n:] ^ h[n:] >> np.uint64(32))
        n *= 2
    return _mix(h)


def least(h: np.ndarray) -> np.ndarray:
    """The least of ``WINDOW`` hashes from each place on."""
    n = 1
    while 2 * n <= WINDOW:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (WINDOW - n)], h[WINDOW - n :])


def segments_of(raw: bytes) -> tuple[list[int], list[int], list[int], list[bytes], list[bool]]:
    """Of each segment: start, starts, class, 128-bit hash, and whether the class's substring stands in it more than once."""
    begin, many, kind, content, again = [], [], [], [], []
    for at in range(0, len(raw) - LENGTH + 1, STEP):
        part = raw[at : at + STEP + LENGTH - 1]
        h = grams(np.frombuffer(part, np.uint8))
        m = least(h)
        cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
        view = memoryview(part)
        values = m[np.concatenate(([0], cuts))].astype(np.int64).tolist()
        for lo, hi, value in zip([0, *cuts.tolist()], [*cuts.tolist(), len(m)], values, strict=True):
            for s in range(lo, hi, WINDOW):
                e = min(hi, s + WINDOW)
                begin.append(at + s)
                many.append(e - s)
                kind.append(value)
                content.append(xxhash.xxh3_128_digest(view[s : e + LENGTH - 1]))
                again.append(bool(np.count_nonzero(h[s : e + WINDOW - 1] == m[s]) > 1))
    return begin, many, kind, content, again


def pieces_of(raw: bytes, starts: list[int], counts: list[int]) -> Iterator[tuple[bytes, bytes, int, int, int, int, bytes, bytes]]:
    """The pieces of segments: see ``piece``."""
    for s, n in zip(starts, counts, strict=True):
        h = grams(np.frombuffer(raw, np.uint8, n + LENGTH - 1, s))
        found = np.flatnonzero(h == h[:WINDOW].min())
        before = -1
        for p in found.tolist():
            first, last = max(0, before + 1), min(n - 1, p)
            before = p
            if first > last:
                continue
            near, far, p = p - last, p - first, p + s
            for b in range(near // WIDTH, far // WIDTH + 1):
                lo, hi = b * WIDTH, b * WIDTH + WIDTH - 1
                d1, d2 = max(lo, near), min(hi, far)
                core = xxhash.xxh3_128_digest(raw[p - lo : p - hi + LENGTH], b)
                yield piece(core, lo, hi, d1, d2, p - d2, raw[p - d2 : p - lo], raw[p - hi + LENGTH : p - d1 + LENGTH])


def piece(core: bytes, lo: int, hi: int, d1: int, d2: int, start: int, left: bytes, right: bytes) -> tuple[bytes, bytes, int, int, int, int, bytes, bytes]:
    """(core's hash, hash of the piece, lo, hi, first start, starts, bytes left of the core, bytes right of it).

    A core begins ``lo`` bytes before the class's substring and is the bytes that are common to all strings that begin
    ``lo`` to ``hi`` before it. The piece has those that begin ``d1`` to ``d2`` before it.
    """
    return core, xxhash.xxh3_128_digest(b"%d %d " % (d1, d2) + left + right), lo, hi, start, d2 - d1 + 1, left, right


def halves(core: bytes, lo: int, hi: int, start: int, n: int, left: bytes, right: bytes) -> Iterator[tuple[bytes, bytes, int, int, int, int, bytes, bytes]]:
    """The same strings as pieces of two longer cores, each half as wide."""
    far, near, middle = lo + len(left), hi - len(right), (lo + hi) // 2
    for low, high in ((lo, middle), (middle + 1, hi)):
        d1, d2 = max(near, low), min(far, high)
        if d1 <= d2:
            more = left[far - low :], right[: hi - high]
            longer = xxhash.xxh3_128_digest(b"%d %d %d " % (low, high, len(more[0])) + core + more[0] + more[1])
            yield piece(longer, low, high, d1, d2, start + far - d2, left[far - d2 : far - low], right[hi - high : hi - d1])


class _File:
    """An array in a file (in memory) that is read and written from its beginning to its end."""

    def __init__(self, kind):
        self.kind, self.file = kind, io.BytesIO()

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.kind)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(values.astype(self.kind, copy=False).tobytes())
        self.file.truncate()


def common_prefixes(strings: list[np.ndarray], weight) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all strings in order, as places in their concatenation, and each one's common prefix with the one before.

    Symbols are whole numbers from 1 on, ``weight(symbols)`` says how long they are. The empty suffixes come first.
    """
    size = np.array([*map(len, strings)], np.int64)
    text = np.concatenate([*strings, np.zeros(0, np.int64)]).astype(np.int64)
    begin, m = np.cumsum(size) - size, len(strings)
    transform, prefix, suffix = _File(np.uint16), _File(np.int32), _File(np.int64)
    transform.write(np.where(size > 0, text[np.maximum(begin + size - 1, 0)] if len(text) else 0, 0))
    prefix.write(np.zeros(m))
    suffix.write(begin + size)
    who, place, at = np.flatnonzero(size), np.flatnonzero(size), (begin + size)[size > 0]
    while len(who):
        b, l, i = transform.read(), prefix.read(), suffix.read()
        order = np.argsort(b, kind="stable")
        rank = np.empty(len(b), np.int64)
        rank[order] = np.arange(len(b))
        ended = int(np.count_nonzero(b == 0))
        k = rank[place]
        turn = np.argsort(k)
        who, place, at, k = who[turn], place[turn], at[turn] - 1, k[turn]
        symbol = b[place]
        new = m + k - ended
        # the rows before and after with the same symbol in front
        above, below = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(b) - 1)]
        has_above, has_below = (k > 0) & (b[above] == symbol), (k + 1 < len(b)) & (b[below] == symbol)
        padded = np.append(l, 0)
        w = weight(symbol)

        def span(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """The least common prefix from row ``lo`` to before ``hi``."""
            return np.minimum.reduceat(padded, np.stack([lo, hi], 1).ravel())[::2] if len(lo) else lo

        total = len(b) + len(who)
        fresh = np.zeros(total, bool)
        fresh[new] = True
        out_b, out_l, out_i = np.empty(total, np.uint16), np.empty(total, np.int32), np.empty(total, np.int64)
        out_b[~fresh], out_l[~fresh], out_i[~fresh] = b, l, i
        out_b[new] = np.where(at > begin[who], text[at - 1], 0)
        out_i[new] = at
        out_l[new] = 0
        out_l[new[has_below] + 1] = w[has_below] + span(place[has_below] + 1, below[has_below] + 1)
        out_l[new[has_above]] = w[has_above] + span(above[has_above] + 1, place[has_above] + 1)
        transform.write(out_b)
        prefix.write(out_l)
        suffix.write(out_i)
        more = at > begin[who]
        who, place, at = who[more], new[more], at[more]
    return suffix.read(), prefix.read()


def repeats(cores: np.ndarray, sizes: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> list[np.ndarray]:
    """For each piece, which of its starts (from the left) begin a string that stands at another start too.

    ``cores`` are numbers from 0 on, and ``sizes`` has the length of each.
    """
    symbols = cores + 257
    weight = np.concatenate([np.ones(257, np.int64), sizes])
    bytes_of = lambda x: np.frombuffer(x, np.uint8).astype(np.int64) + 1
    strings = [np.concatenate([bytes_of(a), [c], bytes_of(z)]) for a, c, z in zip(lefts, symbols.tolist(), rights, strict=True)]
    suffix, prefix = common_prefixes(strings, weight.__getitem__)
    near = np.maximum(prefix, np.append(prefix[1:], 0)) >= LENGTH
    size = np.array([*map(len, strings)])
    flags = np.zeros(int(size.sum()) + 1, bool)
    flags[suffix[near]] = True
    stops = np.cumsum(size)
    return [flags[b - n : b - n + len(a) + 1] for a, n, b in zip(lefts, size.tolist(), stops.tolist(), strict=True)]


def _bundle(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    _, first, cores = np.unique(rows[["c1", "c2"]].to_numpy(), axis=0, return_index=True, return_inverse=True)
    sizes = LENGTH - (rows["hi"] - rows["lo"]).to_numpy()[first]
    found = repeats(cores.ravel(), sizes, rows["left"].tolist(), rows["right"].tolist())
    for who, digest, start, flags in zip(rows["_tf_id"], rows["_tf_hash"], rows["start"], found, strict=True):
        if flags.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
            out += [(who, digest, start + a, b - a) for a, b in edge.reshape(-1, 2).tolist()]
    return pd.DataFrame(out, columns=["_tf_id", "_tf_hash", "start", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The removed runs of bytes of each document, from its repeated starts."""
    for batch in batches:
        begins, ends = [], []
        for starts, counts in zip(batch.column(2), batch.column(3), strict=True):
            lo = np.asarray(starts.values, np.int64)
            order = np.argsort(lo, kind="stable")
            lo = lo[order]
            hi = np.maximum.accumulate(lo + np.asarray(counts.values, np.int64)[order] + LENGTH - 1)
            fresh = np.concatenate(([True], lo[1:] > hi[:-1]))
            begins.append(lo[fresh].astype(np.int32))
            ends.append(hi[np.append(np.flatnonzero(fresh)[1:] - 1, len(hi) - 1)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["_tf_id", "_tf_hash", "_tf_begins", "_tf_ends"])


def _longs(digests: list[bytes]) -> list[pa.Array]:
    """128-bit hashes as two columns."""
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text", BLOCK):
        lists, many = [[], [], [], [], []], []
        for t in texts(b, "text"):
            found = segments_of(t.encode())
            for whole, own in zip(lists, found, strict=True):
                whole += own
            many.append(len(found[0]))
        owners = [pa.array(np.repeat(b.column(c).to_numpy(), many)) for c in (0, 1)]
        start, n, kind, content, again = lists
        columns = [*owners, pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(kind, pa.int64()), *_longs(content), pa.array(again, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["_tf_id", "_tf_hash", "start", "n", "class", "k1", "k2", "again"])


_PIECE = ["_tf_id", "_tf_hash", "c1", "c2", "w1", "w2", "lo", "hi", "start", "n", "left", "right"]
_PIECES = "_tf_id long, _tf_hash long, c1 long, c2 long, w1 long, w2 long, lo int, hi int, start int, n int, left binary, right binary"


def _piece_batch(owners: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    core, whole, *rest = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([*owners, *_longs(core), *_longs(whole), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], names=_PIECE)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text", BLOCK // 4):
        columns = dict(zip(b.schema.names, b.columns, strict=True))
        rows, many = [], []
        for t, starts, counts in zip(texts(b, "text"), columns["starts"].to_pylist(), columns["counts"].to_pylist(), strict=True):
            found = [*pieces_of(t.encode(), starts, counts)]
            rows += found
            many.append(len(found))
        yield _piece_batch([pa.array(np.repeat(columns[c].to_numpy(), many)) for c in ("_tf_id", "_tf_hash")], rows)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = {c: b.column(b.schema.get_field_index(c)) for c in _PIECE}
        cores = np.stack([columns[c].to_numpy() for c in ("c1", "c2")], 1).tobytes()
        rows, many = [], []
        for k, rest in enumerate(zip(*(columns[c].to_pylist() for c in ("lo", "hi", "start", "n", "left", "right")), strict=True)):
            found = [*halves(cores[16 * k : 16 * k + 16], *rest)]
            rows += found
            many.append(len(found))
        yield _piece_batch([pa.array(np.repeat(columns[c].to_numpy(), many)) for c in ("_tf_id", "_tf_hash")], rows)


_OWNER = "_tf_id long, _tf_hash long"


def _by_document(spans: DataFrame) -> DataFrame:
    """The starts of each document; there are no more of them than it has bytes."""
    return spans.groupBy("_tf_id", "_tf_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))


def _small(spans: DataFrame, column: str) -> DataFrame:
    """Marked for broadcast if its size, as counted, is within the bound."""
    rows, inner = spans.agg(F.count("*"), F.sum(F.size(column))).first()
    return F.broadcast(spans) if 64 * rows + 8 * (inner or 0) <= BROADCAST_BYTES else spans


_SPAN = ["_tf_id", "_tf_hash", "start", "n"]


def _alike(*columns: str) -> Column:
    """Whether all rows of a group have the same hash."""
    return reduce(Column.__and__, [F.min(c) == F.max(c) for c in columns])


def settled(pieces: DataFrame, scratch: Scratch, level: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The repeated starts among pieces, and what is left to do: one of each kind of piece of cores with too many kinds."""
    core = ["c1", "c2"]
    cores = pieces.groupBy(*core).agg(F.count("*").alias("_rows"), _alike("w1", "w2").alias("_same")).filter("_rows > 1").drop("_rows")
    met = scratch.table(pieces.join(cores, core), f"met-{level}")
    # What stands twice is a repeat, and one of each kind is compared with the others of its core.
    unlike = met.filter("not _same")
    rest = [c for c in _PIECE if c not in (*core, "w1", "w2", *_SPAN)]
    whole = unlike.groupBy(*core, "w1", "w2").agg(F.count("*").alias("_rows"), F.min(F.struct(*_SPAN)).alias("_one"), F.min(F.struct(*rest)).alias("_bytes"))
    whole = scratch.table(whole, f"whole-{level}")
    twin = unlike.join(whole.filter("_rows > 1").select(*core, "w1", "w2"), [*core, "w1", "w2"])
    many = scratch.table(whole.groupBy(*core).agg(F.count("*").alias("_kinds")).filter("_kinds > 1"), f"many-{level}")
    compared = whole.join(many, core).select("_kinds", *core, "w1", "w2", "_one.*", "_bytes.*")
    kinds, most = many.agg(F.sum(F.when(F.col("_kinds") <= MOST, F.col("_kinds"))), F.max("_kinds")).first()
    small = compared.filter(F.col("_kinds") <= MOST).withColumn("bundle", F.pmod(F.xxhash64(*core), F.lit(max(1, -(-(kinds or 0) // BUNDLE)))))
    sorted_ = small.select("bundle", *core, *_SPAN, "lo", "hi", "left", "right").groupBy("bundle").applyInPandas(_bundle, f"{_OWNER}, start int, n int")
    found = [met.filter("_same").select(*_SPAN), twin.select(*_SPAN), sorted_]
    return found, compared.filter(F.col("_kinds") > MOST).select(*_PIECE) if (most or 0) > MOST else None


def removed_runs(spark: SparkSession, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(_tf_id, _tf_hash, _tf_begins, _tf_ends) for each document of (_tf_id, _tf_hash, text) that loses bytes."""
    found = scratch.table(keyed.mapInArrow(thrifty(_segments), f"{_OWNER}, start int, n int, class long, k1 long, k2 long, again boolean"), "segments")
    classes = found.groupBy("class").agg(F.count("*").alias("rows"), _alike("k1", "k2").alias("_alike"), F.max("again").alias("again"))
    classes = classes.filter("rows > 1 or again").select("class", ((F.col("rows") > 1) & F.col("_alike")).alias("_same"))
    flagged = scratch.table(found.join(classes, "class").select(*_SPAN, "class", "k1", "k2", "_same"), "flagged")
    scratch.drop("segments")

    # Segments that stand twice are repeats; one of each kind goes on, as others may share a part of it.
    mixed = flagged.filter("not _same")
    kinds = scratch.table(mixed.groupBy("class", "k1", "k2").agg(F.count("*").alias("_rows"), F.min(F.struct(*_SPAN)).alias("_one")), "kinds")
    equal = mixed.join(kinds.filter("_rows > 1").select("class", "k1", "k2"), ["class", "k1", "k2"]).select(*_SPAN)
    open_ = scratch.table(_by_document(kinds.select("_one.*")), "open")
    cut = keyed.join(_small(open_, "starts"), ["_tf_id", "_tf_hash"]).select("_tf_id", "_tf_hash", "text", "starts", "counts")
    pieces = scratch.table(cut.mapInArrow(thrifty(_pieces), _PIECES), "pieces")

    spans, level = [flagged.filter("_same").select(*_SPAN), equal], 0
    while pieces is not None:
        more, left = settled(pieces, scratch, level)
        spans += more
        level += 1
        pieces = left if left is None else scratch.table(left.mapInArrow(_halves, _PIECES), f"pieces-{level}")
    whole = reduce(DataFrame.unionByName, spans)
    return scratch.table(_by_document(whole).mapInArrow(thrifty(_runs), f"{_OWNER}, _tf_begins array<int>, _tf_ends array<int>"), "runs")


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with text shortened, and n_bytes, n_removed, n_spans and kept (binary)."""
    scratch = Scratch(spark, "repeats")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_tf_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tf_hash")]
    runs = removed_runs(spark, docs.select(*key, "text"), scratch)
    made = ["text", "n_bytes", "n_removed", "n_spans", "kept"]
    others = [c for c in docs.columns if c not in made]
    joined = docs.select(*others, "text", *key).join(_small(runs, "_tf_begins"), ["_tf_id", "_tf_hash"], "left").drop("_tf_id", "_tf_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            out = []
            for t, begins, ends in zip(texts(b, "text"), columns["_tf_begins"].to_pylist(), columns["_tf_ends"].to_pylist(), strict=True):
                raw = t.encode()
                if begins is None:
                    out.append((t, len(raw), 0, 0, raw))
                    continue
                kept = b"".join(raw[a:z] for a, z in zip([0, *ends], [*begins, len(raw)], strict=True))
                out.append((kept.decode("utf-8", "ignore"), len(raw), len(raw) - len(kept), len(begins), kept))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in others), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[*others, *made])

    return joined.mapInArrow(thrifty(run), StructType([*(docs.schema[c] for c in others), *StructType.fromDDL("text string, n_bytes long, n_removed long, n_spans long, kept binary").fields]))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
