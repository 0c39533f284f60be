"""Byte-level BPE by merge replay over a corpus of distinct words.

The distinct words of a block of documents lie one after the other in an array of symbols with links to their
neighbours. An inverted index leads from each pair's merge to the positions where the pair stands; the merges are
applied in the order of their ranks, each at all its positions at once, and only the touched neighbours get new
entries in the index. A merge never looks beyond its word, so the words of a block are encoded as those of the whole
corpus would be, and a block needs no shuffle; a worker keeps the ids of the words that it has met last.

Edge cases: a null or empty text has no ids; equal rows give equal results; a null doc_id stays null; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import blocks, texts
from tracefold.llm.split import WordTable, assemble

BLOCK = 16 << 20
_NONE = np.iinfo(np.int32).max


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.into = np.array([i for _, i in pairs], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, which is also the id of what it makes."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.into[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has; a word that is itself in the vocabulary has one id."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        kept = whole >= 0
        ids, count = self._replay([w for w, has in zip(words, kept.tolist(), strict=True) if not has])
        return assemble(kept, whole[kept], np.ones(int(kept.sum()), np.int64), ids, count)

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, ends = int(size.sum()), np.cumsum(size)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        if n:
            after[ends[size > 0] - 1] = -1
            before[(ends - size)[size > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        stands = np.full(n, _NONE, np.int32)  # the merge of the pair that now begins here

        def enter(at: np.ndarray) -> None:
            rank = self.merged(token[at], token[after[at]])
            stands[at] = rank
            keep = np.flatnonzero(rank != _NONE)
            if not keep.size:
                return
            at, rank = at[keep], rank[keep]
            if at.size > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                groups = zip(rank[np.concatenate(([0], edges))].tolist(), np.split(at, edges), strict=True)
            else:
                groups = [(int(rank[0]), at)]
            for r, own in groups:
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[stands[at] == rank]
            if not at.size:
                continue
            at.sort()
            follows = after[at]
            if at.size > 1 and (touch := follows[:-1] == at[1:]).any():
                # overlapping pairs, as in aaa: from the left, every other one
                place = np.arange(at.size)
                begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~touch)), place, 0))
                at = at[(place - begin) % 2 == 0]
                follows = after[at]
            beyond = after[follows]
            token[at] = rank
            token[follows] = -1
            stands[follows] = _NONE
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            stands[at[~inner]] = _NONE
            left = before[at]
            enter(np.unique(np.concatenate((left[left >= 0], at[inner]))))
        alive = token >= 0
        total = np.concatenate(([0], np.cumsum(alive)))
        return token[alive], total[ends] - total[ends - size]


class Codec(WordTable):
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.written = {i: str(i).encode() for i in ranks.values()}
        super().__init__(pattern)

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.replay.encode([w.encode() for w in words])

    def lists(self, documents: list[str]) -> Iterator[list[int]]:
        ids, stops = self.encode(documents)
        for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False):
            yield ids[a:b].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.replay.bytes.__getitem__, ids))

    def digest(self, documents: list[str]) -> Iterator[tuple[int, str, str]]:
        """How many ids, and the digests of the ids as written and of the bytes that they decode to."""
        for ids in self.lists(documents):
            yield len(ids), hashlib.sha256(b" ".join(map(self.written.__getitem__, ids))).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=1)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for all tasks of a worker."""
    return Codec(load_ranks(ranks_path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in blocks(batches, "text", BLOCK // 4):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([*own.lists(texts(b, "text"))], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded binary) for each row of (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: t for t, i in load_ranks(ranks_path).items()}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(table[i] for i in ids or ()) for ids in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in blocks(batches, "text", BLOCK):
            rows = [*own.digest(texts(b, "text"))]
            n, ids, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
