"""Best-fit decreasing packing of tokenized documents into sequences.

Documents of one length are alike, so the packing works on the histogram of lengths, which never has more entries
than a sequence has tokens: a segment tree over the remaining capacities gives the tightest open sequences, and all
documents that would go there one by one go there at once. The plan has a few rows for each length; each document
finds its place in it by its rank among the documents of its length, so that no task ever holds them all.

Edge cases: a null or empty text is the end token alone; the string of a token that the tokenizer's file adds is that
token, as the library has it by default; rows are packed one by one, repeated ones too, and a null
doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import Scratch, blocks, texts, thrifty
from tracefold.llm.split import WORDS, WordTable, assemble

CAPACITY = 2048
END = 0
BLOCK = 4 << 20
#: What a worker keeps that goes on to other work.
FEW_WORDS = 250_000
TOGETHER = 200
_SPACED = regex.compile(r"(?s).+?\s|[^\S ]").match


class WordIds(WordTable):
    """Ids by the tokenizers library, asked for all new words of a block in a few texts.

    The library finds the strings of its added tokens in a text, and matches what is between them; so does this.
    ``as_text``: these strings are ordinary text, as the library has it with ``encode_special_tokens``.
    """

    def __init__(self, path: str, pattern: str, as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        super().__init__(pattern, frozenset() if as_text else frozenset(added))

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A line feed before each word is a match of its own, as a word has white space at most as its first
        # character, a space; so its id divides the words' ids.
        apart = lambda w: w in self.special or _SPACED(w)
        simple = [w for w in words if not apart(w)]
        if len(simple) == len(words):
            plain, lone = np.ones(len(words), bool), []
        else:
            plain = np.array([not apart(w) for w in words])
            lone = [e.ids for e in self.tokenizer.encode_batch_fast([w for w in words if apart(w)], add_special_tokens=False)]
        joined = ["\n" + "\n".join(simple[at : at + TOGETHER]) for at in range(0, len(simple), TOGETHER)]
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(joined), 50):  # what the library returns holds much more than ids
            found += [np.array(e.ids) for e in self.tokenizer.encode_batch_fast(joined[at : at + 50], add_special_tokens=False)]
        ids = np.concatenate(found)
        cut = ids == self.line[0]
        return assemble(plain, ids[~cut], np.diff(np.append(np.flatnonzero(cut), len(ids))) - 1, np.array([i for x in lone for i in x], np.int64), np.array([*map(len, lone)], np.int64))


@lru_cache(maxsize=1)
def word_ids(path: str, pattern: str, as_text: bool = False) -> WordIds:
    """One table for all tasks of a worker."""
    return WordIds(path, pattern, as_text)


class CapacityTree:
    """How many sequences are open for each remaining capacity, with the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open sequence that is not under ``length``."""
        at = self.leaves + length
        if self.sums[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for ``histogram[length]`` documents of each length.

    Rows (length, rank, sequence, each, offset): from that rank on, documents of the length go into the sequences from
    that number on, ``each`` to a sequence, one after the other from that offset.
    """
    tree, open_, rows, sequences = CapacityTree(capacity), defaultdict(list), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = capacity, -(-left // (capacity // length))
                first, sequences = sequences, sequences + n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            spare = first + full
            if full:
                rows.append((length, rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                if rest := room - each * length:
                    open_[rest].append((first, full))
                    tree.add(rest, full)
            if left and full < n:  # fewer than would fill one more
                rows.append((length, rank, spare, each, capacity - room))
                if rest := room - left * length:
                    open_[rest].append((spare, 1))
                    tree.add(rest, 1)
                spare, left = spare + 1, 0
            if spare < first + n:
                open_[room].append((spare, first + n - spare))
                tree.add(room, first + n - spare)
    return np.array(rows, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """Each document's ids and the end token, cut into pieces of at most ``capacity``; only a first piece is shorter.

    task and place number the pieces of one length that a task has written. ``forget``: a worker keeps fewer words, and
    gives their memory back after each task, for a session in which it goes on to other work.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer, pattern)
        words.most = FEW_WORDS if forget else WORDS
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in blocks(batches, "text", BLOCK // 2 if forget else BLOCK):
            ids, stops = words.encode(texts(batch, "text"))
            rows, start = [], 0
            for doc, stop in zip(batch.column(0).to_pylist(), stops.tolist(), strict=True):
                own = np.append(ids[start:stop], np.uint32(END)).astype("<u4")
                start, at = stop, 0
                cut = len(own) % capacity or capacity
                for k in range(-(-len(own) // capacity)):
                    held = own[at:cut]
                    rows.append((doc, k, at, len(held), zlib.crc32(held.tobytes()), task, int(seen[len(held)]), *[held.tolist()] * with_ids))
                    seen[len(held)] += 1
                    at, cut = cut, cut + capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds)], names=names)
        if forget:
            words.clear()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(thrifty(run), schema)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """All pieces with the sequence that each goes to and its offset there."""
    scratch = Scratch(spark, "pack")
    cut = scratch.table(pieces(docs, tokenizer, pattern, capacity, with_ids, forget), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    # at most `capacity` rows, whatever the input
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(histogram, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = spark.sparkContext.broadcast(plan[order])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        key = (plan[:, 0] << 48) + plan[:, 1]
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            length, rank = get("length").to_numpy(), get("rank").to_numpy()
            row = plan[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            n, each = rank - row[:, 1], np.maximum(row[:, 3], 1)
            found = [get("doc_id"), get("piece"), get("start"), get("length"), get("ids_crc32"), pa.array(row[:, 2] + n // each), pa.array(row[:, 4] + n % each * length)]
            yield pa.RecordBatch.from_arrays([*found, *([get("ids")] if with_ids else [])], names=names)

    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "task", "place")
    return ranked.mapInArrow(thrifty(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * with_ids)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
