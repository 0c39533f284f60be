"""Toxicity: embeddings of subwords, averaged and fed to a linear softmax, all trained together in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams and of the word itself, so a misspelt word
shares most of its vectors with the right one. A window of about ``WINDOW`` words has the mean of its words' vectors,
where a word's repetitions and the missing words of a very short window count as zero vectors; a document has the
score of its most toxic window, in training too, so a long document isn't diluted. All windows of all whole texts are
scored. Subwords of fewer than ``MIN_DOCUMENTS`` training texts keep a zero vector: they could only be learnt by heart.

Edge cases: a null, empty or wordless text has the score of the bias alone; where no labelled row of either class is
left to learn from, all scores are the share of toxic rows (0 without rows); repeated rows are scored alike; repeated
or contradictory labels all count in training; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import blocks, texts, thrifty
from tracefold.llm.sampling import remainder, sample_by_label

#: Rows of each class, about, that the model is fitted on, and the characters of all their texts.
TRAIN_ROWS = {0: 2_400, 1: 1_500}
TRAIN_CHARS = 24_000_000
#: Chosen by the log-loss on rows whose crc32(doc_id) mod 5 is 1, trained on those with 2, 3 and 4.
BITS, DIMENSIONS, WINDOW, ORDERS = 17, 16, 32, (3, 4, 5)
MIN_DOCUMENTS, LEAST, TOXIC_WEIGHT = 3, 16, 0.35
EPOCHS, RATE, DECAY, SEED = 200, 0.05, 1e-5, 7
BLOCK = 2 << 20
WORDS = 200_000
PART = 20_000
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
_PRIME = np.uint64(0x100000001B3)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the subwords of all words, one word after the other, and where each word begins."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    rest = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # places up to the word's end
    total = np.full(len(points), 0xCBF29CE484222325, np.uint64)
    owner, bucket = [], []

    def put(at: np.ndarray, n: int) -> None:
        mixed = total[at] ^ total[at] >> np.uint64(29)
        bucket.append(((mixed * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(word[at].astype(np.int32))

    for n in range(1, min(max(ORDERS), len(points)) + 1):
        total[: len(points) - n + 1] = (total[: len(points) - n + 1] ^ points[n - 1 :]) * _PRIME
        if n in ORDERS:
            put(np.flatnonzero(rest >= n), n)
    if len(words):
        # the whole word, and so every word has one bucket at least
        whole = np.add.reduceat(points * (np.arange(len(points)).astype(np.uint64) - np.repeat((np.cumsum(size) - size).astype(np.uint64), size) * np.uint64(1) + np.uint64(0x9E37)) * _PRIME, np.cumsum(size) - size)
        mixed = whole ^ whole >> np.uint64(31)
        bucket.append(((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(np.arange(len(words), dtype=np.int32))
    owner, bucket = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (owner, bucket))
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words)))


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of documents with so many words begin, in all their words; and how many each has, 1 at least."""
    each = np.maximum(1, np.rint(size / WINDOW).astype(np.int64))
    owner = np.repeat(np.arange(len(size)), each)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    return (np.cumsum(size) - size)[owner] + k * size[owner] // each[owner], each


def once(words: np.ndarray, begin: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each window without repetitions, where each window begins among them, and what to divide by."""
    size = np.diff(np.append(begin, len(words)))
    owner = np.repeat(np.arange(len(begin)), size)
    pairs = np.unique(owner * vocabulary + words)
    return pairs % vocabulary, np.searchsorted(pairs // vocabulary, np.arange(len(begin))), np.maximum(size, LEAST)


class Model:
    def __init__(self, embedding: np.ndarray, classes: np.ndarray, bias: np.ndarray):
        self.scores = embedding @ (classes[1] - classes[0])  # what each subword adds to the difference of the classes
        self.bias = float(bias[1] - bias[0])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros(0)

    def __getstate__(self):
        return {"scores": self.scores.astype(np.float32), "bias": self.bias, "place": {}, "known": np.zeros(0)}

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's place among the scores that are known; new words are scored once."""
        if len(self.place) > WORDS:
            self.clear()
        fresh = list(set(words) - self.place.keys())
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            bucket, first = subwords(fresh)
            total = np.add.reduceat(self.scores[bucket].astype(np.float64), first)
            self.known = np.append(self.known, total / np.diff(np.append(first, len(bucket))))
        return np.array([*map(self.place.__getitem__, words)], np.int64)

    def predict(self, documents: list[str]) -> np.ndarray:
        split = [_WORDS(t.lower()) for t in documents]
        size = np.array([*map(len, split)], np.int64)
        best = np.zeros(len(documents))
        if has := np.flatnonzero(size).tolist():
            words = self.places([w for own in split for w in own])
            begin, each = windows(size[has])
            words, begin, many = once(words, begin, len(self.known))
            mean = np.add.reduceat(self.known[words], begin) / many
            best[has] = np.maximum.reduceat(mean, np.cumsum(each) - each)
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -500, 500)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def clear(self) -> None:
        pass

    def predict(self, documents: list[str]) -> np.ndarray:
        return np.full(len(documents), self.share)


def fit(documents: list[str], labels: np.ndarray) -> Model | Constant:
    """Full-batch Adam on embeddings, class vectors and biases together."""
    if not 0 < labels.sum() < len(labels):
        return Constant(float(labels.mean()) if len(labels) else 0.0)
    vocabulary: dict[str, int] = {}
    own = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _WORDS(t.lower())], np.int64) for t in documents]
    size = np.array([*map(len, own)])
    held = np.flatnonzero(size)
    labels = labels[held].astype(np.float64)
    if not 0 < labels.sum() < len(labels):
        return Constant(float(labels.mean()) if len(labels) else 0.0)
    size, words = size[held], np.concatenate(own)
    del own
    # a part of the vocabulary at a time, as hashing takes much more memory than its result
    listed = [*vocabulary]
    parts = [subwords(listed[at : at + PART]) for at in range(0, len(listed), PART)]
    many = np.concatenate([np.diff(np.append(f, len(b))) for b, f in parts])
    bucket, first = np.concatenate([b for b, _ in parts]), np.cumsum(many) - many
    del parts, listed
    begin, each = windows(size)
    texts_of = np.unique(np.repeat(np.arange(len(held)), size) * len(vocabulary) + words) % len(vocabulary)
    frequent = np.zeros(1 << BITS, np.float32)
    np.add.at(frequent, bucket, np.repeat(np.bincount(texts_of, minlength=len(vocabulary)), many))
    mask = frequent >= MIN_DOCUMENTS
    words, begin, over = once(words, begin, len(vocabulary))
    stop = np.append(begin[1:], len(words))
    doc_first = np.cumsum(each) - each
    weight = np.where(labels == 1, TOXIC_WEIGHT / labels.sum(), (1 - TOXIC_WEIGHT) / (1 - labels).sum())
    random = np.random.default_rng(SEED)
    e = (random.standard_normal((1 << BITS, DIMENSIONS)) * 0.01).astype(np.float32) * mask[:, None]
    u = random.standard_normal((2, DIMENSIONS)).astype(np.float32)
    c = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, u, c)]
    for epoch in range(1, EPOCHS + 1):
        d = u[1] - u[0]
        word = np.add.reduceat((e @ d)[bucket], first) / many
        mean = np.add.reduceat(word[words], begin) / over
        top = np.maximum.reduceat(mean, doc_first)
        # the first window that has the document's highest score
        at = np.flatnonzero(mean == np.repeat(top, each))
        owner = np.repeat(np.arange(len(held)), each)[at]
        at = at[np.unique(owner, return_index=True)[1]]
        g = (1 / (1 + np.exp(-np.clip(top + c[1] - c[0], -60, 60))) - labels) * weight
        # g by word, then by subword
        length = stop[at] - begin[at]
        place = np.repeat(begin[at] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        by_word = np.bincount(words[place], np.repeat(g / over[at], length), len(many)) / many
        active = np.flatnonzero(by_word)
        span = many[active]
        inner = np.repeat(first[active] - np.cumsum(span) + span, span) + np.arange(int(span.sum()))
        by_sub = np.bincount(bucket[inner], np.repeat(by_word[active], span), 1 << BITS).astype(np.float32) * mask
        pull = e.T @ by_sub
        slopes = (by_sub[:, None] * d[None, :] + DECAY * e, np.stack([-pull, pull]) + DECAY * u, np.array([-g.sum(), g.sum()], np.float32))
        for p, slope, (m, v) in zip((e, u, c), slopes, state, strict=True):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            p -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return Model(e, u, c)


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model | Constant:
    """From about ``rows`` of each class among the labelled documents, of whatever length, collected to the driver.

    Where the sample's texts would have more than ``chars`` characters, fewer rows are taken, by the same hash of the id
    for all. Of a text with more than a quarter of ``chars`` a stretch of that length is read, at a place that a hash gives.
    """
    labelled = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_tf_id"), F.col("toxic").cast("int").alias("_tf_toxic"))
    sample = sample_by_label(labelled, "_tf_toxic", "_tf_id", rows)
    found = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_tf_id")).filter("text is not null").select("doc_id", "_tf_toxic", "text")
    total = found.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if total > chars:
        found = found.filter(F.pmod(F.xxhash64("doc_id", F.lit("budget")), F.lit(1 << 20)) < int((1 << 20) * chars / total))
    most = chars // 4
    size = F.char_length("text")
    stretch = F.substring("text", F.pmod(F.xxhash64("doc_id"), F.greatest(size - most, F.lit(1))).cast("int") + 1, F.lit(most))
    found = found.withColumn("text", F.when(size <= most, F.col("text")).otherwise(stretch))
    found = found.toPandas().sort_values(["doc_id", "_tf_toxic"], kind="stable")
    return fit(found["text"].tolist(), found["_tf_toxic"].to_numpy())


def score(spark: SparkSession, docs: DataFrame, model: Model | Constant) -> DataFrame:
    """``docs`` with columns score (0 to 1) and predicted (1 from 0.5); such columns of its own are replaced."""
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    from pyspark.sql.types import StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            found = shared.value.predict(texts(b, "text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])
        shared.value.clear()  # the worker goes on to other work

    return kept.mapInArrow(thrifty(run), StructType([*kept.schema.fields, *StructType.fromDDL("score double, predicted int").fields]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 5) != 0)
    scored = score(spark, docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
