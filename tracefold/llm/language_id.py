"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language come from a bounded sample of labelled rows and make a matrix of log-probabilities of
fixed width, which is broadcast. Scoring gathers the matrix's rows for all n-grams of a block of texts and sums them
by text.

Edge cases: `und` with score 0 for a null text, an empty one or one without a letter, and for every text where no
labelled row is left to learn from; rows are scored one by one, repeated ones alike; ties go to the first language in
alphabetical order; an empty table gives an empty result; other columns than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import blocks, texts
from tracefold.llm.sampling import remainder, sample_by_label

#: Rows of each language, about, that the counts are taken from.
TRAIN_ROWS = 4_000
BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
BLOCK = 2 << 20
STEP = 1 << 19
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTER = regex.compile(r"\p{L}").search
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def _points(text: str) -> np.ndarray:
    """The text in lower case, with one space for each run of other things than letters."""
    return np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip(" ") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def features(points: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of each n-gram, for one order after the other; the last places of the array have none."""
    total = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        total = total[: len(points) - n + 1] + points[n - 1 :] * _MULTIPLIERS[n - 1]
        mixed = (total ^ total >> np.uint32(15)) * np.uint32(0x2C1B3C6D + 2 * n)
        yield (mixed >> np.uint32(32 - BITS)).astype(np.int64)


def _pieces(points: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Stretches of a text with the number of places at which their n-grams start."""
    for at in range(0, len(points), STEP):
        yield points[at : at + STEP + max(ORDERS) - 1], min(STEP, len(points) - at)


def count(texts_: list[str]) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for text in texts_:
        for piece, n in _pieces(_points(text)):
            for found in features(piece):
                total += np.bincount(found[:n], minlength=1 << BITS)
    return total


class Model:
    """languages: in order. weights: log-probabilities by language and bucket. prior: log-probabilities by language."""

    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray):
        self.languages = languages
        self.weights = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * counts.shape[1])) if languages else counts
        self.prior = np.log(rows / rows.sum()) if languages else rows

    def predict(self, documents: list[str]) -> tuple[list[str], list[float]]:
        open_ = [i for i, t in enumerate(documents) if self.languages and _LETTER(t)]
        names, scores = ["und"] * len(documents), [0.0] * len(documents)
        total = np.zeros((len(documents), len(self.languages)))
        held: list[tuple[int, np.ndarray, int]] = []

        def flush() -> None:
            if not held:
                return
            points = np.concatenate([p for _, p, _ in held])
            size = np.array([len(p) for _, p, _ in held])
            first = np.cumsum(size) - size
            owner, places = np.array([i for i, *_ in held]), np.array([n for *_, n in held])
            for order, found in zip(ORDERS, features(points), strict=True):
                many = np.clip(size - order + 1, 0, places)  # no n-gram goes beyond its text
                has = many > 0
                starts = np.stack([first[has], first[has] + many[has]], 1).ravel()
                for k, weights in enumerate(self.weights):
                    np.add.at(total[:, k], owner[has], np.add.reduceat(np.append(weights[found], 0.0), starts)[::2])
            held.clear()

        size = 0
        for i in open_:
            for piece, n in _pieces(_points(documents[i])):
                held.append((i, piece, n))
                size += len(piece)
                if size >= STEP:
                    flush()
                    size = 0
        flush()
        for i in open_:
            joint = total[i] + self.prior
            best = int(joint.argmax())
            names[i], scores[i] = self.languages[best], float(1 / np.exp(joint - joint[best]).sum())
        return names, scores


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From the rows of (doc_id, text, lang) with a language and a letter, about ``rows`` for each language."""
    sample = sample_by_label(labelled.filter("lang is not null and text is not null"), "lang", "doc_id", rows).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in blocks(batches, "text", BLOCK):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if _LETTER(text):
                    found[lang] = found.get(lang, 0) + count([text])
                    seen[lang] = seen.get(lang, 0) + 1
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], seen[lang]))], names=["lang", "bucket", "n"])

    # The sample has a fixed size, so a few tasks count it, whatever the size of the table.
    counted = sample.repartition(8).mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts, seen = np.zeros((len(languages), 1 << BITS)), np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        inner = own[own["bucket"] >= 0]
        counts[k, inner["bucket"].to_numpy()] = inner["n"].to_numpy()
        seen[k] = own.loc[own["bucket"] < 0, "n"].sum()
    return Model(languages, counts, seen)


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of (doc_id, text)."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            names, scores = shared.value.predict(texts(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(remainder("doc_id", 3) != 1))
    return predict(spark, docs, model).withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
