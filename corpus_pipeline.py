"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, suffix-array dedup and best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. n_chars follows the text. Rows without doc_id go only as copies, and null or empty texts stay;
rows that share an id are documents of their own, but for common lines, which go by doc_id. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common, line_dedup, near_dedup, packing, repeats
from tracefold.llm import toxicity as toxic
from tracefold.llm.sampling import remainder

#: Near-duplicate documents in the pipeline are those of this Jaccard similarity or more.
SIMILARITY = (80, 100)

#: SQL cannot express a trained classifier, the tokenizer or the packing.
ORACLE_SQL = None


def _documents(changed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars counted anew."""
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    return changed.select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model learns from the labels of the training folds."""
    common.small_batches(spark)
    labels = common.table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    return toxic.score(spark, docs, toxic.train(docs, labels)).filter("predicted = 0").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all documents but one."""
    common.small_batches(spark)
    return _documents(line_dedup.dedup_lines(spark, docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest doc_id."""
    common.small_batches(spark)
    return near_dedup.drop_near_duplicates(spark, docs, SIMILARITY)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur twice go; what is left of characters that were cut goes too."""
    common.small_batches(spark)
    return _documents(repeats.remove_repeats(spark, docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document."""
    common.small_batches(spark)
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, forget=True)


STAGES = [("toxicity", toxicity), ("lines", lines), ("near_duplicates", near_duplicates), ("suffixes", suffixes), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written as Parquet and read again by the next."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
