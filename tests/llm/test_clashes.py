"""Tables that already have columns with the names that operators 2, 3, 9 and 10 use or return."""

import public_tokenizers
from pyspark.sql import functions as F

from tracefold.llm import byte_bpe, chat, language_id, packing

PATH, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur le tapis", "fr"), (2, "le chat", "fr"), (3, None, None), (4, "", "en"), (None, "word " * 3000, "en")]


def documents(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string")


def clashing(df, *names):
    """The table with these columns of another type in front of its own."""
    return df.select(*[F.array(F.lit("other")).alias(n) for n in names], "*")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_byte_bpe(spark):
    docs = documents(spark)
    more = clashing(docs, "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    for run in (lambda d: byte_bpe.round_trip(d, PATH, public_tokenizers.PATTERN), lambda d: byte_bpe.decode(byte_bpe.encode(d, PATH, public_tokenizers.PATTERN), PATH)):
        assert rows(run(more)) == rows(run(docs))


def test_language_id(spark):
    docs = documents(spark)
    more = clashing(docs, "lang_pred", "score", "held_out", "bucket", "n", "weight", "rank")
    one, two = language_id.train(docs), language_id.train(more)
    assert one.languages == two.languages == ["en", "fr"] and (one.weights == two.weights).all() and (one.prior == two.prior).all()
    assert rows(language_id.predict(spark, more, two)) == rows(language_id.predict(spark, docs, one))


def test_packing(spark):
    docs = documents(spark)
    more = clashing(docs, "piece", "start", "length", "ids_crc32", "task", "place", "rank", "before", "n", "sequence_id", "offset")
    # which of two alike pieces comes first is open, so what is compared is each document's pieces and each sequence's fill
    for names in (["doc_id", "piece", "start", "length", "ids_crc32"], ["sequence_id", "offset", "length"]):
        assert rows(packing.pack(spark, more, JSON, public_tokenizers.PATTERN).select(names)) == rows(packing.pack(spark, docs, JSON, public_tokenizers.PATTERN).select(names))


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    more = clashing(turns, "seq", "kind", "no", "formatted", "loss_start", "loss_end", "n_turns", "loss_chars")
    assert rows(chat.digests(chat.messages(chat.as_events(more)))) == rows(chat.digests(chat.messages(chat.as_events(turns))))
