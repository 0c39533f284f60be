"""Language identification and toxicity: held-out accuracy and edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tracefold.llm import language_id, toxicity

DIR = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    got = language_id.op3_language_id(spark, DIR).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !?", "en"), (6, "und der hund", None), (7, "the dog " * 90_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(spark, docs, model).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert got[3].score == 0.0
    nothing = language_id.train(docs.filter("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.predict(spark, docs, nothing).collect()} == {"und"}
    assert language_id.predict(spark, docs.limit(0), model).count() == 0


def test_languages_by_a_plain_bayes(spark):
    """Every n-gram on its own, from the whole training sample, without blocks or batches."""
    texts = {"en": ["the cat sat on the mat", "dogs and cats, and the rest"], "de": ["der hund und die katze", "ein haus am see"], "fr": ["la maison est là", "le chat et le chien"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    size = 1 << language_id.BITS

    def grams(text):
        points = language_id._points(text)
        for n in range(1, 4):
            for at in range(len(points) - n + 1):
                *_, found = [*language_id.features(points[at : at + n])][:n]
                yield int(found[0])

    counts = {lang: Counter(g for t in own for g in grams(t)) for lang, own in texts.items()}
    for text in ["the hund", "chat et cat", "x", "une maison, the house " * 30]:
        joint = {lang: math.log(1 / 3) + sum(math.log((c[g] + 0.5) / (c.total() + 0.5 * size)) for g in grams(text)) for lang, c in counts.items()}
        top = max(joint.values())
        [name], [score] = model.predict([text])
        assert joint[name] == top and math.isclose(score, 1 / sum(math.exp(j - top) for j in joint.values()), rel_tol=1e-9)


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    text = "Äpfel und birnen, the end. " * 50
    whole = language_id.count([text])
    monkeypatch.setattr(language_id, "STEP", 37)
    assert np.array_equal(language_id.count([text]), whole)


def test_a_batch_does_not_change_a_score(spark):
    texts = ["the cat", "la maison est là", "", "x" * 5000, "der hund"]
    counts = np.stack([language_id.count([t]) for t in ("the cat sat on the mat", "la maison de la rue", "der hund und die katze")])
    model = language_id.Model(["en", "fr", "de"], counts.astype(float), np.ones(3))
    together = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone])


def made(random, n, toxic):
    words = ["".join(random.choice(list("aeioulmnrst"), random.integers(2, 8))) for _ in range(n)]
    if toxic:
        for at in random.integers(0, n, max(2, n // 40)):
            words[at] = ["worthless", "idiot", "stupid"][random.integers(3)]
    return " ".join(words)


def test_toxicity_learns_and_shares_subwords():
    random = np.random.default_rng(3)
    labels = np.arange(500) % 4 == 0
    model = toxicity.fit([made(random, int(random.integers(20, 400)), t) for t in labels], labels.astype(int))
    held = np.arange(200) % 4 == 0
    scores = model.predict([made(random, int(random.integers(20, 2000)), t) for t in held])
    assert scores[held].min() > scores[~held].max() - 0.5 and np.mean((scores >= 0.5) == held) > 0.95
    clean, toxic, misspelt = model.predict(["moral steam lots rent tale" * 3, "you are stupid and worthless", "you are stupidd and wworthless"])
    assert toxic > 0.5 and misspelt > 0.5 > clean


def test_toxicity_by_plain_loops():
    random = np.random.default_rng(5)
    labels = (np.arange(80) % 4 == 0).astype(int)
    texts = [made(random, int(random.integers(3, 120)), t) for t in labels]
    model = toxicity.fit(texts, labels)
    for text in texts[:20]:
        words = text.lower().split()
        begin, _ = toxicity.windows(np.array([len(words)]))
        best = -np.inf
        for a, z in zip(begin, [*begin[1:], len(words)], strict=True):
            total = 0.0
            for w in set(words[a:z]):
                bucket, _ = toxicity.subwords([w])
                total += np.mean([float(np.float64(model.scores[b])) for b in bucket])
            best = max(best, total / max(z - a, toxicity.LEAST))
        assert math.isclose(model.predict([text])[0], 1 / (1 + math.exp(-best - model.bias)), rel_tol=1e-6)


def test_training_reads_long_texts_and_keeps_its_budget(spark):
    rows = [(i, "fine words here and there") for i in range(300)] + [(1000, "x " * 4000 + "idiot")]
    labels = [(i, 0) for i in range(300)] + [(1000, 1), (1000, 0)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda texts, y: seen.append((texts, y.tolist()))
    try:
        toxicity.train(docs, labels)
        toxicity.train(docs, labels, chars=4_000)
    finally:
        toxicity.fit = fit
    (whole, y), (few, _) = seen
    assert len(whole) == 302 and sorted(y) == [0] * 301 + [1] and whole.count(rows[-1][1]) == 2
    assert 0 < len(few) < 200 and all(len(t) <= 1_000 for t in few)


def test_toxicity_edge_cases(spark):
    rows = [(1, "good day to you"), (2, None), (3, ""), (4, "?!"), (5, "good day to you")]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, None)], "doc_id long, toxic int")
    scored = toxicity.score(spark, docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert toxicity.score(spark, docs.limit(0), toxicity.Constant(0.0)).count() == 0
    model = toxicity.fit(["bad bad word here"] * 10 + ["some fine text"] * 10, np.array([1] * 10 + [0] * 10))
    many = model.predict(["", "bad bad word here", "some fine text", "fine " * 5000 + "bad word"])
    assert many[1] > many[2] and np.array_equal(model.predict(["", "x"])[:1], model.predict([""]))


def test_toxicity_of_held_out_documents(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    clean, toxic = ([r.predicted for r in held if truth[r.doc_id] == k] for k in (0, 1))
    assert np.mean(clean) < 0.02 and np.mean(toxic) > 0.5


@pytest.mark.parametrize("size", [0, 1, 47, 48, 49, 500])
def test_windows_cover_all_words(size):
    begin, each = toxicity.windows(np.array([size]))
    assert each[0] == max(1, round(size / toxicity.WINDOW)) and begin[0] == 0 and (np.diff(begin) > 0).all()
