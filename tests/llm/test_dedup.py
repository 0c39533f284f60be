"""Line, near, suffix and embedding dedup against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import embedding_dedup, line_dedup, near_dedup, repeats
from tracefold.llm.components import connected
from tracefold.llm.common import Scratch
from tracefold.llm.shingles import shingle_set

DOCS = "doc_id long, text string"


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ------------------------------------------------------------------------------------------------ components


@pytest.mark.parametrize("kind", ["random", "sparse", "chain", "star", "empty"])
def test_components(spark, kind):
    random_ = random.Random(kind)
    links = {
        "random": [(random_.randrange(80), random_.randrange(80)) for _ in range(60)],
        "sparse": [(random_.randrange(400), random_.randrange(400)) for _ in range(90)],
        "chain": random_.sample([(i, i + 1) for i in range(150)], 150),
        "star": [(7, i) for i in range(200)],
        "empty": [],
    }[kind]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = connected(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c").collect()
    assert {r.node: r.label for r in got} == components(nodes, links)


# ------------------------------------------------------------------------------------------------ lines


def plain_lines(rows, min_docs=5, min_chars=40):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    holders = defaultdict(set)
    for doc, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(doc)
    out = {}
    for doc, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and doc != max(holders[key(x)]))]
        out[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.fixture
def line_rows():
    random_ = random.Random(4)
    common = ["A common line that many documents share, number %d" % i for i in range(6)] + ["é" * 40, "é" * 39, " \t" + "X" * 45 + "\x0b"]
    rows = [(i, "\n".join(random_.choice([*common, "own %d %d" % (i, k), "", "x" * 45]) for k in range(random_.randint(0, 12)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, common[0] + "\n" + common[0].upper())]


def test_lines_against_brute_force(spark, line_rows):
    got = line_dedup.dedup_lines(spark, spark.createDataFrame(line_rows, DOCS).repartition(5)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == plain_lines(line_rows)


@pytest.mark.parametrize("shard, part", [(2, 100), (1, 3), (10_000, 10_000)])
def test_lines_in_shards_and_parts(spark, line_rows, monkeypatch, shard, part):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    monkeypatch.setattr(line_dedup, "PART_KEYS", part)
    got = line_dedup.dedup_lines(spark, spark.createDataFrame(line_rows, DOCS)).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {k: v[2] for k, v in plain_lines(line_rows).items()}


def held(state):
    """Counts, and the fingerprints of each filter by the pair of buckets that a key of theirs may be in."""
    counts = {tuple(r) for r in state.counts.collect()}
    marks = {}
    for r in state.filters.collect():
        f = line_dedup.CuckooFilter(r.buckets, bytes(r.data))
        at, slot = np.nonzero(f.table)
        mark = f.table[at, slot]
        marks[r.shard] = sorted(zip(mark.tolist(), np.minimum(at, at ^ f._step(mark)).tolist(), strict=True))
    return counts, {k: v for k, v in marks.items() if v}


@pytest.mark.parametrize("shard", [4, 10_000])
def test_deleting_documents_takes_decisions_back(spark, line_rows, monkeypatch, shard):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    a, b = spark.createDataFrame(line_rows[:40], DOCS), spark.createDataFrame(line_rows[40:], DOCS)
    before = line_dedup.index_lines(spark, a)
    grown = before.insert(b)
    whole = line_dedup.index_lines(spark, a.unionByName(b))
    assert held(grown)[0] == held(whole)[0] and held(grown) != held(before)
    keys = np.array([(r.k1, r.k2) for r in grown.common.collect()])
    screened = {(r.k1, r.k2) for r in grown.screened(grown.postings).collect()}
    assert {tuple(k) for k in keys.tolist()} <= screened
    got = line_dedup.dedup_lines(spark, a.unionByName(b), state=grown).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == plain_lines(line_rows)
    less = grown.delete(b.select("doc_id"))
    assert held(less) == held(before)
    got = line_dedup.dedup_lines(spark, a, state=less).collect()
    assert {r.doc_id: r.text for r in got} == {k: v[0] for k, v in plain_lines(line_rows[:40]).items()}
    assert held(less.delete(a.select("doc_id"))) == (set(), {})


def test_a_filter_that_overflows_is_built_anew(spark):
    line = lambda k: "line number %d, which is long enough to count" % k
    rows = lambda keys: spark.createDataFrame([(i, "\n".join(map(line, keys))) for i in range(5)], DOCS)
    state = line_dedup.index_lines(spark, rows(range(3))).insert(rows(range(3, 400)))
    assert state.filters.count() == 1 and state.common.count() == 400
    assert state.screened(state.postings).select("k1").distinct().count() == 400


def test_lines_of_rows_without_ids(spark):
    common = "a line that is common to all of these documents here"
    rows = [(None, common)] * 3 + [(i, common + "\nown") for i in range(4)]
    got = line_dedup.dedup_lines(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(None, common)] * 3 + [(0, "own"), (1, "own"), (2, "own"), (3, common + "\nown")], key=repr)


def test_cuckoo_filter():
    random_ = np.random.default_rng(1)
    keys = random_.integers(-(1 << 62), 1 << 62, (3000, 2))
    f = line_dedup.CuckooFilter.sized(2000)
    for a, b in keys[:2000].tolist():
        f.insert(a, b)
    assert not f.full and f.contains(keys[:2000, 0], keys[:2000, 1]).all() and f.contains(keys[2000:, 0], keys[2000:, 1]).mean() < 0.01
    for a, b in keys[:1000].tolist():
        assert f.delete(a, b)
    assert f.contains(keys[1000:2000, 0], keys[1000:2000, 1]).all() and f.contains(keys[:1000, 0], keys[:1000, 1]).mean() < 0.01
    small = line_dedup.CuckooFilter(2)
    for a, b in keys[:50].tolist():
        small.insert(a, b)
    assert small.full and small.contains(keys[:, 0], keys[:, 1]).all()


def test_lines_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x")], "doc_id long, text string, n_lines int, lang string")
    assert line_dedup.dedup_lines(spark, docs).select("doc_id", "text", "lang", "n_lines").first() == (1, "a", "x", 1)
    assert line_dedup.dedup_lines(spark, docs.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------ near-duplicates


def near_rows():
    random_ = random.Random(9)
    words = ["w%d" % i for i in range(400)]
    rows, base = [], [random_.choice(words) for _ in range(120)]
    for i in range(150):
        own = list(base)
        kind = i % 5
        if kind == 0:
            own = [random_.choice(words) for _ in range(random_.randint(1, 200))]
        elif kind == 1:
            for _ in range(random_.randint(0, 6)):
                own[random_.randrange(len(own))] = random_.choice(words)
        elif kind == 2:
            own = own[: random_.randint(100, 120)]
        elif kind == 3:
            own = base[:4] if i % 2 else base[:9]
        rows.append((i, " ".join(own).title() if i % 7 == 0 else "\t".join(own)))
    return [*rows, (500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "ONE "), (505, "one\u00a0two")]


def near_truth(rows, part=85, whole=100):
    sets = {i: set(shingle_set(t or "").tolist()) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, components(sets, links)


@pytest.mark.parametrize("broadcast, tile, bundle", [(500_000, 64, 4_000), (0, 7, 30)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, broadcast, tile, bundle):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "BUNDLE", bundle)
    rows = near_rows()
    sizes, label = near_truth(rows)
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (sizes[i], label[i], label[i] == i) for i in sizes}


def test_near_duplicates_in_one_band(spark, monkeypatch):
    """Chains and stars of near copies that share bands, and a template whose fillings are no links."""
    monkeypatch.setattr(near_dedup, "TILE", 5)
    random_ = random.Random(12)
    words = ["w%d" % i for i in range(5000)]
    base, rows = [random_.choice(words) for _ in range(300)], []
    own = base
    for _ in range(60):  # each is near the one before, the ends are far apart
        own = list(own)
        own[random_.randrange(300)] = random_.choice(words)
        rows.append(own)
    rows += [[random_.choice(words) if 40 * (k % 6) < i < 40 * (k % 6) + 12 else w for i, w in enumerate(base)] for k in range(60)]
    rows += [base[:180] + [random_.choice(words) for _ in range(60)] for _ in range(50)]
    random_.shuffle(rows)
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    _, label = near_truth(rows)
    assert 40 < len(set(label.values())) < 110
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def row_components(rows, similarity=(85, 100)):
    """(doc_id, text) of each row with its component's smallest id, rows being documents whatever their ids."""
    _, label = near_truth([(k, t) for k, (_, t) in enumerate(rows)], *similarity)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(label[k], []).extend([] if i is None else [i])
    return [(i, t, min(least[label[k]], default=None)) for k, (i, t) in enumerate(rows)], label


def odd_rows():
    """Repeated ids with other texts, missing ids, and rows that are alike in all."""
    long = [" ".join("%s%d" % (c, k) for k in range(100)) for c in "abcdefg"]
    near = [t.replace("50 ", "x ") for t in long]
    rows = [(1, long[0]), (5, long[1]), (5, near[0]), (7, long[2]), (None, near[2]), (9, near[2] + " y"), (None, long[3]), (None, near[3])]
    rows += [(3, long[4]), (3, long[4]), (3, near[4]), (None, long[5]), (None, long[5]), (8, None), (8, ""), (None, None), (2, long[6]), (None, long[6]), (11, near[1])]
    return rows


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rows = odd_rows()
    want, _ = row_components(rows)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, node string, h int")
    got = near_dedup.near_duplicates(spark, df).collect()
    key = lambda r: repr(r)
    sizes = [(len(shingle_set(t or "")), i, c) for i, t, c in want]
    assert sorted(((r.n_shingles, r.doc_id, r.component_id) for r in got), key=key) == sorted(sizes, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_dropping_near_duplicates_keeps_one_row_of_each_group(spark):
    rows = odd_rows()
    _, label = row_components(rows)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, label string, h int")
    got = near_dedup.drop_near_duplicates(spark, df)
    assert got.columns == df.columns
    groups = {k: label[k] for k, (_, t) in enumerate(rows) if t}
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(groups.values())) + sum(not t for _, t in rows)
    for g in set(groups.values()):
        own = [rows[k] for k in groups if groups[k] == g]
        least = min(own, key=lambda r: (r[0] is None, r[0] or 0))[0]
        assert sum(r in own for r in kept) == 1 and [i for i, t in kept if (i, t) in own] == [least]


def test_near_duplicates_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    sizes, label = near_truth(rows)
    got = near_dedup.op6_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], label[i]) for i in sizes}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark, spark.createDataFrame([], DOCS)).count() == 0
    assert near_dedup.drop_near_duplicates(spark, spark.createDataFrame([], DOCS)).count() == 0
    assert [r.component_id for r in near_dedup.near_duplicates(spark, spark.createDataFrame([(4, None)], DOCS)).collect()] == [4]


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("A b")) == 1 and shingle_set("A B c d E").tolist() == shingle_set("a b C D e").tolist()
    assert shingle_set("Ä x").tolist() != shingle_set("ä x").tolist() and len(shingle_set("a a a a a a a")) == 1


def test_estimates():
    random_ = np.random.default_rng(2)
    pool = random_.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = 1000
        common = int(2 * n * share / (1 + share))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
        found = near_dedup.estimate(*(near_dedup.sketches([s]).reshape(1, -1) for s in (a, b)))[0, 0]
        assert abs(found - share) < 0.15


# ------------------------------------------------------------------------------------------------ repeats


def plain_repeats(texts):
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        marks = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                marks[i] += 1
                marks[i + 200] -= 1
        covered = np.cumsum(marks)[:-1] > 0
        runs = np.count_nonzero(np.diff(np.concatenate(([0], covered.astype(int)))) == 1)
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


def repeat_rows():
    random_ = random.Random(5)
    words = ["".join(random_.choice("abcdeé") for _ in range(random_.randint(1, 7))) for _ in range(300)]
    some = lambda n: " ".join(random_.choice(words) for _ in range(n))
    base, rows = some(150), []
    for i in range(72):
        own = base.split()
        for _ in range(random_.randint(1, 6)):
            own[random_.randrange(len(own))] = random_.choice(words)
        a = random_.randint(0, 300)
        rows.append((i, [some(random_.randint(0, 200)), f"x{i} {base} y{i}", " ".join(own), random_.choice(["ab", "a", "xyz ", "Èeu "]) * random_.randint(50, 400), base[a : a + random_.randint(190, 260)], base, some(40) + base[a : a + 230] + some(40) + base[a + 50 : a + 400], None if i % 3 else ""][i % 8]))
    return [*rows, (900, "z" * 199), (901, "q" * 200), (902, "k" * 201), (902, "k" * 201)]


@pytest.mark.parametrize("most, bytes_, step", [(2000, 1 << 25, 1 << 20), (3, -1, 257), (1, -1, 1 << 20)])
def test_repeats_against_brute_force(spark, monkeypatch, most, bytes_, step):
    for name, value in (("MOST", most), ("BROADCAST_BYTES", bytes_), ("STEP", step)):
        monkeypatch.setattr(repeats, name, value)
    rows = repeat_rows()
    got = repeats.remove_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(5)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = plain_repeats([(t or "").encode() for _, t in rows])
    assert sorted(tuple(r) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_repeats_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = repeats.op5_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    want = plain_repeats([t.encode() for _, t in rows])
    assert sorted(tuple(r) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_repeats_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 7), (None, None, "y", 8)], "doc_id long, text string, kept string, n_chars int")
    got = repeats.remove_repeats(spark, docs).orderBy("n_chars").collect()
    assert [(r.doc_id, r.text, bytes(r.kept), r.n_chars) for r in got] == [(1, "a", b"a", 7), (None, "", b"", 8)]
    assert repeats.remove_repeats(spark, docs.limit(0)).count() == 0


def test_halves_have_the_same_strings():
    """Pieces cut down to single strings still name the bytes that stand at their starts."""
    raw = random.Random(1).randbytes(600)
    starts, counts, *_ = repeats.segments_of(raw)
    rows, want = [*repeats.pieces_of(raw, starts, counts)], [*range(401)]
    assert sorted(s + k for _, _, _, _, s, n, _, _ in rows for k in range(n)) == want
    while any(n > 1 for *_, n, _, _ in rows):
        rows = [h for core, _, lo, hi, start, n, left, right in rows for h in (repeats.halves(core, lo, hi, start, n, left, right) if hi > lo else [(core, b"", lo, hi, start, n, left, right)])]
    assert sorted(r[4] for r in rows) == want and len({r[0] for r in rows}) == len(want)
    for _, _, lo, hi, start, n, left, right in rows:
        assert len(left) + len(right) == hi - lo and raw[start : start + len(left)] == left and raw[start + 200 - len(right) : start + 200] == right


def test_whole_documents_sorted_column_by_column():
    """The named construction over whole documents, on a small collection, finds what the operator finds."""
    random_ = random.Random(8)
    base = random_.randbytes(500)
    documents = [random_.randbytes(80) + base[a : a + 260] + random_.randbytes(40) for a in (0, 30, 100, 240)] + [random_.randbytes(300)]
    suffix, prefix = repeats.common_prefixes([np.frombuffer(d, np.uint8).astype(np.int64) + 1 for d in documents], lambda s: np.ones_like(s))
    near = np.maximum(prefix, np.append(prefix[1:], 0)) >= 200
    found, begin = set(suffix[near].tolist()), np.cumsum([0, *map(len, documents)])
    count = Counter(d[i : i + 200] for d in documents for i in range(len(d) - 199))
    assert found == {int(begin[k]) + i for k, d in enumerate(documents) for i in range(len(d) - 199) if count[d[i : i + 200]] > 1} and found


def test_suffix_order_and_prefixes():
    random_ = random.Random(3)
    for _ in range(40):
        strings = [np.array([random_.randint(1, 3) for _ in range(random_.randint(0, 14))], np.int64) for _ in range(random_.randint(1, 12))]
        suffix, prefix = repeats.common_prefixes(strings, lambda s: np.where(s == 3, 5, 1))
        begin = np.cumsum([0, *map(len, strings)])
        listed = sorted((tuple(s[i:].tolist()), x, int(begin[x] + i)) for x, s in enumerate(strings) for i in range(len(s) + 1))

        def shared(a, b):
            n = 0
            for p, q in zip(a, b, strict=False):
                if p != q:
                    break
                n += 5 if p == 3 else 1
            return n

        assert suffix.tolist() == [s[2] for s in listed]
        assert prefix.tolist() == [0, *(shared(a[0], b[0]) for a, b in zip(listed, listed[1:], strict=False))]


# ------------------------------------------------------------------------------------------------ embeddings


def vector_rows(n=400):
    random_ = np.random.default_rng(8)
    base = random_.standard_normal((40, 64))
    x = np.concatenate([random_.standard_normal((n // 2, 64)), base[random_.integers(0, 40, n // 2)] + random_.standard_normal((n // 2, 64)) * random_.uniform(0, 0.5, (n // 2, 1))])
    x[5], x[6] = x[7], x[7] * 3
    return x


@pytest.mark.parametrize("tile, broadcast", [(256, 100_000), (3, 0)])
def test_vectors_against_brute_force(spark, monkeypatch, tile, broadcast):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "BROADCAST_FILTERS", broadcast)
    x = vector_rows()
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    truth = components(range(len(x)), np.argwhere(near).tolist())
    assert near.sum() > 300 and {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (near[i].sum(), truth[i], truth[i] == i) for i in range(len(x))}


@pytest.mark.parametrize("dimensions", [2, 3, 16, 64, 300])
@pytest.mark.parametrize("vectors", [1_000, 3_000_000])
def test_pairs_at_the_threshold_share_a_filter(dimensions, vectors):
    random_ = np.random.default_rng(dimensions)
    a, b = random_.standard_normal((2, 300, dimensions))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    code = embedding_dedup.code_size(vectors)
    x, y = embedding_dedup.passed(a, code), embedding_dedup.passed(b, code)
    assert all(len(f) >= embedding_dedup.PASSED and (np.diff(f) > 0).all() and f.max() < code**2 for f in x)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)]) >= 0.97
    assert np.mean([*map(len, x)]) < 3 * embedding_dedup.PASSED


def test_vectors_with_repeated_and_missing_ids(spark):
    random_ = np.random.default_rng(4)
    base = random_.standard_normal((6, 20))
    near = base + 0.02 * random_.standard_normal(base.shape)
    rows = [(1, base[0]), (5, base[1]), (5, near[0]), (7, near[0] * 2 + 0.01), (None, near[2]), (9, base[2]), (12, near[2] + 0.01), (None, base[3]), (None, near[3]), (4, base[4]), (4, base[4]), (None, base[5]), (None, None)]
    x = np.stack([np.zeros(20) if v is None else v for _, v in rows])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = components(range(len(x)), np.argwhere(near).tolist())
    least = {c: min((rows[k][0] for k in label if label[k] == c and rows[k][0] is not None), default=None) for c in label.values()}
    want = [(i, int(near[k].sum()), i if v is None else least[label[k]]) for k, (i, v) in enumerate(rows)]
    df = spark.createDataFrame([(i, None if v is None else v.tolist(), 5, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, raw string")
    got = embedding_dedup.near_vectors(spark, df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [-1.0, 0.0]), (9, [1e-300, 0.0]), (10, []), (11, [1.0, 0.0]), (12, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark, df).collect()}
    assert got == {i: (3, 1, i == 1) if i in (1, 2, 9, 11) else (0, i, True) for i, _ in rows}
    assert embedding_dedup.near_vectors(spark, df.limit(0)).count() == 0
