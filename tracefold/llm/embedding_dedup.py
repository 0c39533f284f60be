"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction, and a vector passes it if its cosine with the direction exceeds a threshold. The directions
form a random product code: the space, after a random rotation, is the product of two subspaces (of one, where it has
few dimensions) with a small random code each, and a direction is one codeword of each. So the directions that a vector passes are listed from its products
with the codewords, best first, without trying them all. Vectors that pass the same filter meet there: filters are
dealt to tiles of two blocks of bounded size, and a tile verifies all its pairs in double precision. A pair counts in
the first filter that both pass, and nowhere else; a tile gives counts and no more links than connect what is
connected. Equal vectors take part once, as one node, whose number says nothing about ids.

The number of directions follows the number of vectors, and the threshold follows from both, so that a vector passes
about ``PASSED`` filters and a filter is passed by about ``TILE`` vectors, however many there are: the comparisons of a
vector do not grow with the table, unless a part of the space is crowded.

Edge cases: a vector that is null, zero, or holds a null or non-finite component links with nothing and is its own
component; equal vectors link with each other; vectors of different lengths (dimensions) never link. Rows are vectors,
and several may have one vec_id: each has the links of its own vector. A row without vec_id links others like any row;
its component_id is that of its component, null where no row there has an id, and kept compares both ids, null equal to
null. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import Scratch
from tracefold.llm.components import connected

COSINE = 0.95
#: Filters that a vector passes, about and at least; a vector that exceeds the threshold in fewer takes its best so many.
PASSED = 24
#: Codewords of each part: this many at least, and as many as ids of 31 bits allow.
LEAST_CODE, MOST_CODE = 144, 46_340
#: Spaces of fewer dimensions are one part, with so many codewords at most.
LEAST_DIMENSIONS, MOST_WORDS = 16, 1 << 17
#: Vectors in a block of a tile, and about as many as pass a filter.
TILE = 256
BUNDLE = 4_000
#: Crowded filters are broadcast up to this number; beyond it both sides are shuffled, with the same result.
BROADCAST_FILTERS = 100_000
SEED = 20_240_607


def code_size(vectors: int) -> int:
    """Codewords of each part for so many vectors."""
    return min(MOST_CODE, max(LEAST_CODE, math.ceil(math.sqrt(PASSED * vectors / TILE))))


@lru_cache(maxsize=64)
def _caps(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of the sphere within each."""
    angle = np.linspace(0, np.pi, 200_001)[1:-1]
    mass = np.cumsum(np.sin(angle) ** (dimensions - 2))
    return angle, mass / mass[-1]


def cap_cosine(dimensions: int, share: float) -> float:
    """The cosine that a random direction has, or exceeds, with a given one with probability ``share``."""
    angle, mass = _caps(dimensions)
    return float(np.cos(np.interp(share, mass, angle)))


def words_of(dimensions: int, code: int) -> int:
    """Codewords of the one part of a space of few dimensions, where caps need not be narrower than a pair's angle."""
    angle, mass = _caps(max(2, dimensions))
    return min(code**2, MOST_WORDS, math.ceil(PASSED / np.interp(np.arccos(COSINE), angle, mass)))


@lru_cache(maxsize=8)
def codes(dimensions: int, code: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation, and for each part of the space a code of vectors of length 1 / sqrt(parts)."""
    random = np.random.default_rng([SEED, dimensions, code])
    rotation = np.linalg.qr(random.standard_normal((dimensions, dimensions)))[0]
    parts = np.array_split(np.arange(dimensions), 2 if dimensions >= LEAST_DIMENSIONS else 1)
    made = []
    for part in parts:
        words = random.standard_normal((code if len(parts) == 2 else words_of(dimensions, code), len(part)))
        made.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(len(parts)))
    return rotation, made


def passed(vectors: np.ndarray, code: int) -> list[np.ndarray]:
    """The filters that each unit vector passes, in ascending order."""
    dimensions = vectors.shape[1]
    rotation, made = codes(dimensions, code)
    if len(made) == 1:
        products = vectors @ rotation @ made[0].T
        bound = min(cap_cosine(dimensions, PASSED / len(made[0])), COSINE) if dimensions > 1 else COSINE
        few = products.shape[1] - PASSED
        found = [np.flatnonzero(x > bound) for x in products]
        return [np.sort(f if len(f) >= PASSED else np.argpartition(x, few)[few:]).astype(np.int32) for f, x in zip(found, products, strict=True)]
    turned = np.split(vectors @ rotation, [made[0].shape[1]], axis=1)
    bound = cap_cosine(dimensions, min(0.5, PASSED / code**2))
    out = []
    for p, q in zip(*(x @ c.T for x, c in zip(turned, made, strict=True)), strict=True):
        order = np.argsort(-q, kind="stable")
        q = -q[order]  # ascending
        first = np.flatnonzero(p - q[0] > bound)
        many = np.searchsorted(q, p[first] - bound)  # codewords of the second part that lift it over the bound
        if int(many.sum()) < PASSED:
            few = min(PASSED, code)
            first = np.argpartition(-p, few - 1)[:few]
            sums = p[first][:, None] - q[:few]
            best = np.argsort(-sums, axis=None, kind="stable")[:PASSED]
            ids = first[best // few] * code + order[best % few]
        else:
            place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            ids = np.repeat(first, many) * code + order[place]
        out.append(np.sort(ids).astype(np.int32))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's length and components as bytes, and their hash; null for those that link with nothing.

    Components that single precision holds exactly are kept so, as the same numbers in half the space.
    """
    for b in batches:
        ids, hashes, raws = b.column(0), [], []
        for v in b.column(1):
            x = None
            if v.is_valid and v.values is not None and len(v.values) and not v.values.null_count:
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all() or not x.any():
                    x = None
            if x is None:
                raws.append(None)
                hashes.append((None, None))
                continue
            x = x + 0.0  # one zero
            with np.errstate(over="ignore", under="ignore"):
                single = x.astype("<f4")
            raws.append(b"%d " % len(x) + (single if (single == x).all() else x).tobytes())
            hashes.append(tuple(np.frombuffer(xxhash.xxh3_128_digest(raws[-1]), np.int64).tolist()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([h for h, _ in hashes], pa.int64()), pa.array([h for _, h in hashes], pa.int64()), pa.array(raws, pa.binary())], names=["vec_id", "h1", "h2", "raw"])


def _components(raw: bytes) -> np.ndarray:
    n, held = raw.split(b" ", 1)
    return np.frombuffer(held, "<f4" if len(held) == 4 * int(n) else "<f8").astype(np.float64)


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.stack([_components(r) for r in raws])
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(code: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(1000, 2_000_000 // code, 4_000_000 // min(code**2, MOST_WORDS)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                raws = b.column(2).to_pylist()
                size = np.array([int(r.split(b" ", 1)[0]) for r in raws])
                found: list = [None] * len(raws)
                for n in np.unique(size):
                    own = np.flatnonzero(size == n)
                    for i, f in zip(own.tolist(), passed(_unit([raws[i] for i in own]), code), strict=True):
                        found[i] = f
                columns = [b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(pa.int32())), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "weight", "raw", "filters", "size"])

    return run


def _tile(me: int, rows: pd.DataFrame, bound: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(nodes, how many vectors each links with here, links that connect them) for the tile of one filter."""
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    vectors, block = _unit(rows["raw"].tolist()), rows["block"].to_numpy()
    sides = [np.flatnonzero(block == k) for k in (i, j)]
    near = vectors[sides[0]] @ vectors[sides[1]].T >= bound
    if i == j:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = sides[0][a], sides[1][b]
    lists = rows["filters"].tolist()
    wide = max(map(len, lists))
    table = np.full((len(lists), wide), -1, np.int32)
    for k, f in enumerate(lists):
        table[k, : len(f)] = f
    nodes, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
    total = np.zeros(len(nodes), np.int64)
    parent = np.arange(len(nodes))
    links = []
    # earlier filters of each vector; a pair that shares one of them has been counted there
    early = np.where((table >= 0) & (table < me), table, -1)
    distinct = np.unique(early[early >= 0])
    marks = np.zeros((len(nodes), len(distinct)), np.float32)
    k, c = np.nonzero(early >= 0)
    marks[k, np.searchsorted(distinct, early[k, c])] = 1
    if len(a):
        shared = marks[sides[0]] @ marks[sides[1]].T > 0
        place = np.full(len(nodes), -1)
        left, right = place.copy(), place.copy()
        left[sides[0]], right[sides[1]] = np.arange(len(sides[0])), np.arange(len(sides[1]))
        first = ~shared[left[a], right[b]]
        a, b = a[first], b[first]
        np.add.at(total, a, weight[b])
        np.add.at(total, b, weight[a])

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[q] = p
                links.append((int(nodes[x]), int(nodes[y])))
    return nodes, total, links


def _bundle(bound: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, counts, links = [], [], []
        for (me, *_), own in rows.groupby(["filter", "i", "j", "size"], sort=False):
            if len(own) > 1:
                n, total, found = _tile(me, own, bound)
                nodes.append(n[total > 0])
                counts.append(total[total > 0])
                links += found
        a = np.concatenate([*nodes, [x for x, _ in links]]).astype(np.int64)
        n = np.concatenate([*counts, np.zeros(len(links))]).astype(np.int64)
        b = np.concatenate([np.full(len(a) - len(links), -1), [y for _, y in links]]).astype(np.int64)
        # the counts of a bundle by node, and its links
        frame = pd.DataFrame({"a": a, "b": b, "n": n})
        linked = np.zeros(len(a), bool)
        linked[len(a) - len(links) :] = True
        summed = frame[~linked].groupby("a", as_index=False)["n"].sum().assign(b=0, link=False)
        return pd.concat([summed, frame[linked].assign(link=True)])[["a", "b", "n", "link"]]

    return run


def near_vectors(spark: SparkSession, rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding)."""
    scratch = Scratch(spark, "vectors")
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = scratch.table(source.mapInArrow(_read, "vec_id long, h1 long, h2 long, raw binary"), "read")
    sets = read.filter("raw is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    # Numbers that are given once, as the table is written once.
    sets = scratch.table(sets.select(F.monotonically_increasing_id().alias("node"), "*"), "sets")
    listed = sets.select("node", "weight", "raw").mapInArrow(_filters(code_size(sets.count())), "node long, weight long, raw binary, filters array<int>, size int")
    listed = scratch.table(listed, "listed")
    met = listed.select(F.explode("filters").alias("filter"), "size").groupBy("filter", "size").agg(F.count("*").alias("many"))
    crowded = scratch.table(met.filter(F.col("many") > TILE).select("filter", "size", F.ceil(F.col("many") / TILE).cast("int").alias("blocks")), "crowded")
    few, more = crowded.agg(F.count("*"), F.sum(F.col("blocks") * (F.col("blocks") - 1))).first()
    dealt = listed.withColumn("filter", F.explode("filters")).join(F.broadcast(crowded) if few <= BROADCAST_FILTERS else crowded, ["filter", "size"], "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node", "filter"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("filter", "size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "weight", "raw", "filters")
    total = (listed.agg(F.sum(F.size("filters"))).first()[0] or 0) + TILE * (more or 0)
    tiles = tiles.withColumn("bundle", F.pmod(F.xxhash64("filter", "size", "i", "j"), F.lit(max(1, -(-total // BUNDLE)))))
    found = scratch.table(tiles.groupBy("bundle").applyInPandas(_bundle(cosine), "a long, b long, n long, link boolean"), "found")
    counts = found.filter("not link").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    component = connected(found.filter("link").select("a", "b"), scratch, "components")
    smallest = component.join(sets.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("_least"))
    owned = component.join(smallest, "label").select("node", "_least", F.lit(True).alias("_linked"))
    labelled = sets.select("node", "h1", "h2", "least", "weight").join(counts, "node", "left").join(owned, "node", "left")
    label = F.when(F.col("_linked"), F.col("_least")).otherwise(F.col("least"))
    labelled = labelled.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("_links"), label.alias("_label"))
    joined = read.drop("raw").join(labelled, ["h1", "h2"], "left")
    label = F.when(F.col("_links").isNull(), F.col("vec_id")).otherwise(F.col("_label"))
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), label.eqNullSafe(F.col("vec_id")).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), reach(node, other) as (
  select vec_id, vec_id from embeddings union select r.node, l.b from reach r join link l on r.other = l.a
)
select e.vec_id, (select count(*) from link where a = e.vec_id) as n_links, r.component_id, r.component_id = e.vec_id as kept
from embeddings e join (select node, min(other) as component_id from reach group by node) r on r.node = e.vec_id
"""
