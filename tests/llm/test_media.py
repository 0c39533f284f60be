"""Progressive JPEG: stored payloads, and a decoder that takes images of any progressive shape."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import media


def decoded(images):
    parsed = [media.parse(i) for i in images]
    return parsed, *media.coefficients(parsed)


@pytest.mark.parametrize("text", [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "日本語😀" * 3000])
def test_round_trip(text):
    payload = media.payload(text)
    raw = (text or "").encode()
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == raw.rstrip(b"\0") and len(payload) - len(raw) <= 64
    parsed, coef, base = decoded(media.encode([payload]))
    assert media.payload_of(parsed[0], coef, base[0]) == payload
    kinds = [s.band for s in parsed[0].scans]
    assert any(ah for *_, ah, _ in kinds) and len({b[:2] for b in kinds}) > 2  # successive approximation, spectral selection


def test_all_bytes_survive():
    payload = bytes(random.Random(1).randrange(256) for _ in range(64 * 700))
    parsed, coef, base = decoded(media.encode([payload, b"\xff" * 64, bytes(range(256))]))
    assert [media.payload_of(p, coef, b) for p, b in zip(parsed, base, strict=False)] == [payload, b"\xff" * 64, bytes(range(256))]


def test_a_batch_does_not_matter():
    payloads = [media.payload("text %d " % i * (i * 37 % 301)) for i in range(40)]
    together = media.encode(payloads)
    assert [media.encode([p])[0] for p in payloads] == together
    images, coef, base = decoded(together)
    features = {i: media.feature(t) for own, made in media.tensors(images, coef, base) for i, t in zip(own, made, strict=True)}
    for i, image in enumerate(together):
        [(_, made)] = media.tensors(*decoded([image]))
        assert media.feature(made[0]) == features[i]


class Writer:
    """A plain encoder of given levels, a symbol at a time, with all that progressive scans allow."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - k) & 1 for k in range(n)]

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        self.bits = []
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\0")

    def symbol(self, s):
        self.put(s, 9)  # code of s: its number in nine bits, which leaves the last codes free

    def magnitude(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)


def ac_scan(blocks, ss, se, ah, al):
    w, run, pending = Writer(), 0, []

    def flush():
        nonlocal run, pending
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            w.bits += pending
        run, pending = 0, []

    for block in blocks:
        cut = [int(math.copysign(abs(v) >> al, v)) for v in block]
        last = max((k for k in range(ss, se + 1) if (abs(cut[k]) == 1 if ah else cut[k])), default=-1)
        zeros, bits = 0, []
        for k in range(ss, se + 1):
            if k > last:
                break
            if ah and abs(cut[k]) > 1:
                bits.append(abs(cut[k]) & 1)
            elif cut[k]:
                flush()
                while zeros > 15:
                    # sixteen zeros, and the correction bits among them
                    w.symbol(0xF0)
                    taken, seen = 0, 0
                    for at in range(start, k):
                        if ah and abs(cut[at]) > 1:
                            taken += 1
                        else:
                            seen += 1
                            if seen == 16:
                                start = at + 1
                                break
                    w.bits += bits[:taken]
                    bits, zeros = bits[taken:], zeros - 16
                w.symbol(zeros << 4 | (1 if ah else abs(cut[k]).bit_length()))
                if ah:
                    w.put(cut[k] > 0, 1)
                    w.bits += bits
                else:
                    w.magnitude(cut[k])
                zeros, bits, start = 0, [], k + 1
                continue
            else:
                zeros += 1
            if zeros == 1 and not cut[k] or k == ss:
                start = start if k > ss else ss
        rest = [abs(cut[k]) & 1 for k in range(max(last + 1, ss), se + 1) if ah and abs(cut[k]) > 1]
        if last < se:
            run += 1
            pending += rest
    flush()
    return w.done()


def grey_image(blocks, across, down, script):
    table = bytes([0] * 8 + [254, 0] + [0] * 6), None
    symbols = bytes(range(254))
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes([1] * 64)), media._segment(0xC2, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + bytes([1, 0x11, 0]))]
    out += [media._segment(0xC4, bytes([kind << 4]) + table[0] + symbols) for kind in (0, 1)]
    for ss, se, ah, al in script:
        out.append(media._scan_header([(1, 0)], ss, se, ah, al))
        if ss:
            out.append(ac_scan(blocks, ss, se, ah, al))
            continue
        w, before = Writer(), 0
        for b in blocks:
            if ah:
                w.put(b[0] >> al & 1, 1)
                continue
            v = (b[0] >> al) - before
            before = b[0] >> al
            w.symbol(abs(v).bit_length())
            w.magnitude(v)
        out.append(w.done())
    return b"".join([*out, b"\xff\xd9"])


SCRIPTS = [
    [(0, 0, 0, 0), (1, 63, 0, 0)],
    [(0, 0, 0, 2), (1, 10, 0, 1), (11, 63, 0, 1), (0, 0, 2, 1), (1, 10, 1, 0), (11, 63, 1, 0), (0, 0, 1, 0)],
    [(0, 0, 0, 1), (1, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0), (0, 0, 1, 0)],
]


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("density", [0.02, 0.3, 0.9])
def test_decoder_takes_any_levels(script, density):
    random_ = np.random.default_rng(int(density * 100))
    levels = np.where(random_.random((12, 64)) < density, random_.integers(-90, 91, (12, 64)), 0)
    image = grey_image(levels.tolist(), 4, 3, script)
    _, coef, _ = decoded([image])
    assert np.array_equal(coef, levels)


def test_samples_are_the_inverse_transform():
    random_ = np.random.default_rng(5)
    levels = np.where(random_.random((4, 64)) < 0.2, random_.integers(-60, 61, (4, 64)), 0)
    parsed, coef, base = decoded([grey_image(levels.tolist(), 2, 2, SCRIPTS[0])])
    [(_, made)] = media.tensors(parsed, coef, base)
    a = np.array([[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    for k in range(4):
        block = np.zeros(64)
        block[media.ZIGZAG] = levels[k]
        want = np.clip(np.rint(a.T @ block.reshape(8, 8) @ a + 128), 0, 255)
        got = made[0][8 * (k // 2) : 8 * (k // 2) + 8, 8 * (k % 2) : 8 * (k % 2) + 8, 0]
        assert np.abs(got - want).max() <= 1


def test_zigzag():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64))


def test_colours_of_an_upsampled_image():
    """Three components in 4:2:0 against the definition: inverse transform, repeated chroma, real-valued conversion."""
    raw = np.random.default_rng(7).choice([0, 255, 254, 1], 64 * 40, p=[0.9, 0.06, 0.02, 0.02]).astype(np.uint8).tobytes()
    [image], coef, base = decoded(media.encode([raw]))
    [(_, made)] = media.tensors([image], coef, base)
    assert [c[1:3] for c in image.components] == [(2, 2), (1, 1), (1, 1)]
    a = np.array([[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    _, _, planes, _ = media._layout(image.height, image.width, tuple(image.components))
    full = []
    for (wide, high, first, _), (_, h, v, q) in zip(planes, image.components, strict=True):
        plane = np.zeros((8 * high, 8 * wide))
        for k in range(wide * high):
            block = np.zeros(64)
            block[media.ZIGZAG] = coef[base[0] + first + k] * np.asarray(image.quantization[q])
            plane[8 * (k // wide) : 8 * (k // wide) + 8, 8 * (k % wide) : 8 * (k % wide) + 8] = np.clip(a.T @ block.reshape(8, 8) @ a + 128, 0, 255)
        full.append([[plane[y * v // 2, x * h // 2] for x in range(image.width)] for y in range(image.height)])
    y, cb, cr = np.array(full[0]), np.array(full[1]) - 128, np.array(full[2]) - 128
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    assert made.shape[1:] == want.shape and np.abs(made[0] - want).max() <= 3 and want.std() > 5


def test_operator(spark):
    rows = [(1, "some text"), (2, None), (3, ""), (4, "some text"), (None, "x" * 5000)]
    df = spark.createDataFrame([(*r, b"own") for r in rows], "doc_id long, text string, rgb binary")
    got = media.store_and_read(df).collect()
    assert [bytes(r.payload) for r in got] == [media.payload(t) for _, t in rows]
    assert got[0].media == got[3].media and got[0].rgb == got[3].rgb and all(len(r.rgb) == r.height * r.width * 3 for r in got)
    features = media.with_feature(media.store_and_read(df)).collect()
    assert [r.feature for r in features] == [media.feature(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)) for r in got]
    empty = media.store_and_read(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == media.with_feature(empty).count() == 0


def test_query_against_the_texts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op1_media_columns(spark, sf).collect()
    assert len(got) == len(texts)
    seen = {}
    for r in got:
        own = media.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(own))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]))
        [made] = media.encode([own])
        [image], coef, base = decoded([made])
        [(_, tensor)] = media.tensors([image], coef, base)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(made), hashlib.sha256(made).hexdigest(), media.feature(tensor[0]))
        assert seen.setdefault(texts[r.doc_id], r[1:]) == r[1:]


def test_digests(spark):
    row = media.store_and_read(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).select(F.crc32(F.substring("payload", -64, 64)).alias("c")).first()
    assert row.c == zlib.crc32(b"ab" + bytes(62))
