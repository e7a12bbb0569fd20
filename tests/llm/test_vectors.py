"""Hard negatives and one-bit search against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import hard_negatives as hard
from skein.llm import one_bit_search as bits
from skein.llm import vectors as vec
from skein.llm.hard_negatives import Anchor, LengthBucket, hard_negatives
from skein.llm.one_bit_search import code_width, encode, nearest_rows, rotation, unit
from skein.llm.queries import QUERIES
from tests.llm.helpers import SF, plain

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, bucket string, asks string, rank string"


def odd_vectors(seed: int = 3, n: int = 400) -> list[tuple]:
    """Rows with near and exact copies, ties, other lengths, nulls and values that are no numbers; extra columns clash with the operators' own."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 6)).round(2)
    rows = []
    for i in range(n):
        row = base[i % 40] * (1 + i % 3) + (rng.normal(size=6).round(2) / 4 if i % 4 else 0)
        rows.append((i, [float(np.float32(x)) for x in row], int(rng.integers(0, 4))))
    rows += [(500 + i, [1.0, 0, 0, 0, 0, 0], i % 2) for i in range(60)]  # many equal vectors
    rows += [(600, [0.0] * 6, 1), (700, [], 1), (800, [0.5], 2), (801, [1.0] * 9, 2), (802, [-1e-3] * 6, 3), (900, [1e19] * 6, 1), (901, [3e19] * 6, 1)]
    rows += [(1000, None, 1), (1001, [1.0, None, 1.0], 1), (1002, [NAN] * 6, 1), (1003, [INF, 1.0], 1), (1100, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [rows[0], (0, [9.0] * 6, 3), (100, [-1.0] * 6, 0), (100, [-1.0] * 6, 0)]
    random.Random(seed).shuffle(rows)
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


def usable(rows, labels: bool) -> dict[int, tuple]:
    """Vector and label by id, without the rows that take no part; of rows that repeat an id the smallest."""
    out: dict[int, tuple] = {}
    for i, v, label in rows:
        if i is None or v is None or (labels and label is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        if not labels and not any(v):
            continue
        key = (label, v) if labels else (v,)
        if i not in out or key < out[i]:
            out[i] = key
    return out


def plain_negatives(rows, positives: int = 5, negatives: int = 5, every: int = 100) -> list[tuple]:
    known = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in usable(rows, True).items()}
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in known.items() if i != a}
        first = sorted((i for i in score if known[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in first:
            fits = [i for i in score if known[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            for rank, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:negatives], 1):
                out.append((a, p, rank, i, score[p], score[i]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("buckets", "rows"), [(1, 2048), (5, 16), (3, 1)])
def test_hard_negatives(spark, monkeypatch, buckets, rows):
    data = [r for r in odd_vectors() if r[0] not in (900, 901)]
    monkeypatch.setattr(hard, "number_of_buckets", lambda *_: buckets)
    monkeypatch.setattr(hard.LengthBuckets.__init__, "__defaults__", (rows,))
    got = hard_negatives(frame(spark, data), F.col("vec_id") % 20 == 0)
    want = plain_negatives(data, every=20)
    assert len(want) > 300 and plain(got) == want
    assert plain(hard_negatives(frame(spark, data), F.col("vec_id") % 20 == 0, 2, 1)) == plain_negatives(data, 2, 1, 20)


def test_hard_negatives_of_odd_tables(spark):
    empty = frame(spark, [])
    assert hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    one = frame(spark, [(0, [1.0], 1), (1, [1.0], 2), (2, None, None)])
    assert hard_negatives(one, F.col("vec_id") == 0).count() == 0  # no positive
    big = frame(spark, [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [3e6, 1.5], 2)])  # products beyond the whole numbers of doubles
    a = [math.floor(256 * x) for x in (float(np.float32(3e6)), 1.0)]
    scores = [a[0] * a[0] + 256 * math.floor(256 * x) for x in (2.0, 1.5)]
    assert plain(hard_negatives(big, F.col("vec_id") == 0)) == [(0, 1, 1, 2, *scores)]


def test_a_bucket_holds_every_candidate():
    rng = np.random.default_rng(7)
    codes = np.floor(256 * rng.normal(size=(500, 8)))
    lengths = np.sqrt((codes**2).sum(axis=1))
    bucket = LengthBucket(codes, lengths, np.arange(500), np.zeros(500))
    dropped = 0
    for row in np.floor(256 * rng.normal(size=(50, 8))):
        anchor = Anchor(row)
        scores = codes @ row
        for least in np.quantile(scores, [0.5, 0.9, 0.99, 1]):
            cosine = least / (anchor.length * bucket.longest) if least > 0 else -1
            found = np.arange(500)[bucket.candidates(anchor.focus, anchor.angles, cosine)]
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
            dropped += 500 - len(found)
    assert dropped > 0


def test_hard_negative_query(spark):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert plain(QUERIES["op11_hard_negatives"](spark, SF)) == plain_negatives(rows)


def plain_cosine(a, b) -> float:
    dot, na, nb = 0.0, 0.0, 0.0
    for x, y in zip(a, b):
        dot += x * y
    for x in a:
        na += x * x
    for y in b:
        nb += y * y
    return dot / (math.sqrt(na) * math.sqrt(nb))


def plain_nearest(rows, every: int, k: int = 5) -> list[tuple]:
    known = {i: v for i, (v,) in usable(rows, False).items()}
    out = []
    for q, v in known.items():
        if q % every == 0:
            score = {i: plain_cosine(v, w) for i, w in known.items() if i != q}
            for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k], 1):
                out.append((q, rank, i, score[i]))
    return out


def test_rotation_keeps_angles():
    for d, width in ((1, 64), (6, 64), (64, 256), (100, 512)):
        turn = rotation(d, width)
        assert np.allclose(turn @ turn.T, np.eye(d), atol=1e-9)
    assert [code_width(d) for d in (1, 16, 17, 64, 100)] == [64, 64, 128, 256, 512]


def test_error_bound_holds():
    rng = np.random.default_rng(5)
    rows, asked = rng.normal(size=(2000, 64)), unit(rng.normal(size=(50, 64)))
    codes, a = encode(rows, 256)
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    estimates = (asked @ rotation(64, 256)) @ signs.T / (np.sqrt(256) * a)
    error = np.abs(estimates - asked @ unit(rows).T)
    for spread, share in ((1, 0.6), (2, 0.94), (4, 0.9999)):
        assert (error <= spread * np.sqrt((1 / a**2 - 1) / 255)).mean() > share


@pytest.mark.parametrize(("buckets", "at_once"), [(1, 4096), (4, 7)])
def test_nearest_rows(spark, monkeypatch, buckets, at_once):
    data = odd_vectors()
    monkeypatch.setattr(bits, "number_of_buckets", lambda *_: buckets)
    monkeypatch.setattr(bits, "_VECTORS", at_once)
    got = {(r.query_id, r.rank): r for r in nearest_rows(frame(spark, data), F.col("vec_id") % 20 == 0).collect()}
    want = plain_nearest(data, 20)
    assert got.keys() == {(q, rank) for q, rank, _, _ in want}
    for q, rank, i, score in want:
        assert got[q, rank].vec_id == i and math.isclose(got[q, rank].score, score, rel_tol=1e-12)


def test_nearest_rows_of_odd_tables(spark):
    assert nearest_rows(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    few = frame(spark, [(0, [1.0, 2.0], 1), (1, [2.0, 4.0], 1), (50, None, 1), (51, [0.0, 0.0], 1)])
    assert [(r.query_id, r.vec_id) for r in nearest_rows(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
    alone = frame(spark, [(0, [1.0, 2.0], 1)])
    assert nearest_rows(alone, F.col("vec_id") == 0).count() == 0


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id): r.score for r in QUERIES["op12_one_bit_search"](spark, "/root/testdata/sf0.01").collect()}
    want = {(q, i): s for q, _, i, s in plain_nearest(rows, 50)}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-12) for x in want)


def test_buckets_follow_bytes_and_tasks(spark, monkeypatch):
    few = frame(spark, [(i, [1.0] * 4, 1) for i in range(50)])
    assert vec.number_of_buckets(few, "embedding") == 1
    monkeypatch.setattr(vec, "BUCKET_BYTES", 320)
    assert vec.number_of_buckets(few, "embedding") == 5
    monkeypatch.setattr(vec, "LEAST_ROWS", 5)
    monkeypatch.setattr(vec, "BUCKET_BYTES", 1 << 30)
    assert vec.number_of_buckets(few, "embedding") == int(spark.conf.get("spark.sql.shuffle.partitions"))
