"""Codes, errors and codebooks against plain Lloyd rounds on integers; Elkan's bounds against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsframe.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plainly(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    least = {}
    for i, v, _ in sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[1])):
        least.setdefault(i, v)
    books = [[cut(v, p) for v in list(least.values())[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((far(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[nearest(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = [[nearest(v, p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in b) for b in best]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    totals = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    return sorted((str(i), "".join(f"{k:02x}" for _, k in b), e, totals[label], sha) for (i, _, label), b, e in zip(kept, best, errors, strict=True))


def vectors(seed, n, coarse):
    r = random.Random(seed)
    draw = (lambda: r.choice([-2, -1, 0, 1]) / 256) if coarse else (lambda: r.uniform(-1, 1))
    return [(i, [draw() for _ in range(32)], r.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("rows", [vectors(1, 300, False), vectors(2, 200, True), vectors(3, 20, False), [(1, [0.5] * 32, 1)] * 3])
def test_codes_equal_plain_rounds(spark, rows):
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == plainly(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(5, 90, False)
    bad = [(200, None, 1), (201, [None] * 32, 1), (202, [nan] * 32, 1), (203, [inf] + [0.0] * 31, 1), (204, [], 1), (205, [1.0] * 16, 1), (206, [1.0] * 33, None)]
    odd = [(None, [0.25] * 32, None), (7, [0.125] * 32, 2), (7, [0.125] * 32, 2)]
    frame = spark.createDataFrame(good + bad + odd, SCHEMA)
    for name in ("id", "whole", "code", "error", "upper", "lower", "key"):
        frame = frame.selectExpr("*", f"'clash' as {name}")
    got = vector_codes.compress(frame).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == plainly(good + odd)
    assert vector_codes.compress(frame.where("false")).count() == 0
    assert vector_codes.compress(frame.where("vec_id between 200 and 204")).count() == 0
    with pytest.raises(ValueError, match="fit a long"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 32, 1)], SCHEMA))


@pytest.mark.parametrize("coarse", [False, True])
def test_bounds_prune_and_never_lose_a_tie(coarse):
    r = np.random.default_rng(4)
    x = r.integers(-3, 4, (500, 4)) if coarse else r.integers(-300, 300, (500, 4))
    entries = x[:64].copy()
    code, upper, lower = vector_codes.assign(x, entries)
    took = []
    for step in range(4):
        moved = entries + r.integers(-2, 3, entries.shape) // (1 if step else 2)
        code, upper, lower, n = vector_codes.reassign(x, entries, moved, code, upper, lower)
        want, far = vector_codes.assign(x, moved)[0], np.sqrt(vector_codes.squared(x, moved))
        assert (code == want).all()
        assert (upper >= far[np.arange(500), code]).all() and (lower <= far).all()
        entries = moved
        took.append(n)
    if not coarse:
        assert max(took) < 0.4 * x.shape[0] * len(entries)


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = vectors(6, 120, False)
    coded, books = vector_codes.encode(spark.createDataFrame(rows, SCHEMA))
    by = dict((i, v) for i, v, _ in rows)
    for r in coded.where(F.col("id") < 20).collect():
        whole = np.floor(256 * np.float32(by[r.id]).astype(float))
        assert int((((books.decode(r.code) * 256) - whole) ** 2).sum()) == r.error
