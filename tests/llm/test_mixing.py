"""Targets by a plain reading, thresholds by sorting, on odd documents."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from oddsframe.llm import mixing
from tests.llm.helpers import ODD, documents

DOCS = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(5, 2, 1), most=3, share=1.0):
    """sizes: by source. Excess goes round until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), sum(sizes.values()) * share, set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - most * sizes[s]) for s in open_)
        over = {s for s in open_ if target[s] >= most * sizes[s]}
        for s in over:
            target[s] = float(most * sizes[s])
        open_ -= over
    return target


def hashed(doc_id, text):
    seen = f"{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
    return int(hashlib.md5(seen.encode()).hexdigest()[:15], 16)


def plain_taken(rows, targets):
    """rows: (doc_id, text, source). Documents by hash, until the next would miss the budget by more."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = {}
    for source, target in targets.items():
        own = sorted({(hashed(i, t), size(t)) for i, t, s in rows if s == source})
        count = {h: sum(hashed(i, t) == h for i, t, s in rows if s == source) for h, _ in own}
        total = sum(n * count[h] for h, n in own)
        times = int(target // total) if total else 0
        rest, sum_, cut = target - times * total, 0, -1
        for h, n in own:
            n *= count[h]
            if n and sum_ + n > rest:
                if sum_ + n - rest < rest - sum_:
                    cut = h
                break
            sum_, cut = sum_ + n, h
        for i, t, s in rows:
            if s == source:
                out.setdefault((i, t, s), size(t) * (times + (hashed(i, t) <= cut)))
    return out


def texts(seed, n, sources, hot=0.0):
    r = random.Random(seed)
    return [(k, " ".join(["w"] * r.choice([0, 1, 3, 50, 400])), sources[0] if r.random() < hot else r.choice(sources)) for k in range(n)]


@pytest.mark.parametrize("rows", [texts(1, 300, ["b", "a", None, "Ä", "c", ""]), texts(2, 200, list("abcdefghijklmnop"), hot=0.5), texts(3, 5, ["x"]), [(1, "a b", "s"), (1, "a b", "s"), (2, "c", "t"), (None, None, None), (None, "d", None)]])
def test_mix_equals_a_plain_reading(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = plain_targets(sizes)
    taken = plain_taken(rows, targets)
    want = sorted((str(i), len((t or "").split()), sizes[s], round(targets[s], 6), taken[i, t, s]) for i, t, s in rows)
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert all(r.taken <= 3 * r.size for r in got)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))


def test_taken_words_are_within_half_a_document(spark):
    frame = spark.createDataFrame(texts(7, 4_000, ["a", "b", "c", "d", "e"], hot=0.3), DOCS)
    rows = mixing.mix(frame).groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    assert len(rows) == 5 and all(abs(r.taken - r.target) <= r.largest / 2 for r in rows)


def test_small_levels_refine_to_the_same_cut(spark, monkeypatch):
    frame = spark.createDataFrame(texts(8, 400, ["a", "b", "c"]), DOCS)
    want = sorted(map(tuple, mixing.mix(frame).collect()))
    monkeypatch.setattr(mixing, "LEVEL_BITS", 2)
    assert sorted(map(tuple, mixing.mix(frame).collect())) == want


def test_sources_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    from oddsframe.llm import common

    frame = spark.createDataFrame(texts(9, 3_000, ["a", "b", "c"], hot=0.6), DOCS)
    want = sorted(map(tuple, mixing.mix(frame).collect()))
    monkeypatch.setattr(common, "ATTACHED_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(frame).collect())) == want


def test_mixed_repeats_whole_rows(spark):
    frame = spark.createDataFrame(texts(10, 200, ["a", "b", "c", "d"]), DOCS).withColumn("copies", F.lit("clash")).withColumn("size", F.lit("clash"))
    plan = {r.doc_id: (r.size, r.taken) for r in mixing.mix(frame).collect()}
    got = mixing.mixed(frame)
    assert got.columns == frame.columns
    times = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) * size == taken for i, (size, taken) in plan.items())


def test_odd_rows(spark):
    got = mixing.mix(documents(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD) and sum(r.size for r in got if r.doc_id in (1, 2, 3, 8)) == 0
    assert {r.size for r in got if r.doc_id == 6} == {50_000}
    assert mixing.mix(documents(spark, ODD, extra=True).where("false")).count() == 0


def test_reruns_agree_however_rows_are_dealt(spark):
    frame = spark.createDataFrame(texts(11, 500, ["a", "b", None]), DOCS)
    runs = [sorted(map(tuple, mixing.mix(frame.repartition(k)).collect())) for k in (1, 7)]
    assert runs[0] == runs[1]
