import random
import zlib

import numpy as np
import pytest

from oddsframe.llm import toxicity as T
from tests.llm.helpers import DOCS, ODD, documents

LABELS = "doc_id long, quality int, toxic int"


def made(n=400):
    r = random.Random(2)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [r.choice(common) for _ in range(r.randint(20, 200))]
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def brute_segments(x):
    """By definition: the best segment first, then what is left and right of it."""
    best, at = 0.0, None
    for i in range(len(x)):
        s = 0.0
        for j in range(i, len(x)):
            s += x[j]
            if s > best + 1e-12:
                best, at = s, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return brute_segments(x[:i]) + [at] + [(a + j, b + j) for a, b in brute_segments(x[j:])]


@pytest.mark.parametrize("seed", range(8))
def test_maximal_segments_equal_the_definition(seed):
    x = np.random.default_rng(seed).normal(-0.2, 1, 60)
    assert [(a, b) for a, b, _ in T.maximal_segments(x)] == brute_segments(x)


def test_held_out_accuracy(spark):
    rows, labels = made()
    out = T.score_toxicity(documents(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert right / len(held) > 0.95 and all(r.predicted == int(r.score >= 0.3) for r in out)


def test_held_out_labels_are_not_learned_from(spark):
    rows, labels = made()
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    score = lambda lab: sorted((r.doc_id, r.score) for r in T.score_toxicity(documents(spark, rows), spark.createDataFrame(lab, LABELS)).collect())
    assert score(labels) == score(flipped)


def test_drop_keeps_clean_rows_and_columns(spark):
    rows, labels = made()
    df = documents(spark, rows + [(9000, None), (9001, "")], extra=True)
    left = T.drop_toxic(df, spark.createDataFrame(labels, LABELS))
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == df.columns and {9000, 9001} <= ids
    clean = {i for i, _, t in labels if not t}
    assert len(clean & ids) / len(clean) > 0.98 and len({i for i, _, t in labels if t} & ids) < 8


def test_passages_are_places_in_the_text():
    m = T.Model({"scum": 5.0, "idiot": 5.0}, 1.0, 0.1, 3.0, 0.5, -2.0)
    text = "good words here, you idiot scum! and more good words"
    (start, end, chance), = m.passages(text)
    assert text[start:end] == "idiot scum" and chance < 1


def test_extreme_value_constants_are_found_again():
    r = np.random.default_rng(3)
    n = r.integers(20, 2000, 20_000).astype(float)
    decay, K = 1.3, 2e-3
    s = (np.log(K * n) - np.log(-np.log(r.uniform(size=len(n))))) / decay  # best passages by definition
    least = 1.0
    got = T.extreme_value_fit(n, np.where(s >= least, s, 0.0), least)
    assert abs(got[0] / decay - 1) < 0.05 and abs(got[1] / K - 1) < 0.15


def test_significance_is_the_chance_of_one_passage_and_grows_with_more():
    for s, n in ((3.0, 100), (8.0, 1000)):
        e = 0.01 * n * np.exp(-1.1 * s)
        assert T.significance([s], n, 1.1, 0.01) == pytest.approx(min(1.0, 1 - np.exp(-e)) if 1.1 * s - np.log(0.01 * n) > 1 else 1.0)
    one, two = T.significance([8.0], 1000, 1.1, 0.01), T.significance([8.0, 7.0], 1000, 1.1, 0.01)
    assert two < one < 1 and T.significance([], 50, 1.0, 0.1) == 1.0
    m = T.Model({"a": 1.0}, 1.1, 0.01, 3.0, 0.5, -2.0)
    scores = []
    for p in (1.0, 0.3, 1e-2, 1e-6, 1e-20, 1e-200):
        m.significance = lambda _, p=p: p
        scores.append(m.score("x"))
    assert scores == sorted(scores) and scores[0] < 0.01 and scores[-1] > 0.99


def test_near_copies_are_merged_only_if_all_sketches_agree(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(10**6):x}" for _ in range(400)]
    rows = [(" ".join(base), 0), (" ".join(base), 0), (" ".join([*base[:200], *(f"v{r.randrange(10**6):x}" for _ in range(200))]), 1)]
    seen = []
    keep = T.token_scores
    try:
        T.token_scores = lambda learn: seen.append(learn) or {}
        T.fit(spark.createDataFrame(rows * 1 + [(" ".join(base), 1)], "text string, toxic int"))
        whole = seen[0]
    finally:
        T.token_scores = keep
    path = whole.inputFiles()[0].rsplit("/", 1)[0]
    got = sorted((r.toxic, r.text[:20], len(r.text)) for r in spark.read.parquet(path).collect())
    # the copies are one text with the toxic label; the half-alike text stays
    assert [g[0] for g in got] == [1, 1] and len({g[2] for g in got}) == 2


def test_odd_rows(spark):
    rows, labels = made(200)
    out = T.score_toxicity(documents(spark, [(i if i is None else 5000 + i, t) for i, t in ODD] + rows), spark.createDataFrame(labels + labels[:9] + [(None, 0, 1), (3, 1, None)], LABELS))
    assert out.count() == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in out.collect())
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in T.score_toxicity(documents(spark, rows[:5]), none).collect()} == {0.0}
    assert T.score_toxicity(spark.createDataFrame([], DOCS), none).count() == 0
