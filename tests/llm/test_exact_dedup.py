import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from oddsframe.llm import exact_dedup as X
from tests.llm.helpers import DOCS, ODD, documents, words


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_groups_equal_brute_force(spark):
    rows = [(i, words(i % 40, 12)) for i in range(200)] + [(500 + i, "hot  copy\t!") for i in range(150)] + ODD
    assert got(X.exact_groups(documents(spark, rows, extra=True), bucket=30)) == brute(rows)


def test_empty_table(spark):
    assert X.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_drop_keeps_one_of_each_text_and_all_columns(spark):
    rows = [(i, words(i % 7, 5)) for i in range(50)]
    df = documents(spark, rows, extra=True)
    left = X.drop_exact_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == list(range(7))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 60_000])
def test_filter_has_no_false_negative_and_few_positives(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    raw = X.fuse_filter(keys)
    assert X.fuse_contains(raw, keys).all()
    assert X.fuse_contains(raw, rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.001


def test_incoming_hits_are_those_of_the_snapshot(spark):
    old = X.digests(documents(spark, [(i, words(i, 6)) for i in range(100)]))
    new = X.digests(documents(spark, [(1000 + i, words(i, 6)) for i in range(90, 130)] * 2))
    groups, hits = X.dedup_incoming(old, new)
    assert hits.count() == 10
    sizes = {r.keep_id: r.group_size for r in groups.collect()}
    assert sizes[95] == 3 and sizes[5] == 1 and sizes[1110] == 2


def test_a_digest_collision_is_told_apart_by_bytes(spark, monkeypatch):
    rows = [(i, words(i % 40, 12)) for i in range(150)] + [(500 + i, "hot  copy\t!") for i in range(40)] + ODD
    monkeypatch.setattr(X, "digest", lambda text: X.F.substring(X.F.sha2(text, 256), 1, 1))  # sixteen digests for all texts
    df = documents(spark, rows)
    plain = lambda rows: sorted(r[:4] for r in rows if r[0] is not None)
    assert X.unequal_groups(df, df.select("doc_id")).count() > 10
    assert plain(got(X.exact_groups(df))) == plain(brute(rows))


def test_only_groups_of_unequal_bytes_are_told(spark):
    docs = documents(spark, [(1, "a"), (2, "a"), (3, "b")])
    assert X.unequal_groups(docs, docs.select("doc_id")).count() == 0


def test_sieves_pass_every_value_and_few_others(spark, monkeypatch):
    from oddsframe.llm import common

    values = spark.range(0, 30_000, 3).toDF("v")
    others = spark.range(1, 30_000, 3).toDF("v")
    test = common.sieve_of(values, "v")
    assert values.where(test(X.F.col("v"))).count() == 10_000 and others.where(test(X.F.col("v"))).count() < 400
    monkeypatch.setattr(common, "SIEVE_MOST", 16)  # too small: more get through, none is lost
    test = common.sieve_of(values, "v")
    assert values.where(test(X.F.col("v"))).count() == 10_000
    rows = spark.range(100).selectExpr("if(id = 7, null, id) as v", "id")
    gone = spark.range(0, 100, 2).toDF("v")
    left = common.without(rows, gone, "v", lambda a, b: a.v == b.v)
    assert sorted(r.id for r in left.collect()) == list(range(1, 100, 2))


def test_rows_repeated_under_one_id_stay_once(spark):
    df = documents(spark, [(4, "word"), (4, "word"), (5, "word"), (6, "other"), (None, "third"), (7, "x"), (7, "y")], extra=True)
    left = X.drop_exact_duplicates(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("4", "word"), ("6", "other"), ("7", "x"), ("7", "y"), ("None", "third")]
