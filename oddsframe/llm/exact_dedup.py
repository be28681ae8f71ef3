"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

`build_filters` makes one binary fuse filter (three-wise, 16-bit fingerprints) for each bucket of a snapshot's digests;
the bucket count follows the snapshot, so a filter is bounded in size and none is ever on the driver. `screen` sends each
incoming digest to the filter of its bucket. A negative is certainly not in the snapshot; a positive goes to the exact
bucket, a join on the digest, and the normalised bytes of its group are compared. Duplicates
within the incoming batch are grouped separately, by digest, before the screen, so a hot group is one row there.

Defined results: a null text counts as empty; texts are equal when identical after each run of ASCII white space is one
space; repeated rows under one doc_id are copies of each other with the same keep_id; `kept` is true on each row whose
doc_id is the group's least, and `drop_exact_duplicates` then keeps one row for each doc_id and text. A group with null ids only has
a null keep_id and its rows are kept. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.common import ASCII_SPACE, bounded_batches, fraction_of, materialise, parts_for, sieve_of, spread_join, without

#: Digests a filter, about; a filter of this size has 0.6 MB.
BUCKET = 250_000


def normalised(col: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(col).cast("string"), F.lit("")), ASCII_SPACE, " ")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(hashed: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three cells of each key: in three consecutive segments, the first chosen by the upper bits."""
    first = ((hashed >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
    mask = np.uint64(segment - 1)
    low = [(hashed & mask), (hashed >> np.uint64(18) & mask), ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & mask)]
    return np.stack([first + i * segment + x.astype(np.int64) for i, x in enumerate(low)], axis=1)


def fuse_filter(keys: np.ndarray) -> bytes:
    """A binary fuse filter over distinct 64-bit keys: header (seed, segment, segments) and 16-bit cells.

    Built by peeling: cells that one key alone touches are taken off in rounds, all such cells of a round at once; the
    cells are set in reverse order. A seed under which peeling gets stuck is replaced by the next.
    """
    n = len(keys)
    segment = max(4, 1 << int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    segment = min(segment, 1 << 18)
    cells = int(np.ceil(max(n, 8) * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 8))))) + 16
    for seed in range(1, 200):
        segments = max(1, int(np.ceil(cells / segment)) - 2 + seed // 20)
        hashed = _mix(keys, seed)
        at = _places(hashed, segment, segments)
        size = (segments + 2) * segment
        alive, rounds = np.ones(n, dtype=bool), []
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        for c in range(3):
            owner += np.bincount(at[:, c], weights=np.arange(n), minlength=size).astype(np.int64)
        while alive.any():
            lone = np.nonzero(count == 1)[0]
            if not len(lone):
                break
            who, where = np.unique(owner[lone], return_index=True)
            cell = lone[where]
            rounds.append((who, cell))
            alive[who] = False
            for c in range(3):
                np.subtract.at(count, at[who, c], 1)
                np.subtract.at(owner, at[who, c], who)
        if alive.any():
            continue
        table = np.zeros(size, dtype=np.uint16)
        mark = _mark(hashed)
        for who, cell in reversed(rounds):
            table[cell] = 0
            table[cell] = mark[who] ^ table[at[who, 0]] ^ table[at[who, 1]] ^ table[at[who, 2]]
        return np.array([seed, segment, segments], dtype="<i8").tobytes() + table.astype("<u2").tobytes()
    raise RuntimeError("no seed peels this filter")


def _mark(hashed: np.ndarray) -> np.ndarray:
    return ((hashed ^ (hashed >> np.uint64(29))) & np.uint64(0xFFFF)).astype(np.uint16)


def fuse_contains(raw: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key if the filter may hold it; true for every key it was built from."""
    seed, segment, segments = np.frombuffer(raw[:24], dtype="<i8")
    table = np.frombuffer(raw[24:], dtype="<u2")
    hashed = _mix(keys, int(seed))
    at = _places(hashed, int(segment), int(segments))
    return (table[at[:, 0]] ^ table[at[:, 1]] ^ table[at[:, 2]]) == _mark(hashed)


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, cells binary): a filter for each bucket of the digests (column key: long)."""

    def build(rows: pa.Table) -> pa.Table:
        keys = np.unique(rows["key"].to_numpy().view(np.uint64))
        return pa.table({"bucket": rows["bucket"][:1], "cells": pa.array([fuse_filter(keys)], pa.binary())})

    return groups.select("key", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")).groupBy("bucket").applyInArrow(build, "bucket int, cells binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """incoming (sha, key) that may be in the snapshot: (sha)."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return left.select(["sha"]).slice(0, 0)
        return left.select(["sha"]).filter(pa.array(fuse_contains(right["cells"][0].as_py(), left["key"].to_numpy().view(np.uint64))))

    dealt = incoming.select("sha", "key", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "sha string")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha) of each row's normalised text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(normalised()).alias("sha"))


def _key() -> Column:
    """The first 60 bits of the digest as a long; equal digests have equal keys."""
    return F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("key")


def dedup_incoming(snapshot: DataFrame, incoming: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Groups of equal texts of two batches of (doc_id, sha): the snapshot's and the incoming one's.

    Returns (groups, hits): groups (sha, keep_id, group_size) over both batches, and the digests (sha) of the incoming batch that the filters and then
    the exact buckets found in the snapshot.
    """
    by_digest = lambda d: d.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    old, new = materialise(by_digest(snapshot).withColumn("key", _key()), "snapshot"), materialise(by_digest(incoming).withColumn("key", _key()), "incoming")
    buckets = parts_for(max(old.count(), new.count()), bucket)
    maybe = screen(new, build_filters(old, buckets), buckets)
    hits = materialise(old.select("sha", "least", "n").join(maybe, "sha", "left_semi"), "hits")
    both = new.join(hits.select("sha", F.col("least").alias("old_least"), F.col("n").alias("old_n")), "sha", "left")
    mixed = both.select("sha", F.least("least", "old_least").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"))
    rest = old.join(hits, "sha", "left_anti").select("sha", F.col("least").alias("keep_id"), F.col("n").alias("group_size"))
    return mixed.unionByName(rest), hits.select("sha")


def exact_groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    The table is taken as two batches by a hash of doc_id and digest: an immutable snapshot and an incoming batch. The members of every
    group are then compared by bytes; where they differ (a digest collision) the group falls apart into groups of equal bytes.
    """
    rows = materialise(digests(docs), "digests")
    old = fraction_of(F.col("doc_id"), F.col("sha")) < 0.5
    groups, _ = dedup_incoming(rows.where(old), rows.where(~old), bucket)
    groups = materialise(groups, "groups")
    report = spread_join(rows, groups, "sha").select("doc_id", "keep_id", "group_size", "sha")
    members = materialise(report.where("group_size > 1").select("doc_id"), "members")
    collided = materialise(unequal_groups(docs, members), "collided")
    if collided.isEmpty():
        return _report(report)
    texts = materialise(_texts(docs).join(collided, "sha", "left_semi"), "texts")
    own = texts.groupBy("sha", "text").agg(F.min("doc_id").alias("own_id"), F.count("*").alias("own_size"))
    apart = texts.join(own, ["sha", "text"]).select("doc_id", F.col("own_id").alias("keep_id"), F.col("own_size").alias("group_size"), "sha")
    return _report(report.join(collided, "sha", "left_anti").select("doc_id", "keep_id", "group_size", "sha").unionByName(apart))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text")).withColumn("sha", digest(F.col("text")))


def unequal_groups(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(sha) of the groups whose members' normalised bytes aren't all the same. members: (doc_id) of groups of several.

    Of the members' texts, the least and the greatest by digest must be equal. A sieve of the members' ids lets their texts alone through, and copies
    collapse before the shuffle, so a hot group is a row a task. A text that gets through by chance is a group of its own."""
    bounded_batches(docs.sparkSession)
    may = sieve_of(members, "doc_id")(F.col("doc_id").cast("long")) | F.col("doc_id").isNull()
    ends = _texts(docs.where(may)).groupBy("sha").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return ends.where("low <> high").select("sha")


def _report(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs without the copies of a text of smaller doc_id, and with one row for each doc_id and text that stays."""
    report = materialise(exact_groups(docs, bucket), "report")
    gone = materialise(report.where("not kept").select("doc_id", F.col("text_sha256").alias("__sha")).distinct(), "gone")
    again = materialise(report.where("kept and doc_id is not null").groupBy("doc_id", F.col("text_sha256").alias("__sha")).count().where("count > 1").drop("count"), "again")
    same = lambda left, right: left.doc_id.cast("long").eqNullSafe(right.doc_id) & (digest(normalised()) == right["__sha"])
    known = without(docs, gone, "doc_id", same)
    if again.isEmpty():
        return known
    once = without(known, again, "doc_id", same)
    twice = known.withColumn("__own", digest(normalised())).join(again, [known.doc_id.cast("long") == again.doc_id, F.col("__own") == again["__sha"]], "left_semi").dropDuplicates(["doc_id", "__own"]).drop("__own")
    return once.unionByName(twice.select(*docs.columns))
