"""SimHash near-duplicate detection by multi-index hashing.

`fingerprints` makes 64-bit SimHash codes. `link_fingerprints` finds all codes at most two bits apart: a code is cut into two
segments, each with a table from segment values to codes. Small Hamming balls are enumerated within a segment, their values are
looked up in its table, and the matches' complete distances are verified. A segment value that very many codes share is split by the whole code, exactly.

`near_duplicates` serves the corpus pipeline: five-word shingles and a Jaccard similarity of 0.8 or more. There 64 SimHash bits
can't give right results (pairs at similarity 0.8 differ in 9 bits at the median and up to 17), so a fingerprint has 48 min-wise
symbols instead of 64 bits, in 8 segments of 6. The index is the same: the Hamming ball of radius one is enumerated within each segment (each symbol left
open in turn), table matches are fetched, and complete similarities are verified on whole shingle sets. A pair at similarity 0.8 shares a ball with probability 0.9998.

Defined results: a null text counts as empty; a text without words has fingerprint zero, linked like any other; a text with
fewer words than a shingle is one shingle; repeated rows come out once each with the same values; an empty table gives an
empty result; other columns are ignored. In near_duplicates rows of null ids are left out, and so stay in drop_near_duplicates; rows
repeated under one id go or stay together. A null doc_id never is a component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.llm.common import bounded_batches, components, hot_keys, materialise, parts_for, sieve_of, spread_join, without

SEED = 42
CODE_BITS = 64
#: Segments of a code for the multi-index; codes that may share a segment before its key is split.
SEGMENTS, HOT = 2, 64
#: Links are at this many differing bits or fewer.
RADIUS = 2
#: Near duplicates in the pipeline: words a shingle, least Jaccard similarity; segments of a fingerprint and min-wise symbols a segment.
NEAR_WORDS, NEAR_SIMILARITY, NEAR_SEGMENTS, SYMBOLS = 5, 0.8, 8, 6
#: Each text of a bucket is compared with this many first texts of the bucket; where that leaves a bucket open, with all that may be similar.
LEADERS = 3
#: Texts of a block of an open bucket, and shingles, about; owners from which on shingles are compared as bits.
BLOCK, BLOCK_SHINGLES, RARE = 1_000, 1_000_000, 8


def shingle_hashes(text: str | None, words: int, lower: bool = True) -> list[int]:
    """XXH64 of each shingle, repeats included. bytes.split() and bytes.lower() know ASCII only, as the contract wants."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = (raw.lower() if lower else raw).split()
    if not w:
        return []
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return [h(join(w), SEED)]
    return [h(join(x), SEED) for x in zip(*(w[i:] for i in range(words)), strict=False)]


def code_of(hashes: list[int]) -> int:
    """Bit i is 1 if set in over half of the hashes; no hashes: zero. Counts in blocks, so long texts need little memory."""
    if not hashes:
        return 0
    a = np.array(hashes, dtype="<u8")
    total = np.zeros(CODE_BITS, dtype=np.int64)
    for at in range(0, len(a), 1 << 16):
        total += np.unpackbits(a[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(a), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, code long) for each row; code holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [code_of(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(np.array(codes, dtype=np.uint64).view(np.int64))], names=["doc_id", "code"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, code long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_key(code: Column, segment: int) -> Column:
    """The code with all other segments blanked: equal exactly for codes that share the segment."""
    width = CODE_BITS // SEGMENTS
    return code.bitwiseAND(F.lit(_signed((1 << width) - 1 << segment * width)).cast("long"))


def segment_ball(code: Column, segment: int) -> Column:
    """Keys of the segment's Hamming ball of radius one without its middle, as far as a bit that is set is cleared.

    Of two codes one bit apart in the segment, one has that bit set, so one of the two probes the other's key."""
    width = CODE_BITS // SEGMENTS
    flips = F.array(*[F.lit(_signed(1 << (segment * width + i))).cast("long") for i in range(width)])
    return F.transform(F.filter(flips, lambda f: code.bitwiseAND(f) != 0), lambda f: segment_key(code, segment).bitwiseXOR(f))


def code_ball(code: Column) -> Column:
    """The code and its variants by one bit, in any segment."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(CODE_BITS)])
    return F.transform(flips, lambda f: code.bitwiseXOR(f))


def near(a: str = "a", b: str = "b") -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def link_fingerprints(codes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that connect all distinct codes (column code) at most two bits apart.

    Tables by segment hold each code once a segment. Two codes within two bits share a segment, or are one bit apart in both: so
    the balls are of radius one in segment 0 and of radius zero in segment 1, and no link is lost. Every table match is verified by its complete distance.
    A key that more than HOT codes share is split: its codes, and those that probe it, are posted under their whole code's ball of radius one, whose
    buckets hold 65 codes at most; two codes within two bits meet there too."""
    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts_for(codes.count(), 100_000))
    distinct = codes.select("code").distinct()
    table = distinct.select("code", F.explode(F.array(*[F.struct(F.lit(s).cast("byte").alias("segment"), segment_key(F.col("code"), s).alias("key")) for s in range(SEGMENTS)])).alias("t")).select("code", "t.*")
    probes = distinct.select("code", F.lit(0).cast("byte").alias("segment"), F.explode(segment_ball(F.col("code"), 0)).alias("key"))
    table = materialise(table.repartition(parts, "segment", "key"), "segments")
    hot = materialise(table.groupBy("segment", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("segment", "key"), "hot")
    split = not hot.isEmpty()
    cold = table.join(salted(hot), salted_on(table), "left_anti") if split else table
    same = cold.alias("x").join(cold.alias("y"), ["segment", "key"]).where("x.code < y.code").select(F.col("x.code").alias("a"), F.col("y.code").alias("b"))
    ball = probes.alias("p").join(cold.where("segment = 0").alias("t"), ["segment", "key"]).select(F.least("p.code", "t.code").alias("a"), F.greatest("p.code", "t.code").alias("b"))
    links = same.where(near()).union(ball.where(near()))
    if split:
        members = table.join(salted(hot), salted_on(table), "left_semi").select("code").union(probes.join(salted(hot), salted_on(probes), "left_semi").select("code"))
        links = links.union(meet_at_whole_codes(members.distinct(), parts))
    return links.distinct()


#: Parts that a hot key's codes are dealt to where they meet the list of hot keys.
SALTS = 16


def salted(hot: DataFrame) -> DataFrame:
    """Hot keys, a row for each of the SALTS parts of their codes."""
    return hot.select(F.col("segment").alias("hot_segment"), F.col("key").alias("hot_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def salted_on(rows: DataFrame) -> Column:
    return (rows.segment == F.col("hot_segment")) & (rows.key == F.col("hot_key")) & (F.pmod(F.xxhash64(rows.code), F.lit(SALTS)) == F.col("salt"))


def meet_at_whole_codes(codes: DataFrame, parts: int) -> DataFrame:
    """Edges that connect codes (distinct) at most two bits apart: each is posted under its ball of radius one, and a bucket's least code is linked to
    the bucket's others, which all are within two bits of it."""
    postings = codes.select("code", F.explode(code_ball(F.col("code"))).alias("key")).repartition(parts, "key")
    buckets = postings.groupBy("key").agg(F.sort_array(F.collect_list("code")).alias("found")).where(F.size("found") > 1)  # 65 at most
    star = F.explode(F.slice("found", 2, CODE_BITS)).alias("b")
    return buckets.select(F.col("found")[0].alias("a"), star).where(near())


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable by links."""
    codes = materialise(fingerprints(docs, words), "codes")
    groups = codes.groupBy("code").agg(F.min("doc_id").alias("least"))
    found = components(link_fingerprints(groups))
    linked = found.join(groups, found.node == groups.code, "left").groupBy("component").agg(F.min("least").alias("component_id"))
    of_code = found.join(linked, "component").select(F.col("node").alias("code"), "component_id")
    least = groups.join(of_code, "code", "left").select("code", F.coalesce("component_id", "least").alias("component_id"))
    return spread_join(codes, least, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _constants(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name} {i}", SEED) | 1 for i in range(n)], dtype=np.uint64)


def symbols_of(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of distinct shingle hashes: NEAR_SEGMENTS x SYMBOLS min-wise values. Two texts agree in a symbol with the probability of their similarity."""
    n = NEAR_SEGMENTS * SYMBOLS
    multiply, add = _constants("multiply", n), _constants("add", n)
    low = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[at : at + 4096, None] * multiply + add).min(axis=0))
    return low.reshape(NEAR_SEGMENTS, SYMBOLS)


def symbol_balls(symbols: np.ndarray) -> np.ndarray:
    """Keys of the Hamming ball of radius one within each segment: the segment with each of its symbols left open in turn.

    Two texts share a key exactly if they differ in one symbol of a segment at most."""
    weighed = symbols * _constants("place", NEAR_SEGMENTS * SYMBOLS).reshape(symbols.shape)
    open_ = _constants("open", NEAR_SEGMENTS * SYMBOLS).reshape(symbols.shape)
    return _mixed(_mixed(weighed.sum(axis=1, dtype=np.uint64)[:, None] - weighed) + open_).ravel()


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(uid, doc_id, keys: the balls' keys, shingles: distinct 32-bit hashes, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets = [], []
            for t in b.column("text"):
                h = np.unique(np.array(shingle_hashes(t.as_py(), words), dtype=np.uint64))
                sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                keys.append(symbol_balls(symbols_of(h)).view(np.int64) if len(h) else np.zeros(0, dtype=np.int64))
            sizes = lambda x: np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int32)
            flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes(keys)), pa.array(flat(keys, np.int64))), pa.ListArray.from_arrays(pa.array(sizes(sets)), pa.array(flat(sets, np.int32)))], names=["doc_id", "keys", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, keys array<long>, shingles array<int>")


def near_duplicates(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """Rows (doc_id, keep_id) of the documents that are linked to others; keep_id is the least doc_id of the group.

    Texts with equal shingle sets are one class. Each class is posted under the balls of its fingerprint's segments; in a
    bucket every class is compared with the LEADERS first ones: all pairs of a small bucket, and a star for a hot one. Where a
    larger bucket's classes aren't all connected by these, the rest of its pairs are found by `across`. Pairs are verified by the
    Jaccard similarity of whole shingle sets, so all pairs of a bucket are either connected or known to be apart. A text without words is linked to none.
    """
    sketches = _sketches(docs.where("doc_id is not null"), words).where(F.size("shingles") > 0)
    rows = materialise(sketches.withColumn("whole", F.xxhash64("shingles")), "sketches")
    classes = materialise(rows.groupBy("whole").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first(F.size("shingles")).alias("n")), "classes")
    posted = classes.select("whole", "n", F.explode("keys").alias("key"))
    counts = materialise(posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "counts")
    # keys of one class alone stay behind without a shuffle; a hot bucket is dealt to several tasks
    busy = materialise(spread_join(materialise(posted.where(sieve_of(counts, "key")(F.col("key"))), "posted"), counts, "key"), "busy")
    # each task passes on its own first ones alone
    first = busy.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("whole"))).where(F.col("rank") <= LEADERS)
    heads = materialise(first.groupBy("key").agg(F.collect_list(F.struct(F.col("whole").alias("leader"), F.col("n").alias("leader_n"))).alias("leaders")), "leaders")
    pairs = (
        spread_join(busy, heads, "key")
        .select("whole", "n", F.explode("leaders").alias("of"))
        .select("whole", "n", "of.leader", "of.leader_n")
        .where("whole <> leader")
        .where(F.least("n", "leader_n") >= similarity * F.greatest("n", "leader_n"))
        .select(F.least("whole", "leader").alias("a"), F.greatest("whole", "leader").alias("b"))
        .distinct()
    )
    side = sets_of(rows, busy.select("whole").distinct())
    links = materialise(verified(pairs, side, similarity), "links")
    found = components(links)
    hot = busy.where(F.col("members") > LEADERS + 1).join(found, F.col("whole") == found.node, "left").select("key", "whole", "n", F.coalesce("component", "whole").alias("component"))
    open_buckets = hot.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"), F.sum("n").alias("size")).where("x <> y")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    more = materialise(across(hot.join(open_buckets.select("key", blocks.alias("blocks")), "key"), side, similarity), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    groups = found.join(classes.select("whole", "least"), found.node == classes.whole).groupBy("component").agg(F.min("least").alias("keep_id"))
    of_class = found.join(groups, "component").select(F.col("node").alias("whole"), "keep_id")
    keep = classes.join(of_class, "whole", "left").select("whole", F.coalesce("keep_id", "least").alias("keep_id"))
    return spread_join(rows.select("doc_id", "whole"), keep, "whole").where("doc_id <> keep_id").select("doc_id", "keep_id")


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """A table (whole, shingles) of the classes wanted (whole), and of a few others that a sieve lets through."""
    bounded_batches(rows.sparkSession)
    return materialise(rows.where(sieve_of(wanted, "whole")(F.col("whole"))).select("whole", "shingles").dropDuplicates(["whole"]), "sets")


def verified(pairs: DataFrame, side: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets in side (whole, shingles) are similar enough. Sets are fetched for the pairs; those of a text in very many pairs go to several tasks."""
    pairs = materialise(pairs, "pairs")
    first = spread_join(pairs, side.select(F.col("whole").alias("a"), F.col("shingles").alias("x")), "a")
    counted = hot_keys(pairs, "b")
    both = spread_join(first, side.select(F.col("whole").alias("b"), F.col("shingles").alias("y")), "b", hot=counted)
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def across(members: DataFrame, side: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar members of open buckets (key, whole, component, blocks).

    A bucket's members are dealt to its blocks, and each two blocks are compared in one task; all pairs of a bucket so are compared, but rows only come
    out for components that grow together."""
    block = F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.withColumn("block", block).withColumn("other", other).select("key", "whole", "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(rows: pa.Table) -> pa.Table:
        sets = [x.values.to_numpy() for x in rows["shingles"]]
        links = np.array(grown_together(sets, rows["component"].to_numpy(), similarity), dtype=np.int64).reshape(-1, 2)
        whole = rows["whole"].to_numpy()
        return pa.table({"a": whole[links[:, 0]], "b": whole[links[:, 1]]})

    return dealt.join(side, "whole").groupBy("key", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def grown_together(sets: list[np.ndarray], component: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(i, j) for sets that similarity connects to a set j of another component: as many as are needed to connect all."""
    m, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    first = np.nonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))[0]
    n = np.diff(np.concatenate([first, [len(tokens)]]))
    common = np.zeros((m, m), dtype=np.int32)
    for c in range(2, RARE):  # tokens of few owners, pair by pair
        at = owners[first[n == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(common, (at[:, i], at[:, j]), 1)
    common += common.T
    many = np.nonzero(n >= RARE)[0]
    for at in range(0, len(many), 4096):  # the others as bits
        part = many[at : at + 4096]
        bits = np.zeros((m, -(-len(part) // 64) * 64), dtype=bool)
        for column, k in enumerate(part.tolist()):
            bits[owners[first[k] : first[k] + n[k]], column] = True
        for word in np.packbits(bits, axis=1).view(np.uint64).T:
            common += np.bitwise_count(word[:, None] & word[None, :])
    alike = common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(alike, True)
    _, label = np.unique(component, return_inverse=True)
    group = label.copy()
    while True:
        near = np.where(alike, group[None, :], m).min(axis=1)
        best = np.full(int(label.max()) + 1, m)
        np.minimum.at(best, label, near)
        now = best[label]
        if np.array_equal(now, group):
            break
        group = now
    start = {int(g): i for i, g in reversed(list(enumerate(label.tolist())))}  # a set of the component that gave the group its number
    lead = {int(x): i for i, x in reversed(list(enumerate(label.tolist())))}
    return [(lead[x], start[int(group[lead[x]])]) for x in lead if int(group[lead[x]]) != x]


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the near duplicates of a document of smaller doc_id; one document of each group stays."""
    gone = materialise(near_duplicates(docs, **options).select("doc_id").distinct(), "gone")
    return without(docs, gone, "doc_id", lambda left, right: left.doc_id.cast("long") == right.doc_id)
