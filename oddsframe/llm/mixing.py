"""Mixing sources to target weights: how often each document is taken, so that each source fills its share of the mix.

Hash-threshold histograms. Sizes are words. A source's target is met by whole copies of all its documents and one copy more of those whose hash is below
a threshold, so the sets that are taken once, twice and so on are nested. The threshold comes from sums of sizes by source and leading hash bits: the
bucket in which the running sum passes the budget is the only one that is read again, by the next bits, until one hash is left in it; it counts if
that brings the sum nearer. Nothing is sorted but the at most 4,096 buckets of a source. Documents then pass a comparison of their hash with their source's threshold.

The hash is taken of doc_id and text, so reruns agree, however rows are dealt. Sources weigh by their place in code point order, null last; the water level
that caps the targets is found by sums over the table of sources.

Defined results. A null text has no words. Documents without words are taken with 0 words. Rows that are equal in doc_id and text share a hash, and so are taken
alike. A source's taken words miss its target by half a document (of such repeats: half their words) at most. The empty source name is a source
of its own, unlike null. An empty table gives no rows. Extra columns are left alone by mixed and not read by mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsframe.llm.common import attach, materialise

#: Weights of the sources in order, repeating; what a source's target may be of its size at most; the mix's size as a share of all sizes.
WEIGHTS, MOST, SHARE = (5, 2, 1), 3, 1.0
#: Bits of a hash, and of it a level of histograms.
HASH_BITS, LEVEL_BITS = 60, 12

_SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space; null: 0. Each run becomes one letter, so no array of words is made."""
    return F.coalesce(F.char_length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), _SPACE, "")), F.lit(0)).cast("long")


def _facts(prefix: str = "") -> list[Column]:
    """A document's key of its source (never null), size and hash, from the columns doc_id, text and source."""
    seen = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    number = F.conv(F.substring(F.md5(seen.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return [F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias(f"{prefix}key"), word_count(F.col("text")).alias(f"{prefix}size"), number.alias(f"{prefix}hash")]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = SHARE) -> DataFrame:
    """(key, source_size, target) of each source of (key, size). Shares by weight; what a source can't take is shared out again until no target is over most
    times its source's size."""
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    # "" stands for null, which comes last; the others are "s" and the name
    ordered = materialise(sources.orderBy(F.col("key") == "", "key").withColumn("at", F.monotonically_increasing_id()), "sources")
    part, starts = F.shiftright("at", 33), [0]
    counts = {r["part"]: r["count"] for r in ordered.groupBy(part.alias("part")).count().collect()}  # a row a partition
    for k in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(k, 0))
    place = F.pmod(F.element_at(F.array(*map(F.lit, starts)), part.cast("int") + 1) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(len(weights))).cast("int")
    weighed = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    cap, level, full = most * F.col("source_size"), None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > cap
        sums = weighed.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if sums[2] == full or sums[1] is None:
            break
        level, full = (total * share - (sums[0] or 0)) / sums[1], sums[2]
    target = cap if level is None or sums[1] is None else F.least(cap, F.col("weight") * level)
    return weighed.select("key", "source_size", target.cast("double").alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, source_size, target, copies, cut): all documents of a source are taken copies times, those of a hash below cut once more. sizes: a table of (key, size, hash)."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = materialise(targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "targets")
    rows, bounds = sizes.where("size > 0"), wanted.select("key", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        sums = rows.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        upto = F.sum("n").over(Window.partitionBy("key").orderBy("bucket"))  # LEVEL_BITS bounds a source's buckets
        passed = sums.join(bounds.select("key", "rest", "below", "prefix"), "key").drop("prefix").withColumn("upto", F.col("below") + upto)
        passed = passed.where("upto > rest and upto - n <= rest")
        bounds = materialise(passed.select("key", "rest", (F.col("upto") - F.col("n")).alias("below"), F.col("bucket").alias("prefix"), "n", "rows"), "bounds")
        if not shift or (bounds.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
        rows = materialise(attach(rows, bounds.select("key", "prefix"), "key").where(F.shiftright("hash", shift) == F.col("prefix")).drop("prefix"), "bucket")
    nearer = F.col("below") + F.col("n") - F.col("rest") < F.col("rest") - F.col("below")
    cuts = bounds.select("key", F.shiftleft(F.col("prefix") + F.when(nearer, 1).otherwise(0), shift).alias("cut"))
    return materialise(wanted.join(cuts, "key", "left").select("key", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).alias("cut")), "cuts")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = SHARE) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of documents: its words, its source's words and target, and the words that the mix takes, repeats counted."""
    sizes = materialise(docs.select("doc_id", *_facts()), "sizes")
    times = F.col("copies") + (F.col("hash") < F.col("cut")).cast("int")
    return attach(sizes, thresholds(sizes, source_targets(sizes, weights, most, share)), "key").select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = SHARE) -> DataFrame:
    """The mix itself: the rows of documents, each as often as it is taken (those without words as often as their source's whole copies)."""
    sizes = materialise(docs.select(*_facts()), "sizes")
    cuts = thresholds(sizes, source_targets(sizes, weights, most, share)).select(F.col("key").alias("__key"), F.col("copies").alias("__copies"), F.col("cut").alias("__cut"))
    joined = attach(docs.select("*", *_facts("__")), cuts, "__key")
    times = F.col("__copies") + (F.col("__hash") < F.col("__cut")).cast("int")
    return joined.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))))).select(*docs.columns)


ORACLE_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as hash
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight, sum(source_size) over () as total from s),
-- sources that reach their caps first come first: the water level is a weight's share once those are full, and the highest of these is the one that none is above
o as (select *, sum(weight) over (order by 3 * source_size / weight, place rows between current row and unbounded following) as weights,
    coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, place rows between unbounded preceding and 1 preceding), 0) as filled from w),
l as (select max(cast(total - filled as double) / cast(weights as double)) as water from o),
t as (select source, source_size, least(cast(3 * source_size as double), weight * water) as target from w, l),
c as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as copies from t),
r as (select *, target - copies * source_size as rest from c),
g as (select source, hash, sum(size) as n from d where size > 0 group by source, hash),
u as (select source, hash, n, sum(n) over (partition by source order by hash) as upto from g),
b as (select u.source, max(case when upto <= rest or (upto - n <= rest and upto - rest < rest - (upto - n)) then hash end) as last from u join r on u.source is not distinct from r.source group by u.source)
select d.doc_id, d.size, r.source_size, r.target, d.size * (r.copies + (d.hash <= coalesce(b.last, -1))::int) as taken
from d join r on d.source is not distinct from r.source left join b on d.source is not distinct from b.source
"""
