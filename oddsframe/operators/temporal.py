"""Joins along time, as one shuffle and a window each."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.functions.exprs import interval, micros, micros_of


#: Windows that a chunk of a key's time line is wide in range sums.
WINDOWS_A_CHUNK = 16
#: Quantiles of a hot key's times, among which its cuts are chosen; so many pieces a key has at most.
QUANTILES = 1_000


def pieces(rows: DataFrame, by: list[str], time: str, size: int) -> DataFrame:
    """rows with __chunk, the place of their piece of their key's time line: 0 for keys of at most `size` rows, else cut at quantiles into pieces of about so many.

    Equal times stay together. Keys are counted, and those over size alone have quantiles; there are fewer of them than rows / size, and as many cuts, which all tasks get. It's all one lazy
    plan, which reads rows twice more."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > size)
    grid = F.array(*[F.lit(k / QUANTILES) for k in range(1, QUANTILES)])
    line = rows.join(F.broadcast(counts.drop("__n")), by, "left_semi").groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx(micros(time), grid, 10 * QUANTILES).alias("__q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES) * size / F.col("__n"))).cast("int")
    cuts = line.select(*by, F.array_distinct(F.filter("__q", lambda _, k: (k + 1) % step == 0)).alias("__cuts"))
    place = F.size(F.filter("__cuts", lambda c: c < micros(time)))
    return rows.join(F.broadcast(cuts), by, "left").withColumn("__chunk", F.coalesce(F.when(F.col("__cuts").isNotNull(), place), F.lit(0)).cast("long")).drop("__cuts")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    take: dict[str, str],
    tolerance: timedelta | None = None,
    ties: list[str] | None = None,
    chunk: timedelta | int | None = None,
) -> DataFrame:
    """left with the last row of right at or before its time, by key: columns `take` (new name: right's column).

    The sides are dealt and sorted together and the last right row is carried along. Of right rows of equal time the last by
    `ties` counts; a right row counts even if its values are null. A match older than `tolerance` is none.
    `chunk` cuts a key's time line, so that a hot key is dealt to many tasks: a number cuts keys of more rows into pieces of about so many (see pieces), a time span all keys
    at its multiples. The last row of earlier chunks is carried into each by a join of one row a chunk.
    """
    values = F.struct(*[F.col(c).alias(n) for n, c in take.items()], F.col(right_on).alias("__at"))
    order = F.struct(*[F.col(c) for c in ties]) if ties else F.struct(F.lit(0).alias("none"))
    kind = right.select(order.alias("o"), values.alias("v")).schema
    a = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind["o"].dataType).alias("__o"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(kind["v"].dataType).alias("__v"))
    b = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), order.alias("__o"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("__l"), values.alias("__v"))
    keys = list(by)
    both = a.unionByName(b)
    if chunk is not None:
        both = pieces(both, keys, "__t", chunk) if isinstance(chunk, int) else both.withColumn("__chunk", F.floor(micros("__t") / micros_of(chunk)))
        keys.append("__chunk")
    line = Window.partitionBy(*keys).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(line))
    if chunk is not None:
        ends = both.where("__side = 0").groupBy(*keys).agg(F.max_by("__v", F.struct("__t", "__o")).alias("__end"))
        stops = both.select(*keys).distinct().join(ends, keys, "left")
        earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = stops.select(*keys, F.last("__end", ignorenulls=True).over(earlier).alias("__carried")).where("__carried is not null")
        found = found.where("__side = 1").join(carried, keys, "left").withColumn("__v", F.coalesce("__v", "__carried"))
    out = found.where("__side = 1")
    hit = F.col("__v") if tolerance is None else F.when(F.col("__t") - F.col("__v.__at") <= interval(tolerance), F.col("__v"))
    return out.select("__l.*", hit.alias("__v")).select(*left.columns, *[F.col(f"__v.{n}").alias(n) for n in take])


def range_sum(probes: DataFrame, points: DataFrame, by: str, probe_time: str, point_time: str, value: str, after: timedelta, until: timedelta) -> DataFrame:
    """probes with `__sum`: the sum of points' values with time in (t + after, t + until], null where there are none.

    A key's time line is cut into chunks of many windows, and a point goes to each chunk whose probes it can be near to, seldom more than one: so a hot
    key is dealt to many tasks."""
    cols, low, high = probes.columns, micros_of(after), micros_of(until)
    width = max(WINDOWS_A_CHUNK * (high - low), 1)
    chunk = lambda t: F.floor(t / width)
    t, p = micros(probe_time), micros(point_time)
    a = probes.select(F.col(by).alias("__k"), chunk(t).alias("__c"), t.alias("__t"), F.lit(None).cast("double").alias("__x"), F.struct(*cols).alias("__l"))
    b = points.where(F.col(point_time).isNotNull()).select(F.col(by).alias("__k"), F.explode(F.sequence(chunk(p - high), chunk(p - low))).alias("__c"), p.alias("__t"), F.col(value).cast("double").alias("__x"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"))
    near = Window.partitionBy("__k", "__c").orderBy("__t").rangeBetween(low + 1, high)
    return a.unionByName(b).withColumn("__sum", F.sum("__x").over(near)).where("__l is not null").select("__l.*", "__sum")


def forward_join(probes: DataFrame, points: DataFrame, by: str, probe_time: str, point_time: str, window: timedelta, how: Column | None = None) -> DataFrame:
    """Pairs of probes and points with point time in (t, t + window], by key.

    An equi-join on key and time bucket of the window's width: a probe looks in its own bucket and the next, so no
    key's points all meet all its probes.
    """
    width = micros_of(window)
    at = F.floor(micros(probe_time) / width)
    a = probes.withColumn("__bucket", F.explode(F.array(at, at + 1)))
    b = points.withColumn("__bucket", F.floor(micros(point_time) / width))
    out = a.join(b, [by, "__bucket"]).where((F.col(point_time) > F.col(probe_time)) & (F.col(point_time) <= F.col(probe_time) + interval(window)))
    return (out if how is None else out.where(how)).drop("__bucket")


def forward_fill(df: DataFrame, value: str, by: list[str], order: str, limit: int) -> DataFrame:
    """df with nulls of value replaced by the last one of at most `limit` rows before."""
    return df.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-limit, 0)))
