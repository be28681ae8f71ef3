"""Calibration cells, multiple testing, block bootstrap, and losses against the market."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.functions.exprs import EPS, divide, log_loss, norm_sf_sql

N_BOOT, SEED = 2000, 7
#: Weights of resampled blocks are numbers below this prime; its square fits a long.
BOOT_PRIME = 2**31 - 1


def _cells(clusters: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Cells from clusters (keys, r: summed residual, n, p_sum, y_sum). The squared residuals come from sums, so no list is gathered."""
    total = lambda e: F.sum(e)
    g = clusters.groupBy(*keys).agg(
        total(F.col("n")).alias("n"), F.count("*").alias("events"), total(F.col("p_sum")).alias("__p"), total(F.col("y_sum")).alias("__y"),
        total(F.col("r") * F.col("r")).alias("__rr"), total(F.col("r") * F.col("n")).alias("__rn"), total(F.col("n") * F.col("n")).alias("__nn"), *(extra or []),
    )
    g = g.withColumns({"p_mean": divide(F.col("__p"), F.col("n")), "freq": divide(F.col("__y"), F.col("n"))}).withColumn("diff", F.col("freq") - F.col("p_mean"))
    square = F.greatest(F.col("__rr") - 2 * F.col("diff") * F.col("__rn") + F.col("diff") * F.col("diff") * F.col("__nn"), F.lit(0.0))
    k = F.col("events").cast("double")
    g = g.withColumn("se", F.when(F.col("events") > 1, F.sqrt(divide(k, k - 1) * square) / F.col("n")))
    z = F.when(F.col("se") > 0, divide(F.col("diff"), F.col("se"))).when(F.col("se") == 0, F.when(F.col("diff") > 0, F.lit(float("inf"))).when(F.col("diff") < 0, F.lit(float("-inf"))).otherwise(0.0))
    g = g.withColumns({"z": z, "ci_lo": F.col("diff") - 1.96 * F.col("se"), "ci_hi": F.col("diff") + 1.96 * F.col("se")})
    p = F.when(F.abs("z") >= 38, 0.0).when(F.col("se").isNotNull(), F.least(F.lit(1.0), 2 * F.expr(norm_sf_sql("abs(z)"))))
    return g.withColumn("pval", p).drop("__p", "__y", "__rr", "__rn", "__nn")


def _clusters(df: DataFrame, keys: list[str], price: str, outcome: str, extra: list[Column] | None = None) -> DataFrame:
    p, y = F.col(price), F.col(outcome)
    return df.groupBy(*keys).agg(F.sum(y - p).alias("r"), F.count("*").alias("n"), F.sum(p).alias("p_sum"), F.sum(y).cast("double").alias("y_sum"), *(extra or []))


def cell_stats(df: DataFrame, by: list[str], price: str = "p", outcome: str = "y", cluster: str = "event_id") -> DataFrame:
    """By cell: n, events, mean price, realised frequency, their difference with its cluster-robust error, z, 95 % interval and p-value.

    A cluster's summed residual is one observation. Cells of one cluster have null se, z and p-value.
    """
    return _cells(_clusters(df, [*by, cluster], price, outcome), by)


def grouping_cells(df: DataFrame, dims: list[str], always: list[str], price: str = "p", outcome: str = "y", cluster: str = "event_id", mean: tuple[str, str] | None = None, fill: str = "ALL") -> DataFrame:
    """Cells for all subsets of dims, each with the keys `always`: one scan, aggregated to clusters by (dims, always), then rolled up per set.

    A key that a set leaves out reads `fill`. mean: (column, name) of a row mean to add.
    """
    extra = [F.sum(mean[0]).alias("__m"), F.count(mean[0]).alias("__c")] if mean else []
    base = _clusters(df, [*dims, *always, cluster], price, outcome, extra)
    sets = [dict(zip(dims, x, strict=True)) for x in product([True, False], repeat=len(dims))]
    rows = base.withColumn("__set", F.explode(F.array(*[F.lit(i) for i in range(len(sets))])))
    for d in dims:
        kept = [i for i, s in enumerate(sets) if s[d]]
        rows = rows.withColumn(d, F.when(F.col("__set").isin(kept), F.col(d)).otherwise(F.lit(fill)))
    keys = ["__set", *dims, *always]
    sums = ["r", "n", "p_sum", "y_sum", *(["__m", "__c"] if mean else [])]
    clusters = rows.groupBy(*keys, cluster).agg(*[F.sum(c).alias(c) for c in sums])
    more = [divide(F.sum("__m"), F.sum("__c")).alias(mean[1])] if mean else []
    return _cells(clusters, keys, more).drop("__set")


def side_view(df: DataFrame, price: str = "p", outcome: str = "y") -> DataFrame:
    """Each row twice: side YES, and side NO with price and outcome turned round."""
    sides = F.array(F.struct(F.lit("YES").alias("s"), F.col(price).alias("p"), F.col(outcome).alias("y")), F.struct(F.lit("NO").alias("s"), (1 - F.col(price)).alias("p"), (1 - F.col(outcome)).alias("y")))
    out = df.withColumn("__x", F.explode(sides))
    return out.select(*[F.col("__x.p").alias(c) if c == price else F.col("__x.y").alias(c) if c == outcome else F.col(c) for c in df.columns], F.col("__x.s").alias("side"))


def benjamini_hochberg(df: DataFrame, pval: str = "pval", q: float = 0.05, name: str = "bh_pass") -> DataFrame:
    """df with a flag for the hypotheses rejected at false discovery rate q; null and NaN p-values never pass.

    Meant for tables of cells: ranks are global, so equal p-values are counted first and only distinct ones are ranked in one task.
    """
    p = F.when(F.col(pval).isNull() | F.isnan(pval), 1.0).otherwise(F.col(pval))
    counts = df.select(p.alias("__p")).groupBy("__p").agg(F.count("*").alias("__n"))
    ranked = counts.withColumns({"__rank": F.sum("__n").over(Window.orderBy("__p")), "__all": F.sum("__n").over(Window.partitionBy())})
    # within ties the last rank is the largest, and passes if any of them does
    cut = ranked.where(F.col("__p") * F.col("__all") / F.col("__rank") <= q).agg(F.max("__p").alias("__cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(name, F.coalesce(p <= F.col("__cut"), F.lit(False))).drop("__cut")


def bonferroni_threshold(alpha: float, n_tests: int) -> float:
    return alpha / max(n_tests, 1)


def poisson_steps(modulus: int = BOOT_PRIME) -> list[int]:
    """Where a number uniform in 0 .. modulus - 1 has to be at least for a Poisson variable of mean 1 to be over 0, over 1 and so on."""
    out, upto, term, k = [], 0.0, math.exp(-1), 0
    while not out or out[-1] < modulus - 1:
        upto += term
        k += 1
        term /= k
        out.append(min(math.ceil(upto * modulus), modulus - 1))
    return out[:-1]


def block_weights(blocks: DataFrame, block: str, n_boot: int, seed: int) -> DataFrame:
    """Each row of blocks once for each repetition __rep of 0 .. n_boot, with its weight __w: how often the block is drawn, 1 in repetition 0.

    A weight is a Poisson variable of mean 1, from a hash of (seed, block, repetition) alone: the block's digest gives three numbers, the coefficients of a
    polynomial in the repetition modulo a prime. So weights are independent over blocks and, three by three, over repetitions, don't depend on how rows are dealt,
    and are whole-number arithmetic that any SQL engine repeats.
    """
    seen = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(block).cast("string"), F.lit("null"))).cast("binary"))
    digits = lambda k: F.conv(F.substring(seen, 8 * k + 1, 8), 16, 10).cast("long") % BOOT_PRIME
    rows = blocks.withColumns({f"__h{k}": digits(k) for k in range(3)})
    rows = rows.withColumn("__rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot).cast("long"))))
    x = ((F.col("__h2") * F.col("__rep") % BOOT_PRIME + F.col("__h1")) * F.col("__rep") + F.col("__h0")) % BOOT_PRIME
    rows = rows.withColumn("__x", x).drop("__h0", "__h1", "__h2")
    drawn = sum(((F.col("__x") >= step).cast("long") for step in poisson_steps()), F.lit(0).cast("long"))
    return rows.withColumn("__w", F.when(F.col("__rep") == 0, F.lit(1).cast("long")).otherwise(drawn)).drop("__x")


def block_ci(df: DataFrame, num: str, den: str | None, block: str, group: list[str] | None = None, n_boot: int = N_BOOT, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """(group, point, lo, hi): sum(num) / sum(den), or sum(num), with a percentile interval from resampled blocks.

    All in the JVM: rows are summed to blocks, each block gets its weight in every repetition (`block_weights`), and weighted sums are added up by (group,
    repetition), each task first by itself; so a group may have any number of blocks, and no task holds them. Sums without den are scaled to the number of
    blocks that there are, as if exactly so many had been drawn. Fewer than two blocks give no interval; repetitions without a value don't count.
    """
    keys = group or []
    by = keys or ["__all"]
    rows = df if keys else df.withColumn("__all", F.lit(0))
    zero = F.lit(0.0)
    sums = rows.groupBy(*by, F.col(block).alias("__block")).agg(F.coalesce(F.sum(num).cast("double"), zero).alias("__a"), (F.coalesce(F.sum(den).cast("double"), zero) if den else zero).alias("__b"))
    # blocks are few bytes but much work: dealt to all cores before they are repeated
    sums = sums.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = lambda c: F.sum(F.col(c) * F.col("__w"))
    each = block_weights(sums, "__block", n_boot, seed).groupBy(*by, "__rep").agg(total("__a").alias("__a"), total("__b").alias("__b"), F.sum("__w").alias("__w"), F.count("*").alias("__n"))
    value = divide(F.col("__a"), F.col("__b")) if den else divide(F.col("__a") * F.col("__n"), F.col("__w"))
    each = each.withColumn("__v", value)
    tail = (1 - level) / 2
    drawn = F.when((F.col("__rep") > 0) & (F.col("__n") > 1), F.col("__v"))
    out = each.groupBy(*by).agg(F.max(F.when(F.col("__rep") == 0, F.col("__v"))).alias("point"), F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("__ci"))
    return out.select(*keys, "point", F.col("__ci")[0].alias("lo"), F.col("__ci")[1].alias("hi"))


def block_ci_sql(rows: str, num: str, den: str | None, block: str, group: list[str], n_boot: int = N_BOOT, seed: int = SEED, level: float = 0.95) -> str:
    """A query with the columns of block_ci over a named table, in the SQL of the engine that checks results."""
    by, tail = "".join(f"{g}, " for g in group), (1 - level) / 2
    drawn = " + ".join(f"(x >= {step})::bigint" for step in poisson_steps())
    hashes = ", ".join(f"cast('0x' || substr(seen, {8 * k + 1}, 8) as bigint) % {BOOT_PRIME} as h{k}" for k in range(3))
    value = "case when sum(b * w) <> 0 then sum(a * w) / sum(b * w) end" if den else "case when sum(w) <> 0 then sum(a * w) * count(*) / sum(w) end"
    grouped = f"group by {', '.join(group)}" if group else "having count(*) > 0"
    return f"""
        select {by}max(case when rep = 0 then v end) as point, quantile_cont(case when rep > 0 and n > 1 then v end, {tail}) as lo, quantile_cont(case when rep > 0 and n > 1 then v end, {1 - tail}) as hi from (
          select {by}rep, {value} as v, count(*) as n from (
            select *, case when rep = 0 then 1 else {drawn} end as w from (
              select *, ((h2 * rep % {BOOT_PRIME} + h1) * rep + h0) % {BOOT_PRIME} as x from (
                select *, {hashes} from (
                  select {by}coalesce(cast(sum({num}) as double), 0) as a, {f'coalesce(cast(sum({den}) as double), 0)' if den else '0.0'} as b, md5('{seed}:' || coalesce(cast({block} as varchar), 'null')) as seen
                  from {rows} group by {by}{block})), (select unnest(range({n_boot + 1})) as rep))) group by {by}rep) {grouped}"""


def ratio_ci(df: DataFrame, num: str, den: str, block: str, **options) -> DataFrame:
    return block_ci(df, num, den, block, **options)


def mean_ci(df: DataFrame, value: str, block: str, **options) -> DataFrame:
    return block_ci(df.withColumn("__one", F.lit(1.0)), value, "__one", block, **options)


def sum_ci(df: DataFrame, value: str, block: str, **options) -> DataFrame:
    return block_ci(df, value, None, block, **options)


def outcome_losses(panel: DataFrame, model_col: str = "p_model") -> DataFrame:
    """Log loss of market and model on what happened: of exclusive groups the winning market's row, of other markets both sides."""
    neg, won = F.col("neg_risk"), F.col("winner") == 0
    kept = panel.where(F.when(neg, won).otherwise(~neg))
    loss = lambda group, single: F.when(neg, log_loss(F.col(group))).otherwise(log_loss(F.when(won, F.col(single)).otherwise(1 - F.col(single)), EPS))
    return kept.withColumns({"ll_market": loss("q_market", "p"), "ll_model": loss(model_col, model_col)}).withColumn("diff", F.col("ll_model") - F.col("ll_market"))


def head_to_head(losses: DataFrame, group: str | None = None, block: str = "block", n_boot: int = N_BOOT) -> DataFrame:
    """By group: n, events, mean losses, model minus market with a block-bootstrap interval."""
    rows = losses.withColumn("group", F.col(group).cast("string") if group else F.lit("all"))
    g = rows.groupBy("group").agg(F.count("*").alias("n"), (F.countDistinct("event_id") + F.max(F.col("event_id").isNull().cast("int"))).alias("events"), F.avg("ll_market").alias("ll_market"), F.avg("ll_model").alias("ll_model"))
    ci = mean_ci(rows, "diff", block, group=["group"], n_boot=n_boot).select("group", F.col("point").alias("model_minus_market"), F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))
    return g.join(ci, "group").orderBy("group")
