"""Column expressions shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

import re
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price band edges, the floor of probabilities, the buffer before an outcome can be known.
BAND_EDGES = [0.01, 0.03, 0.05, 0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.90, 0.95, 0.97, 0.99]
EPS = 1e-4
LOOKAHEAD_BUFFER = timedelta(hours=1)

_UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_duration(text: str) -> timedelta:
    """'90m', '6h', '7d' as a timedelta; fractions are allowed."""
    if not (m := re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([mhd])\s*", text)):
        raise ValueError(f"not a duration: {text!r} (write 90m, 6h or 7d)")
    return timedelta(seconds=float(m[1]) * _UNIT_SECONDS[m[2]])


def micros_of(d: timedelta) -> int:
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def interval(d: timedelta) -> Column:
    """d as an interval literal."""
    return F.expr(f"interval '{micros_of(d)}' microsecond")


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without time zone."""
    return F.unix_micros(col(c).cast("timestamp"))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c within [low, high]; null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def mean_of(*cols: Column) -> Column:
    """The mean of those that aren't null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(count > 0, total / count)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def to_fahrenheit(c: Column) -> Column:
    return c * 9 / 5 + 32


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def band_labels(edges: list[float]) -> list[str]:
    points = [0.0, *edges, 1.0]
    return [f"{round(a * 100):g}-{round(b * 100):g}" for a, b in zip(points, points[1:], strict=False)]


def band(c: str | Column = "p", edges: list[float] | None = None) -> Column:
    """The label of a price's band, closed on the left; null for a null price."""
    edges = BAND_EDGES if edges is None else edges
    x, labels = col(c), band_labels(edges)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(x < edge, label)
    return out.otherwise(labels[-1])


def taker_fee(price: Column, enabled: Column | None = None, rate: Column | None = None, exponent: Column | None = None) -> Column:
    """Fee a share: rate * (price * (1 - price)) ^ exponent where fees are on, else 0."""
    on = F.coalesce(F.col("fees_enabled"), F.lit(False)) if enabled is None else enabled
    by = F.coalesce(F.col("fee_rate"), F.lit(0.0)) if rate is None else rate
    power = F.coalesce(F.col("fee_exponent"), F.lit(1.0)) if exponent is None else exponent
    return F.when(on, by * F.pow(price * (1 - price), power)).otherwise(0.0)


def usable(time_col: str, buffer: timedelta = LOOKAHEAD_BUFFER) -> Column:
    """If a time is after the market's creation (when that is known) and before its outcome could be known."""
    t = F.col(time_col)
    return (F.col("created_ts").isNull() | (t >= F.col("created_ts"))) & (t <= F.col("known_ts") - interval(buffer))


def log_loss(p: Column, eps: float = EPS) -> Column:
    return -F.log(clip(p, eps, 1.0))


def binary_log_loss(p: Column, y: Column, eps: float = EPS) -> Column:
    return log_loss(F.when(y == 1, p).otherwise(1 - p), eps)


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def norm_pdf_sql(z: str) -> str:
    return f"(exp(-({z}) * ({z}) / 2.0) / 2.5066282746310002e0)"


# Numerator and denominator of the rational approximation of the normal tail, highest power first.
_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def _poly(coefficients: list[float], x: str) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}e0)" if "e" not in repr(c) else f"({acc} * {x} + {c!r})", coefficients[1:], f"{coefficients[0]:.14e}")


def norm_sf_sql(z: str) -> str:
    """P(Z > z) of the standard normal as SQL that several engines read; 14 digits."""
    x = f"least(abs({z}), 38e0)"
    near = f"{_poly(_TOP, x)} / {_poly(_BOTTOM, x)}"
    far = f"1e0 / (({x} + 1e0 / ({x} + 2e0 / ({x} + 3e0 / ({x} + 4e0 / ({x} + 0.65e0))))) * 2.506628274631e0)"
    tail = f"(exp(-{x} * {x} / 2e0) * (case when {x} < 7.07106781186547e0 then {near} else {far} end))"
    return f"(case when ({z}) is null then null when ({z}) > 0 then {tail} else 1e0 - {tail} end)"


def norm_cdf_sql(z: str) -> str:
    return norm_sf_sql(f"(-({z}))")


def norm_cdf(name: str) -> Column:
    """The normal distribution function of a column by name."""
    return F.expr(norm_cdf_sql(f"`{name}`"))


def crps_gaussian_sql(y: str, mu: str, sigma: str) -> str:
    z = f"((({y}) - ({mu})) / ({sigma}))"
    return f"(({sigma}) * ({z} * (2e0 * {norm_cdf_sql(z)} - 1e0) + 2e0 * {norm_pdf_sql(z)} - 0.5641895835477563e0))"


def interval_prob_sql(a: str, b: str, mu: str, sigma: str, m: str) -> str:
    """P(a <= max(m, X) < b) for a normal X, within [0, 1]; a null m is minus infinity."""
    upper = f"(case when ({b}) > coalesce({m}, -1e9) then {norm_cdf_sql(f'(({b}) - ({mu})) / ({sigma})')} else 0e0 end)"
    lower = f"(case when ({a}) > coalesce({m}, -1e9) then {norm_cdf_sql(f'(({a}) - ({mu})) / ({sigma})')} else 0e0 end)"
    return f"greatest(0e0, least(1e0, {upper} - {lower}))"
