"""Market rules of daily-temperature events from labels and descriptions; what doesn't parse is reported, not dropped in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of bucket labels, station codes in addresses, and dates in descriptions.
_N, _DEG = r"(-?\d+)", r"\s*°?\s*[FC]?"
LABELS = {
    "lt": rf"^<\s*{_N}{_DEG}$",
    "le": rf"(?i)^{_N}{_DEG}\s+or\s+(?:below|lower|less)$",
    "ge": rf"(?i)^{_N}{_DEG}\s+or\s+(?:higher|above|more)$",
    "range": rf"^{_N}\s*[-–]\s*{_N}{_DEG}$",
    "eq": rf"^{_N}{_DEG}$",
}
ICAO = [r"timeseries\?site=([A-Za-z0-9]{4})\b", r"wunderground\.com/history/daily/[^\s]*?/([A-Za-z0-9]{4})(?:[/.\s]|$)"]
DATES = [(r"\bon (\d{1,2} [A-Z][a-z]{2} '\d{2})", "d MMM ''yy"), (r"\bon (\d{1,2} [A-Z][a-z]{2} \d{4})", "d MMM yyyy"), (r"\bon ([A-Z][a-z]+ \d{1,2}, \d{4})", "MMMM d, yyyy")]
SOURCE_PHRASE = "resolution source for this market will be"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def parse_label(label: Column) -> Column:
    """struct<ok, low, high>: inclusive whole bounds of a bucket label; an open end is null."""
    t = F.trim(label)
    a = {k: _number(t, p) for k, p in LABELS.items()}
    none = F.lit(None).cast("int")
    bounds = lambda low, high: F.struct(F.lit(True).alias("ok"), low.alias("low"), high.alias("high"))
    return (
        F.when(t.rlike(LABELS["lt"]), bounds(none, a["lt"] - 1))
        .when(t.rlike(LABELS["le"]), bounds(none, a["le"]))
        .when(t.rlike(LABELS["ge"]), bounds(a["ge"], none))
        .when(t.rlike(LABELS["range"]), bounds(a["range"], _number(t, LABELS["range"], 2)))
        .when(t.rlike(LABELS["eq"]), bounds(a["eq"], a["eq"]))
        .otherwise(F.struct(F.lit(False).alias("ok"), none.alias("low"), none.alias("high")))
    )


def parse_unit(labels: Column, description: Column) -> Column:
    """C or F from an event's labels joined together, else from its description."""
    return F.when(labels.contains("°C") | labels.contains("° C"), "C").when(labels.contains("°F"), "F").when(description.contains("degrees Celsius"), "C").otherwise("F")


def parse_icao(description: Column, resolution_source: Column) -> Column:
    found = [F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), p, 1), F.lit("")) for t in (description, resolution_source) for p in ICAO]
    return F.upper(F.coalesce(*found))


def parse_source(description: Column) -> Column:
    """wu, noaa, hko or unknown."""
    first = F.substring(F.element_at(F.split(description, SOURCE_PHRASE), -1), 1, 200)
    return F.when(description.contains("Hong Kong Observatory"), "hko").when(first.contains("NOAA"), "noaa").when(first.contains("Wunderground") | first.contains("Weather Underground"), "wu").otherwise("unknown")


def parse_local_date(description: Column, event_date: Column) -> Column:
    """The observation day: from the description, else the event's own date."""
    found = [F.when(description.rlike(p), F.to_date(F.try_to_timestamp(F.regexp_extract(description, p, 1), F.lit(fmt)))) for p, fmt in DATES]
    return F.coalesce(*found, event_date.try_cast("date"))


def weather_frame(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, failures) of events (id, city, description, resolutionSource, eventDate, slug, markets array<struct<id, groupItemTitle>>).

    An event with a label that doesn't parse gives no rules; its slug and label are in failures.
    """
    desc = F.coalesce("description", F.lit(""))
    joined = F.array_join(F.transform("markets", lambda m: F.coalesce(m.groupItemTitle, F.lit(""))), " ")
    e = events.where(F.size("markets") > 0).select(
        F.col("id").alias("event_id"), "city", "slug", parse_icao(desc, F.col("resolutionSource")).alias("station_icao"), parse_source(desc).alias("source"), parse_unit(joined, desc).alias("unit"),
        parse_local_date(desc, F.col("eventDate")).alias("local_date"), desc.contains("Weather Underground Daily Observations table will be used").alias("has_wu_fallback"), F.explode("markets").alias("m"),
    )
    label = F.coalesce("m.groupItemTitle", F.lit(""))
    rows = e.withColumns({"market_id": F.col("m.id"), "bucket_label": label, "b": parse_label(label)})
    rows = rows.withColumn("ok", F.min("b.ok").over(Window.partitionBy("event_id")))
    cols = ["event_id", "city", "station_icao", "source", "unit", "local_date", "has_wu_fallback", "market_id", "bucket_label", F.col("b.low").alias("bucket_low"), F.col("b.high").alias("bucket_high")]
    return rows.where("ok").select(*cols), rows.where("not b.ok").select("event_id", "slug", "bucket_label")


def load(markets: DataFrame, rules: DataFrame) -> DataFrame:
    """Markets with their rules, and opened_after_day_start: if trading began when the local day could have begun anywhere."""
    df = markets.join(rules.drop("event_id"), "market_id")
    return df.withColumn("opened_after_day_start", F.coalesce("start_ts", "created_ts") > F.col("local_date").cast("timestamp") - F.expr("interval 14 hours"))


def settleable() -> Column:
    """Markets that observations settle and that traded before the day began."""
    return F.col("station_icao").isNotNull() & F.col("source").isin("wu", "noaa") & ~F.col("archived_copy") & ~F.coalesce("opened_after_day_start", F.lit(True))
