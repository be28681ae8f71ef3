"""Golden records: of the records of a cluster, which value of each field survives.

Two-stage salted aggregation. Each rule is an order, and a winner is the least struct of (order, value), so winners are minima: first one a (cluster, salt),
then one a cluster over the salts. A first such round finds what the orders themselves need, the latest update of a cluster and its segment; these go
back to the rows by (cluster, salt), so that the rows of a hot cluster stay dealt to as many tasks as there are salts. The second round finds all fields.
No sort of a cluster, no list of its records, no window; the merging stage reads one row a (cluster, salt).

Defined results. A record's cluster is master_id, if null client_id; records with neither make one cluster of their own, with a null id. Strings that are empty
or ASCII white space alone count as null, source too; unknown and null sources are trusted least. A balance that isn't finite, or whose cents don't fit
a long, counts as null. A null client_id comes after all others. Repeated records count in n_records and n_stale; full ties are broken by the value itself. An empty table gives
no records. Extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsframe.llm.common import parts_for

#: Sources by falling trust, and the age in hours, behind the latest record of its cluster, from which a record is stale.
TRUST, STALE_HOURS = ("partner", "store", "web", "crm"), 30 * 24
#: Rows of the table a salt, and salts at least. A cluster never has more (cluster, salt) pairs than records.
ROWS_A_SALT, LEAST_SALTS = 1_000_000, 64

_SPACE = " \t\n\x0b\x0c\r"


def _filled(name: str) -> Column:
    return F.when(F.trim(F.col(name), F.lit(_SPACE)) != "", F.col(name)).alias(name)


def _before(clients: DataFrame) -> tuple[Column, Column]:
    """How long before a fixed moment a record was updated (the later, the less), exact to the microsecond in any session time zone; and how long hours are."""
    if isinstance(clients.schema["updated_at"].dataType, T.TimestampNTZType):
        return F.expr("timestamp_ntz'1970-01-01 00:00:00' - updated_at"), lambda hours: F.expr(f"interval '{hours}' hour")
    return -F.unix_micros("updated_at"), lambda hours: F.lit(hours * 3_600_000_000)


def golden_records(clients: DataFrame, trust: tuple[str, ...] = TRUST, stale_hours: int = STALE_HOURS, salts: int | None = None) -> DataFrame:
    """(cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance_cents, name_from, email_from, segment_from, balance_from, address_from)
    of the table (client_id, master_id, source, updated_at, name, email, segment, city, nation_id, balance). salts: else one a ROWS_A_SALT rows."""
    salts = salts or max(LEAST_SALTS, parts_for(clients.count(), ROWS_A_SALT))
    before, hours = _before(clients)
    cents = F.floor(100 * F.col("balance").cast("double") + 0.5)
    whole = F.abs(100 * F.col("balance").cast("double")) < float(1 << 62)  # false for infinite ones; NaN is greater than all
    source, cluster = _filled("source"), F.coalesce("master_id", "client_id")
    rank = F.coalesce(*(F.when(source == s, F.lit(k)) for k, s in enumerate(trust)), F.lit(len(trust)))
    rows = clients.select(
        F.coalesce(cluster, F.lit(0)).alias("cluster"), cluster.isNull().alias("none"), F.pmod(F.xxhash64("client_id", "updated_at", "name", "email", "balance"), F.lit(salts)).cast("int").alias("salt"),
        F.col("client_id").alias("id"), rank.alias("rank"), before.alias("before"), *map(_filled, ("name", "email", "segment", "city")), F.col("nation_id"), F.when(whole, cents).alias("cents"),
    )
    recent = [F.col("before").isNull().alias("undated"), F.col("before"), F.col("rank"), F.col("id").isNull().alias("nameless"), F.col("id")]
    least = lambda order, value: F.min(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("value"))))
    merged = lambda *names: [F.min(n).alias(n) for n in names]

    # what the orders need: the latest update and the segment, with the salts that a cluster has
    parts = rows.groupBy("cluster", "none", "salt").agg(F.min("before").alias("latest"), least(recent, "segment").alias("chosen"))
    heads = parts.groupBy("cluster", "none").agg(*merged("latest", "chosen"), F.collect_list("salt").alias("salts"))
    known = rows.join(heads.select("cluster", "none", "latest", "chosen", F.explode("salts").alias("salt")), ["cluster", "none", "salt"])

    stale = F.col("before").isNull() | (F.col("before") - F.col("latest") > hours(stale_hours))
    known = known.withColumn("stale", stale).withColumn("others", ~F.col("segment").eqNullSafe(F.col("chosen.value")))
    trusted = [F.col("stale"), F.col("rank"), *recent]
    held = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    parts = known.groupBy("cluster", "none", "salt").agg(
        F.count("*").alias("n_records"), F.count_if("stale").alias("n_stale"), F.min("chosen").alias("segment"),
        least([(-F.char_length("name")).alias("short"), *trusted], "name").alias("name"),
        least(trusted, "email").alias("email"),
        least([F.col("others"), *recent], "cents").alias("balance"),
        F.min(F.struct((-held).alias("held"), *trusted, F.col("city"), F.col("nation_id"))).alias("address"),
    )
    won = parts.groupBy("cluster", "none").agg(F.sum("n_records").alias("n_records"), F.sum("n_stale").alias("n_stale"), *merged("segment", "name", "email", "balance", "address"))
    return won.select(
        F.when(~F.col("none"), F.col("cluster")).alias("cluster_id"), "n_records", "n_stale",
        *(F.col(f"{f}.value").alias(f) for f in ("name", "email", "segment")), F.col("address.city").alias("city"), F.col("address.nation_id").alias("nation_id"), F.col("balance.value").alias("balance_cents"),
        *(F.col(f"{f}.id").alias(f"{f}_from") for f in ("name", "email", "segment", "balance")), F.when(F.col("address.held") < 0, F.col("address.id")).alias("address_from"),
    )


ORACLE_SQL = r"""
with r as (
  select client_id, coalesce(master_id, client_id) as cluster_id, updated_at, nation_id,
    case source when 'partner' then 0 when 'store' then 1 when 'web' then 2 when 'crm' then 3 else 4 end as rank,
    case when not regexp_full_match(name, '[\x20\x09-\x0D]*') then name end as name,
    case when not regexp_full_match(email, '[\x20\x09-\x0D]*') then email end as email,
    case when not regexp_full_match(segment, '[\x20\x09-\x0D]*') then segment end as segment,
    case when not regexp_full_match(city, '[\x20\x09-\x0D]*') then city end as city,
    case when isfinite(balance) then cast(floor(100 * balance + 0.5) as bigint) end as cents
  from clients),
h as (
  select cluster_id, max(updated_at) as latest,
    first(segment order by updated_at desc nulls last, rank, client_id nulls last, segment) filter (segment is not null) as segment,
    first(client_id order by updated_at desc nulls last, rank, client_id nulls last, segment) filter (segment is not null) as segment_from
  from r group by 1),
k as (
  select r.*, h.segment as chosen, h.segment_from, updated_at is null or latest - updated_at > interval 720 hour as stale,
    r.segment is distinct from h.segment as others, (city is not null)::int + (nation_id is not null)::int as held
  from r join h on r.cluster_id is not distinct from h.cluster_id),
o as (
  select *, row_number() over (partition by cluster_id order by stale, rank, updated_at desc nulls last, client_id nulls last) as trusted,
    row_number() over (partition by cluster_id order by updated_at desc nulls last, rank, client_id nulls last) as recent from k)
select cluster_id, count(*) as n_records, cast(sum(stale::int) as bigint) as n_stale,
  first(name order by length(name) desc, trusted) filter (name is not null) as name,
  first(email order by trusted) filter (email is not null) as email, any_value(chosen) as segment,
  arg_min(struct_pack(v := city), held * -1000000000 + trusted).v as city, arg_min(struct_pack(v := nation_id), held * -1000000000 + trusted).v as nation_id,
  first(cents order by others, recent) filter (cents is not null) as balance_cents,
  first(client_id order by length(name) desc, trusted) filter (name is not null) as name_from,
  first(client_id order by trusted) filter (email is not null) as email_from, any_value(segment_from) as segment_from,
  first(client_id order by others, recent) filter (cents is not null) as balance_from,
  first(client_id order by held desc, trusted) filter (held > 0) as address_from
from o group by cluster_id
"""
