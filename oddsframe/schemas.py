"""Declared schemas of stored tables, as DDL that needs no session."""

MARKETS = (
    "event_id string, event_slug string, event_title string, series_slug string, category string, neg_risk boolean, market_id string, "
    "condition_id string, question string, group_item_title string, outcome0 string, outcome1 string, n_outcomes int, token0 string, "
    "token1 string, created_ts timestamp, start_ts timestamp, end_ts timestamp, closed_ts timestamp, uma_end_ts timestamp, closed boolean, "
    "outcome_prices string, winner int, disputed boolean, archived_copy boolean, volume double, fees_enabled boolean, fee_rate double, fee_exponent double"
)
PRICES = "event_id string, market_id string, ts timestamp, p double"
TRADES = "event_id string, market_id string, ts timestamp, side string, outcome_index int, price double, size double, tx string, truncated boolean"
#: A raw event of the market API; fields that are lists in a string stay strings here.
RAW_EVENT = (
    "id string, slug string, title string, seriesSlug string, startDate string, endDate string, negRisk boolean, enableNegRisk boolean, tags array<struct<slug:string>>, "
    "markets array<struct<id:string,conditionId:string,question:string,groupItemTitle:string,outcomes:string,outcomePrices:string,clobTokenIds:string,"
    "closed:boolean,createdAt:string,startDate:string,endDate:string,closedTime:string,umaEndDate:string,volumeNum:double,feesEnabled:boolean,"
    "feeSchedule:struct<exponent:double,rate:double,takerOnly:boolean>,umaResolutionStatuses:string>>"
)


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [c.split()[0] for c in ddl.split(", ")]
