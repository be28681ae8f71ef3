"""Research categories from tag slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order of precedence and the tag slugs of each.
DEFAULT_CATEGORIES: list[tuple[str, list[str]]] = [
    ("crypto_updown", ["up-or-down"]),
    ("crypto", ["crypto", "crypto-prices", "bitcoin", "ethereum", "solana", "xrp", "dogecoin", "hype", "bnb", "zcash"]),
    ("weather", ["weather", "daily-temperature", "highest-temperature", "lowest-temperature", "climate"]),
    ("mentions", ["mention-markets", "mentions", "tweets-markets", "elon-tweets"]),
    ("esports", ["esports", "counter-strike-2", "league-of-legends", "dota-2", "valorant", "cs2", "lol", "rainbow-six-siege", "honor-of-kings", "mobile-legends-bang-bang", "call-of-duty", "overwatch", "starcraft-2", "rocket-league"]),
    ("sports", ["sports", "games", "soccer", "tennis", "basketball", "baseball", "hockey", "cricket", "nba", "nfl", "mlb", "nhl", "ncaa", "ufc", "golf", "f1", "formula1", "table-tennis", "darts", "rugby"]),
    ("finance", ["finance", "equities", "stocks", "indicies", "commodities", "forex", "earnings", "stock-prices", "etf", "finance-updown", "pyth-finance", "business"]),
    ("economics", ["economy", "fed", "fed-rates", "inflation", "economic-policy", "jobs", "gdp", "interest-rates"]),
    ("tech", ["tech", "ai", "big-tech", "openai", "science", "space"]),
    ("culture", ["pop-culture", "movies", "music", "awards", "celebrities", "youtube", "netflix", "top-netflix", "tv", "culture"]),
    ("geopolitics", ["geopolitics", "world", "middle-east", "iran", "israel", "ukraine", "russia", "china", "gaza", "war"]),
    ("politics", ["politics", "elections", "trump", "trump-presidency", "global-elections", "us-presidential-election", "primaries", "primary-elections"]),
]


def categorize(tags: Column, mapping: list[tuple[str, list[str]]] | None = None) -> Column:
    """The first category that has any of the tags (array of slugs, any case), else other."""
    low = F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull()), F.lower)
    out = None
    for name, slugs in DEFAULT_CATEGORIES if mapping is None else mapping:
        hit = F.arrays_overlap(low, F.array(*[F.lit(s) for s in slugs]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit("other") if out is None else out.otherwise("other")
