"""URL filtering: explicit rules, and gradient-boosted trees on lexical features for the rest. DataFrame functions only.

The URLs that a rule decides are the labelled ones (block: 1, allow: 0). Their features - length, depth, digit ratio, entropy,
parameter counts, suffix statistics and the like - are cut into bins at quantiles; labelled URLs are aggregated to distinct bin vectors with counts, over all
rows. The shares of blocked URLs by suffix and by section are taken out of fold. Each tree of the boosted ensemble is grown level by level from sums of gradients by (leaf, feature, bin), aggregated on
the executors; the driver sees LEAVES x features x bins sums and chooses the splits. A URL that no rule fits is
blocked if its predicted probability is over one half.

Defined results: host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path follows up to `?`, `#` or
the end; both are empty for a null url or one without `://`. Such a URL and any other get a verdict from the method. Without labelled URLs
of both kinds the ensemble is empty and the verdict is the more frequent label, allow if there is none. Trees end early where no split gains LEAST_GAIN, so few labels
give the share of blocked URLs rather than chance patterns. Repeated rows come out as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.common import materialise, parts_for, spread_join

#: The contract's rules: verdict, host with path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Of the ensemble, and folds of the labelled URLs.
TREES, DEPTH, RATE, RIDGE, FOLDS = 16, 3, 0.4, 1.0, 5
#: Gain that a split needs: the best of some 200 splits without any meaning gains about as much by chance.
LEAST_GAIN = 4.0
#: Distinct vectors a task of the fit.
VECTORS_A_TASK = 20_000
#: Bins of a feature, at most: it is cut at quantiles of the labelled URLs.
BINS = 16
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "params", "entropy", "host_entropy", "page_number", "suffix_rate", "section_rate")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with the features that depend on the URL alone, and the keys of the two rates."""
    url, digits = F.coalesce("url", F.lit("")), lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return rows.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": digits(url) / F.greatest(F.length(url), F.lit(1)),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
        "params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "entropy": _entropy(url), "host_entropy": _entropy(F.col("host")),
        "page_number": F.coalesce(F.expr("try_cast(regexp_extract(path, '/([0-9]{1,9})[^/]*$', 1) as int)"), F.lit(-1)),
        "suffix": F.element_at(F.split("host", r"\."), -1),
        "section": F.regexp_extract("path", "^/([^/]*)", 1),
    })


def cuts_of(rows: DataFrame) -> dict[str, list[float]]:
    """Where each feature is cut: its distinct quantiles but the last, over all rows."""
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 1000).alias(f) for f in FEATURES]).first()
    return {f: sorted({round(x, 9) for x in found[f] or []}) for f in FEATURES}


def _bins(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Each feature as its bin: how many cuts it is over."""
    cut = {f: reduce(lambda x, y: x + y, [(F.col(f) > c).cast("int") for c in of], F.lit(0)) for f, of in cuts.items()}
    return rows.withColumns({f"b_{f}": F.coalesce(c, F.lit(0)) for f, c in cut.items()})


def _counts(labelled: DataFrame, key: str) -> DataFrame:
    """By key: labelled URLs and blocked ones (n, y), and the same by fold (maps)."""
    folds = labelled.groupBy(key, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("fold", c)))  # noqa: E731  (FOLDS entries)
    return folds.groupBy(key).agg(F.sum("n").alias(f"{key}_n"), F.sum("y").alias(f"{key}_y"), entries("n").alias(f"{key}_ns"), entries("y").alias(f"{key}_ys"))


def with_rates(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """rows with the smoothed share of blocked URLs by each key. A labelled URL's own fold is left out, so that no label speaks for itself."""
    for key, table in tables.items():
        rows = spread_join(rows, table, key, "left")
        own = lambda c: F.when(F.col("label").isNotNull(), F.coalesce(F.try_element_at(F.col(c), F.col("fold")), F.lit(0))).otherwise(0)
        n, y = (F.coalesce(F.col(f"{key}_{c}"), F.lit(0)) - F.coalesce(own(f"{key}_{c}s"), F.lit(0)) for c in "ny")
        rows = rows.withColumn(f"{key}_rate", (y + 1.0) / (n + 2.0)).drop(*[f"{key}_{c}" for c in ("n", "y", "ns", "ys")])
    return rows


def _tree_value(tree, bins: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, low, high = tree
    return F.when(bins[feature] <= cut, _tree_value(low, bins)).otherwise(_tree_value(high, bins))


def _leaf_id(tree, bins: dict[str, Column], at: int = 1) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(at)
    feature, cut, low, high = tree
    return F.when(bins[feature] <= cut, _leaf_id(low, bins, 2 * at)).otherwise(_leaf_id(high, bins, 2 * at + 1))


def _leaves(tree, at: int = 1) -> list[int]:
    return [at] if not isinstance(tree, tuple) else _leaves(tree[2], 2 * at) + _leaves(tree[3], 2 * at + 1)


def _grown(tree, new: dict[int, object], at: int = 1):
    if not isinstance(tree, tuple):
        return new.get(at, tree)
    return (tree[0], tree[1], _grown(tree[2], new, 2 * at), _grown(tree[3], new, 2 * at + 1))


def margin_of(model: dict) -> Column:
    """The log-odds of block, from bin columns."""
    bins = {f: F.col(f"b_{f}") for f in FEATURES}
    return reduce(lambda x, y: x + y, [_tree_value(t, bins) for t in model["trees"]], F.lit(float(model["base"])))


def fit(vectors: DataFrame) -> dict:
    """Boosted trees on logistic loss from distinct bin vectors (b_<feature>, n, positive)."""
    n, positive = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("positive"), F.lit(0))).first()
    if not 0 < positive < n:
        return {"base": 5.0 if n and positive else -5.0, "trees": []}
    model = {"base": math.log(positive / (n - positive)), "trees": []}
    bins = {f: F.col(f"b_{f}") for f in FEATURES}
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-margin_of(model)))
        graded = vectors.withColumns({"g": F.col("positive") - F.col("n") * p, "h": F.col("n") * p * (1 - p)})
        tree: object = 0.0
        for _ in range(DEPTH):
            long = graded.select(_leaf_id(tree, bins).alias("leaf"), "g", "h", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), bins[f].alias("bin")) for f in FEATURES])).alias("x"))
            sums = long.groupBy("leaf", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            new = {leaf: _split([r for r in sums if r.leaf == leaf]) for leaf in {r.leaf for r in sums}}
            tree = _grown(tree, new)
            if not any(isinstance(x, tuple) for x in new.values()):
                break  # no leaf has a split that gains
        if not isinstance(tree, tuple):
            break  # nor would the next tree have one
        model["trees"].append(tree)
    return model


def _split(sums: list):
    """The best split of a leaf by gain, its sides valued by a ridge step; a value where nothing is gained."""
    first = [r for r in sums if r.f == "url_length"]
    G, H = sum(r.g for r in first), sum(r.h for r in first)
    score = lambda g, h: g * g / (h + RIDGE)
    step = lambda g, h: RATE * g / (h + RIDGE)
    best, gain = step(G, H), LEAST_GAIN
    for f in FEATURES:
        g = h = 0.0
        for r in sorted((r for r in sums if r.f == f), key=lambda r: r.bin)[:-1]:
            g, h = g + r.g, h + r.h
            if (x := score(g, h) + score(G - g, H - h) - score(G, H)) > gain:
                gain, best = x, (f, r.bin, step(g, h), step(G - g, H - h))
    return best


def featured(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """A table of the pages' URLs: host, path, lexical features, the rule, and for those that a rule decides label (1: block) and fold."""
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = lexical(rows).withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("by_rule").isNotNull(), (F.col("by_rule.verdict") == "block").cast("int"))
    return materialise(rows.withColumns({"label": label, "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")}), "urls")


class Ensemble:
    """Rates, cuts and trees from the labelled URLs of a featured table."""

    def __init__(self, labelled: DataFrame):
        self.rates = {k: materialise(_counts(labelled, k), k) for k in ("suffix", "section")}
        rated = materialise(with_rates(labelled, self.rates), "labelled")
        self.cuts = cuts_of(rated)
        vectors = _bins(rated, self.cuts).groupBy(*[f"b_{f}" for f in FEATURES]).agg(F.count("*").alias("n"), F.sum("label").alias("positive"))
        counted = materialise(vectors, "vectors")
        self.model = fit(counted.coalesce(parts_for(counted.count(), VECTORS_A_TASK)))

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with the probability p of block."""
        return _bins(with_rates(rows, self.rates), self.cuts).withColumn("p", 1 / (1 + F.exp(-margin_of(self.model))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score (probability of block; 0 or 1 where a rule decides)."""
    rows = featured(pages, rules)
    scored = Ensemble(rows.where("label is not null")).score(rows)
    score = F.coalesce(F.col("label").cast("double"), F.col("p"))
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("p") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))


def held_out_quality(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row: how the ensemble judges the labelled URLs of fold 0 when it is fitted on the others: n, accuracy, log_loss, and base_loss, that of the
    share of blocked URLs alone."""
    labelled = featured(pages, rules).where("label is not null")
    held = labelled.where("fold = 0")
    scored = Ensemble(labelled.where("fold <> 0")).score(held.withColumn("truth", F.col("label")).withColumn("label", F.lit(None).cast("int")))
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = lambda q: -F.avg(F.when(F.col("truth") == 1, F.log(q)).otherwise(F.log(1 - q)))
    share = labelled.where("fold <> 0").agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias("share"))
    return scored.join(F.broadcast(share)).agg(F.count("*").alias("n"), F.avg(((F.col("p") > 0.5).cast("int") == F.col("truth")).cast("double")).alias("accuracy"), loss(p).alias("log_loss"), loss(F.col("share")).alias("base_loss"))


def allowed_pages(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """The pages whose URL isn't blocked."""
    return pages.join(judge_urls(pages, rules).where("verdict = 'allow'").select("page_id").distinct(), "page_id", "left_semi").select(*pages.columns)
