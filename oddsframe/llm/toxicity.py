"""Toxicity by maximum-scoring segments.

Words, and stems of their first STEMS letters, get log-odds of toxic against clean labels, smoothed by an informative Dirichlet prior and less one standard
error. A token of a text is a word in its likeliest form, the word itself or one of its stems; where no form's log-odds are sure it scores DRIFT. (Inflected words are
new too often for one form alone; the README has figures.) A linear-time scan (all maximal scoring subsequences) finds every
passage whose score can't be raised by shortening or lengthening it.

Passages are aggregated by extreme-value calibration. Among clean texts the best passage of n tokens follows P(S >= s) = 1 - exp(-K n exp(-decay s)); both
constants are fitted by maximum likelihood on clean texts that the token scores weren't learned from, texts without any passage as
censored. The r best passages of a text together are as significant as their sum statistic says, and the text as its best r. The significance p becomes the
probability of a toxic text as one side of a mixture: x = -log p is exponential among clean texts, since p is uniform there, and log(1 + x) is normal among
toxic ones, with the median and the median deviation of the calibration texts; the mixture's weight is the share of toxic labels.

Scores are learned from labelled texts, TRAIN_DOCS at most, of the rows that may be learned from; of near copies (all SKETCH min-wise
hashes of five-word shingles equal) one text counts, a toxic one if there is any. The model keeps MAX_TOKENS tokens at most, of the largest log-odds. Every text is scored whole.

Defined results: an empty or null text scores as one without passages; labels that disagree count as toxic if any does; without
labels of both kinds each score is 0. Null doc_ids are held out. Repeated rows come out as they are; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.common import filter_texts, fraction_of, materialise

TRAIN_DOCS, MAX_TOKENS = 30_000, 100_000
#: Weight of the prior in documents; standard errors taken off the log-odds, and what must be left of them for a token to have a score (the
#: log-odds less one error); what other tokens score; letters of stems.
PRIOR, ERRORS, LEAST, DRIFT, STEMS = 20.0, 2.0, 1.2, -0.15, (6, 5, 4)
#: Prediction is 1 from this score.
THRESHOLD = 0.3
#: Share of learning texts that the calibration is fitted on; passages that a sum statistic takes together, at most.
CALIBRATION, SUMMED = 0.25, 12
#: Least spread of the toxic side: few calibration texts don't make it narrow.
SPREAD = 0.35
#: Min-wise hashes that find near copies among learning texts.
SKETCH = 3
_TOKEN = re.compile(r"[^\W\d_]+")


def sketch_of(text: str) -> list[int]:
    """SKETCH min-wise hashes of the five-word shingles."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    x = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))], dtype=np.uint64)
    return [int((x * np.uint64(m)).min().view(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:SKETCH]]


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def token_scores(learn: DataFrame) -> dict[str, float]:
    """Log-odds of words and stems (marked by a hyphen) from rows (text, toxic). A word counts once a text; a stem once a word, by the word's
    share of toxic texts, so that no frequent word alone makes its stem toxic."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                if found := set(tokens_of(text.as_py() or "")):
                    yield pa.record_batch([pa.array(list(found), pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["token", "toxic"])

    tokens = materialise(learn.select("text", "toxic").mapInArrow(spread, "token string, toxic int").groupBy("token").agg(F.sum("toxic").cast("double").alias("y"), F.count("*").alias("n")), "tokens")
    marks = F.explode(F.array(*[F.when(F.length("token") > k, F.concat(F.substring("token", 1, k), F.lit("-"))) for k in STEMS]))
    prefixes = tokens.select(marks.alias("token"), (F.col("y") / F.col("n")).alias("y")).where("token is not null").groupBy("token").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    out: dict[str, float] = {}
    for table, all_of in ((tokens, learn.agg(F.sum("toxic").cast("double").alias("y"), F.count("*").alias("n"))), (prefixes, tokens.agg(F.sum(F.col("y") / F.col("n")).alias("y"), F.count("*").alias("n")))):
        bad, docs = all_of.select(F.coalesce("y", F.lit(0.0)), "n").first()
        if not 0 < bad < docs:
            return out
        alpha = 1 + F.col("n") * PRIOR / docs
        y1, y0 = F.col("y") + alpha * bad / docs, F.col("n") - F.col("y") + alpha * (docs - bad) / docs
        delta = F.log(y1 / (bad + PRIOR + 1 - F.least(y1, F.lit(bad)))) - F.log(y0 / (docs - bad + PRIOR + 1 - F.least(y0, F.lit(docs - bad))))
        error = F.sqrt(1 / y1 + 1 / y0)
        kept = table.withColumns({"sure": delta - ERRORS * error, "score": delta - error}).where(F.col("sure") >= LEAST).orderBy(F.col("sure").desc(), "token").limit(MAX_TOKENS)
        out |= {r.token: r.score for r in kept.select("token", "score").collect()}
    return out


def score_tokens(words: list[str], scores: dict[str, float]) -> np.ndarray:
    get, cache = scores.get, {}
    for w in set(words):
        cache[w] = max(get(w, DRIFT), *(get(w[:n] + "-", DRIFT) for n in STEMS if len(w) > n), DRIFT)
    return np.array([cache[w] for w in words])


def maximal_segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of x, by the linear-time list algorithm."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    # (start, end, sum before, sum up to the end); the link leads to the last segment with a smaller sum before
    found: list[tuple[int, int, float, float]] = []
    links: list[int] = []
    for i in np.nonzero(x > 0)[0].tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = links[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                links.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
            del links[j:]
    return [(s, e, r - le) for s, e, le, r in found]


def extreme_value_fit(lengths: np.ndarray, best: np.ndarray, least: float) -> tuple[float, float]:
    """(decay, K) of the best passages of clean texts, by maximum likelihood. best: 0 for a text without a passage, which is below `least`."""
    n, s, seen = np.maximum(lengths, 1.0), np.maximum(best, least), best > 0
    mass = lambda d: n * np.exp(-d * (s - least))  # noqa: E731  (relative to exp(-d * least), which cancels)
    slope = lambda d: seen.sum() / d - s[seen].sum() + seen.sum() * float((s * mass(d)).sum() / mass(d).sum())
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, float(seen.sum() / (n * np.exp(-low * s)).sum())


def significance(passages: list[float], n: int, decay: float, K: float) -> float:
    """How probable passages as good as these together are by chance in n tokens: the least over the r best, by the sum statistic."""
    out, total = 1.0, 0.0
    for r, s in enumerate(sorted(passages, reverse=True)[:SUMMED], 1):
        total += decay * s - math.log(K * max(n, 1))
        if total <= r:
            break
        # P(sum of r normalised scores >= total), and 2^r for the choice of r
        p = math.exp(min(0.0, -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r))) * (1 if r == 1 else 2**r)
        out = min(out, -math.expm1(-p))
    return max(out, 1e-300)


class Model:
    """Token scores, the constants of extreme values, and of the mixture: middle and spread of log(1 - log p) among toxic texts, and their log odds."""

    def __init__(self, scores: dict[str, float], decay: float, K: float, middle: float, spread: float, odds: float):
        self.scores, self.decay, self.K, self.middle, self.spread, self.odds = scores, decay, K, middle, spread, odds

    def significance(self, text: str | None) -> float:
        x = score_tokens(tokens_of(text or ""), self.scores)
        return significance([s for _, _, s in maximal_segments(x)], len(x), self.decay, self.K) if len(x) else 1.0

    def score(self, text: str | None) -> float:
        if not self.scores:
            return 0.0
        x = -math.log(self.significance(text))
        y = min(math.log1p(x), self.middle)  # a text beyond the middle is no less toxic for it
        logit = self.odds - (y - self.middle) ** 2 / (2 * self.spread**2) - y - math.log(self.spread * math.sqrt(2 * math.pi)) + x
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, expected number by chance) of the significant passages, in code points."""
        spans = [m.span() for m in _TOKEN.finditer(text.lower())] if len(text.lower()) == len(text) else [m.span() for m in _TOKEN.finditer(text)]
        x = score_tokens(tokens_of(text), self.scores)
        found = [(spans[s][0], spans[e - 1][1], self.K * len(x) * math.exp(-self.decay * v)) for s, e, v in maximal_segments(x)] if len(spans) == len(x) else []
        return [p for p in found if p[2] < 1]


def fit(learn: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """From rows (text, toxic)."""
    n = learn.count()
    sample = learn.where(fraction_of(F.col("text")) < min(1.0, train_docs / max(n, 1)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [sketch_of(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch([b.column("text"), b.column("toxic"), *(pa.array([x[i] for x in low], pa.int64()) for i in range(SKETCH))], names=["text", "toxic", *(f"h{i}" for i in range(SKETCH))])

    rows = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(sketch, "text string, toxic int, " + ", ".join(f"h{i} long" for i in range(SKETCH)))
    one = rows.groupBy(*[f"h{i}" for i in range(SKETCH)]).agg(F.max(F.struct("toxic", "text")).alias("s"))
    rows = materialise(one.select(F.xxhash64("s.text").alias("h"), "s.text", "s.toxic"), "learn")
    apart = fraction_of(F.col("h"), F.lit("calibrate")) < CALIBRATION
    scores = token_scores(rows.where(~apart))
    if not scores:
        return Model({}, 1.0, 1.0, 1.0, 2.0, 0.0)
    shared = rows.sparkSession.sparkContext.broadcast(scores)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [score_tokens(tokens_of(t.as_py() or ""), shared.value) for t in b.column("text")]
            best = [sorted((s for _, _, s in maximal_segments(y)), reverse=True)[:SUMMED] for y in x]
            yield pa.record_batch([b.column("toxic"), pa.array([len(y) for y in x], pa.int64()), pa.array(best, pa.list_(pa.float64()))], names=["toxic", "n", "best"])

    points = rows.where(apart).select("text", "toxic").mapInArrow(measure, "toxic int, n long, best array<double>").collect()  # TRAIN_DOCS * CALIBRATION rows at most, about
    clean, toxic = ([p for p in points if p.toxic == t] for t in (0, 1))
    # one more clean text, of the usual length, that has the highest score of a token: no significance is beyond what so many clean texts can show
    lengths = np.array([p.n for p in clean] + [float(np.median([p.n for p in clean] or [100]))])
    best = np.array([p.best[0] if p.best else 0.0 for p in clean] + [max(scores.values())])
    decay, K = extreme_value_fit(lengths, best, min(scores.values()))
    y = np.array([math.log1p(-math.log(significance(p.best, p.n, decay, K))) for p in toxic] or [2.0])
    middle = max(1.0, float(np.median(y)))
    spread = max(SPREAD, 1.4826 * float(np.median(np.abs(y - middle))))
    return Model(scores, decay, K, middle, spread, math.log((len(toxic) + 1) / (len(clean) + 1)))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the rows that may be learned from: crc32 of doc_id as text mod 4 isn't 2."""
    may = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    toxic = labels.where(may & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    return docs.where(may).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(toxic, "doc_id").select("text", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, n_passages."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_texts(docs, labels), train_docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = [t.as_py() or "" for t in b.column("text")]
            score = [m.score(t) for t in texts]
            passages = [len(m.passages(t)) if s >= THRESHOLD else 0 for t, s in zip(texts, score, strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array(passages, pa.int32())], names=["doc_id", "held_out", "score", "predicted", "n_passages"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages int")


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """docs without those that are predicted toxic; all columns stay. Null texts are kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_texts(docs, labels), train_docs))

    return filter_texts(docs, lambda: lambda texts: [model.value.score(t) < THRESHOLD for t in texts])
