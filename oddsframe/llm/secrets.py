"""Secret scans: base patterns, and credential formats inferred by state merging.

The base patterns find assignments, access keys and hexadecimal keys. Their values over all documents, VALUES of each kind by
hash, are the labelled credentials: for each kind a prefix tree of symbol classes is built, and statistically compatible states (Hoeffding's bound
on stop and step frequencies, checked down the tree) are merged into a probabilistic automaton. Every candidate - the value of a base span, or a run of
SHORTEST credential characters or more outside them - is scored by its log-likelihood under the automata against ordinary runs. Base spans stay whatever
their score; other runs whose ratio reaches the threshold of their length are added as spans of kind `format`. The threshold is that of held-out credentials of
about the length, and at least the log odds of ordinary runs to credentials in the documents, which short runs seldom outweigh.

Defined results: a null text counts as empty; spans are in code points, end exclusive, ordered by start, then assign, access, hex,
format; ends of whole matches, not values. Repeated rows come out as they are; an empty table gives an empty result; other columns are ignored.

A kind has an automaton from its first labelled value on. With few values nothing speaks against a merge, so their automaton is one of symbol frequencies, which the counts'
prior keeps apart from 0 and 1. Thresholds come from values that the automaton hasn't seen (by folds) and are lower by their standard error; a single value has none, so there the
least ratio and the log odds of ordinary runs decide. Without any labelled value nothing is scored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.common import bounded_batches, materialise

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Runs are matched whole, so the least lengths may stand in the patterns.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
SHORTEST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: Parameters of the fit: values a kind and ordinary runs that the formats are learned from, those of least hash among all documents; longer ones are scored, but not learned from.
VALUES, LONGEST_LEARNED = 400, 256
#: Of the Hoeffding bound; log-likelihood ratio a symbol that a candidate needs at least; folds for the ratios of values that an automaton hasn't seen.
ALPHA, LEAST_RATIO, FOLDS = 0.05, 0.25, 5
#: Lengths from which thresholds are taken apart; decisions on runs that a task remembers.
LENGTHS, REMEMBERED = (SHORTEST, 10, 15, 20), 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def classes(value: str) -> str:
    """Symbol classes of a value: digits 0, a-f h, other small letters z, capitals A, the rest as they are."""
    return value.translate(_CLASSES)


_CLASSES = {ord(c): k for k, cs in (("0", "0123456789"), ("h", "abcdef"), ("z", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in cs}


class Automaton:
    """A probabilistic automaton from strings, by merging compatible states of their prefix tree in breadth-first order.

    `seen` counts how often a state was reached, `stop` how often a string ended there, `flow` how often each symbol led on; so seen = stop + all flows,
    before and after each merge."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.seen, self.stop, self.step, self.flow = [0], [0], [{}], [Counter()]
        for s in strings:
            at = 0
            self.seen[0] += 1
            for c in s:
                self.flow[at][c] += 1
                if c not in self.step[at]:
                    self.step[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.stop.append(0)
                    self.step.append({})
                    self.flow.append(Counter())
                at = self.step[at][c]
                self.seen[at] += 1
            self.stop[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.red = [0]
        blue = deque((0, c) for c in sorted(self.step[0]))  # edges from kept states to the roots of what is a tree still
        while blue:
            parent, c = blue.popleft()
            s = self.step[parent][c]
            if s in self.red:
                continue
            same = next((r for r in self.red if self.alike(r, s)), None)
            if same is None:
                self.red.append(s)
                blue.extend((s, d) for d in sorted(self.step[s]))
                continue
            self.step[parent][c] = same
            known = {r: set(self.step[r]) for r in self.red}
            self._fold(same, s)
            blue.extend((r, d) for r in self.red for d in sorted(set(self.step[r]) - known[r]))

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Hoeffding's bound on two frequencies."""
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def alike(self, a: int, b: int) -> bool:
        """If the stop and step frequencies of a and of the tree b are compatible, and so on down the tree."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.seen[x], self.seen[y]
            if self._differ(self.stop[x], n, self.stop[y], m) or any(self._differ(self.flow[x][c], n, self.flow[y][c], m) for c in self.step[x].keys() | self.step[y].keys()):
                return False
            todo += [(self.step[x][c], t) for c, t in self.step[y].items() if c in self.step[x]]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the tree's counts to a state and below."""
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.seen[x] += self.seen[y]
            self.stop[x] += self.stop[y]
            for c, t in self.step[y].items():
                self.flow[x][c] += self.flow[y][c]
                if c in self.step[x]:
                    todo.append((self.step[x][c], t))
                else:
                    self.step[x][c] = t

    def log_likelihood(self, s: str) -> float:
        x, out = 0, 0.0
        for c in s:
            if c not in self.step[x]:
                return -math.inf
            out += math.log((self.flow[x][c] + 0.01) / (self.seen[x] + 1.0))
            x = self.step[x][c]
        return out + math.log((self.stop[x] + 0.01) / (self.seen[x] + 1.0))


class Background:
    """Ordinary runs: independent symbol classes and a geometric length."""

    def __init__(self, strings: list[str]):
        n = Counter(c for s in strings for c in s)
        total = sum(n.values())
        self.log = {c: math.log((n[c] + 0.5) / (total + 8)) for c in n}
        self.rare = math.log(0.5 / (total + 8))
        mean = max(1.5, total / max(1, len(strings)))
        self.go, self.halt = math.log(1 - 1 / mean), math.log(1 / mean)

    def log_likelihood(self, s: str) -> float:
        return sum(self.log.get(c, self.rare) for c in s) + len(s) * self.go + self.halt


def unseen_ratios(values: list[str], ordinary: Background) -> list[tuple[int, float]]:
    """(length, ratio a symbol) of each value under the automaton of the other folds, where that makes it at all; none of a single value."""
    folds = min(FOLDS, len(values))
    out = []
    for k in range(folds if folds > 1 else 0):
        others = [Automaton([v for i, v in enumerate(values) if i % folds != k])]
        out += [(len(v), x) for v in values[k::folds] if math.isfinite(x := ratio(v, others, ordinary))]
    return out


def thresholds(ratios: list[tuple[int, float]]) -> list[float]:
    """What a run needs a symbol, by length: the second percentile of unseen values' ratios (of all lengths where a length has none), lower by their standard error; LEAST_RATIO at least."""
    out = []
    for low, high in zip(LENGTHS, (*LENGTHS[1:], math.inf), strict=True):
        seen = [x for m, x in ratios if low <= m < high] or [x for _, x in ratios]
        out.append(max(LEAST_RATIO, float(np.percentile(seen, 2) - np.std(seen) / math.sqrt(len(seen))) if seen else LEAST_RATIO))
    return out


def train(docs: DataFrame, n_values: int = VALUES, longest: int = LONGEST_LEARNED) -> tuple[list[Automaton], Background, list[tuple[float, float]]] | None:
    """Automata, background and thresholds from the values of all documents, n_values a kind, and as many ordinary runs of whole texts; none without any value."""
    from pyspark import TaskContext

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, int]] = defaultdict(dict)
        bound: dict[str, int] = {}
        n_ordinary = n_base = 0

        def keep(kind: str, value: str) -> None:
            h, values = xxhash.xxh64_intdigest(value, 0), kept[kind]
            if h <= bound.get(kind, h):
                values[value] = h
                if len(values) > 4 * n_values:
                    best = heapq.nsmallest(n_values, values.items(), key=lambda x: (x[1], x[0]))
                    kept[kind], bound[kind] = dict(best), best[-1][1]

        for b in batches:
            for t in b.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                n_base += len(base)
                for start, kind, end in base:
                    m = ASSIGN.match(text, start) if kind == 0 else None
                    value = m[2] if m else text[start:end]
                    if len(value) <= longest:
                        keep(KINDS[kind], value)
                runs = [m[0] for m in CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base)] if base else CANDIDATE.findall(text)
                n_ordinary += len(runs)
                for w in set(runs):
                    if len(w) <= longest:
                        keep("ordinary", w)
        rows = [(kind, v, f"{h:016x}") for kind, values in kept.items() for v, h in heapq.nsmallest(n_values, values.items(), key=lambda x: (x[1], x[0]))]
        part = str(TaskContext.get().partitionId())
        cols = list(zip(*rows, ("count ordinary", str(n_ordinary), part), ("count base", str(n_base), part), strict=True))
        yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["kind", "value", "hash"])

    found = materialise(docs.select("text").mapInArrow(gather, "kind string, value string, hash string").distinct(), "credentials")
    rows = [r for kind in (*KINDS[:3], "ordinary") for r in found.where(F.col("kind") == kind).orderBy("hash", "value").limit(n_values).collect()]
    by_kind = defaultdict(list)
    for r in rows:
        by_kind[r.kind].append(classes(r.value))
    ordinary = Background(by_kind["ordinary"] or ["z" * 12])
    kinds = [by_kind[k] for k in KINDS[:3] if by_kind[k]]
    if not kinds:
        return None
    counts = {r.kind: r.n for r in found.where("kind like 'count %'").groupBy("kind").agg(F.sum(F.col("value").cast("long")).alias("n")).collect()}
    odds = math.log(max(1, counts["count ordinary"]) / max(1, counts["count base"]))
    least = thresholds([r for values in kinds for r in unseen_ratios(values, ordinary)])
    return [Automaton(values) for values in kinds], ordinary, [(x, odds) for x in least]


def ratio(symbols: str, automata: list[Automaton], ordinary: Background) -> float:
    """The log-likelihood ratio a symbol of the likeliest format."""
    return (max(a.log_likelihood(symbols) for a in automata) - ordinary.log_likelihood(symbols)) / len(symbols)


def judged(run: str, model) -> tuple[float, bool]:
    """The run's ratio, and if it reaches the threshold of its length."""
    automata, ordinary, least = model
    a_symbol, in_all = least[sum(len(run) >= n for n in LENGTHS[1:])]
    x = ratio(classes(run), automata, ordinary)
    return x, x >= max(a_symbol, in_all / len(run))


def scored_spans(text: str, model, known: dict[str, tuple[float, bool]] | None = None) -> tuple[list[tuple[int, int, int, float | None]], int]:
    """All spans (start, kind, end, ratio), the base ones and those that the automata add, and how many candidates were scored.

    Every candidate is scored: the values of base spans, and each run outside them. Without automata there is no ratio. known: scores of runs, filled here."""
    base = base_spans(text)
    if model is None:
        return [(*b, None) for b in base], 0
    known = {} if known is None else known

    def score(v: str) -> tuple[float, bool]:
        if (found := known.get(v)) is None:
            found = judged(v, model)
            if len(v) <= 64:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[v] = found
        return found

    out = [(s, k, e, score(ASSIGN.match(text, s)[2] if k == 0 else text[s:e])[0]) for s, k, e in base]
    n = len(base)
    for m in CANDIDATE.finditer(text):
        if base and any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        n += 1
        x, credible = score(m[0])
        if credible:
            out.append((m.start(), 3, m.end(), x))
    return sorted(out, key=lambda o: o[:3]), n


def find_secrets(docs: DataFrame, n_values: int = VALUES, longest: int = LONGEST_LEARNED) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), scores (of the spans: the log-likelihood
    ratio a symbol, three digits; -inf for what no format makes, empty without any labelled value), n_scored (candidates scored)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = rows.sparkSession.sparkContext.broadcast(train(rows, n_values, longest))
    join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, bool]] = {}
        for b in batches:
            out = []
            for t in b.column("text"):
                spans, n = scored_spans(t.as_py() or "", model.value, known)
                base = [s for s in spans if s[1] < 3]
                scores = ",".join("" if s[3] is None else f"{s[3]:.3f}" for s in spans)
                out.append((*(sum(s[1] == x for s in base) for x in range(3)), hashlib.sha256(join(base).encode()).hexdigest(), join(spans), scores, n))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64()]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *NAMES])

    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string, n_scored long")


NAMES = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores", "n_scored")


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with each span of the text replaced by the mask; overlapping spans are one."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(F.col("text").cast("string").alias("text"))))

    @F.pandas_udf("string")
    def masked(texts):
        known: dict[str, tuple[float, bool]] = {}

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for s, _, e, _ in scored_spans(text, model.value, known)[0]:
                if s >= at:
                    out += [text[at:s], mask]
                at = max(at, e)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", masked(F.col("text").cast("string")))
