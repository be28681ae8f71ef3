"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary (a sentencepiece model; its path is a parameter). The probability of a word
is the sum over all its segmentations into pieces, by the forward algorithm; of a text, the product over its words. Piece
probabilities come from expectation maximisation on word counts of a sample of labelled texts of at most TRAIN_DOCS rows a language;
the expected counts are summed on the executors, and the driver gets vocabulary x languages numbers.

A text is scored whole. Distinct words of an Arrow batch are scored together, grouped by length, and kept for later batches of
the worker (at most CACHE words).

The language is that of the largest posterior of the whole text under equal priors. That posterior is one to many digits for any text of some length, so the score is
the mean over the text's words of the language's posterior given the word alone, with the weight of evidence under which the learning words' languages are
likeliest: about the share of its words that speak for the language. A text of two languages scores low.

Defined results: `und` with score 0 for a null text, or one without a letter; otherwise the language (ties: the least name) and its score. Without labelled texts each text is `und`. A null doc_id is held out: it never is
learned from. Repeated rows come out as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.common import fraction_of, materialise

#: Labelled texts a language that the model is fitted on, at most (about; chosen by a hash).
TRAIN_DOCS = 1500
ROUNDS = 3
#: Weight of the pooled distribution in a language's probabilities, in pieces.
SMOOTHING = 200.0
CACHE = 400_000
#: Letters of words that are scored together; longer ones are scored one by one, with rescaled sums.
SHORT = 31
#: Weights of a word's evidence that are tried, the best on learning words is taken.
WEIGHTS = tuple(round(0.1 * 1.25**k, 4) for k in range(16))
_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces by id; path: a sentencepiece model (default: the public 32k one)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p: i for i in ordinary if re.fullmatch(r"▁?[^\W\d_]*", p := sp.id_to_piece(i))}  # others are in no word


class Lattice:
    """Forward sums over all segmentations. Of ids, none and unknown are over the vocabulary's: no piece, and a letter that no piece has."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.none = max(pieces.values(), default=0) + 1
        self.unknown = self.none + 1
        self.size = self.none + 2

    def _id(self, part: str) -> int:
        return self.pieces.get(part, self.unknown if len(part) == 1 else self.none)

    def ids(self, words: list[str], n: int) -> dict[tuple[int, int], np.ndarray]:
        """For words of n characters with the mark of a word's start: an array of piece ids for each span."""
        get, out = self.pieces.get, {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                miss = self.unknown if j == i + 1 else self.none
                out[i, j] = np.array([get(w[i:j], miss) for w in words])
        return out

    def log_probs(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log P(word) for each word and language; table: ids x languages."""
        out = np.empty((len(words), table.shape[1]))
        groups = defaultdict(list)
        for k, w in enumerate(words):
            groups[min(len(w), SHORT + 1) + 1].append(k)
        for n, at in groups.items():
            marked = ["▁" + words[k] for k in at]
            if n <= SHORT + 1:
                ids, alpha = self.ids(marked, n), [np.ones((len(at), table.shape[1]))]
                for j in range(1, n + 1):
                    alpha.append(sum(alpha[i] * table[ids[i, j]] for i in range(max(0, j - self.longest), j)))
                out[at] = np.log(np.maximum(alpha[n], 1e-300))
            else:
                for k, w in zip(at, marked, strict=True):
                    out[k] = self._long(w, table)
        return out

    def _long(self, w: str, table: np.ndarray) -> np.ndarray:
        """One long word, with the sums rescaled at each step."""
        last, scale = [np.ones(table.shape[1])], 0.0
        for j in range(1, len(w) + 1):
            now = sum(a * table[self._id(w[j - len(last) + k : j])] for k, a in enumerate(last))
            top = max(float(now.max()), 1e-300)
            scale += np.log(top)
            last = [a / top for a in [*last, now]][-self.longest :]
        return np.log(np.maximum(last[-1], 1e-300)) + scale

    def expected(self, words: list[str], counts: list[float], probs: np.ndarray) -> np.ndarray:
        """Expected piece counts of words under one language's probabilities."""
        total = np.zeros(self.size)
        groups = defaultdict(list)
        for k, w in enumerate(words):
            groups[min(len(w), SHORT + 1) + 1].append(k)
        for n, at in groups.items():
            if n > SHORT + 1:
                for k in at:
                    self._expected_long("▁" + words[k], counts[k], probs, total)
                continue
            ids = self.ids(["▁" + words[k] for k in at], n)
            weight = np.array([counts[k] for k in at])
            alpha, beta = [np.ones(len(at))], {n: np.ones(len(at))}
            for j in range(1, n + 1):
                alpha.append(sum(alpha[i] * probs[ids[i, j]] for i in range(max(0, j - self.longest), j)))
            for i in range(n - 1, -1, -1):
                beta[i] = sum(probs[ids[i, j]] * beta[j] for j in range(i + 1, min(n, i + self.longest) + 1))
            share = weight / np.maximum(alpha[n], 1e-300)
            for (i, j), x in ids.items():
                total += np.bincount(x, weights=alpha[i] * probs[x] * beta[j] * share, minlength=self.size)
        return total

    def _expected_long(self, w: str, count: float, probs: np.ndarray, total: np.ndarray) -> None:
        """Add the expected piece counts of one long word; sums are kept as logarithms."""
        n = len(w)
        log = np.log(np.maximum(probs, 1e-300))
        ids = [[self._id(w[i:j]) for j in range(i + 1, min(n, i + self.longest) + 1)] for i in range(n)]
        parts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # by end: (start, piece)
        for i, row in enumerate(ids):
            for d, x in enumerate(row):
                if x != self.none:
                    parts[i + d + 1].append((i, x))
        ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = back[n] = 0.0
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[i] + log[x] for i, x in parts[j]])
        for i in range(n - 1, -1, -1):
            back[i] = np.logaddexp.reduce([log[x] + back[i + d + 1] for d, x in enumerate(ids[i]) if x != self.none])
        for j in range(1, n + 1):
            for i, x in parts[j]:
                total[x] += count * np.exp(ahead[i] + log[x] + back[j] - ahead[n])


def training_rows(docs: DataFrame) -> DataFrame:
    """(lang, text) of the rows that may be learned from."""
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    return docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def fit(labelled: DataFrame, lattice: Lattice, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, float]:
    """Languages, probabilities by piece and language, and the weight of a word's evidence, from rows (lang, text)."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((lattice.size, 0)), 1.0
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, train_docs / n))) for x, n in sizes.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                found.update((lang, w) for w in _WORD.findall(text.as_py().lower()))
            yield pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    sample = labelled.where(fraction_of(F.col("text")) < share)
    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    cores = min(labelled.sparkSession.sparkContext.defaultParallelism, 256)
    words = materialise(counted.repartition(cores, "word"), "words")  # few bytes, much work: dealt to all cores
    table = np.full((lattice.size, len(langs)), 1.0 / len(lattice.pieces))
    table[lattice.none], table[lattice.unknown] = 0.0, 1e-7
    for _ in range(ROUNDS):
        now = table

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = defaultdict(lambda: np.zeros(lattice.size))
            for b in batches:
                rows = defaultdict(lambda: ([], []))
                for lang, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                    rows[lang][0].append(w)
                    rows[lang][1].append(n)
                for lang, (w, n) in rows.items():
                    total[lang] += lattice.expected(w, n, now[:, langs.index(lang)])
            for lang, x in total.items():
                at = np.nonzero(x)[0]
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["lang", "piece", "n"])

        counts = np.zeros((lattice.size, len(langs)))
        for r in words.mapInArrow(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            counts[r.piece, langs.index(r.lang)] = r.n
        counts[lattice.none] = 0
        pooled = counts.sum(axis=1) + 0.01
        pooled[lattice.none] = 0
        table = (counts + SMOOTHING * (pooled / pooled.sum())[:, None]) / (counts.sum(axis=0) + SMOOTHING)
    final = table

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(WEIGHTS))
        for b in batches:
            if b.num_rows:
                x = lattice.log_probs(b.column("word").to_pylist(), final)
                own, n = np.array([langs.index(v) for v in b.column("lang").to_pylist()]), b.column("n").to_numpy()
                for k, weight in enumerate(WEIGHTS):
                    y = weight * (x - x.max(axis=1, keepdims=True))
                    out[k] += float(n @ (np.log(np.exp(y).sum(axis=1)) - y[np.arange(len(y)), own]))
        yield pa.record_batch([pa.array(range(len(WEIGHTS)), pa.int32()), pa.array(out)], names=["k", "loss"])

    found = words.mapInArrow(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).orderBy("loss", "k").first()
    return langs, final, WEIGHTS[found.k] if found else 1.0


def score_texts(rows: DataFrame, lattice: Lattice, langs: list[str], table: np.ndarray, weight: float, keep: list[str]) -> DataFrame:
    """rows (text and the columns keep) with lang_pred and score instead of the text."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    model = rows.sparkSession.sparkContext.broadcast((lattice, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, table = model.value
        known: dict[str, int] = {}
        rows_of = sure_of = np.zeros((0, len(langs)))
        for b in batches:
            start, at = len(known), []
            for t in b.column("text"):
                text = t.as_py()
                words = _WORD.findall(text.lower()) if text and langs else []
                at.append(np.array([known.setdefault(w, len(known)) for w in words]) if any(c.isalpha() for w in words for c in w) else None)
            new = list(known)[start:]
            if new:
                x = lattice.log_probs(new, table)
                y = np.exp(weight * (x - x.max(axis=1, keepdims=True)))
                rows_of, sure_of = np.concatenate([rows_of, x]), np.concatenate([sure_of, y / y.sum(axis=1, keepdims=True)])
            pred, score = [], []
            for x in at:
                if x is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                best = int(rows_of[x].sum(axis=0).argmax())
                pred.append(langs[best])
                score.append(min(1.0, float(sure_of[x, best].mean())))
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])
            if len(known) > CACHE:
                known, rows_of = {}, np.zeros((0, len(langs)))
                sure_of = rows_of

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_path: str | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. Learns from rows that aren't held out only."""
    lattice = Lattice(vocabulary(vocabulary_path))
    langs, table, weight = fit(training_rows(docs), lattice, train_docs)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return score_texts(rows, lattice, langs, table, weight, ["doc_id", "held_out"])
