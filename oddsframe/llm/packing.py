"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces of at most SIZE tokens. The pieces are dealt at random to shards of about SHARD pieces, each
a packing problem of its own. A shard has ISLANDS islands, each a population that starts from randomised packings. In each of EPOCHS
epochs the islands evolve apart, then their elites migrate to the next island; the best packing of the shard is taken. Crossover injects whole
well-filled bins of one packing into another, removes the bins that hold injected pieces a second time, and best-fits the displaced
pieces. An island rests once it holds a packing at the bound that none can beat, but never before its first generation.

Defined results: a null text counts as empty; an empty text is one piece, the closing id alone; texts longer than SIZE tokens are cut
into pieces of SIZE and a last one; repeated rows are packed as often as they are there; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.common import materialise, parts_for

SIZE, CLOSING_ID = 4096, 1
#: Pieces a shard, about; islands, packings an island, generations between migrations, and epochs (one migration fewer).
SHARD, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 20_000, 3, 4, 8, 4
#: Islands a task, about: an epoch of one takes less time than a task's start. Partitions that islands are dealt to, at most.
TOGETHER, MOST_PARTS = 4, 20_000
#: Words whose ids a worker keeps.
CACHE = 300_000
#: Texts of these characters alone are split here; in them no other rule of the tokenizer's normaliser applies than lower case and white space.
_PLAIN = re.compile(r"[\t\n\r -~¡¿«»À-ÖØ-öø-ÿŒœ–—‘’“”…€]*")
_WORD = re.compile(r"[a-zß-öø-ÿœ]++|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ÿœ0-9]++")


#: How a file that _WORD serves normalises and splits (fixed values of the public tokenizer).
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_as_here(path: str) -> bool:
    """If the file's own rules are those that _WORD follows."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (rules.get("normalizer") or {}).get("normalizers") == _NORMALISER and steps[0].get("pattern") == {"Regex": _SPLITTER}
        and steps[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        and rules["model"].get("end_of_word_suffix") == "</w>"
    )


class Tokenizer:
    """Ids of a tokenizer file, as bytes of little-endian 32-bit numbers. Under the rules of splits_as_here the ids of a text are those of its words,
    one after the other, so words are looked up once and kept; texts with a special token or with characters beyond _PLAIN, and all texts under other rules, go to
    the tokenizer whole."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer as Loaded

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.loaded = Loaded.from_file(path)
        self.by_words = splits_as_here(path)
        self.words: dict[str, bytes] = {}
        vocabulary = self.loaded.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> list[int]:
        return self.loaded.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> None:
        """Ids of words, from one text of them all: white space parts them, and each ends with an id that ends a word."""
        ids = np.array(self.whole(" ".join(words)), dtype="<u4")
        stops = np.nonzero(self.ends[ids])[0] + 1 if len(ids) == 0 or ids.max() < len(self.ends) else []
        if len(stops) != len(words):
            for w in words:
                self.words[w] = np.array(self.whole(w), dtype="<u4").tobytes()
            return
        raw, start = ids.tobytes(), 0
        for w, stop in zip(words, (4 * stops).tolist(), strict=True):
            self.words[w] = raw[start:stop]
            start = stop

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, the closing id after them."""
        known = self.words
        if len(known) > CACHE:
            known.clear()
        split = [_WORD.findall(t.lower()) if self.by_words and _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        new = [w for w in set(chain.from_iterable(s for s in split if s)) if w not in known]
        for at in range(0, len(new), 2_000):
            self._learn(new[at : at + 2_000])
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        for t, s in zip(texts, split, strict=True):
            if s is None:
                yield np.array(self.whole(t), dtype="<u4").tobytes() + closing
            else:
                yield (b"".join(itemgetter(*s)(known)) if len(s) > 1 else known[s[0]] if s else b"") + closing


@cache
def tokenizer_of(path: str | None) -> Tokenizer:
    """One tokenizer a worker process, so that its words last over tasks."""
    return Tokenizer(path)


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(path)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = []
                for d, ids in zip(part.column("doc_id").to_pylist(), tok.ids([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    for k, start in enumerate(range(0, len(ids) // 4, size)):
                        x = ids[4 * start : 4 * (start + size)]
                        rows.append((d, k, start, len(x) // 4, zlib.crc32(x), *([np.frombuffer(x, dtype="<u4").tolist()] if keep_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())


def bound_of(lengths: np.ndarray, size: int) -> int:
    """Sequences that no packing can do without: all tokens, and pieces of over half a sequence."""
    return max(-(-int(lengths.sum()) // size), int((2 * lengths > size).sum()))


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Put the pieces `order` (places in lengths), one after the other, into the fullest bin that takes each.

    bins: the bin of each piece; those of `order` are set here, in a copy whose bins are numbered from 0."""
    apart = np.ones(len(lengths), dtype=bool)
    apart[order] = False
    out = np.empty(len(lengths), dtype=np.int64)
    kept = bins[apart]
    used = np.bincount(kept) > 0
    out[apart] = (np.cumsum(used) - 1)[kept]
    rooms = size - np.bincount(kept, weights=lengths[apart]).astype(np.int64)[used]
    free = np.sort((rooms << 24) + np.arange(len(rooms)))[np.count_nonzero(rooms == 0) :].tolist()
    n, found = len(rooms), []
    for x in lengths[order].tolist():
        at = bisect_left(free, x << 24)
        if at < len(free):
            slot = free.pop(at) - (x << 24)
        else:
            slot = (size - x << 24) + n
            n += 1
        found.append(slot & 0xFFFFFF)
        if slot >> 24:
            insort(free, slot)
    out[order] = found
    return out


def roughly_decreasing(which: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, spread: float) -> np.ndarray:
    """Places in the order of their lengths, the longest first, each length times a random number."""
    return which[np.argsort(-lengths[which] * rng.uniform(1 - spread, 1 + spread, len(which)), kind="stable")]


def fitness(bins: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean of squared fill."""
    fill = np.bincount(bins, weights=lengths) / size
    return -len(fill), float((fill**2).mean()) if len(fill) else 0.0


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """b with whole well-filled bins of a injected.

    b's bins that hold an injected piece go; their other pieces are displaced and put by best fit."""
    fill = np.bincount(a, weights=lengths)
    fullest = np.argsort(-fill, kind="stable")[: max(1, 2 * len(fill) // 3)]
    injected = np.zeros(len(fill), dtype=bool)
    injected[rng.choice(fullest, max(1, int(len(fullest) * rng.uniform(0.4, 0.9))), replace=False)] = True
    inside = injected[a]
    hit = np.zeros(int(b.max()) + 1, dtype=bool)
    hit[b[inside]] = True
    displaced = np.nonzero(~inside & hit[b])[0]
    return best_fit(roughly_decreasing(displaced, lengths, rng, 0.1), lengths, np.where(inside, a + len(hit), b), size)


def mutate(bins: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Empty some of the worst-filled bins and a few others, and best-fit their pieces."""
    fill = np.bincount(bins, weights=lengths)
    worst = np.argsort(fill, kind="stable")[: 1 + rng.integers(1 + len(fill) // 10)]
    freed = np.isin(bins, np.concatenate([worst, rng.integers(0, len(fill), 1 + len(fill) // 50)]))
    return best_fit(roughly_decreasing(np.nonzero(freed)[0], lengths, rng, 0.3), lengths, bins, size)


class Island:
    """A population of packings of one shard's pieces; it starts from randomised packings."""

    def __init__(self, lengths: np.ndarray, size: int, seed: int, people: list[np.ndarray] | None = None):
        self.lengths, self.size, self.rng, self.crossovers = lengths, size, np.random.default_rng(seed), 0
        everyone = np.arange(len(lengths))
        start = [] if people else [best_fit(roughly_decreasing(everyone, lengths, self.rng, s), lengths, everyone, size) for s in np.linspace(0.2, 0.9, POPULATION)]
        self.people = sorted(people or start, key=self._rank)

    def _rank(self, p: np.ndarray) -> tuple[int, float]:
        bins, fill = fitness(p, self.lengths, self.size)
        return -bins, -fill

    @property
    def best(self) -> np.ndarray:
        return self.people[0]

    def evolve(self, generations: int) -> Island:
        """The fitter half stays each generation. One at the bound can't be bettered: an island that holds one rests after its first generation."""
        least = bound_of(self.lengths, self.size)
        for g in range(generations):
            if (g or self.crossovers) and int(self.best.max()) < least:
                break
            one, two = self.people[0], self.people[self.rng.integers(1, len(self.people))]
            children = [crossover(x, y, self.lengths, self.size, self.rng) for x, y in ((one, two), (two, one))]
            self.crossovers += 2
            children.append(mutate(children[0], self.lengths, self.size, self.rng))
            self.people = sorted(self.people + children, key=self._rank)[:POPULATION]
        return self


def _coded(bins: np.ndarray) -> bytes:
    return bins.astype("<i4").tobytes()


def _decoded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i4").astype(np.int64)


_STATE = "shard int, island int, lens array<struct<length:bigint,n:bigint>>, people array<binary>, crossovers long, bins int, fill double"


def evolution(cut: DataFrame, size: int = SIZE, epochs: int = EPOCHS) -> DataFrame:
    """(shard, island, lens, people, crossovers, bins, fill) from pieces (shard, length): what the islands hold in the end, the fittest first.

    A packing gives the bin of each of the shard's pieces in the order of their lengths. Between epochs each island's best goes to the next one."""
    counts = cut.groupBy("shard", "length").agg(F.count("*").alias("n"))
    problems = counts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("lens"))  # at most `size` lengths
    state = problems.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "lens", F.array().cast("array<binary>").alias("people"), F.lit(0).cast("long").alias("crossovers"))
    shards = int(cut.agg(F.max("shard")).first()[0] or 0) + 1

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                shard, island, lens, people, crossovers = (one.column(c)[0].as_py() for c in ("shard", "island", "lens", "people", "crossovers"))
                lengths = np.repeat([x["length"] for x in lens], [x["n"] for x in lens]).astype(np.int64)
                here = Island(lengths, size, (shard * ISLANDS + island) * 1000 + crossovers, [_decoded(p) for p in people])
                here.crossovers = crossovers
                here.evolve(GENERATIONS)
                bins, fill = fitness(here.best, lengths, size)
                told = [pa.array([[_coded(p) for p in here.people]], pa.list_(pa.binary())), pa.array([here.crossovers], pa.int64()), pa.array([-bins], pa.int32()), pa.array([fill], pa.float64())]
                yield pa.record_batch([*(one.column(c) for c in ("shard", "island", "lens")), *told], names=["shard", "island", "lens", "people", "crossovers", "bins", "fill"])

    for _ in range(epochs):
        # work, not bytes, is to be dealt: a stated number of partitions isn't coalesced
        dealt = state.repartition(min(parts_for(shards * ISLANDS, TOGETHER), MOST_PARTS), "shard", "island")
        lived = materialise(dealt.mapInArrow(live, _STATE), "islands")
        guests = lived.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("people")[0].alias("guest"))
        state = lived.join(guests, ["shard", "island"]).select("shard", "island", "lens", F.array_append("people", F.col("guest")).alias("people"), "crossovers")
    return lived


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept)."""
    cut = materialise(pieces(docs, path, size, keep_ids), "pieces")
    shards = parts_for(cut.count(), SHARD)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    found = evolution(dealt, size)
    best = found.groupBy("shard").agg(F.min_by(F.col("people")[0], F.struct("bins", -F.col("fill"), "island")).alias("elite"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("length", "ascending"), ("uid", "ascending")])
        lengths, bins = left["length"].to_numpy(), _decoded(right["elite"][0].as_py())
        order = np.argsort(bins, kind="stable")
        before = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        first = np.searchsorted(bins[order], np.arange(int(bins.max()) + 1))
        offset = np.empty(len(lengths), dtype=np.int64)
        offset[order] = before - before[first][bins[order]]
        return pa.table({"uid": left["uid"], "sequence_id": (left["shard"][0].as_py() << 24) + bins, "offset": offset})

    slots = dealt.select("shard", "uid", "length").groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, "uid long, sequence_id long, offset long")
    return cut.join(slots, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
