"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts are normalised (small letters, runs of other characters one space). An item holds in a document where a window of about the item's size is within
EDITS of the item's length in edits. The walk that embeds a window puts out a character at each step, and a random bit of (step, character) says whether
to go on; texts at a small edit distance so give outputs at a small Hamming distance. As errors add up along a walk, the embedding of an
item-sized window is sampled in stretches of some steps, one from each anchor in it: the start of each word, and each character of scripts without spaces.
Each of several walks samples outputs of a stretch as a key. A key that a document shares with an item aligns the two; a window of the item's size in
which enough anchors agree on the alignment, within the edits allowed, is verified by exact edit distance.

Steps, samples, walks and anchors that must agree follow from the item's length and the recall asked for: RUNGS lists settings from cheap to dear, and an item gets the first one that
finds that share of simulated windows of its length with nearly EDITS of their characters edited (`rung_for`). Aligned windows that share too few runs of Q characters with
the item to be within the edits aren't verified (that loses none). Long items take long stretches, which few texts share
by chance; short ones, with few anchors, short stretches and more walks. Texts are walked for the settings that items have. An exact passage is always found. Items of fewer than SHORTEST
normalised characters leave no room for walks: they are found by an exact key, as whole words without edits.

The index of a block of items, BLOCK characters at most, is built once on the driver and broadcast; a larger benchmark takes one pass over the texts a
block, of which only what is found is kept.

Defined results: null texts count as empty; an item without letters or digits matches nothing; repeated items come out under each item_id, a null
one is dropped; repeated documents come out as they are; an empty table of either kind gives no matches; other columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.common import bounded_batches, filter_texts, materialise

EDITS, SHORTEST, Q = 0.2, 12, 4
#: Share of windows within EDITS that is found.
RECALL = 0.9
#: Settings from cheap to dear: steps of a walk from an anchor, outputs sampled, walks; share of an item's anchors that must agree (one at least).
RUNGS = [(20, 15, 5, 0.15), (16, 12, 6, 0.16), (12, 10, 8, 0.15), (10, 9, 10, 0.15), (8, 7, 12, 0.15), (6, 6, 16, 0.15)]
#: Simulated windows a setting and class of lengths; the classes' ratio; what a setting must find over the recall asked for.
SIMULATED, CLASS, MARGIN = 200, 1.2, 0.02
#: Characters of items in an index, at most.
BLOCK = 4_000_000
#: Characters of documents walked at once, about.
GROUP = 200_000
#: Bits of the table that most keys of documents are turned away by.
SIEVE = 23
_KNOWN = 0x250


def _table() -> np.ndarray:
    """The normalised character of each below _KNOWN; 32 for what isn't a letter or digit."""
    return np.array([ord(chr(c).lower()) if chr(c).isalnum() and len(chr(c).lower()) == 1 else c if chr(c).isalnum() else 32 for c in range(_KNOWN)], dtype=np.uint32)


_CHARS = _table()


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters (a space first), and the place of each in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _CHARS[np.minimum(raw, _KNOWN - 1)]
    if len(far := np.nonzero(raw >= _KNOWN)[0]):
        kinds, which = np.unique(raw[far], return_inverse=True)
        out[far] = np.array([(ord(low) if len(low := chr(c).lower()) == 1 else c) if chr(c).isalnum() else 32 for c in kinds.tolist()], dtype=np.uint32)[which]
    out = np.concatenate([np.array([32], dtype=np.uint32), out])
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    at = np.nonzero(keep)[0]
    return out[at], at - 1


def anchors(codes: np.ndarray) -> np.ndarray:
    """Where words start, and each character of scripts written without spaces (from Thai to Khmer, and from U+2E80)."""
    far = (codes >= 0x2E80) | (codes >= 0x0E00) & (codes < 0x1800)
    at = codes[:-1] == 32
    if far.any():
        at = at | far[1:]
    return np.nonzero(at)[0] + 1


class Walks:
    """The random bits and samples of a setting's walks; the same in every process."""

    def __init__(self, rung: int, seed: int = 7):
        self.rung, (self.steps, samples, self.repeats, self.share) = rung, RUNGS[rung]
        rng = np.random.default_rng(seed)
        self.bits = [rng.integers(0, 2, (self.steps, 256), dtype=np.int64) for _ in range(self.repeats)]
        self.samples = [frozenset(rng.choice(self.steps, samples, replace=False).tolist()) for _ in range(self.repeats)]

    def keys(self, codes: np.ndarray, starts: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
        """The key of the walk from each start, and where the walk ended."""
        bits, sampled = self.bits[repeat], self.samples[repeat]
        padded = np.concatenate([codes, np.zeros(self.steps + 1, dtype=codes.dtype)])
        at, key = starts.astype(np.int64), np.full(len(starts), (repeat + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for j in range(self.steps):
            c = padded[at]
            if j in sampled:
                key = (key ^ c) * np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(29)
            at = at + bits[j][c & 255]
        return key, at


@cache
def _rung_of_class(size: int, recall: float) -> int:
    """The first setting that finds that share of simulated windows of a size, or the last. Windows are of made words, edited near the bound; the same in every process."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n // 4 + 1))[:n].strip().ljust(n, "x")

    def edited(text: str) -> str:
        out = list(text)
        for k in rng.sample(range(len(out)), int(EDITS * len(out) * 0.95)):
            out[k] = rng.choice(("", rng.choice("abcdefghij "), out[k] + rng.choice("abcdefghij ")))
        return "".join(out)

    items = [(k, prose(size)) for k in range(SIMULATED)]
    texts = [f"{prose(60)} {edited(text)} {prose(60)}" for _, text in items]
    for rung in range(len(RUNGS)):
        found = Items(items, rung=rung).find(texts)
        if sum(k in [h[0] for h in hits] for k, hits in enumerate(found)) >= min(1.0, recall + MARGIN) * SIMULATED:
            return rung
    return len(RUNGS) - 1


def rung_for(size: int, recall: float = RECALL) -> int:
    """The setting for items of so many normalised characters: that of the shortest of their class. Beyond the length at which the first setting does, it is the first."""
    step = int(math.log(size / SHORTEST) / math.log(CLASS) + 1e-9)
    for k in range(step + 1):
        if (rung := _rung_of_class(math.ceil(SHORTEST * CLASS**k), recall)) == 0:
            break
    return rung


def _word_keys(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` characters from each start."""
    padded = np.concatenate([codes, np.zeros(length, dtype=codes.dtype)])
    key = np.full(len(starts), length, dtype=np.uint64)
    for j in range(length):
        key = (key ^ padded[starts + j]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(29)
    return key


class _Index:
    """From keys to (item, offset): sorted keys behind a table of bits."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, offsets: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.offsets = keys[order], items[order].astype(np.int32), offsets[order].astype(np.int32)
        self.sieve = np.zeros(1 << SIEVE, dtype=bool)
        self.sieve[(keys >> np.uint64(64 - SIEVE)).astype(np.int64)] = True

    def __getstate__(self):
        return self.keys, self.items, self.offsets, np.packbits(self.sieve)

    def __setstate__(self, state):
        self.keys, self.items, self.offsets, packed = state
        self.sieve = np.unpackbits(packed).astype(bool)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which key, item, offset) of all matches."""
        may = np.nonzero(self.sieve[(keys >> np.uint64(64 - SIEVE)).astype(np.int64)])[0]
        low, high = (np.searchsorted(self.keys, keys[may], side) for side in ("left", "right"))
        n = high - low
        which = np.repeat(may, n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return which, self.items[at], self.offsets[at]


class Items:
    """A block of items (id, text) with their keys."""

    def __init__(self, rows: list[tuple[int, str]], recall: float = RECALL, rung: int | None = None):
        """rung: one setting for all items, else the one that their length and the recall need."""
        rows = sorted((item, text or "") for item, text in rows)
        self.ids = [item for item, _ in rows]
        codes, bounds, _ = _joined([t for _, t in rows])
        self.patterns = [_trimmed(codes[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        self.grams = [_grams(p) for p in self.patterns]
        size = np.array([len(p) for p in self.patterns], dtype=np.int64)
        first = bounds[:-1] + np.array([int(a < z and codes[a] == 32) for a, z in zip(bounds[:-1], bounds[1:], strict=True)], dtype=np.int64)
        starts = anchors(codes)
        owner = np.searchsorted(bounds, starts, side="right") - 1
        inside = (owner >= 0) & (owner < len(rows))
        starts, owner = starts[inside], owner[inside]
        rungs = np.array([-1 if n < SHORTEST else rung_for(n, recall) if rung is None else rung for n in size.tolist()], dtype=np.int64)
        self.most, self.votes = (EDITS * size).astype(np.int64), np.ones(len(rows), dtype=np.int64)
        self.tables: list[tuple[Walks, _Index]] = []
        walked: set[int] = set()
        for one in sorted(set(rungs.tolist()) - {-1}):
            walks, keys, items, offsets = Walks(one), [], [], []
            own = rungs[owner] == one
            for r in range(walks.repeats):
                key, end = walks.keys(codes, starts, r)
                fits = own & (end <= first[owner] + size[owner])
                keys.append(key[fits])
                items.append(owner[fits])
                offsets.append((starts - first[owner])[fits])
            self.tables.append((walks, _Index(*(np.concatenate(x) for x in (keys, items, offsets)))))
            walked |= set(np.concatenate(items).tolist())
            n = np.max([np.bincount(x, minlength=len(rows)) for x in items], axis=0)
            self.votes = np.where(rungs == one, np.maximum(1, (walks.share * n).astype(np.int64)), self.votes)
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, p in enumerate(self.patterns):
            # an item with room for no walk is found by its exact key like a shorter one
            if len(p) and k not in walked:
                at = np.zeros(1, dtype=np.int64)
                self.short.setdefault(len(p), {}).setdefault(int(_word_keys(p, at, len(p))[0]), []).append(k)

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the (item_id, start, end, edits) of items in it, places in code points. Texts are walked together, GROUP characters at a time."""
        out: list[list] = []
        at = 0
        while at < len(texts):
            n, size = at, 0
            while n < len(texts) and (n == at or size + len(texts[n]) <= GROUP):
                size += len(texts[n])
                n += 1
            out += self._find(texts[at:n])
            at = n
        return out

    def _find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        out: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        if not any(len(p) for p in self.patterns):
            return [[] for _ in texts]
        codes, bounds, origin = _joined(texts)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        starts, grams = anchors(codes), _grams(codes)

        def put(doc: int, item: int, start: int, end: int, edits: int) -> None:
            a, z = max(start, int(bounds[doc]), 1), max(min(end, int(bounds[doc + 1])) - 1, int(bounds[doc]), 1)
            place = lambda i: int(origin[min(i, len(origin) - 1)] - begins[doc])
            if item not in out[doc] or edits < out[doc][item][3]:
                out[doc][item] = (self.ids[item], place(a), place(z) + 1, edits)

        for doc, item, low, high in self._aligned(codes, bounds, starts):
            if item in out[doc] and out[doc][item][3] == 0:
                continue
            pattern, most = self.patterns[item], int(self.most[item])
            first, last = int(bounds[doc]), int(bounds[doc + 1])
            exact = next((d for d in {low, high} if first <= d and d + len(pattern) <= last and np.array_equal(codes[d : d + len(pattern)], pattern)), None)
            if exact is not None:
                put(doc, item, exact, exact + len(pattern), 0)
                continue
            begin = max(first, low - most)
            window = slice(begin, min(last, high + len(pattern) + most))
            if not may_be_within(self.grams[item], grams[window], most, high - low + 2 * most):
                continue
            edits, end = edit_search(pattern, codes[window])
            if edits <= most:
                put(doc, item, max(begin, min(low, begin + end - 1)), begin + end, edits)
        for length, known in self.short.items():
            wanted = np.array(sorted(known), dtype=np.uint64)
            keys = _word_keys(codes, starts, length)
            for i in np.nonzero(np.isin(keys, wanted))[0].tolist():
                at = int(starts[i])
                doc = int(np.searchsorted(bounds, at, side="right")) - 1
                ends = at + length == len(codes) or codes[at + length] == 32 or codes[at + length] >= 0x0E00
                for item in known[int(keys[i])]:
                    if ends and doc < len(texts) and at + length <= int(bounds[doc + 1]) and np.array_equal(codes[at : at + length], self.patterns[item]):
                        put(doc, item, at, at + length, 0)
        return [sorted(x.values()) for x in out]

    def _aligned(self, codes: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, least and largest start) of windows whose anchors agree."""
        hits = []
        for walks, index in self.tables:
            for r in range(walks.repeats):
                which, item, offset = index.look_up(walks.keys(codes, starts, r)[0])
                hits.append(np.stack([np.searchsorted(bounds, starts[which], side="right") - 1, item, starts[which] - offset, starts[which]]))
        if not hits:
            return []
        doc, item, start, anchor = np.concatenate(hits, axis=1)
        if not len(doc):
            return []
        line = (doc * len(self.ids) + item) * (1 << 32) + start + (1 << 31)
        # equal votes of a place come from several walks and count once; they meet by a hash
        mixed = line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + anchor.astype(np.uint64)
        order = np.argsort(mixed)
        line, anchor = line[order], anchor[order]
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (anchor[1:] != anchor[:-1])])
        line = np.sort(line[new])
        doc_item, start = line >> 32, (line & 0xFFFFFFFF) - (1 << 31)
        doc, item = doc_item // len(self.ids), doc_item % len(self.ids)
        after = np.searchsorted(line, line + self.most[item], side="right")
        agreed = np.nonzero(after - np.arange(len(line)) >= self.votes[item])[0]
        marks = np.bincount(agreed, minlength=len(line) + 1) - np.bincount(after[agreed], minlength=len(line) + 1)
        ok = np.cumsum(marks)[:-1] > 0
        doc_item, doc, item, start = doc_item[ok], doc[ok], item[ok], start[ok]
        if not len(doc):
            return []
        new = np.concatenate([[True], (doc_item[1:] != doc_item[:-1]) | (start[1:] - start[:-1] > self.most[item[1:]])])
        first = np.nonzero(new)[0]
        last = np.concatenate([first[1:], [len(doc)]]) - 1
        return list(zip(doc[first].tolist(), item[first].tolist(), start[first].tolist(), start[last].tolist(), strict=True))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised characters of all texts, where each text's begin (and the last ends), and the places of characters in the joined texts."""
    codes, origin = normalise("\n".join(texts))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]).astype(np.int64)
    return codes, np.searchsorted(origin, begins), origin


def _trimmed(codes: np.ndarray) -> np.ndarray:
    codes = codes[1:] if len(codes) and codes[0] == 32 else codes
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


def _grams(codes: np.ndarray) -> np.ndarray:
    """A number for the Q characters from each place, fewer at the end; equal for equal ones."""
    padded = np.concatenate([codes, np.zeros(Q, dtype=codes.dtype)]).astype(np.uint64)
    out = padded[: len(codes)].copy()
    for j in range(1, Q):
        out = out * np.uint64(0x110000) + padded[j : j + len(codes)]
    return out


def may_be_within(own: np.ndarray, there: np.ndarray, most: int, band: int) -> bool:
    """False only if no part of a window is within `most` edits of a pattern, from the numbers of their runs of Q characters: an edit spoils at most Q of the pattern's runs, and the
    others stand in the window, from their own place to `band` later. Numbers may meet by chance, which only lets more through."""
    runs = len(own) - Q + 1
    if (least := runs - Q * most) <= 0:
        return True
    if len(there) < runs + band:
        there = np.concatenate([there, np.full(runs + band - len(there), np.uint64(0xFFFFFFFFFFFFFFFF))])
    near = np.lib.stride_tricks.as_strided(there, (runs, band + 1), (there.strides[0], there.strides[0]), writeable=False)
    return int((near == own[:runs, None]).any(1).sum()) >= least


def edit_search(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and where that part ends; bit-parallel."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text.tolist()):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & mask
        ph, mh = (minus | ~(xh | plus)) & mask, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        plus, minus = (mh | ~(xv | ph)) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block` characters each, fetched one after the other; one block at least."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    now, size = [], 0
    for r in rows.toLocalIterator():
        if size and size + len(r.text) > block:
            yield now
            now, size = [], 0
        now.append((r.item_id, r.text))
        size += len(r.text)
    yield now


_HITS = "array<struct<item:bigint,start:bigint,end:bigint,edits:bigint>>"


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def found_by(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, h, hits) of the rows in which items are found; h tells texts under one id apart."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item", "start", "end", "edits")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [[dict(zip(("item", "start", "end", "edits"), y, strict=True)) for y in x] for x in shared.value.find([t or "" for t in b.column("text").to_pylist()])]
            at = pa.array([i for i, x in enumerate(hits) if x], pa.int64())
            yield pa.record_batch([b.column("doc_id").take(at), b.column("h").take(at), pa.array([x for x in hits if x], kind)], names=["doc_id", "h", "hits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, h long, hits {_HITS}")


def all_found(docs: DataFrame, benchmark: DataFrame, block: int, recall: float) -> DataFrame:
    """(doc_id, h, hits) of all blocks' items, one row for each text of an id: one pass over the texts a block, what is found as a table."""
    tables = [materialise(found_by(docs, Items(part, recall)), "hits") for part in blocks(benchmark, block)]
    once = [t.dropDuplicates(["doc_id", "h"]) for t in tables]
    out = once[0]
    for t in once[1:]:
        out = out.unionByName(t)
    return out.groupBy("doc_id", "h").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """One row a document: doc_id, contaminated, n_items, item_ids, spans (item:start:end:edits, comma-joined)."""
    found = all_found(docs, benchmark, block, recall).withColumnsRenamed({"doc_id": "found_id", "h": "found_h"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("h"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("h") == F.col("found_h")), "left").withColumn("hits", F.coalesce("hits", F.array().cast(_HITS)))
    spans = F.transform("hits", lambda x: F.concat_ws(":", x.item, x.start, x.end, x.edits))
    return rows.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.col("hits.item").alias("item_ids"), F.array_join(spans, ",").alias("spans"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay. One block is a filter; more are passes whose findings leave by an anti-join."""
    parts = blocks(benchmark, block)
    first, second = next(parts), next(parts, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(Items(first, recall))
        return filter_texts(docs, lambda: lambda texts: [not x for x in shared.value.find(texts)])
    # the two sides' columns are told apart by their tables, whatever docs has beside them
    found = all_found(docs, benchmark, block, recall).select("doc_id", "h")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == found["h"]), "left_anti")
