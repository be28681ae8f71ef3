import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oddsframe.llm import packing as P
from tests.llm.helpers import DOCS, ODD, documents, words

REAL = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
OURS = P.Tokenizer()


def ids_of(text):
    return [*REAL.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcXYZ'’ \t\nÄßéñ0129.,-!<|>")), max_size=60))
def test_ids_are_the_tokenizers(text):
    (got,) = OURS.ids([text])
    assert np.frombuffer(got, dtype="<u4").tolist() == ids_of(text)


def test_special_tokens_and_contractions():
    for text in ["it's we'll I'M", "a<|endoftext|>b", "x''s ' 's", "Ω É ſ İstanbul", " a b", "a\x1cb", "12½"]:
        (got,) = OURS.ids([text])
        assert np.frombuffer(got, dtype="<u4").tolist() == ids_of(text)


def check(rows, out, size):
    want = Counter()
    for i, t in rows:
        ids = np.array(ids_of(t), dtype="<u4")
        for k, a in enumerate(range(0, len(ids), size)):
            x = ids[a : a + size]
            want[i, k, a, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(by), sum(k[3] * n for k, n in want.items())


def test_packing_is_whole_gapless_and_tight(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 120)
    rows = [(i, words(i, 1 + i * 13 % 120)) for i in range(300)] + [r for r in ODD if r[0] != 6]
    out = P.pack(documents(spark, rows, extra=True), size=512).collect()
    bins, tokens = check(rows, out, 512)
    shards = -(-len(out) // 120)
    assert bins <= -(-tokens // 512) + shards + 1


def test_long_documents_are_cut(spark):
    rows = [(1, "a " * 3000), (2, "b"), (3, None)]
    assert check(rows, P.pack(documents(spark, rows), size=256).collect(), 256)[0] == 12


def test_ids_can_be_kept_and_empty(spark):
    rows = [(1, "hello world"), (2, "")]
    out = {r.doc_id: list(r.ids) for r in P.pack(documents(spark, rows), keep_ids=True).collect()}
    assert out == {1: ids_of("hello world"), 2: [1]}
    assert P.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_another_file_is_used_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, text = Tokenizer.from_file(path), "It's  A test, Ünï 12"
    (row,) = P.pack(documents(spark, [(1, text)]), path=path, keep_ids=True).collect()
    assert list(row.ids) == [*other.encode(text, add_special_tokens=False).ids, 1]


def same(bins, lengths, size):
    assert len(bins) == len(lengths) and np.bincount(bins, weights=lengths).max() <= size and set(bins) == set(range(bins.max() + 1))


def decreasing(lengths, size):
    return P.best_fit(np.argsort(-lengths, kind="stable"), lengths, np.arange(len(lengths)), size)


def islands(lengths, size, epochs=P.EPOCHS):
    """The island model on one machine."""
    here = [P.Island(lengths, size, i) for i in range(P.ISLANDS)]
    for _ in range(epochs):
        best = [x.evolve(P.GENERATIONS).best for x in here]
        for i, x in enumerate(here):
            x.people = sorted([*x.people, best[i - 1]], key=x._rank)
    return here


def test_crossover_and_mutation_keep_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 200)
    a, b = decreasing(lengths, 100), P.best_fit(np.arange(200), lengths, np.arange(200), 100)
    for _ in range(20):
        c = P.crossover(a, b, lengths, 100, rng)
        same(c, lengths, 100)
        same(P.mutate(c, lengths, 100, rng), lengths, 100)
        a, b = b, c


def test_crossover_keeps_whole_bins_of_its_parent():
    rng = np.random.default_rng(2)
    lengths = rng.integers(20, 60, 300)
    a, b = (P.Island(lengths, 100, i).best for i in (1, 2))
    groups = lambda p: {tuple(np.nonzero(p == k)[0]) for k in range(p.max() + 1)}
    assert len(groups(P.crossover(a, b, lengths, 100, rng)) & groups(a)) > 20


def test_evolution_needs_fewer_bins_than_best_fit():
    lengths = np.sort(np.random.default_rng(1).integers(1000, 2501, 1500))
    here = islands(lengths, 4096)
    for x in here:
        same(x.best, lengths, 4096)
        assert x.crossovers == 2 * P.EPOCHS * P.GENERATIONS
    assert min(x.best.max() + 1 for x in here) <= decreasing(lengths, 4096).max() + 1 - 2


def least_bins(lengths, size):
    """By trying every bin for every piece."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            put(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, size - lengths[i]])

    put(0, [])
    return best


def test_small_problems_are_solved_as_by_brute_force():
    for seed in range(12):
        lengths = np.random.default_rng(seed).integers(5, 60, 9)
        assert min(x.best.max() + 1 for x in islands(lengths, 100)) == least_bins(sorted(lengths.tolist(), reverse=True), 100)


def test_generations_run_on_every_shard_and_elites_migrate(spark):
    cut = spark.range(400).selectExpr("cast(id % 2 as int) as shard", "1000 + (id * 7919) % 1500 as length")
    out = P.evolution(cut, 4096, epochs=2).collect()
    assert len(out) == 2 * P.ISLANDS and all(r.crossovers >= 2 for r in out)
    alone = P.evolution(cut, 4096, epochs=1).collect()
    assert {(r.shard, r.island): r.crossovers for r in out} != {(r.shard, r.island): r.crossovers for r in alone}
    for r in out:
        lengths = np.repeat([x.length for x in r.lens], [x.n for x in r.lens])
        same(P._decoded(r.people[0]), lengths, 4096)
