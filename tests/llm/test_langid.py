import random
import zlib

import numpy as np

from oddsframe.llm import langid as L
from tests.llm.helpers import DOCS, ODD, documents

SYLLABLES = {"en": ["the", "tion", "ing", "er", "wh"], "de": ["sch", "ung", "eit", "ver", "über"], "es": ["ción", "ado", "que", "rra", "ñ"]}


def made(n):
    r = random.Random(5)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(40)), lang))
    return out


def brute_log_prob(word, pieces, table, lattice):
    w = "▁" + word

    def total(i):
        if i == len(w):
            return np.ones(table.shape[1])
        out = np.zeros(table.shape[1])
        for j in range(i + 1, len(w) + 1):
            k = pieces.get(w[i:j], lattice.unknown if j == i + 1 else None)
            if k is not None:
                out = out + table[k] * total(j)
        return out

    return np.log(total(0))


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "bab", "▁ab"])}
    lattice = L.Lattice(pieces)
    table = np.random.default_rng(0).random((lattice.size, 2)) / 10
    table[lattice.none] = 0
    words = ["abab", "b", "babba", "xa", "a" * 40]
    got = lattice.log_probs(words, table)
    for w, g in zip(words[:4], got, strict=False):
        assert np.allclose(g, brute_log_prob(w, pieces, table, lattice))
    assert np.allclose(got[4], lattice._long("▁" + "a" * 40, table))


def test_expected_counts_add_up():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab"])}
    lattice = L.Lattice(pieces)
    probs = np.full(lattice.size, 0.2)
    probs[lattice.none] = 0
    counts = lattice.expected(["ab"], [3.0], probs)
    # characters covered by the expected pieces are those of the words
    length = {i: len(p) for p, i in pieces.items()}
    assert abs(sum(counts[i] * n for i, n in length.items()) - 9) < 1e-9


def test_long_words_and_long_pieces_count_like_short_ones(monkeypatch):
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "abababababababab"])}
    lattice = L.Lattice(pieces)
    table = np.random.default_rng(2).random((lattice.size, 2)) / 4
    table[lattice.none] = 0
    words, counts = ["ab" * 9, "ba" * 10 + "x"], [2.0, 5.0]
    short = lattice.log_probs(words, table), lattice.expected(words, counts, table[:, 0])
    assert short[1][pieces["abababababababab"]] > 0
    for w, g in zip(words, short[0], strict=True):
        assert np.allclose(g, brute_log_prob(w, pieces, table, lattice))
    monkeypatch.setattr(L, "SHORT", 3)
    assert np.allclose(short[0], lattice.log_probs(words, table)) and np.allclose(short[1], lattice.expected(words, counts, table[:, 0]))


def test_scores_tell_mixed_texts_from_plain_ones(spark):
    rows = made(200)
    by = {g: [t for _, t, h in rows if h == g] for g in SYLLABLES}
    mixed = [(1000 + i, f"{by['en'][i]} {by['de'][i]}", None) for i in range(10)]
    out = {r.doc_id: r for r in L.identify(documents(spark, rows + mixed)).collect()}
    plain = [out[i].score for i, _, _ in rows]
    assert max(out[1000 + i].score for i in range(10)) < min(plain)


def test_held_out_accuracy_and_columns(spark):
    rows = made(300)
    out = L.identify(documents(spark, rows, extra=True)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_rows_are_not_learned_from(spark):
    rows = made(120)
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else g) for i, t, g in rows]
    assert all(r.lang_pred != "zz" for r in L.identify(documents(spark, swapped)).collect())


def test_odd_rows(spark):
    rows = [(100 + i, t, g) for i, (_, t, g) in enumerate(made(60))] + [(i, t, None) for i, t in ODD] + [(20, "123 !!", "en"), (21, "w" * 5000, None)]
    out = {}
    for r in L.identify(documents(spark, rows)).collect():
        out.setdefault(r.doc_id, r)
    assert [out[i].lang_pred for i in (1, 2, 3, 20)] == ["und"] * 4 and out[1].score == 0
    assert out[4].lang_pred in SYLLABLES and out[6].lang_pred in SYLLABLES and out[21].lang_pred in SYLLABLES and out[None].held_out


def test_without_labels_and_empty(spark):
    assert L.identify(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.lang_pred for r in L.identify(documents(spark, [(1, "abc", None)])).collect()] == ["und"]
