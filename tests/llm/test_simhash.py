import random

import numpy as np
import xxhash

from oddsframe.llm import simhash as S
from tests.llm.helpers import DOCS, ODD, documents, union_find, words


def brute_code(text, k=3):
    w = [x for x in bytes(text or "", "utf-8", "surrogatepass").lower().split()]
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = words(r.randrange(10**6), 1)
    return " ".join(w)


def test_fingerprints_and_components_equal_brute_force(spark):
    base = words(1, 300)
    rows = [(i, words(i, 1 + i % 90)) for i in range(10, 150)] + [(200 + i, edited(base, i % 3, i)) for i in range(60)] + [r for r in ODD if r[0] is not None]
    out = S.simhash_components(documents(spark, rows, extra=True)).collect()
    codes = {}
    for i, t in rows:
        codes[i] = brute_code(t)
    assert all(int(r.fingerprint, 16) == codes[r.doc_id] for r in out) and len(out) == len(rows)
    links = [(a, b) for a in codes for b in codes if a < b and (codes[a] ^ codes[b]).bit_count() <= 2]
    top = union_find(list(codes), links)
    assert {r.doc_id: r.component_id for r in out} == top


def test_all_pairs_at_two_bits_are_linked_and_three_are_not(spark):
    r = random.Random(3)
    codes = [r.getrandbits(64) for _ in range(60)]
    codes += [c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for c in codes] + [c ^ 0b111 << r.randrange(60) for c in codes[:20]]
    # a hot bucket: one code with all its neighbours at one bit, and many more at two
    codes += [codes[0] ^ (1 << i) for i in range(64)] + [codes[0] ^ (1 << i) ^ (1 << (i * 7 + 1) % 64) for i in range(64)]
    signed = [c - (1 << 64) if c >> 63 else c for c in dict.fromkeys(codes)]
    edges = S.link_fingerprints(spark.createDataFrame([(c,) for c in signed], "code long")).collect()
    found = union_find(signed, [(e.a, e.b) for e in edges])
    real = union_find(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    assert found == real


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_null_ids_share_the_component_of_a_known_one(spark):
    out = S.simhash_components(documents(spark, [(None, "a b c d"), (9, "a b c d"), (None, "quite another text")])).collect()
    assert sorted(str(r.component_id) for r in out) == ["9", "9", "None"]


def jaccard(a, b, k=5):
    x, y = ({tuple(t.lower().split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_equal_brute_force(spark):
    rows, n = [], 0
    for f in range(25):
        base = words(1000 + f, 60 + 20 * (f % 10))
        for e in range(6):
            rows.append((n, edited(base, e * (1 + f % 2), n)))
            n += 1
    rows += [(n + i, words(5000 + i, 80)) for i in range(50)] + [(900, ""), (901, None), (902, "one two")]
    text = dict(rows)
    ids = [i for i in text if (text[i] or "").split()]
    links = [(a, b) for a in ids for b in ids if a < b and jaccard(text[a], text[b]) >= 0.8]
    real = {i: k for i, k in union_find(ids, links).items() if i != k}
    found = {r.doc_id: r.keep_id for r in S.near_duplicates(documents(spark, rows, extra=True)).collect()}
    assert found == real and len(real) > 30


def test_a_hot_group_of_near_copies_leaves_one(spark):
    base = words(7, 200)
    rows = [(i, edited(base, 1, i)) for i in range(300)] + [(1000 + i, words(i, 100)) for i in range(20)]
    df = documents(spark, rows)
    left = S.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in left.collect()) == [0, *range(1000, 1020)] and left.columns == df.columns


def test_families_in_shared_hot_buckets_equal_brute_force(spark):
    # texts of one long passage: buckets hold many families, most of whose members are apart from all leaders
    common, rows = words(1, 165), []
    for f in range(130):
        text = f"{common} {words(10_000 + f, 33)}"
        rows += [(2 * f, text), (2 * f + 1, edited(text, 4, f))]
    text = dict(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in text.items() for w in [t.split()]}
    links = [(a, b) for a in text for b in text if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    real = {i: k for i, k in union_find(list(text), links).items() if i != k}
    found = {r.doc_id: r.keep_id for r in S.near_duplicates(documents(spark, rows)).collect()}
    assert found == real and len(real) > 80


def test_code_of_long_lists_is_counted_in_blocks():
    h = [xxhash.xxh64_intdigest(str(i).encode()) for i in range(150_000)]
    bits = sum(np.unpackbits(np.array(h[i : i + 1000], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int) for i in range(0, len(h), 1000))
    assert S.code_of(h) == sum(1 << b for b in range(64) if bits[b] * 2 > len(h))


def test_links_are_the_same_however_many_keys_are_split(spark, monkeypatch):
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(4)]
    codes = {c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for c in centre for _ in range(60)} | {r.getrandbits(64) for _ in range(50)}
    signed = sorted(S._signed(c) for c in codes)
    real = union_find(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    table = spark.createDataFrame([(c,) for c in signed], "code long")
    for hot in (0, 3, 1000):
        monkeypatch.setattr(S, "HOT", hot)
        found = S.link_fingerprints(table).collect()
        assert union_find(signed, [(e.a, e.b) for e in found]) == real
        assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 2 for e in found)


def test_symbols_meet_within_the_ball_of_a_segment_and_not_beyond():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = S.symbols_of(h)
    two = one.copy()
    two[:, 0] += np.uint64(1)  # one symbol of each segment differs
    three = two.copy()
    three[:, 3] += np.uint64(1)
    keys = [set(S.symbol_balls(x).tolist()) for x in (one, two, three)]
    assert len(keys[0]) == S.NEAR_SEGMENTS * S.SYMBOLS
    assert len(keys[0] & keys[1]) == S.NEAR_SEGMENTS and not keys[0] & keys[2] and len(keys[1] & keys[2]) == S.NEAR_SEGMENTS


def test_shared_boilerplate_loses_no_pair_and_null_ids_stay(spark):
    # texts that are alike by a long common passage, but not enough, and pairs among them that are
    common, rows = words(3, 100), []
    rows += [(i, f"{common} {words(20_000 + i, 40)}") for i in range(120)]
    for k in range(100):
        text = f"{words(30_000 + k, 120)}"
        rows += [(1000 + 2 * k, text), (1001 + 2 * k, f"{text} {words(40_000 + k, 20)}")]
    found = {r.doc_id: r.keep_id for r in S.near_duplicates(documents(spark, rows)).collect()}
    assert found == {1001 + 2 * k: 1000 + 2 * k for k in range(100)}
    odd = [(None, rows[0][1]), (1, rows[0][1]), (1, rows[0][1]), (2, rows[0][1])]
    assert sorted(str(r.doc_id) for r in S.drop_near_duplicates(documents(spark, odd)).collect()) == ["1", "1", "None"]


def test_a_spread_join_equals_a_plain_one(spark, monkeypatch):
    from oddsframe.llm import common

    monkeypatch.setattr(common, "TOGETHER", 10)
    left = spark.range(500).selectExpr("id as x", "if(id % 3 = 0, 7, if(id % 50 = 1, null, id)) as k")
    right = spark.range(400).selectExpr("id as k", "id * 2 as y")
    for how in ("inner", "left"):
        assert sorted(map(str, common.spread_join(left, right, "k", how).select("x", "k", "y").collect())) == sorted(map(str, left.join(right, "k", how).select("x", "k", "y").collect()))


def test_blocks_connect_what_brute_force_connects(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.choice(10_000, 150, replace=False)
    sets = []
    for _ in range(60):
        x = base.copy()
        x[r.choice(150, r.integers(0, 25), replace=False)] = r.integers(20_000, 20_400, 1)
        sets.append(np.unique(x).astype(np.int32))
    component = np.array([i // 2 if i < 10 else i for i in range(60)]) * 7 - 3
    got = S.grown_together(sets, component, 0.8)
    same = [(i, j) for i in range(60) for j in range(i) if component[i] == component[j]]
    alike = [(i, j) for i in range(60) for j in range(i) if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)]
    assert union_find(range(60), same + got) == union_find(range(60), same + alike) and len(got) <= 60
    # the same groups come out however small the blocks are
    common, rows = words(1, 165), []
    for f in range(60):
        text = f"{common} {words(10_000 + f, 33)}"
        rows += [(2 * f, text), (2 * f + 1, edited(text, 4, f))]
    df = documents(spark, rows)
    want = sorted(map(tuple, S.near_duplicates(df).collect()))
    monkeypatch.setattr(S, "BLOCK", 9)
    assert sorted(map(tuple, S.near_duplicates(df).collect())) == want and len(want) > 30
