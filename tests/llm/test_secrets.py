import hashlib
import math
import random
import re
from collections import Counter

import pytest

from oddsframe.llm import secrets as S
from tests.llm.helpers import DOCS, ODD, documents, words


def brute(text):
    t, spans = text or "", []
    key = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(key + r"""["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, m.end()))
    return sorted(spans)


def texts():
    r = random.Random(6)
    hexs = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    out = []
    for i in range(150):
        kind = i % 6
        mid = [f'token = "{hexs(40)}"', f"PassWord: {hexs(3)}x", f"api_key='{hexs(12)}' secret=token: {hexs(8)}", "AKIA" + "".join(r.choice("ABCDEFGH234567") for _ in range(r.randint(10, 20))), hexs(r.randint(20, 30)), "nothing"][kind]
        out.append(f"{words(i, 10)} {mid} {words(i + 999, 5)}")
    return [*out, "ſecret=abcdef1", "toKen=abcdef1", "password=secret=abcdef", "é😀 token:abcdef", "AKIA AKIAAKIA" + "A" * 16, "passwd  =  'a.b/c+d-e_f=='"]


def test_base_spans_equal_brute_force(spark):
    rows = [*enumerate(texts()), *[(1000 + k, t) for k, (_, t) in enumerate(ODD)]]
    out = {r.doc_id: r for r in S.find_secrets(documents(spark, rows, extra=True)).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        want = brute(t)
        joined = ",".join(f"{S.KINDS[k]}:{a}:{z}" for a, k, z in want)
        r = out[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_automaton_merges_states_and_prefers_its_language():
    r = random.Random(1)
    strings = ["k" + "".join(r.choice("0h") for _ in range(30)) for _ in range(300)]
    a = S.Automaton(strings[50:])
    assert len(a.red) < 120  # the prefix tree has thousands of states
    own, other = a.log_likelihood(strings[0]), a.log_likelihood("kzzzz" + "z" * 26)
    assert own > other


def slow_merge(strings, alpha):
    """State merging by definition: states are sets of prefixes; counts are taken anew from all strings after every merge."""
    prefixes = sorted({s[:i] for s in strings for i in range(len(s) + 1)}, key=lambda p: (len(p), p))
    state = {p: p for p in prefixes}

    def counts():
        seen, stop, flow = Counter(), Counter(), Counter()
        for s in strings:
            for i in range(len(s) + 1):
                seen[state[s[:i]]] += 1
                if i < len(s):
                    flow[state[s[:i]], s[i]] += 1
            stop[state[s]] += 1
        return seen, stop, flow

    def after():
        return {(state[p[:-1]], p[-1]): state[p] for p in prefixes if p}

    def alike(a, b, seen, stop, flow, step):
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(seen[a]) + 1 / math.sqrt(seen[b]))
        letters = {c for s, c in step if s in (a, b)}
        if abs(stop[a] / seen[a] - stop[b] / seen[b]) > bound or any(abs(flow[a, c] / seen[a] - flow[b, c] / seen[b]) > bound for c in letters):
            return False
        return all(alike(step[a, c], step[b, c], seen, stop, flow, step) for c in letters if (a, c) in step and (b, c) in step)

    red, todo = [""], [("", c) for c in sorted({s[0] for s in strings if s})]
    while todo:
        (p, c), todo = todo[0], todo[1:]
        step = after()
        blue = step[p, c]
        if blue in red:
            continue
        same = next((r for r in red if alike(r, blue, *counts(), step)), None)
        if same is None:
            red.append(blue)
            todo += [(blue, d) for d in sorted(d for s, d in step if s == blue)]
            continue
        before = {(s, d) for s, d in step if s in red}
        for q in prefixes:  # everything below follows the merged state's ways, in order of length
            if state[q] == blue:
                state[q] = same
        changed = True
        while changed:
            changed, ways = False, {}
            for q in prefixes:
                if q:
                    way = ways.setdefault((state[q[:-1]], q[-1]), state[q])
                    if way != state[q]:
                        old = state[q]
                        keep = way if way in red or (old not in red and (len(way), way) <= (len(old), old)) else old
                        gone = old if keep == way else way
                        state.update({x: keep for x in prefixes if state[x] == gone})
                        changed = True
                        break
        todo += [(s, d) for s in red for s2, d in sorted(after()) if s2 == s and (s, d) not in before]
    seen, stop, flow = counts()
    return red, seen, stop, flow, after()


def test_automata_equal_merging_by_definition():
    for seed, letters, alpha in ((1, "ab", 0.05), (2, "abc", 0.05), (3, "ab", 0.8), (4, "a0", 0.5)):
        r = random.Random(seed)
        strings = [("k" if r.random() < 0.6 else "") + "".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(120)]
        a = S.Automaton(strings, alpha)
        red, seen, stop, flow, step = slow_merge(strings, alpha)
        assert len(a.red) == len(red) > 1
        assert [a.seen[s] for s in a.red] == [seen[s] for s in red] and [a.stop[s] for s in a.red] == [stop[s] for s in red]
        for x, y in zip(a.red, red, strict=True):
            assert {c: a.flow[x][c] for c in a.step[x]} == {c: flow[s, c] for s, c in step if s == y}
            assert {c: a.red.index(t) for c, t in a.step[x].items()} == {c: red.index(t) for (s, c), t in step.items() if s == y}
            assert a.seen[x] == a.stop[x] + sum(a.flow[x].values())


def test_every_candidate_is_scored_base_ones_too(spark):
    r = random.Random(8)
    rows = [(i, f"{words(i, 20)} token={r.getrandbits(128):032x} passwd=kk{i}kkk {words(i, 2)}") for i in range(200)]
    for x in S.find_secrets(documents(spark, rows)).collect():
        text = rows[x.doc_id][1]
        base = brute(text)
        runs = [m for m in S.CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base)]
        assert x.n_scored == len(base) + len(runs) and len(x.scores.split(",")) == len(x.spans.split(","))
        assert all(float(v) > -math.inf for v in x.scores.split(",")[:1])


def test_learned_format_is_found_without_its_keyword(spark):
    r = random.Random(2)
    code = lambda: "gh_" + "".join(r.choice("ABCDEFGHIJ0123456789") for _ in range(32))
    rows = [(i, f"{words(i, 30)} token={code()} {words(i + 500, 10)}") for i in range(300)] + [(900 + i, f"{words(i, 8)} {code()} {words(i, 4)}") for i in range(20)] + [(950 + i, words(i, 200)) for i in range(20)]
    out = {x.doc_id: x.spans for x in S.find_secrets(documents(spark, rows)).collect()}
    assert sum("format" in out[900 + i] for i in range(20)) >= 15
    assert not any("format" in out[950 + i] for i in range(20))


@pytest.mark.parametrize("n", [1, 5, 19, 20, 60])
def test_any_number_of_labelled_values_makes_an_automaton(spark, n):
    r = random.Random(7)
    code = lambda: "".join(r.choice("ABCDEFGHIJ0123456789") for _ in range(32))
    rows = [(i, f"{words(i, 30)} token={code()} {words(i + 500, 10)}") for i in range(n)] + [(900 + i, f"{words(i, 8)} {code()} {words(i, 4)}") for i in range(20)] + [(950 + i, words(i, 200)) for i in range(20)]
    out = {x.doc_id: x for x in S.find_secrets(documents(spark, rows)).collect()}
    assert all(x.n_scored > 0 for x in out.values()) and all(out[i].scores for i in range(n))
    assert not any("format" in out[950 + i].spans for i in range(20))
    if n >= 19:
        assert sum("format" in out[900 + i].spans for i in range(20)) >= 15


def test_thresholds_widen_with_few_values():
    few, many = ([(32, 1.0 + (k % 5) / 10) for k in range(n)] for n in (5, 300))
    assert all(S.LEAST_RATIO < a < b for a, b in zip(S.thresholds(few), S.thresholds(many), strict=True))
    assert S.thresholds([]) == [S.LEAST_RATIO] * len(S.LENGTHS)


def test_nothing_is_scored_without_values(spark):
    row = S.find_secrets(documents(spark, [(1, "plain words alone")])).first()
    assert (row.n_scored, row.scores, row.spans) == (0, "", "")


def test_a_kind_rare_among_many_documents_has_its_automaton(spark):
    r = random.Random(3)
    key = lambda: "AKIA" + "".join(r.choice("ABCDEFGH234567") for _ in range(16))
    rare = spark.createDataFrame([(key(),) for _ in range(40)], "text string")
    plain = spark.range(60_000).selectExpr("concat('plain words of text number ', id) as text")
    model = S.train(plain.union(rare))
    assert model is not None and len(model[0]) == 1


def test_ordinary_runs_come_from_whole_texts(spark):
    r = random.Random(4)
    rows = [(f"token={r.getrandbits(64):016x} " + "short of " * 700 + "UPPERCASE_" + "".join(r.choice("QRSTUVW") for _ in range(10)),) for _ in range(60)]
    ordinary = S.train(spark.createDataFrame(rows, "text string"))[1]
    assert "A" in ordinary.log and "_" in ordinary.log


def test_short_and_all_letter_or_all_digit_formats_are_found(spark):
    r = random.Random(5)
    for letters, n in (("QRSTUVWXYZ", 10), ("0123456789", 12), ("QRSTUVWXYZ", 24)):
        code = lambda: "".join(r.choice(letters) for _ in range(n))  # noqa: B023, E731
        rows = [(i, f"{words(i, 30)} token={code()} {words(i + 500, 10)}") for i in range(300)] + [(900 + i, f"{words(i, 8)} {code()} {words(i, 4)}") for i in range(20)] + [(950 + i, words(i, 200)) for i in range(20)]
        out = {x.doc_id: x.spans for x in S.find_secrets(documents(spark, rows)).collect()}
        assert sum("format" in out[900 + i] for i in range(20)) >= 15
        assert not any("format" in out[950 + i] for i in range(20))


def test_masking_and_empty(spark):
    df = documents(spark, [(1, "a token=abcdef1 b"), (2, None)])
    assert {r.doc_id: r.text for r in S.mask_secrets(df).collect()} == {1: "a [SECRET] b", 2: None}
    assert S.find_secrets(spark.createDataFrame([], DOCS)).count() == 0
