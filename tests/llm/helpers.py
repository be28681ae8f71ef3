"""Small tables for the tests of the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """rows: (doc_id, text[, lang]). extra: columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("score", "kept", "hits", "sha", "code", "uid", "shard", "length", "whole", "key"):
            df = df.selectExpr("*", f"'clash' as {name}")
    return df


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


#: Null and empty texts, white space alone, one word, ties, repeats, a very long text.
ODD = [(None, "no id here at all"), (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (5, "word"), (6, "x " * 50_000), (7, "Ünïcödé ß ſ K \u2003 end"), (8, None)]


def union_find(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}
