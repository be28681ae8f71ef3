import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from oddsframe.llm import queries  # noqa: E402
from oddsframe.llm.common import clear_scratch, components, materialise  # noqa: E402
from tests.llm.helpers import documents, union_find, words  # noqa: E402


def fixture(spark, folder):
    base = [(i, words(i, 120)) for i in range(60)]
    item = words(777, 30)
    rows = base + [(100 + i, words(i, 120)) for i in range(5)]
    rows += [(200 + i, " ".join([*words(i, 120).split()[:-1], "edit"])) for i in range(10, 14)]
    rows += [(300, words(50, 40) + " " + item + " " + words(51, 40))]
    rows += [(400 + i, words(600 + i, 60) + " idiot scum " + words(700 + i, 20)) for i in range(80)]
    labels = [(400 + i, 0, 1) for i in range(80)] + [(i, 1, 0) for i in range(60)]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return set(range(60))


def test_stages_drop_what_was_planted_and_nothing_else(spark, tmp_path):
    keep = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == columns, name
        left.append({r.doc_id for r in docs.collect()})
    assert not any(i >= 400 for i in left[0]) and keep <= left[0]
    assert left[0] - left[1] == {100 + i for i in range(5)}
    assert left[1] - left[2] == {200 + i for i in range(10, 14)}
    assert left[2] - left[3] == {300} and left[3] == keep
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == keep


def test_the_whole_pipeline_equals_brute_force(spark, tmp_path):
    """What toxicity leaves is taken as given (its accuracy is tested by itself); the rest is done anew by plain loops."""
    import random

    from oddsframe.llm import decontaminate as D

    r, folder = random.Random(7), str(tmp_path)
    fixture(spark, folder)
    items = [(i, words(9000 + i, 15 + i)) for i in range(12)]
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    for k in range(60):  # near copies of all degrees, copies in other white space, benchmark items with edits
        w = words(k, 120).split()
        for _ in range(k % 12):
            w[r.randrange(len(w))] = words(r.randrange(10**6), 1)
        rows.append((1000 + k, " ".join(w) if k % 3 else "\t\n".join(w)))
        item = list(items[k % 12][1])
        for _ in range(k % 5):
            item[r.randrange(len(item))] = "q"
        rows.append((2000 + k, f"{words(3000 + k, 50)} {''.join(item)} {words(4000 + k, 50)}"))
    rows += [(None, "a text without an id"), (5000, None), (5001, ""), (5002, " ")]
    other = tmp_path / "more"
    other.mkdir()
    documents(spark, rows).write.parquet(f"{other}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{other}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{other}/benchmark.parquet")
    clean = [(x.doc_id, x.text) for x in corpus_pipeline.toxicity_stage(spark, spark.read.parquet(f"{other}/documents.parquet"), str(other)).collect()]
    assert 400 > len(clean) > 150
    by_text: dict = {}
    for i, t in clean:
        by_text.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i, t))
    unique = [min(g, key=lambda x: (x[0] is None, x[0])) for g in by_text.values()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else None for i, t in unique if i is not None}
    known = [i for i, x in sets.items() if x]
    links = [(a, b) for a in known for b in known if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    top = union_find(known, links)
    left = [(i, t) for i, t in unique if top.get(i, i) == i]
    patterns = [D._trimmed(D.normalise(t)[0]) for _, t in items]
    leaks = {i for i, t in left for p in patterns if D.edit_search(p, D.normalise(t or "")[0])[0] <= int(D.EDITS * len(p))}
    want = sorted(str(i) for i, _ in left if i not in leaks)
    assert len(links) > 10 and len(leaks) > 20
    assert sorted(str(x.doc_id) for x in corpus_pipeline.run(spark, str(other)).collect()) == want


def test_stages_of_an_empty_table(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.count() == 0


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (2000, 2001), (2001, 2002), (2002, 2000)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == union_find({x for e in edges for x in e}, edges)


def test_scratch_tables_can_be_cleared(spark):
    t = materialise(spark.range(5), "t")
    path = t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert os.path.isdir(path) and clear_scratch(spark) >= 1 and not os.path.exists(path) and clear_scratch(spark) == 0
