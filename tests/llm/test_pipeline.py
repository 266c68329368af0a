"""The pipeline, stage by stage, on a small table written as the driver's are."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quantloom.llm import cnn, mixing
from tests.llm.test_operators import WORDS, contamination, docs_of, labels_of, prose
from tests.llm.test_similar import roots_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(20)
    at = tmp_path_factory.mktemp("sf")
    items = [(i, prose(rng, 20)) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        text = "\n".join(prose(rng, rng.randrange(6, 25)) for _ in range(rng.randrange(3, 9)))
        if i % 5 == 0:
            text = "\n".join(" ".join(w + "###" for w in x.split()) for x in text.split("\n"))
        if i % 31 == 7:
            text += "\n" + items[i % 5][1]
        rows.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, int(i % 5 != 0), 0))
    for i in range(300, 312):  # copies, and a near copy that differs in one word
        base = rows[i - 299][1]
        rows.append((i, base if i % 2 else base.replace(base.split()[9], "zzz", 1), "en", "s1"))
    docs_of(spark, rows).write.parquet(f"{at}/documents.parquet")
    labels_of(spark, labels).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def test_stages_have_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None and len(WORDS) > 10


def test_each_stage_against_brute_force(spark, folder):
    at, rows, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in kept.collect()}
        out = stage(spark, kept, at)
        after = {r["doc_id"]: r for r in out.collect()}
        assert len(after) == out.count()
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            scores = {r["doc_id"]: r["predicted"] for r in cnn.classify(docs, spark.read.parquet(f"{at}/labels.parquet")).collect()}
            assert set(after) == {i for i, p in scores.items() if p}
            assert sum(i % 5 == 0 for i in after if i < 260) <= 3 and sum(i % 5 != 0 for i in after if i < 260) >= 200
        if k == 1:
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert any(after[i]["text"] != before[i]["text"] for i in after)
            assert all(set(Counter(r["text"].split("\n"))) <= {*before[i]["text"].split("\n"), ""} for i, r in after.items())
        if k == 2:
            roots = roots_of([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i, r in roots.items() if i == r} and len(after) < len(before)
        if k == 3:
            assert set(after) == {i for i, r in before.items() if not contamination(r["text"], items)[4]}
            assert len(after) < len(before)
        if k == 4:
            mixed = {r["doc_id"]: r["taken"] for r in mixing.mix(kept, keep=["doc_id"]).collect()}
            assert {i: r["taken"] for i, r in after.items()} == {i: t for i, t in mixed.items() if t > 0}
            return
        out.write.parquet(f"{at}/stage{k}")
        kept = spark.read.parquet(f"{at}/stage{k}")


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.where("taken > 0").count() == out.count() > 50
