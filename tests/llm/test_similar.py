"""Near-duplicates at 5-word similarity 0.8 against all pairs."""

import random

import numpy as np

import corpus_pipeline
from quantloom.llm import similar
from tests.llm.test_operators import docs_of, prose


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots_of(rows, threshold=0.8):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if i < j and (a == b == set() or len(a & b) >= threshold * len(a | b) > 0) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    texts += [edited(rng, t, k % 7) for k, t in enumerate(texts)]
    hot = prose(rng, 300)
    texts += [edited(rng, hot, 3) for _ in range(30)]  # one group of near copies, around or over 0.8 in part
    texts += ["", "  ", "two words", "Two  words", prose(rng, 8)]
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


def test_similar_documents_against_all_pairs(spark):
    rows = corpus()
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs_of(spark, rows)).collect()}
    assert got == roots_of(rows) and 30 < len(set(got.values())) < len(rows) - 40


def test_dense_group_against_all_pairs(spark, monkeypatch):
    """A chain of near copies in a crowd, whose links aren't between neighbours of any order (F10)."""
    rng = random.Random(21)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, 1 + i % 4), "en", "s") for i in range(150)]
    want = roots_of(rows)
    monkeypatch.setattr(similar, "ORDERS", 4)  # fewer chances to be neighbours
    monkeypatch.setattr(similar, "_CHOSEN", similar._CHOSEN[:4, :9])
    monkeypatch.setattr(similar, "ROWS", 1)
    monkeypatch.setattr(similar, "TILE", 40)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs_of(spark, rows)).collect()}
    assert got == want and 1 < len(set(want.values())) < 150


def test_no_join_of_the_stage_is_broadcast(spark):
    """Whatever the planner thinks of sizes, nothing goes through the driver (F1)."""
    out = similar.similar_documents(docs_of(spark, corpus()))
    out.collect()  # the plan as it ran
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan


def test_linked_tiles_against_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 60)).astype(np.int32) for _ in range(60)]
    one, two = [(k, s) for k, s in enumerate(sets[:25])], [(100 + k % 3, s) for k, s in enumerate(sets[25:])]
    want = {(b, a) for a, s in one for b, t in two if len(np.intersect1d(s, t)) >= 0.7 * len(np.union1d(s, t))}

    def parts(links):
        root = {n: n for n in [a for a, _ in one] + [b for b, _ in two]}
        for u, v in links:
            low, high = sorted((root[u], root[v]))
            root = {k: low if r == high else r for k, r in root.items()}
        return root

    got = similar._linked(one, two, 0.7)
    assert set(got) <= want and parts(got) == parts(want) and 0 < len(got) < len(want)


def test_stage_drops_near_copies_with_edited_words(spark):
    rows = [r for r in corpus() if r[1].strip()]
    out = corpus_pipeline.near_dups(spark, docs_of(spark, rows), "")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(roots_of(rows).values()))


def test_rows_that_share_or_lack_an_id(spark):
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (1, b, "en", "s"), (2, a.upper(), "en", "s"), (None, c, "en", "s"), (None, c, "en", "s"), (None, d, "en", "s"), (3, d, "en", "s"), (4, None, None, None), (5, "", None, None)]
    out = corpus_pipeline.near_dups(spark, docs_of(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted([(1, a), (1, b), (0, c), (3, d), (4, "")])
    assert corpus_pipeline.near_dups(spark, docs_of(spark, []), "").collect() == []


def test_signatures_agree_as_sets_do():
    rng = random.Random(10)
    for n in (0, 2, 6, 20):
        text = prose(rng, 400)
        a, b = (similar.shingles(t.encode()) for t in (text, edited(rng, text, n)))
        jaccard = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        same = (similar.signature(a).view("u1") == similar.signature(b).view("u1")).mean()
        assert abs(same - jaccard) < 0.12


def test_agreement_is_counted_in_bytes(spark):
    rng = random.Random(11)
    rows = []
    for differing in (0, 1, 51, 52, 53, 160):
        x = [rng.randrange(256) for _ in range(160)]
        y = [v ^ (rng.randrange(1, 256) if i < differing else 0) for i, v in enumerate(x)]
        as_longs = lambda v: [int.from_bytes(bytes(v[i : i + 8]), "little", signed=True) for i in range(0, 160, 8)]
        rows.append((differing, as_longs(x), as_longs(y)))
    df = spark.createDataFrame(rows, "n int, p array<long>, q array<long>")
    assert {r["n"] for r in df.where(similar._agreeing("p", "q")).collect()} == {0, 1, 51, 52}
