"""The lattice search against all readings of a token, and disguises of every length."""

import itertools
import random
from math import exp

import pytest

from quantloom.llm import toxicity
from quantloom.llm.toxicity import code
from tests.llm.test_operators import docs_of, labels_of, prose


@pytest.fixture(scope="module")
def model():
    return toxicity.log_model(toxicity.trigrams([" ".join(["you are a stupid moron idiot and the then there worthless"] * 50)]))


def readings(token, model):
    """Every text behind a token with the log probability of its likeliest reading."""
    found = {}
    for picked in itertools.product(*(toxicity.options(token, i) for i in range(len(token)))):
        text, cost, a, b = "", 0.0, 0, 0
        for x, c in picked:
            cost += c
            if x == " " and b == 0:
                break
            if x:
                cost, a, b, text = cost + float(model[a, b, code(x)]), b, code(x), text + x
        else:
            if text:
                found[text] = max(found.get(text, -1e9), cost + (float(model[a, b, 0]) if b else 0.0))
    return found


def test_restore_against_every_reading(model):
    rng = random.Random(4)
    tokens = ["5tup1d", "m0rr00n", "i.d.i.o.t", "y o u", "1d10t!", "wo*th", "a--b", "66", "st*p1d"]
    tokens += ["".join(rng.choice("stu1.o0 d-*aa") for _ in range(7)) for _ in range(60)]
    for token in tokens:
        want = sorted(readings(token, model).items(), key=lambda x: -x[1])[:4]
        got = toxicity.restore(token, model, 4)
        assert len(got) == len(want), token
        total = sum(exp(p - want[0][1]) for _, p in want) if want else 1
        assert [s for _, s in got] == pytest.approx([exp(p - want[0][1]) / total for _, p in want]), token
        if len(want) > 1 and want[0][1] - want[1][1] > 1e-9:
            assert got[0][0] == want[0][0]


def test_long_tokens_are_restored(model):
    padded = "s" + "." * 20 + "t" + "." * 20 + "u" + "." * 20 + "p.1.d"
    assert "stupid" in toxicity.candidates(padded, model)
    assert "moron" in toxicity.candidates("m" + "o" * 300 + "ron", model)
    assert {"idiot", "moron"} <= set(toxicity.candidates(".".join(["you", "are", "an", "1d10t", "and", "a", "m0r0n"] * 6), model))


def test_doubled_letters_short_and_joined_spellings(model):
    assert "idiot" in toxicity.candidates("iddiott", model) and "idiot" not in toxicity.candidates("iddiott", model, lambda w: False)
    assert any("y o u" in t for t in toxicity.tokens("so y o u there"))
    spelled = max(toxicity.tokens("well y o u  i d i o t there"), key=len)
    assert {"you", "idiot"} & set(toxicity.candidates(spelled, model)) and "idiot" in toxicity.candidates("i d i o t", model)
    assert "stupid" in toxicity.candidates("$tupid!!", model)


def test_worth_never_hides_a_restoration(model):
    counts = {"idio-": (90, 0), "idiot": (90, 0), "scum": (90, 0)}
    m = toxicity.Model(model, counts, 100, 100, 0.5)
    for word in ("iddiott", "iiddiot", "sccumm", "idioot", "scum", "moon"):
        free = max(m.of_word(w) for w in toxicity.candidates(word, model))
        assert m.token(word)[0] == free


def test_several_words_of_one_stem_tell_more_than_one(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        stems = [f"zorb{rng.choice('abcdefgh')}{rng.choice('klmn')}" for _ in range(3 if toxic else int(i % 6 == 1))]
        rows.append((i, f"{prose(rng, 20)} {' '.join(stems)} {prose(rng, 20)}", "en", "a"))
        labels.append((i, 1, int(toxic)))
    out = {r["doc_id"]: r for r in toxicity.classify(docs_of(spark, rows), labels_of(spark, labels)).collect()}
    held = [(out[i]["predicted"], t) for i, _, t in labels if out[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
