"""Operators against brute force on small fixtures, and the edge cases that each must define."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import cnn, language, line_dedup, mixing, pseudonyms, quality_rules, simhash, suffix_dedup, toxicity
from quantloom.llm.decontaminate import decontaminate
from quantloom.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed") for b in ("", "tion", "ly", "ing", "ou", "ea")]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "One", "en", None), (4, "One", "en", None),
        (None, "no id here at all", "de", "b"), (5, long, "en", "b"), (6, "déjà vu ßtraße 日本語 \U0001f600", "fr", "a"), (7, "###", None, "b"),
    ]
    df = docs_of(spark, rows)
    for name in (
        "Score", "predicted", "taken", "FP", "kept", "component_id", "n_removed", "lang_pred", "n_hit", "size", "kinds", "n_words", "held_out",
        "rank", "budget", "ahead", "p_source", "limits", "rule", "bin", "node", "root", "least", "y", "k", "c", "at", "m", "__id", "__th", "__bytes", "__size", "__c0",
    ):
        df = df.withColumn(name, F.lit("mine"))
    return df


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def every_operator(spark):
    labels = labels_of(spark, [(1, 1, 0), (5, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1)])
    items = spark.createDataFrame([(1, "no id here at all"), (2, None), (3, ""), (None, "One")], "item_id long, text string")
    return {
        "toxicity": lambda d: toxicity.classify(d, labels),
        "language": language.classify,
        "decontaminate": lambda d: decontaminate(d, items),
        "pseudonyms": lambda d: pseudonyms.pseudonymize(d, b"key"),
        "suffix": suffix_dedup.dedup_substrings,
        "lines": lambda d: line_dedup.dedup_lines(d, report=True),
        "mixing": mixing.mix,
        "simhash": simhash.near_duplicates,
        "cnn": lambda d: cnn.classify(d, labels),
        "rules": quality_rules.quality_rules,
    }


OPERATORS = ["toxicity", "language", "decontaminate", "pseudonyms", "suffix", "lines", "mixing", "simhash", "cnn", "rules"]


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_clashing_columns(spark, name):
    df = awkward(spark)
    out = every_operator(spark)[name](df)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) == 9
    ids = Counter(r["doc_id"] for r in rows)
    assert ids == Counter([1, 2, 3, 4, 4, None, 5, 6, 7])
    same = [tuple(r) for r in rows if r["doc_id"] == 4]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert every_operator(spark)[name](docs_of(spark, [])).collect() == []


def test_no_labels_no_items(spark):
    d = docs_of(spark, [(1, "some words", "en", "a")])
    none = labels_of(spark, [])
    assert toxicity.classify(d, none).first()["predicted"] == 0
    assert 0 <= cnn.classify(d, none).first()["score"] <= 1
    assert decontaminate(d, spark.createDataFrame([], "item_id long, text string")).first()["n_hit"] == 0


# toxicity


def test_toxicity_finds_disguised_words(spark):
    rng = random.Random(1)
    bad = ["idiot", "moron", "stupid", "worthless"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 40).split()
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(toxic)))
    disguised = ["1d10t", "m0r0n", "stuuupid", "s t u p i d", "w0rthl3ss", "s-t-u-p-i-d", "m.o.r.o.n", "iDi0T"]
    for k, w in enumerate(disguised):
        rows.append((1000 + k, f"{prose(rng, 20)} {w} {prose(rng, 20)}", "en", "a"))
    rows += [(2000 + k, prose(rng, 30) + x, "en", "a") for k, x in enumerate([" version 2.0", " +1 (555)", " a a a a a", " B2B", "!!"])]
    out = {r["doc_id"]: r for r in toxicity.classify(docs_of(spark, rows), labels_of(spark, labels)).collect()}
    held = [(out[i]["predicted"], t) for i, _, t in labels if out[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(out[1000 + k]["predicted"] == 1 for k in range(len(disguised)))
    assert all(out[2000 + k]["predicted"] == 0 for k in range(5))


def test_restore_keeps_the_likeliest():
    table = toxicity.log_model(toxicity.trigrams([" ".join(["stupid moron idiot the then there"] * 50)]))
    assert toxicity.restore("5tup1d", table)[0][0] == "stupid"
    assert toxicity.restore("mooooron", table)[0][0] == "moron"
    assert "idiot" in toxicity.candidates("1d.i0t", table)


# language


def test_phrases_against_greedy_search():
    rng = random.Random(2)
    samples = {k: "".join(rng.choice(k * 3 + "abcde ") for _ in range(300)) for k in ("x", "y")}
    model = language.Model(samples)
    texts = [language.fold("".join(rng.choice("abcdexyzé日 ") for _ in range(n))) for n in [*range(1, 40), 513, 700, 1024, 5000, 20_000, 0]]
    texts.append(language.fold("a" * 3000 + samples["x"] * 20))  # matches that cross the pieces
    want = [[bool(t) + misses(t, language.fold(samples[k])) for k in model.langs] for t in texts]
    assert model.phrases(texts).tolist() == want
    assert [model.phrases([t])[0].tolist() for t in texts[-4:]] == want[-4:]


def test_languages_over_many_letters():
    """Two invented languages over the same 1,500 letters, which differ in what follows what."""
    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(1500)]
    pairs = {k: [[rng.choice(letters) for _ in range(2)] for _ in range(700)] for k in ("aa", "bb")}
    write = lambda k, n: "".join(x for _ in range(n) for x in rng.choice(pairs[k]))
    model = language.Model({k: write(k, 4000) for k in pairs})
    got = [model.predict([write(k, 40)])[0][0] == k for k in pairs for _ in range(60)]
    assert sum(got) >= 118


def test_unequal_samples_are_normalised():
    rng = random.Random(7)
    vocab = {"aa": [w for w in WORDS], "bb": [w[::-1] for w in WORDS]}
    model = language.Model({"aa": prose(rng, 8000, vocab["aa"]), "bb": prose(rng, 150, vocab["bb"])})
    assert all(model.predict([prose(rng, 30, vocab[k])])[0][0] == k for k in vocab for _ in range(30))


def misses(text, sample):
    """A miss on an unseen byte starts a phrase at the next one."""
    start, n = 0, 0
    for i in range(len(text)):
        if text[start : i + 1] not in sample:
            n += 1
            start = i if text[i : i + 1] in sample else i + 1
    return n


def test_language_held_out(spark):
    rng = random.Random(3)
    vocab = {"en": WORDS, "xx": ["zu" + w[::-1] for w in WORDS], "yy": ["é" + w + "o" for w in WORDS]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(vocab))
        rows.append((i, prose(rng, rng.randrange(5, 60), vocab[lang]), lang, "a"))
    rows.append((900, "12 34 --", "en", "a"))
    out = {r["doc_id"]: r for r in language.classify(docs_of(spark, rows)).collect()}
    held = [out[i]["lang_pred"] == lang for i, _, lang, _ in rows[:300] if out[i]["held_out"]]
    assert sum(held) >= 0.95 * len(held) and len(held) > 30
    assert out[900]["lang_pred"] == "und" and out[900]["score"] == 0


# decontamination


def contamination(text, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = word.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = word.findall(lower(t))
        wins = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        for win in wins:
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_decontaminate(spark, block):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate([5, 13, 14, 40, 30, 1])] + [(10, "Ünïcode Wörter sind auch dabei"), (11, None)]
    rows = []
    for i in range(40):
        parts = [prose(rng, 20)]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items[:-1])[1]).split()
            a = rng.randrange(len(w))
            parts += ["; ".join(w[a:] if rng.random() < 0.5 else w).upper(), prose(rng, 5)]
        rows.append((i, "\n".join(parts), "en", "a"))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r[1:6]) for r in decontaminate(docs_of(spark, rows), df, keep=["doc_id"], block_bytes=block).collect()}
    assert got == {i: contamination(t, items) for i, t, _, _ in rows}


def test_hit_spans_map_to_the_text(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    row = decontaminate(docs_of(spark, [(1, "Ää -- ALPHA, Beta\ngamma! end", "en", "a")]), items, spans=True).first()
    (a, b), = row["hit_spans"]
    assert "Ää -- ALPHA, Beta\ngamma! end".encode()[a:b] == b"ALPHA, Beta\ngamma"


# pseudonyms


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 10, 97, 1000, 4097):
        net = pseudonyms.Feistel(b"k", "t", size)
        out = [net.walk(x) for x in range(size)]
        assert sorted(out) == list(range(size))
        assert [net.walk(y, back=True) for y in out] == list(range(size))


def test_pseudonyms_round_trip_and_link(spark):
    card = "411111111111111" + pseudonyms.luhn_digit("411111111111111")
    text = (
        f"card {card} and {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} not 4111111111111112, born 1980-02-29 not 1981-02-29, "
        "paid 03/04/2021, am 13.12.2020, on 5 May 2019, March 3, 1999, ssn 123-45-6789, DE89 3704 0044 0532 0130 00, "
        "call +1 (017) 555-7713 or (415) 555-0100, host 51.17.173.3, v1.2.3.4.5, mail jo.doe.55@mail9.example.com"
    )
    rows = [(1, text, "en", "a"), (2, f"again {card} 1980-02-29", "en", "b"), (3, None, None, None), (4, "plain words only", "en", "a")]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymize(docs_of(spark, rows), b"key").collect()}
    new = out[1]["text"]
    vault = pseudonyms.Vault(b"key")
    assert vault.reveal(new) == text and new != text
    for value in (card, "1980-02-29", "123-45-6789", "555-7713", "51.17.173.3", "jo.doe.55"):
        assert value not in new
    assert "4111111111111112" in new and "1981-02-29" in new and "v1.2.3.4.5" in new
    pseudonym = re.search(r"card (\d{16})", new).group(1)
    assert pseudonyms.luhn_digit(pseudonym[:-1]) == pseudonym[-1] and len(pseudonym) == len(card)
    assert f"again {pseudonym}" in out[2]["text"]  # equal values stay linked across documents
    assert re.search(r"and ([\d ]{19})", new).group(1).replace(" ", "") == pseudonym  # and across layouts
    assert out[1]["n_replaced"] == 13 and "card=2" in out[1]["kinds"]
    assert out[3]["text"] is None and out[4]["text"] == "plain words only" and out[4]["n_replaced"] == 0


def test_dates_permute_within_each_layout():
    vault = pseudonyms.Vault(b"x")
    rng = random.Random(6)
    for _ in range(300):
        y, m, d = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29)
        iso, dotted, slashed = f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y}"
        new = vault.redact(iso)[0]
        assert vault.redact(dotted)[0] == ".".join(reversed(new.split("-")))
        assert vault.redact(slashed)[0] == "/".join((new[5:7], new[8:], new[:4]))
        assert vault.reveal(new) == iso


# suffix dedup


def removed(texts, span):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        cover = [False] * len(t)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                cover[i : i + span] = [True] * span
        runs = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((len(t), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("meeting", [1024, 1])
def test_suffix_dedup(spark, meeting):
    rng = random.Random(7)
    passage = prose(rng, 200)
    texts = [prose(rng, rng.randrange(50, 400)) for _ in range(12)]
    for _ in range(25):  # one passage, cut and surrounded differently each time
        a, b = sorted(rng.sample(range(len(passage)), 2))
        texts.append(prose(rng, rng.randrange(40)) + passage[a:b] + rng.choice(["", "é", " x"]) + prose(rng, rng.randrange(40)))
    texts += [texts[0], texts[0], "ab" * 500, "z" * 900, passage + passage, "", None, passage[:399], passage[:400]]
    near = list(texts[1])
    near[len(near) // 2] = "?"
    texts.append("".join(near))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r[1:5]) for r in suffix_dedup.dedup_substrings(docs_of(spark, rows), keep=["doc_id"], meeting=meeting).collect()}
    want = removed([(t or "").encode() for t in texts], 400)
    assert got == dict(enumerate(want))


def test_suffix_dedup_counts_equal_rows(spark):
    text = prose(random.Random(8), 150)
    out = suffix_dedup.dedup_substrings(docs_of(spark, [(1, text, "en", "a")] * 2 + [(2, text[:300], "en", "a")]), keep=["doc_id"]).collect()
    assert [(r["n_removed"], r["n_spans"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [(len(text), 1)] * 2 + [(0, 0)]


# line dedup


def line_chunks(text):
    """(first line, lines) of each chunk."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    mark = [i > 0 and ((h[i - 1] * 31 + h[i]) % 2**32 >> 16) % line_dedup.EVERY == 0 for i in range(len(lines))]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (mark[i] and not mark[i - 1] and i != len(lines) - 2):
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return out


def deduped(texts):
    """Texts in the order of their ids -> texts without lines that repeat in chunks or neighbouring pairs."""
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        lines, gone, told = t.split("\n"), set(), lambda x: bool(x.strip(" "))
        units = [(at, c) for at, c in line_chunks(t) if len(c) > 1 and sum(map(told, c)) > 1]
        units = [("c", at, c) for at, c in units] + [("p", i, lines[i : i + 2]) for i in range(len(lines) - 1) if told(lines[i]) and told(lines[i + 1])]
        for kind, at, c in units:
            if (kind, *c) in seen:
                gone.update(range(at, at + len(c)))
            seen.add((kind, *c))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(9)
    shared = [prose(rng, 6) for _ in range(30)]
    texts = []
    for _ in range(40):
        lines = [prose(rng, 5) for _ in range(rng.randrange(4))]
        a = rng.randrange(25)
        lines += shared[a : a + rng.randrange(12)] + ["", "  "][: rng.randrange(3)] + [prose(rng, 4) for _ in range(rng.randrange(4))]
        texts.append("\n".join(lines))
    texts += [texts[0], "", None, "\n\n\n", "\n\n\n", "x\nx\nx\nx"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    want = deduped(texts)
    assert got == dict(enumerate(want)) and sum(a != b for a, b in zip(texts, want, strict=True)) > 10
    assert got[40] == "" and got[45] == "x" and "python" not in line_dedup.dedup_lines(docs_of(spark, rows))._jdf.queryExecution().executedPlan().toString().lower()
    counts = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark, rows), report=True).collect()}
    for i, t in enumerate(texts):
        n = 0 if t is None else len(t.split("\n"))
        assert counts[i]["n_lines"] == n and counts[i]["n_chunks"] == (0 if t is None else len(line_chunks(t)))
        assert counts[i]["text"] == want[i] and counts[i]["n_removed"] >= 0


def test_every_line_is_left_somewhere_and_passages_go_whole(spark):
    rng = random.Random(12)
    passage = [[prose(rng, 12) for _ in range(n)] for n in (2, 3, 4, 5, 8)]
    texts = ["\n".join([prose(rng, 9) for _ in range(rng.randrange(1, 6))] + rng.choice(passage) + [prose(rng, 9) for _ in range(rng.randrange(1, 6))]) for _ in range(60)]
    rows = [(f"d{i:03}", t) for i, t in enumerate(texts)]  # ids are texts
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    left = Counter(x for lines in got.values() for x in lines)
    assert {x for t in texts for x in t.split("\n")} == set(left) and set(left.values()) == {1}


# mixing


@pytest.mark.parametrize("sizes", [{"a": 400, "b": 300, "c": 50, None: 80}, {"a": 20, "b": 900}, {None: 30}])
def test_mixing_reaches_targets(spark, sizes):
    rng = random.Random(10)
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, prose(rng, rng.randrange(1, 30)), "en", s))
            k += 1
    rows.append((k, None, "en", "a" if "a" in sizes else None))
    out = mixing.mix(docs_of(spark, rows), keep=["doc_id", "source"]).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    names = sorted([s for s in size if s is not None]) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= weight[s] * level}
        for s in full or open_:
            want[s] = 2 * size[s] if full else weight[s] * level
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 30
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    again = mixing.mix(docs_of(spark, rows[::-1]), keep=["doc_id", "source"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


# SimHash


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [48, 2])
def test_near_duplicates(spark, bucket):
    rng = random.Random(11)
    texts = ["", None, "One", "ONE", "a b", "...", "é Ü x y z"]
    for _ in range(12):
        base = prose(rng, 200).split()
        texts.append(" ".join(base))
        for _ in range(8):
            w = list(base)
            w[rng.randrange(200)] = "zzz"
            texts.append(" ".join(w))
    rows = [(i + 5, t, "en", "a") for i, t in enumerate(texts)]
    fps = {i: simhash_of(t) for i, t, _, _ in rows}
    want = classes(list(fps), fps)
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, rows), bucket=bucket).collect()}
    assert {i: r["fingerprint"] for i, r in out.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert len(set(want.values())) < len(want) - 20


def test_links_between_random_fingerprints(spark):
    rng = random.Random(12)
    fps = []
    for _ in range(40):
        f = rng.getrandbits(64)
        fps += [f, f ^ (1 << rng.randrange(64)), f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), f ^ 7]
    fps = sorted(set(fps))
    want = classes(fps, {f: f for f in fps})
    for bucket in (48, 1):
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
        got = {(r["node"] % 2**64): r["root"] % 2**64 for r in components(simhash.links(df, bucket)).collect()}
        groups = lambda m: sorted(sorted(x for x in fps if m.get(x, x) == r) for r in {m.get(x, x) for x in fps})
        assert groups(got) == groups(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}


# quality classifier


def test_cnn_held_out(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        t = prose(rng, rng.randrange(10, 300))
        if bad:
            t = prose(rng, 10) + "\n" + " ".join(w + rng.choice(["***", "###", "$$$"]) for w in t.split())
        rows.append((i, t, "en", "a"))
        labels.append((i, int(not bad), 0))
    out = {r["doc_id"]: r for r in cnn.classify(docs_of(spark, rows), labels_of(spark, labels)).collect()}
    held = [(out[i]["predicted"], q) for i, q, _ in labels if out[i]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())


def test_cnn_sees_the_whole_text():
    import numpy as np

    net = cnn.Network(3).freeze()
    for n in (0, 1, 255, 256, 257, 480, 481, 5000, 140_000):
        first = cnn.starts(n)
        assert first[0] == 0 and first[-1] + cnn.CHUNK >= n and (np.diff(first) <= cnn.HOP).all()
    data = np.random.default_rng(0).integers(0, 256, (3, cnn.CHUNK), dtype=np.uint8)
    w = net.p["filters"]
    plain = np.stack([
        np.maximum(max((net.p["embed"][row[t : t + cnn.KERNEL]].ravel() @ w).astype(float)[f] for t in range(0, cnn.CHUNK - cnn.KERNEL + 1, cnn.STRIDE)) + net.p["bias"][f], 0)
        for row in data for f in range(cnn.FILTERS)
    ]).reshape(3, -1)
    assert np.allclose(net.pooled(data), plain, atol=1e-4)
    text = bytes(data[0]) * 900  # over several blocks
    assert net.scores([text])[0] == pytest.approx(net.scores([b"", text, None])[1])


# quality rules


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark):
    rng = random.Random(14)
    rows = []
    for i in range(400):
        t = "\n".join(prose(rng, rng.randrange(5, 30)) for _ in range(4))
        if i % 10 == 0:
            t = " ".join(w + "##" for w in t.split())
        if i % 17 == 0:
            t += "\n" + t
        if i % 23 == 0:
            t = "é ß " + t.replace("th", "日")
        rows.append((i, t, "en" if i % 3 else "de", f"s{i % 2}"))
    rows += [(900, "short one", "en", "s0"), (901, " ".join(["word"] * 50), "en", "s0"), (902, None, "en", "s0")]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs_of(spark, rows)).collect()}
    for i, t, _, _ in rows:
        want = base_counts(t)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    clean = [i for i in range(400) if i % 10 and i % 17]
    assert all(out[i]["kept"] for i in clean)
    assert not any(out[i]["kept"] for i in range(0, 400, 10))


def test_sketch_quantiles(spark):
    rng = random.Random(15)
    values = {("en", "a"): [rng.lognormvariate(0, 1) for _ in range(500)], ("en", None): [rng.random() for _ in range(300)]}
    rows = [(lang, s, 1000, int(v * 1000), 0, 0, 0) for (lang, s), vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "lang string, source string, n_words long, n_symbols long, n_repeat_words long, n_dup_lines long, word_chars long")
    limits = {(r["lang"], r["source"]): r["limits"] for r in quality_rules.thresholds(df).collect()}
    own = {k: spread_limit(vs) for k, vs in values.items()}
    overall = spread_limit([v for vs in values.values() for v in vs])  # of the language too: there is one
    for key, vs in values.items():
        want = (len(vs) * own[key] + quality_rules.PRIOR * overall) / (len(vs) + quality_rules.PRIOR)
        assert limits[key]["symbols_per_word"] == pytest.approx(want, rel=0.12)
        assert limits[key]["repeat_share"] == pytest.approx(quality_rules.RULES["repeat_share"][2])  # no spread


def spread_limit(values):
    vs = sorted(int(v * 1000) / 1000 for v in values)
    mid, up = vs[(len(vs) + 1) // 2 - 1], vs[-(-len(vs) * 3 // 4) - 1]
    return mid + quality_rules.SPREAD * (up - mid)


def test_limits_follow_the_group(spark):
    """What is far outside its own group goes, though the other group is full of it; a lone row leans on its language."""
    rng = random.Random(16)
    wordy = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(n - 1, n + 2))) for _ in range(60))
    rows = [(i, wordy(5), "en", "short") for i in range(300)] + [(300 + i, wordy(12), "de", "long") for i in range(300)]
    rows += [(900, wordy(12), "en", "short"), (901, wordy(5), "de", "long"), (902, wordy(5), "en", "rare"), (904, wordy(5), None, None)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs_of(spark, rows)).collect()}
    assert all(out[i]["kept"] for i in range(600))
    assert out[900]["broken"] == ["chars_per_word"] and out[901]["broken"] == ["chars_per_word_low"]
    assert out[902]["kept"] and out[904]["kept"]
