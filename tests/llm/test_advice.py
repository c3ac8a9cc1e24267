"""Whole jobs where an operator once took a short cut."""

import random

import numpy as np

from spindle.llm import compact_windows, langid, line_templates, simhash

RNG = random.Random(11)


def word(n=8):
    return "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_op3_wide_leaf_is_generalised(spark):
    """Over MAX_LEAF variable lines of one template, one in each text."""
    own = [f"{word()} {word()} {word()} {word()}" for _ in range(2_000)]
    texts = [f"This page was last edited by {word()}\n{o}" for o in own]
    got = line_templates.drop_lines(docs_of(spark, texts)).collect()
    assert sorted(r["text"] for r in got) == sorted(own)


def test_op3_wide_leaf_of_different_lines(spark):
    """Templates of ten lines each among many lines that share nothing but the leaf: batches don't narrow it."""
    rare = [" ".join(["the first time", *(word() for _ in range(6))]) for _ in range(3)]
    hit = [f"{r} {word()}" for r in rare for _ in range(12)]
    other = [" ".join(["the first time", *(word() for _ in range(7))]) for _ in range(1_600)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_lines(docs_of(spark, hit + other)).collect()}
    assert [k for k in sorted(got) if got[k] == ""] == list(range(len(hit)))
    assert all(got[len(hit) + i] == t for i, t in enumerate(other))


def test_op3_wide_leaves_of_several_rounds(spark):
    """Leaves that end in different rounds keep their lines."""
    many = [f"alpha beta gamma delta {word()}" for _ in range(60)]
    mixed = [" ".join(["one two three", *(k * 3 for k in "abcd"), word()]) for _ in range(40)] + [" ".join(["one two three", *(word() for _ in range(5))]) for _ in range(40)]
    lines, found = line_templates.templates(docs_of(spark, many + mixed).withColumnRenamed("doc_id", "row"), "text", "row", 0.7, 10, max_leaf=8)
    got = {r["template"]: r["n_docs"] for r in found.select("template", "n_docs").distinct().collect()}
    assert got == {"alpha beta gamma delta <*>": 60, "one two three aaa bbb ccc ddd <*>": 40}
    assert found.count() == 100 and lines.count() == 140


def words(n):
    return " ".join(word(6) for _ in range(n))


def test_op8_passage_once_here_and_twice_there(spark):
    """In both orders of the keys, which are hashes of the texts."""
    texts, once = [], {}
    for k in range(8):
        passage = words(54)
        once[2 * k] = f"{words(30)} {passage} {words(40)}"
        texts += [once[2 * k], f"{words(70)} {passage} {words(80)} {passage} {words(50)}"]
    docs = docs_of(spark, texts)
    keys = [r["k"] for r in docs.selectExpr("xxhash64(text) k").collect()]
    assert {keys[i] < keys[i + 1] for i in range(0, 16, 2)} == {True, False}
    got = {r["doc_id"]: r for r in compact_windows.near_passages(docs).collect()}
    assert [got[i]["n_links"] for i in range(16)] == [1] * 16
    assert [got[i]["class_id"] for i in range(16)] == [i - i % 2 for i in range(16)]
    holds = lambda r, f, t: any(s["f"] <= f + 2 and t - 2 <= s["t"] for s in r["spans"])
    for i in range(0, 16, 2):
        assert holds(got[i], 30, 84) and holds(got[i + 1], 70, 124) and holds(got[i + 1], 204, 258)


def test_op8_verify_parts_places_by_diagonal():
    """Two functions that join at different places: every neighbour is on the other copy's diagonal."""
    some = lambda n: np.array([RNG.getrandbits(32) for _ in range(n)], np.uint32)
    a = some(54)
    b = np.concatenate([some(70), a, some(76), a, some(50)])
    at = lambda *v: np.array(v, np.int64)
    fa, fb = compact_windows.verify(a, 0, b, 0, at(0, 0, 1, 1), at(10, 10, 30, 30), at(80, 210, 100, 230), 0.8)
    assert fa and all(any(f <= q + 2 and q + 52 <= t for f, t in fb) for q in (70, 200))


def test_near_dedup_finds_isolated_pairs(spark):
    """Pairs of texts at a similarity of 0.80 to 0.82 with no third copy, which share a common line."""
    texts = []
    for k in range(150):
        w = words(200).split()
        v = list(w)
        for at in (20, 60, 100, 140):
            v[at] = word(7)
        v += [word(7), word(7)] if k % 2 else []
        texts += [" ".join(w), " ".join(v)]
    like = lambda a, b: len(a & b) / len(a | b)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    assert {round(like(sets[i], sets[i + 1]), 2) for i in range(0, 300, 2)} <= {0.8, 0.81, 0.82}
    kept = {r["doc_id"] for r in simhash.near_dedup(docs_of(spark, texts)).collect()}
    assert kept == set(range(0, 300, 2))


def test_near_dedup_common_shingles(spark, monkeypatch):
    """Shingles that most texts share are put last, and no pair is lost."""
    monkeypatch.setattr(simhash, "COMMON", 5)
    line = words(60)
    texts = []
    for _ in range(20):
        w = words(100).split()
        v = list(w)
        v[30] = v[70] = "other"
        texts += [" ".join([line, *w]), " ".join([*v, line])]
    kept = {r["doc_id"] for r in simhash.near_dedup(docs_of(spark, texts)).collect()}
    assert kept == set(range(0, 40, 2))


def test_op5_language_of_long_texts_only(spark):
    """A language whose labelled texts are all longer than PIECE has a dictionary."""
    own = {lang: [word(7) for _ in range(200)] for lang in ("aa", "bb")}
    say = lambda lang, n: " ".join(RNG.choice(own[lang]) for _ in range(n))
    rows = [(k, "1 " * 20_000 * (lang == "bb") + say(lang, 4_000 if lang == "bb" else 300), lang) for k, lang in enumerate(["aa", "bb"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(r[1]) for r in rows if r[2] == "bb") > langid.PIECE
    made = langid.learn(docs)
    assert set(made) == {"aa", "bb"} and max(map(len, made.values())) <= langid.DICT_BYTES + 200
    got = langid.identify(docs, made, ["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
