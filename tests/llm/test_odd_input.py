"""Nulls, repeats, ties, empty tables, long texts and clashing columns, operator by operator."""

import hashlib
import random

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from spindle.llm import common, compact_windows, fingerprints, langid, line_templates, mixing, pu, quality, repeats, simhash, toxicity

RNG = random.Random(23)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(n=7):
    return "".join(RNG.choice("abcdefghijklmnop") for _ in range(n))


def words(n):
    return " ".join(word() for _ in range(n))


def docs_of(spark, texts, kind="long"):
    ids = [str(i) for i in range(len(texts))] if kind == "string" else range(len(texts))
    return spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")


def test_clashing_columns(spark):
    """The operators' own names may be the caller's; all columns pass through."""
    line = "the same footer of every page here"
    rows = [(i, f"{words(30)}\n{line}", i, i, i, i, i) for i in range(12)] + [(12, None, 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __r int, __drop int, __row int, o int, node int")
    out = line_templates.drop_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = out.collect()
    assert all((r["text"] is None and r["doc_id"] == 12) or line not in r["text"] for r in got)
    assert sorted(r["__drop"] for r in got) == [*range(1), 1, *range(1, 12)]
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 13


def test_near_dedup_of_repeated_rows_and_ids(spark):
    a, b = words(60), words(60)
    rows = [(1, a), (1, a), (1, b), (2, a), (None, b), (3, None), (3, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"] or "") for r in simhash.near_dedup(docs).collect()) == sorted([(1, a), (1, b), (3, "")])
    assert simhash.near_dedup(docs.filter("false")).isEmpty()


def test_op4_string_ids_and_repeated_ids(spark):
    texts = [words(k) for k in (5, 30, 1, 12)] + [None, "", words(9)]
    for kind in ("string", "long"):
        got = {int(r["doc_id"]): r for r in fingerprints.op4(docs_of(spark, texts, kind)).collect()}
        for i, t in enumerate(texts):
            want = fingerprints.edited(t or "", texts[(i + 1) % len(texts)] or "")
            assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    twice = spark.createDataFrame([(1, "b c"), (1, "a b"), (2, "x"), (2, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_chars"], r["n_copies"]) for r in fingerprints.op4(twice).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 1, 2), (2, 1, 2)]


def test_a_digest_collision_parts_the_group(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "fingerprint_of", lambda data: f"{len(data):032x}")
    rows = fingerprints.exact_groups(docs_of(spark, ["ab cd", "AB  cd", "xy zw", "longer text"]))
    got = {r["doc_id"]: (r["group_id"], r["n_copies"]) for r in rows.collect()}
    if len({r["fingerprint"] for r in rows.collect()}) == 2:  # workers that forked after the change see it
        assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1)}


def test_keys_part_values_that_share_a_hash(spark, monkeypatch):
    """A key that stands for two values is replaced."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(common.F, "xxhash64", lambda *c: real(*c) % 3 if len(c) == 1 else real(*c))
    docs = docs_of(spark, [f"t{i}" for i in range(12)] + [None, "", "t1"])
    keys = {r["text"]: r["k"] for r in docs.select("text", common.text_key(docs, "text").alias("k")).collect()}
    assert len(set(keys.values())) == len(keys)


@pytest.mark.parametrize("score", [lambda d, l: toxicity.op2(d, l), lambda d, l: quality.op6(d, l)])  # noqa: E741
def test_scores_of_odd_texts(spark, score):
    good, bad = [words(12) for _ in range(40)], [words(6) + " vile hateful scum " + words(5) for _ in range(40)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, "", "   ", bad[0], bad[0], words(6_000)]
    docs = docs_of(spark, texts).selectExpr("doc_id", "text", "doc_id AS score", "text AS t", "1 AS held_out")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(80)] + [(3, 1, 1), (5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score(docs, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[80]["score"] == got[81]["score"] and got[83]["score"] == got[84]["score"] == got[1]["score"]
    assert score(docs.filter("false"), labels).isEmpty()
    none = score(docs, labels.filter("false")).collect()
    assert {r["predicted"] for r in none} == {0}


def test_fit_minimises_the_stated_risk():
    """The trained risk, evaluated plainly, is below that of the zero model and of nearby models."""
    pos = [words(5) + " vile scum " + words(4) for _ in range(60)]
    unl = [words(9) for _ in range(90)] + [words(5) + " vile scum " + words(4) for _ in range(30)]
    prior = 0.25
    model = pu.fit(pos, unl, prior)

    def risk(m):
        fp, fu = (np.array([m.raw(t) for t in ts]) for ts in (pos, unl))
        loss = lambda f: np.logaddexp(0, -f).mean()
        return prior * loss(fp) + max(0.0, loss(-fu) - prior * loss(-fp))

    best, start = risk(model), model.weights.copy()
    assert best < 0.5 * prior * np.log(2) + 0.5 * np.log(2)
    rng = np.random.default_rng(1)
    for _ in range(8):
        model.weights = start + rng.normal(0, 0.3, len(start))
        assert risk(model) > best - 0.01
    model.weights = start
    held = [words(5) + " vile scum " + words(4) for _ in range(40)], [words(9) for _ in range(40)]
    assert min(model.raw(t) for t in held[0]) > max(model.raw(t) for t in held[1])


def test_language_by_plain_compression(spark):
    """identify agrees with a plain count of compressed bytes; ties and texts without letters are rejected."""
    own = {lang: [word(6) for _ in range(80)] for lang in ("aa", "bb", "cc")}
    say = lambda lang, n: " ".join(RNG.choice(own[lang]) for _ in range(n))
    made = {lang: say(lang, 3_000).encode() for lang in own}
    texts = [say(lang, n) for lang in own for n in (5, 60, 5_000)] + [words(30), "", None, "12 !!", "a"]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in langid.identify(docs, made, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        data, sizes = langid.prepared(t), {}
        for lang in sorted(made):
            tool = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(made[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
            sizes[lang] = sum(len(tool.compress(data[k : k + langid.BLOCK])) for k in range(0, len(data), langid.BLOCK))
        assert got[i]["lang_pred"] == min(sorted(sizes), key=sizes.get)
    assert [got[3 * k + n]["lang_pred"] for k in range(3) for n in (1, 2)] == [lang for lang in sorted(own) for _ in (1, 2)]
    one = langid.identify(docs, {"zz": made["aa"], "yy": made["aa"]}, ["doc_id"]).collect()
    assert all(r["rejected"] for r in one) and {r["lang_pred"] for r in one} == {"yy", "und"}
    assert langid.identify(docs.filter("false"), made, ["doc_id"]).isEmpty()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert compact_windows.op8(none).isEmpty() and repeats.op10(none).isEmpty() and mixing.op7(none).isEmpty()
    assert simhash.op1(none).isEmpty() and langid.op5(none).isEmpty() and fingerprints.op4(none).isEmpty() and line_templates.op3(none).isEmpty()
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_op8_against_all_pairs(spark):
    """Classes against a comparison of every pair of passages, with frequent shingles and long texts."""
    line = words(6)
    texts = []
    for k in range(14):
        shared = words(60).split()
        edited = list(shared)
        edited[20] = word()
        texts += [f"{words(40)} {line} {' '.join(shared)} {words(20)}", f"{line} {words(15)} {' '.join(edited)}", f"{words(50)} {line} {words(30)}"]
    texts += [words(9_000), None, "", texts[0]]
    grams = [[tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)] for t in (t or "" for t in texts)]
    windows = [{i: set(g[i : i + compact_windows.SPAN]) for i in range(0, len(g) - compact_windows.SPAN + 1, 1 if len(g) < 500 else 40)} for g in grams]

    def near(i, j):
        if texts[i] == texts[j]:
            return bool(windows[i])
        return any(len(a & b) >= 0.8 * len(a | b) for a in windows[i].values() for b in windows[j].values() if not a.isdisjoint(b))

    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(i, j):
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    got = {r["doc_id"]: r["class_id"] for r in compact_windows.op8(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == part
