"""Every text operator against brute force on small fixtures, with nulls, ties and clashes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from spindle.llm import compact_windows, decontam, fingerprints, langid, line_templates, mixing, pu, repeats, simhash

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def frame(spark, texts, ids=None, extra=None):
    rows = [(ids[i] if ids else i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty, blank, one word, a very long text, ties and repeats."""
    base = prose(300)
    words = base.split()
    near = " ".join(["changed" if i % 150 == 7 else w for i, w in enumerate(words)])
    return [None, "", "  \n ", "word", base, base, near, prose(20_000), "naïve ＡＢＣ ß\ttext", "NAÏVE abc SS text", prose(60), base.upper()]


def hexprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(items, near):
    part = list(range(len(items)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_op1(spark, odd):
    texts = odd + [prose(12) for _ in range(40)]
    got = {r["doc_id"]: r for r in simhash.op1(frame(spark, texts)).collect()}
    prints = [hexprint(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    assert [got[i]["component_id"] for i in range(len(texts))] == linked(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_variants_find_every_near_pair(spark):
    base = RNG.getrandbits(64)
    flips = [base ^ sum(1 << b for b in RNG.sample(range(64), k)) for k in (0, 1, 2, 3, 4, 4, 4, 5, 6, 9) for _ in range(6)]
    far = [RNG.getrandbits(64) for _ in range(40)]
    prints = flips + far
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp0 long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.hamming_components(df).collect()}
    assert [got[i] for i in range(len(prints))] == linked(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_near_dedup(spark):
    texts = []
    for _ in range(8):
        words = prose(200).split()
        texts.append(" ".join(words))
        for k in (2, 5):
            copy = list(words)
            for i in RNG.sample(range(200), k):
                copy[i] = "zz" + copy[i]
            texts.append(" ".join(copy))
    texts += [None, "", texts[0]]
    docs = frame(spark, texts).withColumnRenamed("lang", "__key")
    kept = sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect())
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for t in texts]
    want = sorted(set(linked(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))))
    assert kept == want


def test_op4(spark, odd):
    docs = frame(spark, odd, ids=[7 * i % 13 for i in range(len(odd))])
    rows = sorted(zip([7 * i % 13 for i in range(len(odd))], [t or "" for t in odd]))
    got = {r["doc_id"]: r for r in fingerprints.op4(docs).collect()}
    assert len(got) == len(odd)
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        want = t[: len(t) - half] + other[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == fingerprints.fingerprint(want)
        assert got[i]["near_next"] == (fingerprints.canonical(t) == fingerprints.canonical(other))
    by = collections.defaultdict(set)
    for i, t in rows:
        by[fingerprints.canonical(t)].add(i)
    for i, t in rows:
        assert got[i]["group_id"] == min(by[fingerprints.canonical(t)]) and got[i]["n_copies"] == len(by[fingerprints.canonical(t)])


def test_op4_empty_and_null_ids(spark):
    assert fingerprints.op4(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "c")], "doc_id long, text string")
    assert fingerprints.op4(docs).count() == 4


def test_op5_held_out_accuracy(spark):
    pools = {g: ["".join(random.Random(f"{g}{i}").choice(a) for _ in range(6)) for i in range(80)] for g, a in (("xx", "abcdef"), ("yy", "ghijkl"))}
    rows = []
    for i in range(200):
        g = "xx" if i % 2 else "yy"
        rows.append((i, " ".join(RNG.choice(pools[g]) for _ in range(60)), g))
    rows += [(500, None, "xx"), (501, "12 %", "yy"), (502, "", None)]
    got = {r["doc_id"]: r for r in langid.op5(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in rows[:200])
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i in got)
    assert langid.op5(frame(spark, [])).count() == 0


@pytest.mark.parametrize("target, mod, held", [("toxic", 3, 1), ("quality", 4, 2)])
def test_pu(spark, target, mod, held):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, prose(40) + (" vile rotten" if bad else "")))
        if i % 3 == 0:
            labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, f"doc_id long, {target} int")
    got = {r["doc_id"]: r for r in pu.scored(docs, marks, target, mod, held).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    right = [got[i]["predicted"] == int(i % 4 == 0) for i in range(600) if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.97
    none = pu.scored(docs, marks.limit(0), target, mod, held)
    assert none.filter("predicted = 1").count() == 0


def test_op7(spark):
    texts = [prose(RNG.randint(0, 400)) for _ in range(300)] + [None, "", "   "]
    rows = [(i, t, ("é", "z", None, "a", "b")[min(i % 7, 4)]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string")
    out = mixing.mix(docs, shard_words=2_000)
    got = out.collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs, shard_words=2_000).collect()), key=str)
    size = collections.Counter()
    for i, t, s in rows + rows[:5]:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets_of([size[s] for s in order], (5, 2, 1), 3)))
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in size:
        assert abs(taken[s] - want[s]) <= 16 * (2 + size[s] // 1_000)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_sainte_lague_and_targets():
    assert list(mixing.sainte_lague(np.array([53000, 24000, 23000]), 7, np.array([9, 9, 9]))) == [3, 2, 2]
    assert list(mixing.sainte_lague(np.array([9.0, 1.0]), 10, np.array([3, 9]))) == [3, 7]
    assert mixing.targets_of([100, 100, 100], (5, 2, 1), 3) == [187.5, 75.0, 37.5]
    assert mixing.targets_of([10, 100, 100], (5, 2, 1), 3) == [30.0, 120.0, 60.0]


def test_op3(spark):
    texts = []
    for i in range(30):
        lines = [prose(12), f"Copyright {1990 + i} by the authors of this text", prose(9)]
        texts.append("\n".join(lines))
    texts += [texts[0]] * 20 + [None, "", "\n\n"]
    docs = frame(spark, texts).withColumnRenamed("lang", "n_lines")
    out = {r["doc_id"]: r for r in line_templates.drop_lines(docs).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(line for line in t.split("\n") if not line.startswith("Copyright"))
        assert out[i]["text"] == want
    assert line_templates.op3(frame(spark, [])).count() == 0


def test_lines_join_the_first_leader_that_fits():
    lines = ["a b c d e f g", "a b c d e f h", "a b c x y z w"]
    assert line_templates.first_fit(lines, [], 0.7, True) == [0, 0, 1]
    assert line_templates.first_fit(lines, lines[2:], 0.7, False) == [-1, -1, 0]


def test_op8(spark):
    passage = prose(70).split()
    edited = list(passage)
    edited[10] = edited[60] = "zzz"
    texts = [prose(100) + " " + " ".join(passage) + " " + prose(30), prose(5) + " " + " ".join(passage) + " " + prose(90), prose(200), prose(80) + " " + " ".join(edited), None, "", prose(120)]
    texts += [texts[-1], "short text", "short text"]
    got = {r["doc_id"]: r for r in compact_windows.near_passages(frame(spark, texts)).collect()}
    assert [got[i]["class_id"] for i in range(10)] == [0, 0, 2, 0, 4, 5, 6, 6, 8, 9]
    spans = got[0]["spans"]
    assert len(spans) == 1 and spans[0]["f"] <= 101 and spans[0]["t"] >= 169
    assert got[2]["n_dup_words"] == 0 and got[6]["n_dup_words"] == 120


def test_compact_windows_by_brute_force():
    h = np.array([RNG.getrandbits(64) for _ in range(300)], np.uint64)
    got = compact_windows.compact_windows(h, 20)
    want = []
    for c in range(300):
        left = c
        while left and h[left - 1] > h[c]:
            left -= 1
        right = c
        while right < 299 and h[right + 1] > h[c]:
            right += 1
        if right - left + 1 >= 20:
            want.append((left, c, right))
    assert got == want


def test_op9(spark):
    item, short = prose(40), "only four words here"
    words = item.split()
    cut = words[:38] + ["other", "words"]
    texts = [prose(3_000) + " " + item + " " + prose(50), " ".join(cut), " ".join(words[:20]), None, "", f"x {short} y", item.upper()]
    items = spark.createDataFrame([(1, item), (2, short), (3, None), (4, ""), (5, prose(30))], "item_id long, text string")
    docs = frame(spark, texts)
    got = sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in decontam.op9(docs, items).collect())
    grams = lambda t, n: {tuple(t.lower().split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    want = []
    for d, t in enumerate(texts):
        for k, x, n in ((1, item, 5), (2, short, 4)):
            shared = len(grams(x, n) & grams(t or "", n))
            if shared >= 0.8 * len(grams(x, n)):
                want.append((d, k, shared))
    assert got == want
    left = sorted(r["doc_id"] for r in decontam.decontaminate(docs, items).collect())
    assert left == [d for d in range(len(texts)) if d not in {w[0] for w in want}]


@pytest.mark.parametrize("narrow, widest", [(256, 1 << 14), (1, 1 << 14), (1, 1)])
def test_op10(spark, monkeypatch, narrow, widest):
    monkeypatch.setattr(repeats, "NARROW", narrow)
    line = prose(80)
    periodic = "ab " * 400
    texts = [prose(100) + line + prose(20), line + prose(100), prose(10) + line[:450], line[:350], periodic, prose(200), None, "", "é" * 500, line + "x" + line]
    texts += [texts[5]]
    count = collections.Counter()
    for t in texts:
        b = (t or "").encode()
        count.update(b[s : s + 400] for s in range(len(b) - 399))
    got = {r["doc_id"]: r for r in repeats.op10(frame(spark, texts), widest).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), int(gone.sum()), runs)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_repeat_groups(spark):
    line = prose(80)
    docs = frame(spark, [prose(50) + line + prose(50), prose(9) + line, prose(300)])
    rows = repeats.repeat_groups(docs).collect()
    assert {r["doc_id"] for r in rows} == {0, 1} and min(r["length"] for r in rows) >= 400


def test_pipeline(spark, tmp_path):
    texts = [prose(120) for _ in range(40)]
    item = prose(40)
    texts += [texts[0], texts[1] + " tail", prose(50) + " " + item, None, "", "77 %"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "source_mix"]
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == list(range(40))
