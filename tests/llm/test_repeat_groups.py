"""Maximal repeats with all occurrences against brute force, with buckets parted and not."""

import random

import pytest

from spindle.llm import repeats


@pytest.mark.parametrize("narrow, widest", [(256, 1 << 14), (1, 1 << 14), (1, 1)])
def test_groups_hold_every_occurrence(spark, narrow, widest):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line, other = some(460), some(520)
    texts = [some(200) + line + some(150), line + some(90), some(30) + line[20:], some(40) + line + "!" + other, other[60:] + some(10), some(900), None, ""]
    texts += [texts[5], texts[0][:500] + some(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    length = 400
    data = [(t or "").encode() for t in texts]
    groups = {}
    for r in repeats.repeat_groups(docs, length=length, narrow=narrow, max_bucket=widest).collect():
        groups.setdefault((r["group"], data[r["doc_id"]][r["start"] : r["start"] + r["length"]]), set()).add((r["doc_id"], r["start"]))
    assert len({g for g, _ in groups}) == len(groups)
    covered = [set() for _ in data]
    for (_, shared), at in groups.items():
        assert len(shared) >= length
        every = {(i, s) for i, t in enumerate(data) for s in range(len(t) - len(shared) + 1) if t[s : s + len(shared)] == shared}
        assert at == every and len(at) > 1
        for i, s in at:
            covered[i].update(range(s, s + len(shared)))
    seen = {}
    for i, t in enumerate(data):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    want = [set() for _ in data]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                want[i].update(range(s, s + length))
    assert covered == want


def test_groups_of_an_empty_table(spark):
    assert repeats.repeat_groups(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    assert repeats.op10(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
