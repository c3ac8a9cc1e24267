"""Line templates against one pass over all lines in plain Python; the size of a leaf changes nothing."""

import collections
import random

import pytest

from spindle.llm import line_templates


def brute(texts, similarity=0.7, min_docs=10):
    """The kept text of each document."""
    held = collections.defaultdict(set)
    for t in texts:
        for line in (t or "").split("\n"):
            tokens = line_templates.masked(line)
            if tokens:
                held[tuple(tokens)].add(t)
    leaders, of = collections.defaultdict(list), {}
    for tokens in sorted(held, key=lambda x: (-len(held[x]), " ".join(x).encode())):
        leaf = leaders[len(tokens), tokens[:3]]
        fixed = [t != "<*>" for t in tokens]
        for head in leaf:
            same = sum(f and a == b for f, a, b in zip(fixed, tokens, head))
            if same >= similarity * sum(fixed) and (same or not any(fixed)):
                of[tokens] = head
                break
        else:
            leaf.append(tokens)
            of[tokens] = tokens
    docs = collections.defaultdict(set)
    for tokens, head in of.items():
        docs[head] |= held[tokens]
    keep = lambda line: not (tokens := tuple(line_templates.masked(line))) or len(docs[of[tokens]]) < min_docs
    return [None if t is None else "\n".join(line for line in t.split("\n") if keep(line)) for t in texts]


@pytest.mark.parametrize("max_leaf", [4_000, 1_500, 100, 20])
def test_leaves_of_any_size_drop_the_same_lines(spark, max_leaf):
    rng = random.Random(4)
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir"]
    texts = []
    for _ in range(60):
        lines = ["report of the " + " ".join(rng.choice(words) for _ in range(4)) for _ in range(10)]
        lines += [f"page {rng.randrange(99)} of {rng.randrange(99)}", f"own {rng.random()} x", "", "  "]
        lines += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))]
        texts.append("\n".join(lines))
    texts += [None, "", texts[0], "page 1 of 2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = line_templates.drop_lines(docs, max_leaf=max_leaf)
    got = [r["text"] for r in sorted(out.collect(), key=lambda r: r["doc_id"])]
    want = brute(texts)
    assert got == want
    dropped = sum(len((t or "").split("\n")) - len((k or "").split("\n")) for t, k in zip(texts, want))
    assert 60 < dropped < 700


def test_template_texts(spark):
    rows = [(1, f"user {name} has logged in today", "user ann has logged in today") for name in ("ann", "bob", "<*>")]
    got = line_templates.template_texts(spark.createDataFrame(rows, "leaf long, masked string, template string")).collect()
    assert [r["text"] for r in got] == ["user <*> has logged in today"]
