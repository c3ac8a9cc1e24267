"""Positive-unlabelled learning with the non-negative risk estimator, in numpy.

Texts become binary features: selected words, and quantile bins of surface statistics.  Training sees confirmed positives, unlabelled
texts and the class prior pi, and minimises

    pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])

with the logistic loss l; where the second part turns negative its gradient is followed
upwards, as the non-negative estimator prescribes.  The prior is the share of positives among
the labelled training rows, and the same rows set the two numbers of a final calibration.

Null and empty texts have no words and the statistics of an empty text, and are scored so.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

#: Bounds of the training sample that reaches the driver: rows of each kind.
MAX_POSITIVE, MAX_UNLABELLED, MAX_CALIBRATION = 4_000, 8_000, 4_000
MAX_WORDS = 3_000
#: Quantiles between the bins of a statistic, finer at the ends, where junk lies.
CUTS = (0.01, 0.02, 0.04, 0.07, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.93, 0.96, 0.98, 0.99)
BINS = len(CUTS) + 1
WORD = re.compile(r"\w+")
KINDS = np.zeros(256, np.uint8)  # 0 other sign, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 full stop or comma, 7 beyond ASCII
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[[32, 9, 13]], KINDS[10], KINDS[[44, 46]], KINDS[128:] = 1, 2, 3, 4, 5, 6, 7
STATS = 22


def surface(text: str, words: list[str], lowered: Counter) -> np.ndarray:
    """Statistics of a text's surface; every one is a ratio or a logarithm."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = KINDS[data]
    n = max(1, len(data))
    count = np.bincount(kinds, minlength=8) / n
    lines = text.split("\n")
    spaced = text.split()
    tokens = max(1, len(spaced))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    common = lowered.most_common(1)[0][1] if lowered else 0
    bits = np.bincount(data, minlength=256)
    p = bits[bits > 0] / n
    switches = np.count_nonzero(kinds[1:] != kinds[:-1]) / n
    return np.array(
        [
            *count,
            np.log1p(n),
            np.log1p(tokens),
            len(data) / tokens,
            max((len(w) for w in words), default=0) ** 0.5,
            len(lowered) / max(1, len(words)),
            repeats / max(1, len(words)),
            common / max(1, len(words)),
            np.log1p(len(lines)),
            len(set(lines)) / len(lines),
            -(p * np.log2(p)).sum() if len(data) else 0.0,
            switches,
            sum(w[-1] in ".!?:;" for w in spaced) / tokens,
            sum(not w[0].isalnum() or not w[-1].isalnum() for w in spaced) / tokens,
            sum(w.isupper() for w in words) / max(1, len(words)),
        ]
    )


def parts(text: str) -> tuple[np.ndarray, Counter]:
    words = WORD.findall(text)
    lowered = Counter(w.lower() for w in words)
    return surface(text, words, lowered), lowered


@dataclass
class Model:
    words: dict[str, int]
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def columns(self, stats: np.ndarray, lowered) -> np.ndarray:
        """Indices of the features that a text has."""
        bins = [len(self.words) + i * BINS + int(np.searchsorted(self.edges[i], x, side="right")) for i, x in enumerate(stats)]
        return np.array([*(self.words[w] for w in self.words.keys() & lowered.keys()), *bins], np.int64)

    def raw(self, text: str) -> float:
        stats, lowered = parts(text)
        return float(self.weights[self.columns(stats, lowered)].sum() + self.bias)

    def score(self, text: str) -> float:
        return float(sigmoid(self.scale * self.raw(text) + self.shift))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def select_words(positive: list[Counter], unlabelled: list[Counter], most: int) -> list[str]:
    """The words whose document frequencies differ most between the two samples."""
    a, b = Counter(), Counter()
    for c in positive:
        a.update(c.keys())
    for c in unlabelled:
        b.update(c.keys())
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    scored = []
    for w in a.keys() | b.keys():
        x, y = a[w], b[w]
        if x + y >= 5:
            p = (x + y) / (n + m)
            z = abs(x / n - y / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12)
            if z > 3:
                scored.append((-z, w))
    return [w for _, w in sorted(scored)[:most]]


def fit(positive: list[str], unlabelled: list[str], prior: float, most_words: int = MAX_WORDS, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Model:
    """A linear model on binary features that minimises the non-negative risk by Adam."""
    pos, unl = [parts(t) for t in positive], [parts(t) for t in unlabelled]
    words = {w: i for i, w in enumerate(select_words([c for _, c in pos], [c for _, c in unl], most_words))}
    stats = np.array([s for s, _ in unl] + [s for s, _ in pos])
    edges = np.quantile(stats, CUTS, axis=0).T
    model = Model(words, edges, np.zeros(len(words) + STATS * BINS), 0.0)

    def packed(rows):
        cols = [model.columns(s, c) for s, c in rows]
        return np.concatenate(cols), np.repeat(np.arange(len(cols)), [len(c) for c in cols]), len(cols)

    p_cols, p_rows, n_p = packed(pos)
    u_cols, u_rows, n_u = packed(unl)
    dims = len(model.weights)
    w, b = model.weights, 0.0
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for step in range(1, rounds + 1):
        fp = np.bincount(p_rows, w[p_cols], n_p) + b
        fu = np.bincount(u_rows, w[u_cols], n_u) + b
        sp, su = sigmoid(fp), sigmoid(fu)
        # Losses l(f) = log(1 + e^-f); gradients of l(f) and l(-f) are s - 1 and s.
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= 0:
            gp, gu = prior * (sp - 1) / n_p - prior * sp / n_p, su / n_u
        else:
            gp, gu = prior * sp / n_p, -su / n_u
        g = np.empty(dims + 1)
        g[:-1] = np.bincount(p_cols, gp[p_rows], dims) + np.bincount(u_cols, gu[u_rows], dims) + decay * w
        g[-1] = gp.sum() + gu.sum()
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    model.bias = float(b)
    return model


def calibrate(model: Model, rows: list[tuple[str, int]]) -> Model:
    """Scale and shift by logistic regression on labelled rows (Newton steps, a weak prior)."""
    if len({y for _, y in rows}) < 2:
        return model
    f = np.array([model.raw(t) for t, _ in rows])
    y = np.array([y for _, y in rows], float)
    a, c = 1.0, 0.0
    spread = max(1e-6, f.std())
    for _ in range(50):
        p = sigmoid(a * f + c)
        g = np.array([((p - y) * f).sum() + 0.01 * (a - 1) * spread, (p - y).sum() + 0.01 * c])
        s = p * (1 - p)
        h = np.array([[(s * f * f).sum() + 0.01 * spread + 1e-3, (s * f).sum()], [(s * f).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        size = max(1.0, np.abs(step).max())
        a, c = a - step[0] / size, c - step[1] / size
    model.scale, model.shift = (max(1e-3, float(a)), float(c))
    return model


def sampled(df: DataFrame, h: str, most: int, total: int) -> list:
    """About ``most`` of ``total`` rows, picked by the hash in column ``h``."""
    share = min(1.0, most / max(1, total))
    rows = df if share == 1.0 else df.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return rows.drop(h).collect()


def learn(docs: DataFrame, labels: DataFrame, target: str, held_out, most_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the rows where ``held_out`` (a function of the id column) is false.

    The positives are labelled 1; the unlabelled texts are drawn from all rows that are not
    held out, labelled or not.  At most about MAX_POSITIVE, MAX_UNLABELLED and MAX_CALIBRATION
    rows are picked, so their ids can be broadcast, and reach the driver.  With no positives, or no texts, every score is 0.
    """
    marks = labels.filter(F.col(target).isNotNull() & ~held_out(F.col(id_col)))
    marks = marks.groupBy(id_col).agg(F.max(target).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_all = counts.get(1, 0), sum(counts.values())
    open_ = docs.filter(~held_out(F.col(id_col))).select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    h = lambda salt: F.xxhash64(F.col("i").cast("string"), F.lit(salt)).alias("h")
    none = Model({}, np.zeros((STATS, 0)), np.zeros(STATS * BINS), -40.0)
    if not n_pos:
        return none
    labelled = marks.select(F.col(id_col).alias("i"), "y")
    share = min(1.0, MAX_POSITIVE / n_pos)
    pick = labelled.filter("y = 1").withColumn("h", h("p")).filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    positive = [r["t"] for r in open_.join(F.broadcast(pick.select("i")), "i").select("t").collect()]
    unlabelled = [r["t"] for r in sampled(open_.select("t", h("u")), "h", MAX_UNLABELLED, open_.count())]
    share = min(1.0, MAX_CALIBRATION / n_all)
    pick = labelled.withColumn("h", h("c")).filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    known = [(r["t"], r["y"]) for r in open_.join(F.broadcast(pick.select("i", "y")), "i").select("t", "y").collect()]
    if not positive or not unlabelled:
        return none
    model = fit(sorted(positive), sorted(unlabelled), n_pos / n_all, most_words)
    return calibrate(model, sorted(known))


def apply(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_cols`` with score (0 to 1) and predicted of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = [model.score(t) for t in texts(batch.column(batch.num_columns - 1))]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())],
            [*id_cols, "score", "predicted"],
        )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return map_arrow(docs.select(*id_cols, text_col), run, f"{kinds}, score double, predicted int")


def folds(mod: int, held: int):
    return lambda i: F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary")) % mod == held


def scored(docs: DataFrame, labels: DataFrame, target: str, mod: int, held: int, most_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from the other remainders of crc32(doc_id)."""
    held_out = folds(mod, held)
    model = learn(docs.select("doc_id", "text"), labels.select("doc_id", target), target, held_out, most_words)
    return apply(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, ["doc_id", "held_out"])
