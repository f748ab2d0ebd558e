"""Quality classifier by positive-unlabelled learning.

The positives are documents whose label says good; the unlabelled set is drawn from the web text
itself, whatever its labels.  The model minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with the logistic loss, so its output estimates the posterior of a good document.  The class prior
is estimated from the positives and the unlabelled rows alone: how the labelled rows were picked,
and how many bad ones are among them, has no part in it.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read.  The score
depends on the text alone.  Only the fit uses a bounded sample: SAMPLE positives and SAMPLE
unlabelled rows, the first by a hash of doc_id; features and scores cover every row.

Defined cases: null text is empty; an empty text has zero features and the score 0 (no word speaks
for it); a null doc_id counts as the empty text in crc32; labels that are null, or of
documents that don't exist, are ignored; without both a positive and an unlabelled row the score
is 0.5; a doc_id that has several label rows counts once for each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged

SAMPLE = 6000
HELD_OUT = 2
FOLDS = 4
AT_LEAST = 0.7
HIDDEN = 12
SCHEMA = "doc_id bigint, x array<float>"

#: Byte classes whose shares of the text are features.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c",
    b".", b",", b"!", b"?", b"|", b"#*$%&", b"<>", b"'\"", b"-_", b":;", b"()[]{}", b"/\\@=+~^`",
)
N_FEATURES = len(CLASSES) + 8


def features(text: bytes) -> list[float]:
    """Shares and logarithms of the whole text; one pass over its bytes and one over its words."""
    if not text or not (words := text.split()):
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    out = [math.sqrt(counts[list(c)].sum() / size) for c in CLASSES]
    n, lines = len(words), text.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    out += [
        math.log1p(n),
        math.log1p(len(lines)),
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        float(lengths.mean()),
        float(lengths.std()),
        float(counts[128:].sum() / size),
        len(set(zip(words, words[1:]))) / n,  # noqa: B905
    ]
    return out


def featured(docs: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            values = [features(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, SCHEMA)


class Model:
    """A small network on standardised features: one hidden layer beside a linear term."""

    def __init__(self, n: int, hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.w = {"a": rng.normal(0, 1 / math.sqrt(n), (n, hidden)), "b": np.zeros(hidden), "v": np.zeros(hidden), "l": np.zeros(n), "c": np.zeros(1)}

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._z(x)
        return 1 / (1 + np.exp(-np.clip(np.tanh(z @ self.w["a"] + self.w["b"]) @ self.w["v"] + z @ self.w["l"] + self.w["c"], -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 200, batch: int = 1024, rate: float = 5e-3, decay: float = 1e-4, seed: int = 1) -> Model:
        """Adam on the non-negative risk.  Where the negative part is below zero, the step goes up its gradient."""
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        p, u, rng = self._z(positive), self._z(unlabelled), np.random.default_rng(seed)
        m = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in self.w.items()}
        steps = max(1, math.ceil(max(len(p), len(u)) / batch))
        for step in range(1, epochs * steps + 1):
            xp, xu = p[rng.integers(len(p), size=min(batch, len(p)))], u[rng.integers(len(u), size=min(batch, len(u)))]
            x, w = np.concatenate([xp, xu]), self.w
            h = np.tanh(x @ w["a"] + w["b"])
            g = h @ w["v"] + x @ w["l"] + w["c"]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            soft = np.logaddexp(0, g)  # loss of calling it negative
            k = len(xp)
            negative = soft[k:].mean() - prior * soft[:k].mean()
            dg = np.empty_like(g)
            if negative >= 0:
                dg[:k] = prior * (s[:k] - 1) / k - prior * s[:k] / k
                dg[k:] = s[k:] / len(xu)
            else:
                dg[:k] = prior * s[:k] / k
                dg[k:] = -s[k:] / len(xu)
            dh = np.outer(dg, w["v"]) * (1 - h * h)
            grad = {"a": x.T @ dh, "b": dh.sum(0), "v": h.T @ dg, "l": x.T @ dg, "c": np.array([dg.sum()])}
            for name, d in grad.items():
                d = d + decay * w[name]
                m[name][0] = 0.9 * m[name][0] + 0.1 * d
                m[name][1] = 0.999 * m[name][1] + 0.001 * d * d
                w[name] = w[name] - rate * (m[name][0] / (1 - 0.9**step)) / (np.sqrt(m[name][1] / (1 - 0.999**step)) + 1e-8)
        return self


def _fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def _order(seed: int):
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))


def _few(rows: DataFrame, count: int, sample: int, seed: int) -> DataFrame:
    """The `sample` rows of the least hash, ties by their values.  A bound on the hash first leaves about
    twice as many, so the tasks send on no more than that between them."""
    share = 2 * (sample + 50) / max(count, 1)
    return rows.filter(_order(seed) < int(min(share, 1.0) * (1 << 40))).orderBy(_order(seed), *rows.columns).limit(sample)


def class_prior(labelled: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, by the scores of a classifier of labelled positives
    against unlabelled rows: a positive's mean score is what positives have, so the share of the
    unlabelled at or above a level can't be less than prior times that of the positives.  The least ratio over
    the levels that hold a tenth of the positives or more bounds the prior and is near it where some
    level holds positives alone."""
    levels = np.quantile(labelled, np.linspace(0.0, 0.9, 19))
    p = (labelled[:, None] >= levels).mean(0)
    u = (unlabelled[:, None] >= levels).mean(0)
    # a standard error in favour of the higher ratio: the least of several is low by chance
    u, p = u + np.sqrt(u * (1 - u) / len(unlabelled)), p - np.sqrt(p * (1 - p) / len(labelled))
    return float(np.clip((u / np.maximum(p, 1e-9)).min(), 0.01, 0.99))


def _prior(p: np.ndarray, u: np.ndarray) -> float:
    """The prior by halves: each is scored by a model of the other.  Half for too few rows."""
    if min(len(p), len(u)) < 40:
        return 0.5
    found = []
    for k in (0, 1):
        model = Model(N_FEATURES).fit(p[1 - k :: 2], u[1 - k :: 2], 0.5, epochs=60)
        found.append(class_prior(model.score(p[k::2]), model.score(u[k::2])))
    return float(np.mean(found))


def train(vectors: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """Fits on at most `sample` positives and `sample` unlabelled rows; a number if it can't.  The rows come
    in the order of a hash, so the fit doesn't depend on how the tables are partitioned."""
    known = labels.select("doc_id").filter((F.col("quality") == 1) & (_fold() != HELD_OUT))
    some = _few(known, known.count(), sample, 7).distinct()
    positive = vectors.join(some, "doc_id", "left_semi").orderBy(_order(7), "doc_id", "x").limit(sample)
    unlabelled = _few(vectors, vectors.count(), sample, 11)
    p, u = (np.array([r["x"] for r in d.select("x").collect()], float) for d in (positive, unlabelled))
    if not len(p) or not len(u):
        return 0.5
    return Model(N_FEATURES).fit(p, u, _prior(p, u))


def scored(vectors: DataFrame, model: Model | float) -> DataFrame:
    def rows(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, N_FEATURES)
            y = np.full(len(x), float(model)) if isinstance(model, float) else model.score(x)
            y[~x.any(1)] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.float64())], ["doc_id", "score"])

    return vectors.mapInArrow(rows, "doc_id bigint, score double").select(
        "doc_id", (_fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= AT_LEAST).cast("int").alias("predicted")
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    vectors = staged(featured(docs), "features")
    return scored(vectors, train(vectors, labels))
