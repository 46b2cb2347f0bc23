"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled texts of good quality; everything else is unlabelled web text. A first model tells
positives from unlabelled texts and gives the class prior (the lowest ratio of unlabelled to positive mass over score
tails). The second, a small network, minimises the non-negative unbiased risk
``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])`` with the sigmoid loss.

Features describe the writing (character classes, repeated words and lines, word and line lengths) over the whole
text; they are computed on the executors. The fit sees at most ``TRAIN_ROWS`` positives and as many unlabelled rows.

Defined results: null and empty texts have all-zero features and get the score of such a text; with no positives every
score is 0.5. Rows are neither dropped nor merged; other columns pass through, existing ``score`` and ``predicted``
columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfathom.llm.common import LINE, bounded, picked

TRAIN_ROWS = 20_000
HIDDEN = 8
DECAY = 0.03  # of weights; keeps a few hundred positives from being learnt by heart
FEATURES = 22


def features(text: str | None) -> np.ndarray:
    """A fixed number of measurements of one text."""
    out = np.zeros(FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    lead = bytes_of[192:].sum()
    upper, lower = bytes_of[65:91].sum(), bytes_of[97:123].sum()
    digits, blank = bytes_of[48:58].sum(), bytes_of[32] + bytes_of[9:14].sum()
    letters = upper + lower + lead
    chars = bytes_of[:128].sum() + lead
    ink = max(1.0, chars - blank)
    signs = [bytes_of[[ord(c) for c in group]].sum() / ink for group in (".", ",", "!?", "*#$%&@~^+=", "|<>{}[]\\/_", "\"'()-:;")]
    counted = Counter(words)
    lines = [x for x in LINE.split(text) if x.strip()]
    n = len(words)
    repeats = sum(map(eq, words, words[1:]))
    out[:] = [
        np.log1p(n), np.log1p(chars), letters / ink, upper / max(1.0, letters), lead / max(1.0, letters), digits / ink, blank / chars,
        *signs, ink / n, len(counted) / n, np.log1p(n) * (len(counted) / n), max(counted.values()) / n, repeats / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        float(bytes_of[10] / chars),
    ]
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def features_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([features(t).astype(np.float32) for t in batch])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(net: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ net[0] + net[1])
    return hidden, hidden @ net[2] + net[3][0]


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = 600, batch: int = 1024) -> list[np.ndarray]:
    """Adam on the non-negative risk, or with no prior on plain positive-against-unlabelled log loss."""
    rng = np.random.default_rng(11)
    net = [rng.normal(0, 0.3, (pos.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    for step in range(1, steps + 1):
        x = np.concatenate([pos[rng.integers(0, len(pos), batch)], unl[rng.integers(0, len(unl), batch)]])
        hidden, score = _forward(net, x)
        is_pos = np.arange(2 * batch) < batch
        s = _sigmoid(score)
        if prior is None:
            slope = (s - is_pos) / batch
        else:
            bend = s * (1 - s) / batch
            risk = s[~is_pos].mean() - prior * s[is_pos].mean()
            if risk >= 0:
                slope = np.where(is_pos, -2 * prior * bend, bend)
            else:  # step back until the estimated negative risk is no longer negative
                slope = np.where(is_pos, prior * bend, -bend)
        back = np.outer(slope, net[2]) * (1 - hidden**2)
        grads = [x.T @ back + DECAY * net[0], back.sum(0), hidden.T @ slope + DECAY * net[2], np.array([slope.sum()])]
        rate = 0.02 * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(net, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def class_prior(pos_score: np.ndarray, unl_score: np.ndarray) -> float:
    """Share of positives among the unlabelled: the lowest ratio of tail masses, with a margin for sampling error."""
    cuts = np.quantile(pos_score, np.linspace(0.02, 0.7, 60))
    p = np.array([(pos_score >= c).mean() for c in cuts])
    u = np.array([(unl_score >= c).mean() for c in cuts])
    ratio = (u + np.sqrt(u * (1 - u) / len(unl_score))) / np.maximum(p - np.sqrt(p * (1 - p) / len(pos_score)), 1e-6)
    return float(np.clip(ratio.min(), 0.01, 0.99))


def train(docs: DataFrame, positives: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> dict | None:
    """Fit on the documents of about ``rows`` positive ids and on about ``rows`` of all documents; None without positives."""
    parts = []
    for df in (picked(docs.select(key, text), positives.select(key), key, rows), bounded(docs, key, rows)):
        got = df.select(F.xxhash64(key).alias("h"), features_udf(F.col(text)).alias("x")).toPandas().sort_values("h", kind="stable")  # about ``rows`` short vectors
        parts.append(np.array(got["x"].tolist(), dtype=float).reshape(-1, FEATURES))
    pos, unl = parts
    if not len(pos) or not len(unl):
        return None
    mean, scale = unl.mean(0), unl.std(0) + 1e-6
    norm = lambda x: np.clip((x - mean) / scale, -6, 6)
    pos, unl = norm(pos), norm(unl)
    first = _fit(pos, unl, None)
    prior = class_prior(_forward(first, pos)[1], _forward(first, unl)[1])
    return {"mean": mean, "scale": scale, "net": _fit(pos, unl, prior), "prior": prior}


def score(docs: DataFrame, model: dict | None, text: str = "text", cut: float = 0.5) -> DataFrame:
    """The given rows with ``score`` in 0 to 1 and ``predicted`` (1 from ``cut`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        for batch in batches:
            if fitted is None or not len(batch):
                yield pd.Series(np.full(len(batch), 0.5))
                continue
            x = np.array([features(t) for t in batch])
            x = np.clip((x - fitted["mean"]) / fitted["scale"], -6, 6)
            yield pd.Series(_sigmoid(_forward(fitted["net"], x)[1]))

    scored = docs.drop("score", "predicted").withColumn("score", run(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
