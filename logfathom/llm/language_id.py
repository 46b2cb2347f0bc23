"""Language identification: multinomial naive Bayes over hashed character n-grams.

``train`` counts n-grams of labelled texts in Spark and turns them into a log-probability matrix (n-gram buckets by
languages), whose size does not depend on the data. ``predict`` broadcasts it and scores batches of texts: the n-grams
of a batch form a sparse document-by-bucket matrix, and its product with the log-probabilities is a gather and a sum
per document.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Case, digits, punctuation and runs of
white space do not count. Ties go to the language that sorts first. With no labelled text every text is ``und``.
Rows are neither dropped nor merged, so repeated rows are scored alike; other columns pass through, and existing
``lang_pred`` or ``score`` columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm.common import bounded, pieces

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
TRAIN_ROWS = 20_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Start of each text and, per n-gram order, buckets and counting weights by position."""
    padded = [f" {t.lower()} " for t in texts]
    starts = np.cumsum([0] + [len(p) for p in padded[:-1]])
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    blank = ~letter
    double = np.append(blank[:-1] & blank[1:], True)
    buckets, weights = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            acc = np.full(len(code) - n + 1, n, np.uint32)
            keep = ~blank if n == 1 else ~double[: len(acc)].copy()
            for k in range(n):
                acc = (acc ^ code[k : k + len(acc)]) * np.uint32(0x9E3779B1)
                acc ^= acc >> np.uint32(15)
                if 0 < k < n - 1:
                    keep = keep & ~double[k : k + len(acc)]
            pad = np.zeros(n - 1, np.uint32)
            buckets.append(np.append(acc >> np.uint32(32 - BUCKET_BITS), pad))
            weights.append(np.append(keep[: len(acc)], np.zeros(n - 1, bool)))
    return starts, buckets, weights


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            total = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for _, texts in pieces(part["text"].tolist()):
                _, buckets, weights = _grams(texts)
                for b, w in zip(buckets, weights, strict=True):
                    total += np.bincount(b[w], minlength=1 << BUCKET_BITS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": pd.Series([lang] * len(at), dtype=object), "bucket": at, "n": total[at]})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS):
    """(languages, log-probability matrix of buckets by languages), fitted on about ``rows`` labelled rows."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sample = bounded(known, key, rows).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = sample.mapInPandas(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # languages x buckets at most
    langs = sorted(found["lang"].unique())
    matrix = np.zeros((1 << BUCKET_BITS, max(1, len(langs))))
    for i, name in enumerate(langs):
        own = found[found["lang"] == name]
        matrix[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    matrix += 0.5
    return langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def _scores(texts: list[str | None], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((len(texts), model.shape[1]))
    grams = np.zeros(len(texts))
    for rows, parts in pieces(texts):
        starts, buckets, weights = _grams(parts)
        for b, w in zip(buckets, weights, strict=True):
            for lang in range(model.shape[1]):
                np.add.at(total[:, lang], rows, np.add.reduceat(np.where(w, model[:, lang][b], 0), starts, dtype=np.float64))
            np.add.at(grams, rows, np.add.reduceat(w.astype(np.int64), starts))
    return total, grams


def predict(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The given rows with ``lang_pred`` and ``score`` (the posterior of that language under equal priors)."""
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(matrix)))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, logp = shared.value
        labels = np.array([*names, UNKNOWN], dtype=object)
        for batch in batches:
            total, grams = _scores(batch.tolist(), logp)
            best = total.argmax(axis=1)
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            share = odds.max(axis=1) / odds.sum(axis=1)
            known = (grams > 0) & bool(names)
            yield pd.DataFrame({"lang_pred": labels[np.where(known, best, len(names))], "score": np.where(known, share, 0.0)})

    found = docs.drop("lang_pred", "score").withColumn("__found", run(F.col(text)))
    return found.select("*", "__found.lang_pred", "__found.score").drop("__found")
