"""What the corpus operators share: tables, durable intermediates, word splitting and hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="corpus-"))
    return f"file://{_OWN_DIR[0]}"


def durable(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps survive lost executors and start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows, the same ones every time, picked by a hash of the key; all rows if there are no more."""
    rows = df.count()
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * most / rows))


def picked(docs: DataFrame, labels: DataFrame, key: str, most: int) -> DataFrame:
    """The documents of about ``most`` labels, with the labels' columns. The label sample is bounded, so it is broadcast and
    no text is shuffled."""
    return docs.join(F.broadcast(bounded(labels, key, most)), key)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z only) words of a text, split at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window of ``width`` words, in order; with fewer words, of the whole sequence."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            acc = (acc + hashes[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        return mix64(acc)


def pieces(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Cut texts into runs of at most about ``most`` characters: (row of each piece, pieces)."""
    rows, out, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), most):
            piece = text[at : at + most]
            if size and size + len(piece) > most:
                yield np.array(rows), out
                rows, out, size = [], [], 0
            rows.append(i)
            out.append(piece)
            size += len(piece)
    if out:
        yield np.array(rows), out


LINE = re.compile(r"[\r\n]+")
