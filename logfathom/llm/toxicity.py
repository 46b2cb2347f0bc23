"""Toxicity scores over text restored by a noisy channel.

Writers hide words by leetspeak, by spacing the letters out and by repeating them. A written token is read as the output
of a channel: each sign may stand for itself or for letters it resembles, a run of one sign for one or two of it, and
separators between single letters for nothing. The lattice of these readings is decoded by Viterbi under a character
trigram model of the whole corpus, and the restored words are scored.

``language_model`` counts character trigrams over all words of all documents on the cluster (the model holds at most
``ALPHABET`` letters cubed). ``train`` counts restored words in toxic and other labelled texts and keeps those whose
excess among toxic ones is significant; a logistic regression weighs them. A token is decoded when it is
ambiguous and one of its readings could be a kept word; no other token can change a score.

Defined results: null and empty texts, and texts without a kept word, score the base rate of such texts. Without labels,
or without toxic ones, every score is 0. A word counts once per text. Rows are neither dropped nor merged; other columns
pass through, existing ``score`` and ``predicted`` columns are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm.common import durable, picked

TRAIN_ROWS = 40_000
ALPHABET = 64
EXCESS = 16.0  # twice the log-likelihood ratio that a kept word needs
MOST_WORDS = 5_000  # of the word table, strongest first
CUT = 0.7

# What a sign may stand for besides itself.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
            "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
_CLASS = str.maketrans({sign: ("i" if sign == "1" or sign == "|" else read[0]) for sign, read in READINGS.items()} | {"l": "i", "£": "i"})
_EDGE = re.compile(r"^[^\w@$(|!+€£*]+|[^\w@$|+€£]+$|([$@|+*!%#&])\1+$")
_SPREAD = re.compile(r"(?:\w[.\-_~·]){2,}\w")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
_RUN = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_SEPARATORS = re.compile(r"[.\-_~·\s]")


def bare(token: str) -> str:
    """A lower-case token without punctuation at its ends, nor separators between single letters."""
    if token.isalpha():
        return token
    token = _EDGE.sub("", _EDGE.sub("", token))
    return _SEPARATORS.sub("", token) if _SPREAD.fullmatch(token) else token


def skeleton(token: str) -> str:
    """One string for all tokens that may be written for the same word."""
    return _RUN.sub(r"\1", token.translate(_CLASS))


def ambiguous(token: str) -> bool:
    return not token.isalpha() and any(c.isalpha() for c in token) and any(c in READINGS for c in token) or bool(_LONG_RUN.search(token))


class LanguageModel:
    """Interpolated character trigrams; index 0 is the edge of a word, 1 any other letter."""

    def __init__(self, counts: dict[str, int]):
        letters: Counter[str] = Counter()
        for gram, n in counts.items():
            letters[gram[2]] += n
        letters.pop(" ", None)
        kept = sorted(letters, key=lambda c: (-letters[c], c))[: ALPHABET - 2]
        self.index = {" ": 0} | {c: i + 2 for i, c in enumerate(sorted(kept))}
        tri = np.zeros((ALPHABET, ALPHABET, ALPHABET))
        for gram, n in counts.items():
            a, b, c = (self.index.get(x, 1) for x in gram)
            tri[a, b, c] += n
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p = (uni + 0.5) / (uni + 0.5).sum()
        p = (bi + 8 * p) / (bi.sum(1, keepdims=True) + 8)
        self.logp = np.log((tri + 8 * p) / (tri.sum(2, keepdims=True) + 8)).astype(np.float32)

    def decode(self, token: str, gaps: bool = False) -> str:
        """The likeliest reading; with ``gaps`` word edges may stand between any two letters."""
        index, logp = self.index, self.logp
        best: dict[tuple[str, str], tuple[float, str]] = {(" ", " "): (0.0, "")}
        for run in (m.group() for m in re.finditer(r"(.)\1*", token)):
            sign, length = run[0], len(run)
            options = [(sign * min(length, 2), -0.2), (sign, -0.2 if length > 2 else -3.0)] if length > 1 else [(sign, -0.1)]
            if sign in READINGS:
                reads = [(c, -0.7) for c in READINGS[sign]]
                options = [(sign * length, -6.0 * length), *reads, *([(c * 2, -0.7) for c, _ in reads] if length > 1 else [])]
            if gaps:
                options += [(" " + o, cost - 1.0) for o, cost in options]
            step: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (total, text) in best.items():
                for emitted, cost in options:
                    x, y, value = a, b, total + cost
                    for c in emitted:
                        value += float(logp[index.get(x, 1), index.get(y, 1), index.get(c, 1)])
                        x, y = y, c
                    if (x, y) not in step or value > step[x, y][0]:
                        step[x, y] = (value, text + emitted)
            best = step
        end = {s: (v + float(logp[index.get(s[0], 1), index.get(s[1], 1), 0]), t) for s, (v, t) in best.items()}
        return max(end.values())[1]


def language_model(docs: DataFrame, text: str = "text") -> LanguageModel:
    """Character trigrams over all words of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: Counter[str] = Counter()
        words: Counter[str] = Counter()

        def settle() -> None:
            for word, n in words.items():
                word = word.strip(".,;:!?\"'()")
                if word.isalpha():
                    padded = f"  {word} "
                    for i in range(len(word) + 1):
                        grams[padded[i : i + 3]] += n
            words.clear()

        for batch in batches:
            for one in batch["t"]:
                if one:
                    words.update(one.lower().split())
                if len(words) > 200_000:
                    settle()
        settle()
        yield pd.DataFrame({"gram": pd.Series(list(grams), dtype=object), "n": list(grams.values())})

    counted = docs.select(F.col(text).alias("t")).mapInPandas(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "gram").limit(ALPHABET**3).toPandas()  # the model's size bounds it
    return LanguageModel(dict(zip(top["gram"], top["n"].astype(int), strict=True)))


class Reader:
    """Restored words of texts; readings of tokens are remembered."""

    def __init__(self, model: LanguageModel, words: set[str] | None = None):
        self.model, self.words = model, words
        self.skeletons = None if words is None else {skeleton(w) for w in words}
        self.known: dict[str, str] = {}

    def token(self, token: str, gaps: bool = False) -> str:
        """The word that a lower-case token stands for; one that can't be a kept word is left as it is."""
        plain = bare(token)
        if self.words is None:
            return self.model.decode(plain, gaps) if gaps or ambiguous(plain) else plain
        if plain in self.words:
            return plain
        if gaps or "*" in plain and any(c.isalpha() for c in plain) or skeleton(plain) in self.skeletons:
            return self.model.decode(plain, gaps)
        return plain

    def found(self, text: str | None) -> set[str]:
        if not text:
            return set()
        text = text.lower()
        out = set()
        for token in set(text.split()):
            word = self.known.get(token)
            if word is None:
                word = self.known[token] = self.token(token)
            out.add(word)
        for run in _SPACED.findall(text):
            out.update(self.token(_SEPARATORS.sub("", run), gaps=True).split())
        if len(self.known) > 400_000:
            self.known.clear()
        return out if self.words is None else out & self.words


def train(docs: DataFrame, labels: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> dict | None:
    """Words of toxic texts with their weights, from the documents of about ``rows`` labels (key, y)."""
    known = labels.where(F.col("y").isNotNull()).select(key, "y")
    sample = durable(picked(docs.select(key, F.col(text).alias("t")), known, key, rows).select("t", (F.col("y") == 1).cast("int").alias("y")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        seen: Counter[str] = Counter()
        toxic: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": list(seen.values()), "y": [toxic[w] for w in seen]})
            seen.clear()
            toxic.clear()
            return made

        for batch in batches:
            for one, y in zip(batch["t"], batch["y"], strict=True):
                words = reader.found(one)
                seen.update(words)
                if y:
                    toxic.update(words)
            if len(seen) > 300_000:
                yield out()
        yield out()

    totals = sample.agg(F.count("*"), F.sum("y")).first()
    if not totals[1]:
        return None
    base = min(totals[1] / totals[0], 0.9)
    counted = sample.mapInPandas(count, "word string, n bigint, y bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    rate = F.col("y") / F.col("n")
    miss = F.col("n") - F.col("y")
    excess = 2 * (F.col("y") * F.log(rate / base) + F.when(miss > 0, miss * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    strong = counted.where((F.col("y") > 0) & (rate >= max(0.5, 1.5 * base))).withColumn("excess", excess).where(F.col("excess") >= EXCESS)
    kept = strong.orderBy(F.desc("excess"), "word").limit(MOST_WORDS).toPandas()
    words = sorted(kept["word"])
    spotted = _spot(sample, {"model": model, "weight": dict.fromkeys(words, 0.0)}).where(F.size("found") > 0)
    got = spotted.select("y", "found").toPandas()  # rows of the bounded sample that hold kept words
    weight, bias = _weigh(words, got["found"].tolist(), got["y"].to_numpy(dtype=float))
    rest, toxic = totals[0] - len(got), totals[1] - got["y"].sum()
    return {"model": model, "weight": weight, "bias": bias, "base": float(toxic / max(1, rest))}


def _weigh(words: list[str], found: list, y: np.ndarray, steps: int = 400) -> tuple[dict[str, float], float]:
    """Logistic regression on which kept words a text holds: words that come together share their evidence."""
    index = {w: i for i, w in enumerate(words)}
    rows = np.array([i for i, ws in enumerate(found) for _ in ws], dtype=int)
    cols = np.array([index[w] for ws in found for w in ws], dtype=int)
    w, bias = np.zeros(len(words) + 1), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        raw = w[-1] + np.bincount(rows, weights=w[cols], minlength=len(y))
        miss = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
        grad = np.append(np.bincount(cols, weights=miss[rows], minlength=len(words)) + 0.1 * w[:-1], miss.sum())
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= 0.1 * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    bias = float(w[-1])
    return dict(zip(words, w[:-1].tolist(), strict=True)), bias


def _spot(docs: DataFrame, fitted: dict, text: str = "t") -> DataFrame:
    """Adds ``found``: the kept words that a text holds, restored, in order."""
    shared = docs.sparkSession.sparkContext.broadcast((fitted["model"], set(fitted["weight"])))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(*shared.value)
        for batch in batches:
            yield pd.Series([sorted(reader.found(t)) for t in batch], dtype=object)

    return docs.withColumn("found", run(F.col(text)))


def _scorer(docs: DataFrame, fitted: dict):
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        reader, weight = Reader(own["model"], set(own["weight"])), own["weight"]
        for batch in batches:
            out = []
            for text in batch:
                words = sorted(reader.found(text))
                raw = own["bias"] + math.fsum(weight[w] for w in words)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))) if words else own["base"])
            yield pd.Series(out, dtype=float)

    return run


def score(docs: DataFrame, fitted: dict | None, text: str = "text", cut: float = CUT) -> DataFrame:
    """The given rows with ``score`` in 0 to 1 and ``predicted`` (1 from ``cut`` on)."""
    docs = docs.drop("score", "predicted")
    if fitted is None:
        scored = docs.withColumn("score", F.lit(0.0))
    else:
        scored = docs.withColumn("score", _scorer(docs, fitted)(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
