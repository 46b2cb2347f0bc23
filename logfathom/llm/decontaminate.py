"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names (capitalised words) and units turn into typed placeholders. Windows of ``WINDOW``
template words of the documents are hash-joined with those of the benchmark, and so are windows of the plain words.
Matches of a document with an item are lined up. A run of ``MIN_RUN`` equal words (or the whole item) in a line of
consecutive windows is a verbatim leak. So many words whose slots are consistent are a leak as well: every value of the
item stands for one value of the document, as in a question asked again with other numbers and names. A line is split
where its slots clash, not rejected.

Only windows that can occur in the benchmark leave the scan: its tasks hold a bit table and the sorted hashes of the
benchmark's windows. That table is broadcast up to ``BROADCAST`` windows; beyond, every window goes through the join.

Defined results: words are split at white space, freed of punctuation at their ends and lower-cased. A stretch
with other slots needs ``LITERALS`` words that are no placeholders, so text of names and numbers alone leaks only verbatim;
windows with fewer than ``SEED_LITERALS`` count only as the continuation of others. Capitalised words of ``COMMON`` are no names. An item shorter
than a window is searched as one window of its own length, verbatim. Null and empty texts, items without words and rows
without an id match nothing. Repeated rows of one id count once. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm.common import durable, window_hashes, word_hashes

WINDOW = 8
LITERALS = 5  # of a stretch
SEED_LITERALS = 3  # of a window; a stretch of 13 words with five has a window with three
MIN_RUN = 13
BROADCAST = 1_000_000
BIT_TABLE = 24
# Words that state a unit of measure.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles g mg kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh hz kb mb gb tb".split()
)
# Words that often begin a sentence and name nobody. Third-person pronouns aren't among them: they change with the names.
COMMON = frozenset(
    "a about after all also although an and another any are as at because before both but by can could did do does during each every few find finally "
    "first for from given had has have here how however i if in is it its last later let many more most much my next no not now of on once one only or "
    "other our over please second show since so some still such suppose than that the their then there therefore these they this those though to "
    "today under until was we were what when where whether which while who whose why will with without would write yes yet you your "
    "aber alle als am an auch auf aus bei beim da damit dann das dass dein dem den denn der des die dies diese dieser doch du durch ein eine einem einen "
    "einer es finde für hat heute hier ich im ist ja jede jeder jedes kann kein mit nach nein nicht noch nun nur oder ohne seit sind so über um und unter "
    "viele von vor wann war warum was weil welche wenn wer wie wieviel wir wird wo zu zum zur zwei "
    "après au aussi avec avant car ce ces cette chaque comme comment dans de des donc du elles en et il ils je la le les leur lorsque mais ne nous où par "
    "pour pourquoi quand que quel quelle qui sans si son sont sous sur tous un une vous "
    "al cada como con cuando cuántas cuántos cuál de del desde después donde dónde el ella en entre es esta este hay la las lo los más muchos no o para pero "
    "por porque qué quién se si sin sobre su también todos un una y".split()
) - {"il", "ils", "elles", "ella", "one", "second"}
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
_NUMBER = re.compile(r"[$€£+-]*\d[\d.,:/]*%?")
LITERAL, NUMBER, NAME, UNIT = range(4)


def canonical(word: str) -> tuple[str, int]:
    """The plain form of a word and its kind."""
    bare = _EDGE.sub("", word)
    plain = bare.lower()
    if _NUMBER.fullmatch(bare):
        return plain, NUMBER
    if plain in UNITS:
        return plain, UNIT
    if bare[:1].isupper() and (len(bare) == 1 or bare[1:].islower()) and plain not in COMMON:
        return plain, NAME
    return plain, LITERAL


class Canon(dict):
    """Numbers words by their written form; plain forms, kinds and hashes by number, in arrays that grow by doubling."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.plain: list[str] = []
        self.kinds: list[int] = []
        self.filled, self.hashes, self.kind_of = 0, np.empty((1 << 16, 2), np.uint64), np.empty(1 << 16, np.int8)

    def __missing__(self, word: str) -> int:
        plain, kind = (word, LITERAL) if word.islower() and word.isalpha() and word not in UNITS else canonical(word)
        self[word] = at = len(self.plain)
        self.plain.append(plain)
        self.kinds.append(kind)
        return at

    def _fill(self) -> None:
        first, last = self.filled, len(self.plain)
        while last > len(self.kind_of):
            self.hashes, self.kind_of = np.concatenate([self.hashes, np.empty_like(self.hashes)]), np.concatenate([self.kind_of, np.empty_like(self.kind_of)])
        plain = word_hashes([w.encode("utf-8", "surrogatepass") for w in self.plain[first:last]])
        kinds = np.array(self.kinds[first:last], np.int8)
        self.hashes[first:last, 0] = plain
        self.hashes[first:last, 1] = np.where(kinds == LITERAL, plain, kinds.astype(np.uint64))
        self.kind_of[first:last], self.filled = kinds, last

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, plain hashes, template hashes and kinds of a text."""
        if len(self.plain) > 500_000:
            self.clear()
        words = text.split() if text else []
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.plain) > self.filled:
            self._fill()
        both = self.hashes[at]
        return at, both[:, 0], both[:, 1], self.kind_of[at]


def _beside(keep: np.ndarray, seed: np.ndarray, reach: int) -> np.ndarray:
    """Whether places without a gap in ``keep`` lead to a seed at most ``reach`` away."""
    at = np.arange(len(keep))
    out = np.zeros(len(keep), bool)
    for way in (1, -1):
        k, s = keep[::way], seed[::way]
        gap, last = (np.maximum.accumulate(np.where(x, at, -1)) for x in (~k, s))
        out |= (k & (last > gap) & (at - last <= reach))[::way]
    return out


def _windows(canon: Canon, text: str | None, widths: list[int], reach: int, wanted=None) -> Iterator[tuple[int, int, int, int, str]]:
    """(hash, position, width, 1 for a template, plain words with kinds) of the windows of a text that are wanted."""
    at, plain, templates, kinds = canon.read(text)
    slots = np.concatenate([[0], np.cumsum(kinds != LITERAL)])
    for width in widths:
        n = len(at) - width + 1
        if n < 1:
            continue
        for template in (0, 1) if width == WINDOW else (0,):
            h = window_hashes(templates if template else plain, width) ^ np.uint64(width * 2 + template)
            keep = np.ones(n, bool) if wanted is None else wanted(h)
            if template:
                filled = slots[width:] - slots[:-width]
                seed = (filled > 0) & (filled <= width - SEED_LITERALS)
                keep &= (filled > 0) & (seed | _beside(keep, keep & (seed | (filled == 0)), reach))
            for i in np.flatnonzero(keep).tolist():
                words = " ".join(f"{kinds[j]}{canon.plain[at[j]]}" for j in range(i, i + width))
                yield int(h[i].view(np.int64)), i, width, template, words


def _window_rows(df: DataFrame, key: str, widths: list[int], reach: int, shared=None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon, wanted = Canon(), None
        if shared is not None:
            known = shared.value
            bits = np.zeros(1 << BIT_TABLE, bool)
            shift = np.uint64(64 - BIT_TABLE)
            bits[(known >> shift).astype(np.int64)] = True

            def wanted(h: np.ndarray) -> np.ndarray:
                keep = bits[(h >> shift).astype(np.int64)]
                maybe = np.flatnonzero(keep)
                keep[maybe] = known[np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)] == h[maybe]
                return keep

        names = ["id", "h", "pos", "width", "template", "words"]
        for batch in batches:
            out = []
            for one, text in zip(batch["id"], batch["text"], strict=True):
                for row in _windows(canon, text, widths, reach, wanted):
                    out.append((one, *row))
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out = []
            yield pd.DataFrame(out, columns=names, dtype=object)

    rows = df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("bigint").alias("id"), "text")
    return rows.mapInPandas(run, "id long, h long, pos int, width int, template int, words string")


def consistent(ours: list[str], theirs: list[str]) -> tuple[bool, bool]:
    """(all words are equal, each value stands for one value both ways) for two lined-up word lists with kinds."""
    if [w[1:] for w in ours] == [w[1:] for w in theirs]:
        return True, True
    there, back = {}, {}
    for a, b in zip(ours, theirs, strict=True):
        if a[0] != b[0] or (a[0] == "0" and a != b) or there.setdefault(b, a) != a or back.setdefault(a, b) != b:
            return False, False
    return False, True


def _words(stretch: list) -> tuple[list[str], list[str]]:
    """The lined-up words, with kinds, of a stretch of consecutive windows."""
    ours, theirs = stretch[0][3].split(" "), stretch[0][4].split(" ")
    for w in stretch[1:]:
        more = w[0] + w[2] - stretch[0][0] - len(ours)
        if more > 0:
            ours += w[3].split(" ")[-more:]
            theirs += w[4].split(" ")[-more:]
    return ours, theirs


def _stretches(line: list) -> Iterator[tuple[int, list[str], list[str]]]:
    """(first word, words, item words) of the parts of a line, sorted by position, whose windows overlap or touch."""
    stretch: list = []
    for one in [*line, None]:
        if stretch and (one is None or one[0] > max(w[0] + w[2] for w in stretch[-2:])):
            yield stretch[0][0], *_words(stretch)
            stretch = []
        if one is not None:
            stretch.append(one)


def _equal_runs(ours: list[str], theirs: list[str]) -> Iterator[tuple[int, int]]:
    begin = 0
    for at in range(len(ours) + 1):
        if at == len(ours) or ours[at][1:] != theirs[at][1:]:
            if at > begin:
                yield begin, at
            begin = at + 1


def _fitting(ours: list[str], theirs: list[str]) -> Iterator[tuple[int, int]]:
    """The longest parts in which every value stands for one value both ways: each begins after the clash that ends it."""
    there: dict[str, int] = {}
    back: dict[str, int] = {}  # last place of every item word and document word
    begin = 0
    for at, (a, b) in enumerate(zip(ours, theirs, strict=True)):
        kinds, a, b = a[0] + b[0], a[1:], b[1:]
        if a != b and kinds not in ("11", "22", "33"):
            clash = at
        else:
            i, j = there.get(b, -1), back.get(a, -1)
            clash = max(i if i >= 0 and ours[i][1:] != a else -1, j if j >= 0 and theirs[j][1:] != b else -1)
        if clash >= begin:
            if at > begin:
                yield begin, at
            begin = clash + 1
        there[b] = back[a] = at
    if len(ours) > begin:
        yield begin, len(ours)


def leaks_of(windows: list[tuple[int, int, int, str, str]], length: int, run: int = MIN_RUN) -> list[tuple[int, int, str]]:
    """Leaks of an item of ``length`` words: (first word, words, kind) from (position, item position, width, words, item words).

    Runs of equal words are judged first, then the parts of a stretch with consistent slots. A part inside a run is not told again.
    """
    lines: dict[int, list] = {}
    for one in sorted(windows):
        lines.setdefault(one[0] - one[1], []).append(one)
    out = []
    for line in lines.values():
        for first, ours, theirs in _stretches(line):
            same = [(i, j) for i, j in _equal_runs(ours, theirs) if j - i >= min(run, length)]
            out += [(first + i, j - i, "verbatim") for i, j in same]
            for i, j in _fitting(ours, theirs):
                long_enough = j - i >= min(run, length) and sum(w[0] == "0" for w in ours[i:j]) >= LITERALS
                if long_enough and not any(a <= i and j <= b for a, b in same):
                    out.append((first + i, j - i, "reparameterised"))
    return out


# Java's form of the words that ``str.split`` gives: items' lengths count the words that the windows are made of.
SPLIT_WORD = r"[^\x1c-\x1f\p{IsWhite_Space}]+"


def leaks(docs: DataFrame, benchmark: DataFrame, run: int = MIN_RUN, broadcast: int = BROADCAST) -> DataFrame:
    """One row per leak: doc_id, item_id, first word and number of words in the document, kind."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    items = items.withColumn("length", F.regexp_count("text", F.lit(SPLIT_WORD))).where("length > 0")
    short = items.where(F.col("length") < WINDOW).select("length").distinct().toPandas()["length"].tolist()  # below WINDOW values
    widths = sorted({WINDOW, *map(int, short)})
    reach = items.agg(F.max("length")).first()[0] or 0  # no line of windows is longer
    known = durable(_window_rows(items, "item_id", widths, reach).join(items.select(F.col("item_id").alias("id"), "length"), "id").where(F.col("width") == F.least("length", F.lit(WINDOW))))
    hashes = known.select("h").distinct()
    shared = None
    if hashes.count() <= broadcast:
        found = hashes.toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64)  # ``broadcast`` numbers at most
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(found)) if len(found) else None
        if shared is None:
            return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word int, n_words int, kind string")
    ours = _window_rows(docs, "doc_id", widths, reach, shared).select(F.col("id").alias("doc_id"), "h", "pos", "words")
    theirs = known.select("h", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "width", F.col("words").alias("item_words"), "length")
    met = ours.join(theirs, "h").groupBy("doc_id", "item_id", "length").agg(F.collect_set(F.struct("pos", "item_pos", "width", "words", "item_words")).alias("met"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, item, length, met in zip(batch["doc_id"], batch["item_id"], batch["length"], batch["met"], strict=True):
                windows = [(m["pos"], m["item_pos"], m["width"], m["words"], m["item_words"]) for m in met]
                out += [(doc, item, *one) for one in leaks_of(windows, length, run)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "start_word", "n_words", "kind"], dtype=object)

    return met.mapInPandas(judge, "doc_id long, item_id long, start_word int, n_words int, kind string")


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without a leak; rows without an id stay."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
