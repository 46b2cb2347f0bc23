"""Near-duplicates, repeated passages and benchmark leaks against brute force."""

import random
import tracemalloc
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from logfathom.llm import components, decontaminate, near_dedup, substring
from logfathom.llm.common import window_hashes, word_hashes, words_of

WORDS = [f"w{i}" for i in range(2000)]


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def edited(words, seed, edits):
    rng, out = random.Random(seed), list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def brute_components(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").split()
        grams = {tuple(w.lower() for w in words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        sets[i] = grams
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            least[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus():
    rows = [(i, " ".join(prose(i, 40 + i % 60))) for i in range(60)]
    rows += [(100 + i, " ".join(edited(prose(i, 40 + i % 60), i, 1 + i % 3))) for i in range(30)]
    crowd = prose(999, 120)
    rows += [(200 + i, " ".join(edited(crowd, i, i % 5))) for i in range(40)]
    rows += [(300 + i, "One two THREE") for i in range(3)] + [(310, "one two"), (311, ""), (312, None), (313, "\t \n"), (314, "")]
    return rows


@pytest.mark.parametrize("leaf, depth", [(16, 4), (2, 2), (2, 1)])
def test_components_equal_brute_force(spark, leaf, depth):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS key", "2 AS component", "3 AS rep")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, leaf=leaf, depth=depth).collect()}
    assert got == brute_components(rows)


def test_intersections_equal_plain_sets():
    rng = np.random.default_rng(4)
    for pool, size in ((50, 30), (400, 60), (5000, 40), (9000, 3000)):
        left, right = ([np.unique(rng.integers(0, pool, rng.integers(1, size)).astype(np.uint64)) for _ in range(k)] for k in (17, 40))
        want = [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
        assert near_dedup.intersections(left, right).tolist() == want
    assert near_dedup.intersections([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0.0]]


def test_a_crowd_just_under_the_limit_is_compared_whole(spark, monkeypatch):
    """Members of many small groups inside one crowd of similar texts, in blocks of a few rows."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    base = prose(31, 150)
    rows = [(100 * g + k, " ".join(edited(edited(base, g, 6), 1000 * g + k, k))) for g in range(12) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, leaf=2, depth=1).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 1


def test_near_duplicates_odd_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = " ".join(prose(1, 50))
    rows = [(5, same), (5, same), (None, same), (None, "all alone here"), (7, "word " * 30_000)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(map(tuple, got), key=str)
    assert found == sorted([(5, 46, 5, True), (5, 46, 5, True), (None, 46, 5, False), (None, 1, None, True), (7, 1, 7, True)], key=str)


def test_a_pair_at_the_limit_is_a_link(spark):
    base = prose(4, 104)  # 100 shingles; with the last 14 + 2/7 replaced both sides share 75 of 100 and more
    rows = [(i, " ".join(base[: 104 - i])) for i in (0, 25, 26)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 25: 0, 26: 0}
    alone = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).collect()}
    assert alone == {0: 0, 26: 26}


def test_a_class_meets_the_hubs_of_one_node_only(spark, monkeypatch):
    """Nodes hold much the same crowd, so comparing its members in all of them made rows per node."""
    base = prose(41, 150)
    rows = [(i, " ".join(edited(base, i, i % 4))) for i in range(60)]
    pairs, met = near_dedup._pairs, []

    def counted(left, right, *given):
        if left is not right:
            met.append((left.count(), left.select("rep").distinct().count()))
        return pairs(left, right, *given)

    monkeypatch.setattr(near_dedup, "_pairs", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=4, depth=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert met and all(n == classes > 20 for n, classes in met)


def test_connected_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (101, 100)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100), (103, 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_equals_quadratic_dynamic_programme():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randrange(1, 25)
        x = np.array(sorted(rng.sample(range(200), n)))
        y = np.array([rng.randrange(200) for _ in range(n)])
        best = []
        for j in range(n):
            best.append(max([5.0] + [best[i] - 0.1 * (x[j] - x[i] + y[j] - y[i]) + 5 for i in range(j) if y[i] < y[j]]))
        first = substring.chain(x, y, widest=10**6)[0]
        own = 5.0 * len(first) - 0.1 * float((x[first[-1]] - x[first[0]]) + (y[first[-1]] - y[first[0]]))
        assert own == pytest.approx(max(best)) and (np.diff(x[first]) > 0).all() and (np.diff(y[first]) > 0).all()


def test_pairs_chained_together_equal_pairs_chained_alone(monkeypatch):
    rng = np.random.default_rng(8)
    counts, packed, want = [], [], []
    for trial in range(300):
        x = np.arange(rng.integers(1, 90)) + rng.integers(0, 500) if trial % 3 else rng.integers(0, 60, rng.integers(1, 12))
        y = x + rng.integers(0, 30) if trial % 3 else rng.integers(0, 60, len(x))
        if trial % 3 == 2:  # two runs, apart by less or more than a chain may be
            x, y = np.append(x, x + len(x) + rng.integers(0, 60)), np.append(y, y + len(y) + rng.integers(0, 60))
        own = np.unique(np.append(x, x[:1]) * 2**31 + np.append(y, y[:1]))
        counts.append(len(x) + 1)
        packed.append(rng.permutation(np.append(x, x[:1]) * 2**31 + np.append(y, y[:1])))
        a, b = own // 2**31, own % 2**31
        order = np.lexsort((a, a - b))
        a, b = a[order], b[order]
        begins = np.append(True, (np.diff(a) != 1) | (np.diff(b) != 1))
        first = np.flatnonzero(begins)
        keep = ((np.arange(len(a)) - first[np.cumsum(begins) - 1]) % substring.THIN == 0) | np.append(begins[1:], True)
        a, b = a[keep], b[keep]
        want += [(trial, a[one].tolist(), b[one].tolist()) for one in substring.chain(a, b)]
    chain, alone = substring.chain, []
    monkeypatch.setattr(substring, "chain", lambda *given: alone.append(1) or chain(*given))
    pair, x, y, sizes = substring.chains_of(np.array(counts), np.concatenate(packed))
    edges = np.cumsum(sizes)[:-1]
    got = [(int(p), a.tolist(), b.tolist()) for p, a, b in zip(pair, np.split(x, edges), np.split(y, edges), strict=True)]
    assert sorted(got) == sorted(want) and len(alone) < 200
    assert [len(part) for part in substring.chains_of(np.empty(0, int), np.empty(0, int))] == [0, 0, 0, 0]


def test_passages_are_found_and_cut(spark):
    passage, fuzzy = prose(77, 80), prose(78, 90)
    rows = [(1, prose(1, 100) + passage + prose(2, 50)), (2, passage + prose(3, 30)), (3, prose(5, 200)), (4, prose(6, 20) + fuzzy),
            (5, prose(7, 60) + edited(fuzzy, 1, 4) + prose(8, 10)), (6, prose(9, 30) + passage[:30] + prose(10, 30)), (9, [])]
    docs = spark.createDataFrame([(i, " ".join(w), "s") for i, w in rows] + [(10, None, "s"), (None, " ".join(passage), "s")], "doc_id long, text string, source string")
    found = substring.repeated_passages(docs)
    got = {(r.doc_id, r.source_id): r for r in found.collect()}
    assert set(got) == {(2, 1), (5, 4)}
    assert (got[2, 1].start_word, got[2, 1].end_word, got[2, 1].source_start, got[2, 1].matched) == (0, 80, 100, 80)
    assert abs(got[5, 4].start_word - 60) <= 4 and abs(got[5, 4].end_word - 150) <= 4
    kept = {r.doc_id: r.text for r in substring.remove_repeats(docs, found).collect()}
    assert kept[2] == " ".join(prose(3, 30)) and kept[1] == " ".join(rows[0][1]) and kept[10] is None and kept[9] == ""
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def test_every_copy_of_a_passage_is_found(spark):
    passage = prose(50, 60)
    rows = [(i, " ".join(prose(1000 + i, 40) + passage + prose(2000 + i, 40))) for i in range(50)] + [(60, "of " * 200), (61, "x " * 9 + "of " * 150)]
    got = {(r.doc_id, r.source_id) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(1, 50)} | {(61, 60)}


def test_a_passage_whose_seeds_are_known_is_found(spark):
    """Its seeds occur first in documents that hold parts of it only: in two, or in many."""
    passage = prose(60, 60)
    parts = [passage[:30], passage[30:]]
    for copies in (1, 12):
        rows = [(i, prose(3000 + i, 40) + parts[i % 2] + prose(4000 + i, 40)) for i in range(2 * copies)]
        rows += [(100 + i, prose(5000 + i, 40) + passage + prose(6000 + i, 40)) for i in range(3)]
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
        got = {(r.doc_id, r.source_id): r.matched for r in substring.repeated_passages(docs).collect()}
        assert got[101, 100] == 60 and 60 in (got.get((102, 100)), got.get((102, 101))) and {d for d, _ in got} == {101, 102}


def test_an_edited_passage_of_common_seeds_is_found(spark):
    """Every stretch that two documents share occurs in twelve earlier ones, each time with other words around it."""
    passage = prose(61, 64)
    other = [f"e{i}" if i % 8 == 7 else w for i, w in enumerate(passage)]
    rows = [(100 * c + n, prose(100 * c + n, 25) + passage[8 * c : 8 * c + 7] + prose(9000 + 100 * c + n, 25)) for c in range(8) for n in range(12)]
    rows += [(1000, prose(70, 30) + passage + prose(71, 30)), (1001, prose(72, 20) + other + prose(73, 40)), (1002, prose(74, 50) + other[:30])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = [tuple(r) for r in substring.repeated_passages(docs).collect()]
    assert [row[:2] for row in got] == [(1001, 1000)] and got[0][2] == 20 and got[0][6] == 56


def test_a_long_run_of_one_word_is_covered_by_a_shorter_one(spark):
    docs = spark.createDataFrame([(1, "x y " + "of " * 50 + "z"), (2, "a " * 7 + "of " * 333 + "b " * 7)], "doc_id long, text string")
    spans = [set(range(r.start_word, r.end_word)) for r in substring.repeated_passages(docs).collect()]
    assert set().union(*spans) == set(range(7, 340))


def test_pairs_of_common_seeds_equal_brute_force():
    """Open occurrences meet the earlier ones that end their run there and have three words in common beyond it."""
    r = random.Random(3)
    line = prose(62, 12)
    texts = [[r.choice("abcdefg") for _ in range(r.randrange(9))] + line[r.randrange(3) :] + [r.choice("abcdefg") for _ in range(r.randrange(20))] for _ in range(60)]
    texts += [["a"] * 30 + ["b", "c", "d"], ["a"] * 9 + ["b", "c", "e"], line]
    rows = []
    for doc, words in enumerate(texts):
        spans = [(0, len(words))] if doc % 5 == 4 else []
        h, pos, places = substring.places_of(" ".join(words), np.arange(len(words)), spans)
        assert len(h) == len(words) - 4 and (pos == np.arange(len(h))).all() and (places["open"] == (doc % 5 != 4)).all()
        rows.append((np.full(len(h), doc), pos, places))
    doc, pos, places = (np.concatenate(x) for x in zip(*rows, strict=True))

    def grams(words):
        return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}

    want = set()
    for i, j in combinations(range(len(doc)), 2):
        a, b, p, q = texts[doc[j]], texts[doc[i]], pos[j], pos[i]
        if places["open"][j] and doc[i] != doc[j] and a[p : p + 5] == b[q : q + 5]:
            for x, y in ((a[max(0, p - 13) : p][::-1], b[max(0, q - 13) : q][::-1]), (a[p + 5 : p + 18], b[q + 5 : q + 18])):
                if x[:1] != y[:1] and grams(x) & grams(y):
                    want.add((j, i))
    for most in (7, 10**6):
        later, earlier = substring.matches_in_context(doc, places, most)
        assert set(zip(later.tolist(), earlier.tolist(), strict=True)) == want and len(later) == len(want) > 200
    assert [len(x) for x in substring.matches_in_context(doc[:0], places[:0])] == [0, 0]


def test_open_seeds_of_a_document():
    """A stretch of common seeds is open if one of its seeds lies in no passage, also one left out between equal seeds."""
    words = prose(63, 40)
    _, pos, places = substring.places_of(" ".join(words), np.array([2, 3, 4, 20, 21, 22, 99]), [(1, 8), (15, 27)])
    assert pos.tolist() == [2, 3, 4, 20, 21, 22] and places["open"].tolist() == [True] * 3 + [False] * 3
    _, pos, places = substring.places_of(" ".join(["a"] * 30 + ["b"]), np.array([0]), [(0, 9), (20, 31)])
    assert pos.tolist() == [0, 25] and places["open"].all() and places["next"][0, 0] == 0 and places["next"][0, 1] == places["next"][1, 0] != places["next"][1, 1]
    assert [len(x) for x in substring.places_of(None, np.array([0]), [])] == [0, 0, 0]


def test_edited_passages_are_found(spark):
    """60 words with one edit in every 8, 7 or 6, and 80 words with one in every 6: at least 83 per cent equal."""
    rows = []
    for trial in range(80):
        n, step = [(60, 8), (60, 7), (60, 6), (80, 6)][trial % 4]
        passage = prose(7000 + trial, n)
        other = [f"e{trial}x{i}" if i % step == step // 2 else w for i, w in enumerate(passage)]
        rows += [(2 * trial, prose(8000 + trial, 40) + passage), (2 * trial + 1, prose(9000 + trial, 40) + other)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.source_id) for r in substring.repeated_passages(docs).collect()}
    assert got == {(2 * t + 1, 2 * t) for t in range(80)}


def test_a_stretch_at_the_limit_is_a_passage():
    pieces = [(3, 3, 3), (1, 1, 0)] * 20
    assert substring.passages(0, 100, pieces) == [(0, 80, 100, 180, 60)]
    assert all(b - a < 50 for a, b, *_ in substring.passages(0, 100, [(3, 3, 3), (2, 2, 0)] * 20))


def test_chains_left_out_early_hold_no_passage(spark, monkeypatch):
    """Texts of few phrases, edited at random, with passages near the limit and at the edges of texts."""
    r = random.Random(11)
    phrases = [prose(20_000 + i, r.randint(3, 9)) for i in range(60)]
    rows = []
    for i in range(120):
        words = [w for _ in range(r.randint(1, 30)) for w in r.choice(phrases)]
        passage = [w if r.random() < 0.9 else f"e{i}x{j}" for j, w in enumerate(prose(21_000 + i % 7, 58))]
        at = r.choice([0, len(words) // 2, len(words)])
        rows.append((i, " ".join(words[:at] + passage + words[at:] if i % 3 else words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(row) for row in substring.repeated_passages(docs).collect()}
    monkeypatch.setattr(substring, "_extensible", lambda docs, chains, k, least: chains)
    assert got == {tuple(row) for row in substring.repeated_passages(docs).collect()} and len(got) > 100


def test_narrow_integers_come_back():
    for values in ([0], [255, 1], [256, 0, 7], [2**16], [2**32, 5], [2**63]):
        x = np.array(values, np.uint64)
        assert (substring.widen(substring.narrow(x), len(x)).view(np.uint64) == x).all()
    ids = np.array([-(2**63), -5, 3, 2**63 - 1])
    steps = np.append(np.uint64(0), np.diff(ids.view(np.uint64)))
    assert (ids[0] + np.cumsum(substring.widen(substring.narrow(steps), 4)) == ids).all()


def test_passages_of_extreme_ids_are_found(spark):
    passage = " ".join(prose(31, 70))
    docs = spark.createDataFrame([(-(2**63), passage), (2**63 - 1, f"x {passage}"), (-1, passage)], "doc_id long, text string")
    got = {(r.doc_id, r.source_id) for r in substring.repeated_passages(docs).collect()}
    assert {(-1, -(2**63)), (2**63 - 1, -(2**63))} <= got


def test_cut_words_keeps_the_rest():
    assert substring.cut_words("a  b\nc d", [(1, 3)]) == "a  d"
    assert substring.cut_words("a b c d", [(0, 2), (1, 9)]) == ""
    assert substring.cut_words("a b", []) == "a b"


ITEM = "Anna has 12 red apples in a basket and gives 5 of them to her neighbour while Tom carries 30 kg of potatoes over the hill"


def leaked(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS length", "2 AS h")
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string"), **more).collect()}


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_leaks_verbatim_and_with_other_slots(spark, bound):
    other = ITEM.replace("Anna", "Berta").replace("12", "40").replace("Tom", "Max").replace("30 kg", "9 lbs").replace("5 of", "7 of")
    broken = "{0} has 3 red apples in a basket and gives 3 of them".format("Eva")
    pad = " ".join(prose(1, 20))
    docs = [(1, f"{pad} {ITEM.upper().replace('ANNA', 'anna')} {pad}"), (2, f"{pad} {other} {pad}"), (3, f"{pad} {broken} {pad}"), (4, pad), (5, ""), (6, None), (None, ITEM)]
    got = leaked(spark, docs, [(1, ITEM), (2, None), (3, ""), (None, ITEM)], broadcast=bound)
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised"}


def test_inconsistent_slots_are_no_leak():
    ours = "1 0a 17 0b".replace("1 ", "1x ").split()
    assert decontaminate.consistent(["1x", "0a", "1x"], ["1y", "0a", "1y"]) == (False, True)
    assert decontaminate.consistent(["1x", "0a", "1z"], ["1y", "0a", "1y"]) == (False, False)
    assert decontaminate.consistent(["1x", "0a", "1x"], ["1y", "0a", "1w"]) == (False, False)
    assert decontaminate.consistent(ours, ours) == (True, True)


def test_a_clash_of_slots_keeps_what_lies_beside_it(spark):
    other = ITEM.replace("Anna", "Berta").replace("12", "40").replace("5 of", "7 of")
    docs = [(1, ITEM.replace("12", "5")), (3, other.replace("Tom", "Berta"))]
    assert leaked(spark, docs, [(1, ITEM)]) == {(1, 1): "verbatim", (3, 1): "reparameterised"}
    words = [f"0{w}" for w in "a b c d e f g h".split()]
    assert list(decontaminate._fitting(["1x", *words, "1x", *words], ["1y", *words, "1z", *words])) == [(0, 9), (1, 18)]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_questions_dense_with_slots_are_found(spark, bound):
    items = [(1, "Tom has 3 pens. Ann has 5 pens. How many pens do they have?"), (2, "Sam drove 90 miles in 2 hours. Then he drove 60 miles in 3 hours. How far did he drive in all?")]
    items += [(3, "we write down 1 2 3 4 5 6 7 8 9 10 11 12 and then stop here")]
    docs = [(1, "Max has 4 pens. Eva has 9 pens. How many pens do they have?"), (2, "Jim drove 80 miles in 4 hours. Then he drove 50 miles in 5 hours. How far did he drive in all?")]
    docs += [(3, "we write down 21 22 23 24 25 26 27 28 29 30 31 32 and then stop here"), (4, " ".join(map(str, range(300))))]
    assert leaked(spark, docs, items, broadcast=bound) == {(i, i): "reparameterised" for i in (1, 2, 3)}


def test_short_items_and_empty_benchmark(spark):
    assert leaked(spark, [(1, "so what is life about then"), (2, "what is")], [(1, "What is life?"), (2, "?!")]).get((1, 1)) == "verbatim"
    assert leaked(spark, [(1, "x")], []) == {}
    assert leaked(spark, [], [(1, ITEM)]) == {}


def test_leaks_equal_brute_force(spark):
    items = [(i, " ".join(prose(500 + i, 15 + 3 * i))) for i in range(8)]
    docs = [(d, " ".join(prose(d, 30) + (items[d % 8][1].split() if d % 3 == 0 else []) + prose(d + 1, 30))) for d in range(40)]
    want = {(d, i) for d, text in docs for i, item in items if f" {item} " in f" {text} "}
    assert set(leaked(spark, docs, items)) == want


def test_window_hashes_tell_lengths_apart():
    h = word_hashes(words_of("A a b \x1fc"))
    assert len(h) == 3 and len(window_hashes(h, 5)) == 1 and len(window_hashes(h, 2)) == 2
    assert window_hashes(h[:1], 5)[0] != window_hashes(np.repeat(h[:1], 2), 5)[0]


def test_items_set_apart_by_other_blanks_have_as_many_words_as_their_windows(spark):
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    assert all(b.isspace() for b in blanks)
    rows = [(i, f"a{b}b{b}{b}c\u200bd") for i, b in enumerate(blanks)]
    counted = spark.createDataFrame(rows, "i long, text string").select(F.regexp_count("text", F.lit(decontaminate.SPLIT_WORD)).alias("n"), "text").collect()
    assert all(r.n == len(r.text.split()) == 3 for r in counted)
    words = "how many cups of the warm tea did they then drink together".split()
    items = [(1, "\xa0".join(words))]
    docs = [(1, "They drink to the weather of many warm days."), (2, "It asks: " + " ".join(words))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {2}


def test_packing_keeps_few_copies_of_the_seeds(spark):
    """A seed is 24 bytes; joining, sorting and packing all seeds of a batch takes 64 bytes a seed at most."""

    class Docs:
        def where(self, *_):
            return self

        select = where

        def mapInPandas(self, run, _):
            return run

    batch = pd.DataFrame({"doc_id": range(150), "text": [" ".join(f"w{i}x{j}" for j in range(3000)) for i in range(150)]})
    run = substring._packs(Docs(), substring.K, substring.MIN_WORDS, 64)
    tracemalloc.start()
    try:
        packed = sum(len(h) // 4 for out in run(iter([batch])) for h in out["h"])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert packed == 150 * 2996 and peak < 64 * packed
