"""Chat formatting, page text, mixing and vector search."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logfathom.llm import chat_format, html_text, mixing, pivot_index

TRICKY = ["", "plain", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<|im_start|>user<|im_sep|>", "a < | b", "\n\n  lead", "trail \n ", "é漢字👍🏽", "\\<|", "<", "<|endoftext|>", "x" * 5000]
CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("text", TRICKY)
def test_escape_round_trip(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)


def test_conversations_read_back(spark):
    rng = random.Random(1)
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], rng.choice(TRICKY) + rng.choice(TRICKY)) for c in range(20) for t in range(6)]
    rows += [(30, 0, None, None), (30, 0, "assistant", None), (None, 2, "assistant", "b"), (None, 1, "assistant", "a"), (31, 0, "assistant", "same"), (31, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "'x' AS formatted", "1 AS turns")
    formatted = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert len(got) == 23
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=str)
        seen = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (seen, loss))
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_long_conversations_come_in_stretches(spark):
    """No row holds much more than ``most`` characters; tokens and digests are those of the whole."""
    rng = random.Random(6)
    rows = [(c, t, ["user", "assistant"][t % 2], rng.choice(TRICKY[:-1]) + f" word{t} é") for c in (None, 5, 2**60, 2**60 + 1) for t in range(rng.randrange(40, 90))]
    df = spark.createDataFrame(rows, CONV).repartition(3)
    whole = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert len(whole) == 4
    parts = chat_format.format_conversations(df, most=200)
    got = {}
    for r in parts.collect():
        got.setdefault(r.conv_id, []).append(r)
    for c, own in got.items():
        assert [r.part for r in own] == list(range(len(own))) and len(own) > 3 and max(len(r.formatted) for r in own) < 1000
        at = np.cumsum([0] + [len(r.formatted) for r in own]).tolist()
        assert "".join(r.formatted for r in own) == whole[c].formatted
        for name in ("input_ids", "loss_mask"):
            assert sum((list(r[name]) for r in own), []) == list(whole[c][name])
        for name in ("token_start", "token_end"):
            assert [x + shift for r, shift in zip(own, at[:-1], strict=True) for x in r[name]] == list(whole[c][name])
    digests = [sorted(map(tuple, chat_format.read_back(x).collect()), key=str) for x in (parts, chat_format.format_conversations(df))]
    assert digests[0] == digests[1] and len(digests[0]) == 4


def test_a_batch_of_conversations_is_bounded():
    """Many conversations, and one of many turns, are handed on a few at a time."""

    class Rows:
        def __getattr__(self, _):
            return lambda *_: self

        def mapInArrow(self, run, _):
            return run

    turns = [(c, "assistant", f"{c} " + "lorem ipsum " * 400) for c in range(600)] + [(600, "user", "dolor sit amet " * 300)] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*turns, strict=True)], ["conv_id", "role", "text"])
    made = list(chat_format.format_conversations(Rows())(iter([batch])))
    sizes = [sum(map(len, out.column("formatted").to_pylist())) for out in made]
    assert sum(out.num_rows for out in made) > 601 and max(sizes) < 2 * chat_format.BATCH and len(made) > 3
    assert max(len(x) for out in made for x in out.column("formatted").to_pylist()) < 2 * chat_format.STRETCH


def test_tokens_inside_spans_by_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(50):
        spans = np.sort(rng.choice(100, 8, replace=False)).reshape(-1, 2).tolist()
        starts = rng.integers(0, 100, 40)
        ends = starts + rng.integers(0, 6, 40)
        want = [e > s and any(a <= s and e <= b for a, b in spans) for s, e in zip(starts, ends, strict=True)]
        assert chat_format.loss_tokens(starts, ends, [tuple(x) for x in spans]).tolist() == want
    assert not chat_format.loss_tokens(np.array([0]), np.array([1]), []).any()


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>menu</a></ul></nav><div id="cookie-notice"><p>We use cookies, do you agree, yes or no, please?</div>
%s<div class="comments"><p>First, a comment, with commas, and many more words than anything else, honestly.</p></div>
<aside>side, bar, text</aside><form><p>Sign up, now, here</p></form><footer>end &copy;</footer></body></html>"""


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>A &amp; B</h1><p>One,\n two &eacute; <b>three.<p>Four.<ul><li>x<li>y</ul></article>", "A & B\nOne, two é three.\nFour.\nx\ny"),
        ("<div class=content><h2>H</h2><p>Long enough text, with a comma, to score well here.<br>next</p><p>z</p></div>", "H\nLong enough text, with a comma, to score well here. next\nz"),
        ("<main><section><p>First part, which is long enough to count.</p></section><section><p>Second.</p></section></main>", "First part, which is long enough to count.\nSecond."),
        ("<article><table><tr><td>a<td>b</table><p>Text, after a table.</p><pre>c\n  d</pre></article>", "a\nb\nText, after a table.\nc d"),
        ("<article><p>Keep<script>no()</script> this, please.</p><div class='ad'>Buy</div><aside>no</aside><p>And this.</p></article>", "Keep this, please.\nAnd this."),
    ],
)
def test_page_text(body, want):
    assert html_text.main_text(PAGE % body) == want


LONG = "".join(f"<p>Paragraph {i} of the article, with a comma, and some more words to read.</p>" for i in range(18))


def test_a_page_wrapped_in_a_form_is_read():
    page = f"<body><form action=x><input name=q><div>{LONG}</div></form><form><p>Sign up, now, here</p></form></body>"
    assert html_text.main_text(page).count("\n") == 17 and "Sign up" not in html_text.main_text(page)


def test_what_lies_beside_the_best_container_stays():
    page = f"<body><div id=content><div>{LONG}</div><h2>End</h2><div><p>A closing part, short.</p></div><pre>x = 1</pre><p>Short.</p><ul><li><a href=1>More</a></li></ul></div></body>"
    assert html_text.main_text(page).split("\n")[18:] == ["End", "A closing part, short.", "x = 1", "Short."]


@pytest.mark.parametrize("name", ["post-comments", "article-comments", "main-menu", "content-ad", "mainMenu", "comment-body"])
def test_names_of_other_parts_go(name):
    page = f'<body><article>{LONG}<div class="{name}"><p>Not of the article, at all, I say, this text.</p></div></article></body>'
    assert "Not of the article" not in html_text.main_text(page)


@pytest.mark.parametrize("part", ['<div class="header"><h1>Kept</h1></div>', '<div class="notice-of-race"><p>Kept</p></div>', "<blockquote><p>Said</p><footer>Kept</footer></blockquote>",
                                  '<div id="content" class="sidebar-right"><p>Kept</p></div>', '<div class="has-sidebar"><p>Kept</p></div>'])
def test_parts_of_the_article_stay(part):
    assert "Kept" in html_text.main_text(f"<body><article>{part}{LONG}</article></body>").split("\n")


@pytest.mark.parametrize("torn", ["<a ", '<a x="', "<a x='\"", "<!--", '<div class="a', "</a "])
def test_a_megabyte_of_torn_markup_takes_little_time(torn):
    begun = time.monotonic()
    assert "hello, world" in html_text.main_text(f"<p>hello, world</p>{torn * (2**20 // len(torn))}")
    assert time.monotonic() - begun < 5
    assert html_text.main_text(f'<p>a &lt; b</p><p>{torn}<b title="x < y"class=z>bold</b></p>').endswith("bold")


def test_cosines_of_extreme_vectors_and_ids_with_several_vectors(spark):
    rows = [(0, [1e-200, 0.0]), (50, [1e200, 1e200]), (3, [3.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -2e-308])]
    index = pivot_index.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in pivot_index.search(index, index["members"].where("vec_id % 50 = 0")).collect()}
    half = 0.5**0.5
    assert got == pytest.approx({(0, 50): half, (0, 3): 0.0, (0, 4): 0.0, (50, 0): half, (50, 3): half, (50, 4): -half}, abs=1e-15)


def test_odd_pages(spark):
    pages = [(1, None), (2, ""), (3, "just text &lt; 3"), (4, "<p>a<p>b"), (5, "<div>" * 3000 + "deep, text" + "</div>" * 3000), (5, "<!-- x --><br>"), (6, "<p>" + "word, " * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, html string").selectExpr("*", "1 AS n_chars", "'old' AS text")
    got = html_text.extract(df).orderBy("page_id", "html").collect()
    assert [r.text[:10] for r in got] == ["", "", "just text ", "a\nb", "", "deep, text", "word, word"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def test_permutation_is_a_bijection(spark):
    for size in (1, 2, 7, 64, 1000):
        got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size).cast("bigint"), F.lit(9)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(size))


def targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: level * weight[s] for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("block", [1, 16, 256])
def test_mix_meets_its_targets(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["a", "b", "B", "é", None, "c"] + ["a"] * 4), " ".join("w" * rng.randrange(1, 400))) for i in range(300)]
    rows += [(900, "tiny", "one two\tthree"), (901, "none", ""), (902, "none", None), (903, "a", "x " * 30_000), (5, "a", "again and again"), (5, "a", "again and again"), (None, "b", "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS sid", "3 AS target", "'s' AS bucket")
    mixed = mixing.mix(docs, block=block)
    taken = mixed["taken"].collect()
    assert sorted(map(tuple, taken), key=str) == sorted(map(tuple, mixing.mix(docs, block=block)["taken"].collect()), key=str)
    assert len(taken) == len(rows)
    sizes = {}
    for _, s, text in rows:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    want = targets(sizes)
    for s, size in sizes.items():
        own = [r for r in taken if r.source == s]
        assert {r.source_size for r in own} == {size} and all(r.target == pytest.approx(want[s]) for r in own)
        assert sum(r.taken for r in own) == pytest.approx(want[s], abs=1)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sum(r.words for r in mixed["slots"].collect()) == sum(r.taken for r in taken)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_shards_read_back_hold_the_words_counted_as_taken(spark, tmp_path, block):
    rng = random.Random(block)
    rows = [(i, rng.choice("aaab") if i % 9 else None, " \n".join(f"{i}_{k}" for k in range(rng.randrange(0, 300)))) for i in range(120)]
    rows += [(500, "tiny", "500_0 500_1\t500_2"), (501, "none", None), (502, "a", " ".join(f"502_{k}" for k in range(5000))), (None, "b", "x_0 x_1")]
    rows += [(503, "b", "503_0 503_1"), (503, "b", "503_2 503_3")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(docs, block=block)
    mixing.write_shards(mixed["shards"], str(tmp_path / "mix"))
    found = spark.read.parquet(str(tmp_path / "mix")).collect()
    assert len({(r.shard, r.slot) for r in found}) == len(found) == mixed["slots"].count()
    assert all(len(r.text.split(" ")) == r.words <= block for r in found)
    words = Counter(w for r in found for w in r.text.split(" "))
    assert max(words.values()) <= 2 and set(words) <= {w for r in rows for w in (r[2] or "").split()}
    counted = Counter()
    for w, n in words.items():
        counted[w.split("_")[0]] += n
    taken = Counter()
    for r in mixed["taken"].collect():
        taken["x" if r.doc_id is None else str(r.doc_id)] += r.taken
    assert counted == +taken
    packed = [w for r in mixed["blocks"].collect() for w in r.packed]
    assert sorted(packed) == sorted(w for r in rows for w in (r[2] or "").split())


def test_a_shard_is_filled_where_it_is_written(spark, monkeypatch):
    """All slots of a shard come in one partition, so texts don't move again; rows given three times count three times."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 4)
    rows = [(i // 3, "ab"[i // 3 % 2], " ".join(f"{i // 3}_{k}" for k in range(1 + i // 3))) for i in range(60)]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=3)
        found = mixed["shards"].withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    shards = {r.shard for r in found}
    assert len(shards) == len({(r.shard, r.task) for r in found}) > 10
    assert len({(r.shard, r.slot) for r in found}) == len(found) == mixed["slots"].count()
    words, taken = Counter(w.split("_")[0] for r in found for w in r.text.split(" ")), Counter()
    for r in mixed["taken"].collect():
        taken[str(r.doc_id)] += r.taken
    assert words == +taken


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs)["taken"].count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None)], docs.schema))["taken"].collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)]


def test_shares_follow_the_multinomial(spark):
    rows = [(i, "ab"[i % 2], "w " * 200) for i in range(400)]
    slots = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=4)["slots"]
    per = {r.shard: r.n for r in slots.where("sid = 0").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    whole = [per[s] for s in range(min(per), min(per) + 20)]
    assert len(set(whole)) > 5 and abs(sum(whole) / len(whole) - 0.6667 * mixing.SHARD_SLOTS) < 4 * math.sqrt(mixing.SHARD_SLOTS / 4.5)


def exact(vectors, query, k):
    x = {i: np.array(v, float) for i, v in vectors}
    q = x[query]
    score = lambda v: (v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))
    return [i for _, i in sorted((-score(v), i) for i, v in x.items() if i != query)[:k]]


def vectors_of(seed, n, d=8):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=d).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("shard", [50, 4096])
def test_search_is_exact_when_all_are_candidates(spark, shard):
    rows = vectors_of(1, 300)
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [(7, rows[7][1])]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [float("inf")] + [1.0] * 7), (2005, [1.0, 2.0]), (2006, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS shard", "3 AS ids")
    index = pivot_index.build_index(df, pivots=16, prefix=6, shard_rows=shard)
    got = {}
    for r in pivot_index.search(index, index["members"].where("vec_id % 7 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert 7 in got and not set(got) & set(range(2000, 2100))
    assert all(got[q] == exact(dict(rows).items(), q, 5) for q in got)


def test_recall_with_few_candidates(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=32)).tolist()) for i in range(1500)]
    index = pivot_index.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=2000)
    found = pivot_index.search(index, index["members"].where("vec_id % 50 = 0"), candidates=400).collect()
    hits = sum(r.vec_id in exact(rows, r.query_id, 5) for r in found)
    assert len(found) == 150 and hits / 150 >= 0.9


def test_footrule_orders_candidates():
    order = np.array([[0, 1, 2], [2, 1, 0], [3, 4, 5], [0, 2, 1]])
    lists = {p: (np.argwhere(order == p)[:, 0], np.argwhere(order == p)[:, 1]) for p in range(6)}
    assert set(pivot_index.footrule_best(np.array([0, 1, 2]), lists, 4, 3, 2)) == {0, 3}


def test_search_over_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = pivot_index.build_index(empty)
    assert pivot_index.search(index, index["members"]).count() == 0
    alone = pivot_index.build_index(spark.createDataFrame([(50, [1.0, 2.0])], empty.schema))
    assert pivot_index.search(alone, alone["members"]).count() == 0
