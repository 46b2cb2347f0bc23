"""Filter audit, byte-level BPE and the Merkle manifest against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from logfathom.llm import byte_bpe, filter_audit, merkle
from logfathom.llm.oracles import ORACLES
from logfathom.llm.queries import op13_merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# filter audit


@pytest.mark.parametrize("n", [1, 2, 5])
def test_path_counts_are_factorials(n):
    edges = filter_audit.lattice(n)
    assert len(edges) == n << (n - 1)
    for state, f, orders in edges:
        size = bin(state).count("1")
        assert not state >> f & 1 and orders == math.factorial(size) * math.factorial(n - size - 1)


def plain_audit(docs, labels):
    first, out = {}, {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text],
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                stay = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_by_every_order(spark):
    rng = random.Random(3)
    texts = ["", None, "one", "A B C", "a# b", " ".join(f"w{i}" for i in range(250)), "same word " * 150, "é漢 " * 220, "\x85 x y" * 70 + " " * 30, "$" + "Z" * 20000]
    docs = [(i if rng.random() > 0.1 else None, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s", 1) for i in range(120)]
    docs += docs[:7] + [(5, "another text of the same id", "en", "s", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    clash = spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS digest", "2 AS failed", "3 AS part", "4 AS good", "5 AS n", "6 AS first")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1))
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit_documents(clash, known).collect()}
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit_documents(clash.limit(0), known).count() == 0
    bare = filter_audit.audit_documents(clash, known.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(bare) == (0, 0)


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", 3, 1.0), ("p", 1, 1.0), ("p", 0, 1.0)], "part string, failed int, w double")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(rows, ("X", "Y")).collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (1, 0, 1, 0, 1), ("YX", 1): (2, 1, 0, 0, 1), ("YX", 2): (1, 1, 1, 1, 3)}


# byte-level BPE

ODD = [
    "", " ", "a", "\x00\x01", "don't we'll I'M", "   lead and trail   ", "a\r\n\r\n b\t\tc", "1234567 8,90", "é漢字かな👍🏽 Ωмир", "  x ",
    "a" * 5000, "ab" * 3001, " " * 4097 + "x", "!?" * 700, "漢字" * 400, "naïveté" * 90, "<|endoftext|>", "x�y", "́́e",
]


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(reference):
    ranks = reference._mergeable_ranks
    return byte_bpe.Encoder(ranks, byte_bpe.PairTable(ranks), public_tokenizers.PATTERN)


def test_pair_table_is_whole(encoder):
    ranks, table = encoder.ranks, encoder.table
    rng = random.Random(5)
    pairs = [(ranks[t[:c]], ranks[t[c:]], r) for t, r in rng.sample(sorted(ranks.items()), 3000) for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks]
    a, b, want = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
    assert (table.rank(a, b) == want).all()
    tokens = {r: t for t, r in ranks.items()}
    a, b = np.random.default_rng(1).integers(-1, len(ranks), (2, 20000)).astype(np.int32)
    want = [byte_bpe.NONE if x < 0 or y < 0 else ranks.get(tokens[x] + tokens[y], byte_bpe.NONE) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert table.rank(a, b).tolist() == want


def test_encoder_equals_the_reference(encoder, reference):
    rng = random.Random(7)
    letters = "etaoinshrdlu" * 4 + "qzxjéßñ漢字Ωж👍 '-\n\t1,."
    texts = ODD + ["".join(rng.choices(letters, k=rng.choice([3, 30, 300, 3000]))) for _ in range(150)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (255, 256, 257, 1000, 20000)]  # one match each
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert got.tolist() == reference.encode_ordinary(text)


def test_long_rows_merge_as_short_ones(encoder):
    rng = np.random.default_rng(2)
    for size in (2, 3, 7, 40, 200):
        for letters in (b"ab", b"the and", b"aaaaaaab", bytes(range(256))):
            raw = rng.choice(np.frombuffer(letters, np.uint8), size)
            tokens = encoder.of_byte[raw]
            short, number = byte_bpe.merge_rows(tokens[None, :].copy(), np.array([size]), encoder.table)
            assert number.tolist() == [len(short)]
            assert byte_bpe.merge_long(tokens.copy(), encoder.table).tolist() == short.tolist()


def test_long_texts_are_read_in_runs(encoder, reference, monkeypatch):
    text = " ".join(f"word{i} don't" for i in range(500))
    monkeypatch.setattr(byte_bpe, "MATCHES", 16)
    monkeypatch.setattr(byte_bpe, "CACHED", 8)
    assert [x.tolist() for x in encoder.encode([text, None, text[:50]])] == [reference.encode_ordinary(text), [], reference.encode_ordinary(text[:50])]


def test_encode_and_decode_whole_table(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*ODD, None, "twice", "twice", "long words " * 100000])], "doc_id long, text string")
    rows = docs.unionByName(odd).selectExpr("*", "'x' AS ids", "1 AS tokens")
    encoded = byte_bpe.encode(rows)
    read = byte_bpe.decode(encoded)
    assert read.columns == ["doc_id", "text", "tokens", "ids", "decoded"]
    for r in read.collect():
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    want = []
    for r in rows.collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.read_back(encoded).collect())) == sorted(want)
    assert byte_bpe.decode(byte_bpe.encode(rows.limit(0))).count() == 0 and byte_bpe.read_back(byte_bpe.encode(rows.limit(0), keep=("doc_id",))).count() == 0
    unknown = byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"))
    assert [bytes(r.decoded) for r in unknown.collect()] == [b"", b""]


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, pos):
    for level in levels[:-1]:
        run = pos - pos % 3
        yield "".join(level[run:pos]), "".join(level[pos + 1 : run + 3])
        pos //= 3


def plain_manifest(docs):
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: sha("".join(map(spell, (i, source, lang, n, text))))
    parts = {}
    for i, text, lang, source, n in docs:
        h = leaf(i, text, lang, source, n)
        cut = text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        parts.setdefault(source, []).append((i is not None, i or 0, h, leaf(i, text.replace("\n", ""), lang, source, n) if cut else h, i))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in sorted(parts[s], key=lambda r: r[:4])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for pos, (*_, h, begun, i) in enumerate(sorted(parts[s], key=lambda r: r[:4])):
            path = [*siblings(trees[s], pos), *siblings(top, at)]
            fold = begun
            for before, after in path:
                fold = sha(before + fold + after)
            out.append((i, h, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def written(spark, tmp_path, docs):
    spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS pos", "'x' AS part", "2 AS h", "3 AS changed", "4 AS n").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_manifest_by_plain_trees(spark, tmp_path):
    rng = random.Random(11)
    sources = ["hot"] * 6 + [None, "", "é", "￿", "😀"] + [f"s{i}" for i in range(40)]
    texts = ["a\nb", "", None, "\n", "no newline", "漢字\n", "x" * 3000]
    docs = [(i, rng.choice(texts), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, i])) for i in rng.sample(range(10**9), 400)]
    docs += docs[:5] + [(None, "t\n", "en", "hot", 1), (None, None, None, None, None), (7, "x", "en", "lone", 1), (-8, "x\n", "en", "lone pair", 1), (-8, "y\n", "en", "lone pair", 1)]
    got = op13_merkle(spark, written(spark, tmp_path, docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(docs)


def test_manifest_of_blocks_over_blocks(spark, tmp_path, monkeypatch):
    docs = [(i, f"t\n{i}", "en", "big" if i % 10 else f"s{i % 70}", i) for i in range(3000)]
    got = op13_merkle(spark, written(spark, tmp_path, docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(docs)


@pytest.mark.parametrize("docs", [[], [(3, "only\n", "en", "s", 1)], [(3, None, None, None, None)], [(3, "same\n", "en", "s", 1)] * 4])
def test_manifest_of_few_rows(spark, tmp_path, docs):
    got = op13_merkle(spark, written(spark, tmp_path, docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(docs)


def test_manifest_sql_is_the_plain_tree(tmp_path):
    docs = [(i, f"t\n{i}" if i % 3 else None, "en", [None, "a", "b"][i % 3] if i % 7 else f"s{i}", i) for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", docs)
    assert sorted(con.execute(ORACLES["op13_merkle"]).fetchall(), key=str) == plain_manifest(docs)
