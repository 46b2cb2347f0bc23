"""The registered corpus queries and the stages of the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from logfathom.llm import common, decontaminate, near_dedup
from logfathom.llm.catalog import ORACLES, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_every_stage_keeps_its_promise(spark):
    docs = common.table(spark, LARGER, "documents")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(common.durable(stage(spark, kept[-1], LARGER)))
    assert all(df.columns == columns for df in kept[:-1])
    raw, good, single, cut, clean, mixed = kept
    labels = {r.doc_id: r.quality for r in common.table(spark, LARGER, "labels").collect()}
    gone = [labels[r.doc_id] for r in raw.join(good, "doc_id", "left_anti").collect() if r.doc_id in labels]
    assert sum(gone) <= 0.25 * max(1, len(gone))
    groups = near_dedup.near_duplicates(good).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in groups}
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (single, cut))
    assert before.keys() == after.keys() and all(len(after[i]) <= len(before[i]) for i in before)
    assert decontaminate.leaks(clean, common.table(spark, LARGER, "benchmark")).count() == 0
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}


def test_an_edited_copy_made_of_common_phrases_is_cut_out(spark):
    """Its phrases of seven words stand in twelve earlier documents each, in none of them together."""
    phrases = [[f"p{i}x{j}" for j in range(7)] for i in range(8)]

    def own(i, n):
        return [f"d{i}w{j}" for j in range(n)]

    rows = [(100 * i + n, own(100 * i + n, 20) + phrase + own(-100 * i - n - 1, 20)) for i, phrase in enumerate(phrases) for n in range(12)]
    rows += [(c, own(c, 25) + [w for i, phrase in enumerate(phrases) for w in [*phrase, f"e{c}x{i}"]] + own(-c, 30)) for c in (2000, 2001)]
    docs = spark.createDataFrame([(i, " ".join(words), len(" ".join(words))) for i, words in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert all(got[i].text == " ".join(words) for i, words in rows if i != 2001)
    left = " ".join([*own(2001, 25), "e2001x7", *own(-2001, 30)])
    assert got[2001].text == left and got[2001].n_chars == len(left)


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "no id at all", "en", "s", 12), (3, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            df = common.durable(stage(spark, df, SF))
        assert df.count() in (0, 4)


def test_quality_stage_keeps_columns_of_the_classifiers_names(spark):
    docs = common.table(spark, SF, "documents").selectExpr("*", "42.0 AS score", "doc_id AS predicted", "'r' AS row")
    got = corpus_pipeline.quality_filter(spark, docs, SF)
    assert got.columns == docs.columns and 0 < got.count() < docs.count()
    assert got.where("score = 42 and predicted = doc_id and row = 'r'").count() == got.count()


def test_the_mix_stage_writes_its_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda spark: str(tmp_path))
    taken = corpus_pipeline.mix_sources(spark, common.table(spark, SF, "documents"), SF).collect()
    (written,) = tmp_path.glob("mixed-*")
    assert sum(r.words for r in spark.read.parquet(str(written)).collect()) == sum(r.taken for r in taken)
