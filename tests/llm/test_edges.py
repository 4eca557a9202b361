"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every query."""

import pytest
from tables import empty_tables, odd_tables

import corpus_pipeline
from codegrain.llm import registry

QUERIES = registry.queries() | corpus_pipeline.queries()
PER_DOCUMENT = {"op3_secrets", "op4_toxicity", "op5_mixing", "op6_simhash", "op7_quality", "op10_outliers"}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return odd_tables(tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return empty_tables(tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name in PER_DOCUMENT:
        assert len(rows) == spark.read.parquet(f"{odd}/documents.parquet").count()
        assert all(0 <= r["score"] <= 1 for r in rows if "score" in r)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert len(rows) == (1 if name == "op1_chat" else 0)


def test_stages_keep_the_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert [t for _, t in out.dtypes] == ["bigint", "string", "string", "string", "bigint"], name
        out.collect()


def test_stages_on_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0


def test_stages_chain_without_being_written(spark, odd):
    """What an earlier stage wrote stays for as long as a later one reads it."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, odd)
    assert docs.count() > 0


def test_a_run_leaves_one_table(spark, odd):
    from codegrain.llm import common

    common.drop_cuts()
    pieces = corpus_pipeline.run(spark, odd)
    assert [p.rsplit("codegrain-", 1)[1].rsplit("-", 1)[0] for _, p, _ in common._WRITTEN] == ["tokens"]
    assert pieces.count() > 0


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_values_on_odd_rows(spark, odd):
    """Nulls, empty and repeated texts, ties and odd ids have the stated results."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{odd}/documents.parquet").collect()}
    rows = QUERIES["op2_topk"](spark, odd).collect()
    ids = {r["query_id"] for r in rows}
    assert ids == {0, 400, 500} - {500} and not {r["vec_id"] for r in rows} & {100, 200, 300, 500, None}
    assert len(rows) == 10 * 3  # two rows of id 0 and one of id 400 ask
    assert all(r["rank"] == n % 10 + 1 for n, r in enumerate(sorted((r for r in rows if r["query_id"] == 400), key=lambda r: r["rank"])))
    for r in QUERIES["op3_secrets"](spark, odd).collect():
        assert (r["n_access"], r["n_assign"]) == (0, 0) or r["doc_id"] is None or docs[r["doc_id"]]
        if r["doc_id"] is not None and not docs[r["doc_id"]]:
            assert (r["n_hex"], r["spans"]) == (0, "")
    assert all(r["taken"] == 0 and r["size"] == 0 for r in QUERIES["op5_mixing"](spark, odd).collect() if r["doc_id"] is not None and not (docs[r["doc_id"]] or "").split())
    prints = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, odd).collect() if r["doc_id"] is not None}
    assert {prints[i] for i in (0, 1, 2, 3)} == {("0" * 16, 0)} and prints[7] == prints[8] and prints[9] == prints[10]
    assert rows_of(QUERIES["op8_suffix"](spark, odd), "doc_id", "start_word", "end_word", "partner_id") == sorted([(7, 0, 60_000, 8), (8, 0, 60_000, 7), (9, 0, 320, 10), (10, 0, 320, 9)], key=repr)
    packed = [r for r in QUERIES["op9_packing"](spark, odd).collect() if r["doc_id"] is None]
    assert sorted(r["doc_tokens"] for r in packed)[:2] == [1, 1] and all(r["length"] > 0 for r in packed)
    for r in QUERIES["op10_outliers"](spark, odd).collect():
        if r["doc_id"] is not None and not (docs[r["doc_id"]] or "").split():
            assert (r["n_words"], r["word_chars"], r["base_failed"], r["kept"]) == (0, 0, True, False)
