"""The stages one by one against plain Python, and all queries that have SQL."""

import hashlib

import brute
import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from crivo.llm import queries
from crivo.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark, small_dir):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small_dir), f"test-{name}")
        out.append(docs)
    return out


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == stages[0].columns for df in stages[1:5])
    assert stages[1].count() == stages[0].count()


def test_one_of_each_group_is_left(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    ids = sorted(before)
    groups = brute.reachable([brute.fingerprint(before[i], 3) for i in ids])
    assert set(after) == {min(ids[g] for g in group) for group in groups}
    assert all(after[i] == before[i] for i in after)


def test_passages_are_cut(stages):
    before, after = sorted(by_id(stages[2]).items()), by_id(stages[3])
    for i, kept, n in brute.without_repeats(before, 20):
        if kept or not n:
            assert after[i] == (dict(before)[i] if len(kept) == n else " ".join(kept))
        else:
            assert i not in after
    counted = stages[3].where(F.col("n_chars") != F.length("text"))
    assert counted.count() == stages[0].where(F.col("n_chars") != F.length("text")).count()


def test_documents_with_benchmark_windows_go(spark, small_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i for i, _, hit, _ in brute.contaminated(sorted(by_id(stages[3]).items()), items) if not hit}
    assert set(by_id(stages[4])) == want and len(want) > 100


def test_tokens_of_what_is_left(stages):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts, found = by_id(stages[4]), stages[5].collect()
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()


def test_run_is_its_stages(spark, small_dir, stages):
    found = corpus_pipeline.run(spark, small_dir)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in found.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in stages[5].collect())


def test_rejected_languages_and_odd_rows_pass_every_stage(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "the and of", "en", None, None), (10**9, None, None, "s", 0), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "12 34", None, "s", 5),
                                 (10**9 + 3, "qzx jvk wqq zzxj kvq xjq", None, "s", 3), (10**9 + 3, "qzx jvk wqq zzxj kvq xjq", None, "s", 3)], docs.schema)
    rows = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, small_dir), f"odd-{name}")
        kept = {r["doc_id"] for r in rows.select("doc_id").collect()}
        assert not kept & {10**9, 10**9 + 1, 10**9 + 2, 10**9 + 3} and None in kept


def test_columns_of_any_name_pass_every_stage(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(120)
    names = ["_id", "_h", "_own_h", "_key", "id", "h", "h1", "fp", "key", "kept", "n_words", "n_removed", "items", "lang_pred", "score", "row", "found", "root", "component"]
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        docs, wide = stored(stage(spark, docs, small_dir), f"narrow-{name}"), stored(stage(spark, wide, small_dir), f"wide-{name}")
        assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in wide.collect())
        if name != "tokens":
            assert wide.columns == [*docs.columns, *names]
            assert wide.where(" OR ".join(f"{c} != concat('{c} ', doc_id)" for c in names)).count() == 0


def test_no_rows(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, small_dir), f"none-{name}")
        assert rows.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, small_dir, name):
    assert difference(spark, connect(small_dir), queries.QUERIES[name], queries.ORACLES[name], small_dir) is None


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
