"""The registered queries over small tables: against their SQL, or for their contract's columns."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from siftlake.llm import near_dup, quality_rules, queries
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_url_verdicts": "page_id host path rule verdict",
    "op3_near_duplicates": "doc_id n_shingles component_id kept",
    "op4_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op5_section_tokens": "doc_id section start n_chars n_tokens",
    "op6_token_files": "doc_id start n_tokens ids_crc32",
    "op7_quality_scores": "doc_id held_out score predicted",
    "op8_contaminated": "doc_id item_id similarity start",
    "op9_mix_sources": "doc_id size source_size target taken",
    "op10_language_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_one_query_an_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert {"pipeline", *queries.QUERIES} <= set(contract.queries())


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    result = compare(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name])
    assert isinstance(result, tuple), result


@pytest.mark.parametrize("name", [name for name in COLUMNS if name not in queries.ORACLE])
def test_query_runs_over_its_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.count()
    table = "pages" if name.startswith("op2") else "documents"
    whole = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert 0 < rows <= whole if name.startswith("op8") else rows >= whole


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    """Each stage on all that the one before kept, decided anew from the operators' own reports."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mix_sources", "token_files"]
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / f"{step}")
        out.write.parquet(path)
        after = spark.read.parquet(path)
        ids = sorted(r["doc_id"] for r in after.select("doc_id").collect())
        if name == "quality_rules":
            want = sorted(r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect())
            assert ids == want
        elif name == "near_duplicates":
            assert ids == sorted(r["doc_id"] for r in near_dup.near_duplicates(docs, 5).where("kept").collect())
        elif name == "decontamination":
            from siftlake.llm import decontamination
            bad = {r["doc_id"] for r in decontamination.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and ids == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad)
        elif name == "mix_sources":
            from siftlake.llm import mixing
            taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_sources(docs).collect()}
            assert ids == sorted(i for i, n in taken.items() for _ in range(n))
        else:
            from siftlake.llm import token_files
            import public_tokenizers
            again = token_files.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))
            assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
        if step < len(names) - 1:
            assert after.schema == docs.schema
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
