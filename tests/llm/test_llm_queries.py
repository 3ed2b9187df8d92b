import importlib

import oracle
import pytest

from gristmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2": "doc_id size source_size target taken",
    "op3": "doc_id n_shingles component_id kept",
    "op4": "doc_id piece start length bin_id capacity offset",
    "op5": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6": "doc_id held_out lang_pred score",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9": "vec_id n_links component_id kept",
    "op10": "doc_id start n_tokens ids_crc32",
    "op11": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12": "doc_id n_bytes n_tokens over_limit",
    "op13": "lang source part item value rank",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    oracle.compare(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op")))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    table = "conversations" if name.startswith("op1_") else "embeddings" if name.startswith("op9_") else "documents"
    if table == "documents" and "doc_id" in df.columns:
        assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_the_pipeline_stage_by_stage(spark):
    from gristmill.llm import langid, line_quality, minhash_forest

    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, seen[-1], SF).cache()
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() > 0
        seen.append(out)
    ids = [[r[0] for r in d.select("doc_id").collect()] for d in seen]
    kept = {r["doc_id"] for r in line_quality.quality_verdicts(docs).where("kept").collect()}
    assert sorted(ids[1]) == sorted(kept)
    model = langid.train(seen[1])
    assert set(ids[1]) - set(ids[2]) == {r["doc_id"] for r in langid.identify(seen[1], model).where("lang_pred = 'und' OR score < 0.05").collect()}
    groups = minhash_forest.near_duplicates(seen[2], 5, 80).collect()
    assert sorted(ids[3]) == sorted({r["component_id"] for r in groups})
    assert set(ids[4]) <= set(ids[3])
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in seen[3].collect()}
    packed = seen[5].groupBy("doc_id").sum("length").collect()
    copies = {i: ids[4].count(i) for i in set(ids[4])}
    assert {r[0]: r[1] for r in packed} == {i: n * (words[i] + 1) for i, n in copies.items()}
    assert pipeline.run(spark, SF).count() == seen[5].count()


@pytest.mark.parametrize("kind", ["awkward", "no languages", "empty"])
def test_stages_take_awkward_rows(spark, kind):
    from cases import awkward, table

    rows = [] if kind == "empty" else awkward()
    if kind == "no languages":
        rows = [(*r[:2], None, *r[3:]) for r in rows]
    docs = table(spark, rows)
    pipeline = importlib.import_module("corpus_pipeline")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        if kind != "empty" and k == 2:
            ids = [r["doc_id"] for r in docs.collect()]
            assert None in ids and 0 in ids and 1 not in ids and 8 not in ids
    assert (docs.count() == 0) == (kind == "empty")


def test_the_rest_does_not_need_this_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['gristmill.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()) and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
