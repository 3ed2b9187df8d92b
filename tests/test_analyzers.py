"""Table functions in SQL against the same on DataFrames."""

from collections import Counter

import pytest

from gristmill.operators import analyzers, chunks
from gristmill.plans import samples, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def own():
    kept = {k: list(v) for k, v in analyzers.ANALYZERS.items()}
    yield
    analyzers.ANALYZERS.clear()
    analyzers.ANALYZERS.update(kept)


def test_analyze_by_lateral(spark, own):
    texts = [("python", t) for t, _ in samples.PYTHON + samples.PATHS + samples.TAINT] + [("go", t) for t, _ in samples.BLOCKS] + [("Python", "eval(x)\n"), ("python", None), ("python", ""), (None, "eval(x)"), ("cobol", "STOP RUN"), ("javascript", "function f() {\n" + "if (a) {}\n" * 12 + "}\n")]
    files = spark.createDataFrame([(f"f{k}", *t) for k, t in enumerate(texts)], "file_path string, language string, content string")
    files.createOrReplaceTempView("analyzed_files")
    analyzers.register_functions(spark)
    rows = lambda df: Counter(map(tuple, df.collect()))
    sql = rows(spark.sql("SELECT file_path, a.* FROM analyzed_files, LATERAL analyze(language, content) a"))
    assert sql == rows(analyzers.analyze_files(files)) and len({k[1] for k in sql}) > 15
    for k, (_, want) in enumerate(samples.PATHS):
        have = {x[1:3] + x[4:5] for x in sql if x[0] == f"f{len(samples.PYTHON) + k}"}
        assert set(want) <= have
    # One's own analyzer, for a language that had none.
    analyzers.register("COBOL", lambda text: ((("stop", "low", "smell", 1, "stops"),) if "STOP" in text else ()))
    analyzers.register_functions(spark)
    mine = spark.sql("SELECT file_path, a.severity, count(*) FROM analyzed_files, LATERAL analyze(language, content) a WHERE check = 'stop' GROUP BY 1, 2").collect()
    assert [r[1:] for r in mine] == [("low", 1)]


@pytest.mark.parametrize(("most", "overlap"), [(100, 10), (4000, 10), (700, 0), (100, 49), (100, 60)])
def test_chunks_of_partitioned_lines(spark, most, overlap):
    analyzers.register_functions(spark)
    docs = tables.files(spark, SF).where("content IS NOT NULL").selectExpr("cast(doc_id AS string) AS file_path", "content")
    long = spark.createDataFrame([(f"long{n}", "\n".join(f"line {k}" for k in range(n))) for n in (1, 50, 51, 90, 91, 130, 333)], "file_path string, content string")
    files = docs.unionByName(long)
    files.selectExpr("file_path", "posexplode(split(content, '\\n', -1)) AS (k, line)").createOrReplaceTempView("all_lines")
    got = spark.sql(f"SELECT * FROM line_chunks(TABLE(SELECT * FROM all_lines) PARTITION BY (file_path) ORDER BY (k), {most}, {overlap})")
    want = chunks.line_chunks(files, most, overlap)
    rows = lambda df: sorted(map(tuple, df.select("file_path", "chunk", "start_line", "end_line", "content", "context").collect()), key=repr)
    assert rows(got) == rows(want)
