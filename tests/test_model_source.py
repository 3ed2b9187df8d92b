"""The model as a data source: every request answered, none paid for twice."""

from collections import Counter

import pytest

from gristmill.sources import model_source, responses


def calls(folder):
    return Counter(x.read_text() for x in folder.iterdir())


def test_answers_errors_and_a_second_call(spark, tmp_path):
    paid = tmp_path / "paid"
    paid.mkdir()
    prompts = [f"p{k}" for k in range(20)] + ["refuse it", "twice busy", "never there", "", None, "é\n\"x\""]
    df = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")
    ask = lambda: model_source.ask_model(spark, df, f"file://{tmp_path}/model", "tests.fake_provider:answer", model=str(paid), rows_each=4, retries=2, wait=0.01)
    got = {int(r["id"]): r for r in ask().collect()}
    assert len(got) == len(prompts) and all(got[k]["answer"] == f"answer to {p}" and got[k]["attempts"] == 1 for k, p in enumerate(prompts[:20]))
    assert (got[20]["error"], got[20]["attempts"]) == ("no", 1) and (got[21]["answer"], got[21]["attempts"]) == ("answer to twice busy", 3)
    assert got[22]["error"] == "OSError: down" and got[22]["attempts"] == 3 and got[22]["answer"] is None and got[25]["answer"] == 'answer to é\n"x"'
    first = calls(paid)
    again = {int(r["id"]): r for r in ask().collect()}
    assert all(again[k]["answer"] == got[k]["answer"] for k in got) and not any(again[k]["asked"] for k in got if got[k]["answer"] is not None)
    more = calls(paid) - first
    assert set(more) == {"refuse it", "never there"}  # what has no answer is asked again
    assert model_source.ask_model(spark, df.limit(0), f"file://{tmp_path}/model", "tests.fake_provider:answer", model=str(paid)).count() == 0


def test_a_lost_worker_repeats_no_paid_call(spark, tmp_path):
    paid = tmp_path / "paid"
    paid.mkdir()
    prompts = [f"p{k}" for k in range(10)] + ["die here"] + [f"q{k}" for k in range(5)]
    df = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string").coalesce(1)
    ask = lambda: model_source.ask_model(spark, df, f"file://{tmp_path}/model", "tests.fake_provider:answer", model=str(paid), retries=0)
    try:
        ask().collect()  # on one machine Spark does not try a task again
    except Exception as e:  # noqa: BLE001
        assert "exited" in str(e) or "crashed" in str(e) or "EOF" in str(e)
    got = {int(r["id"]): r["answer"] for r in ask().collect()}
    assert got == {k: f"answer to {p}" for k, p in enumerate(prompts)}
    assert all(n == (2 if p.startswith("die") else 1) for p, n in calls(paid).items())


def test_options_and_findings(spark, tmp_path):
    spark.dataSource.register(model_source.ModelAnswers)
    with pytest.raises(Exception, match="missing"):
        spark.read.format("model_answers").option("log", "x").load().collect()
    answers = spark.createDataFrame([("a", '[{"severity": "low", "message": "m"}]')], "id string, answer string")
    assert responses.parse_findings(answers, "answer", ["id"]).first()["message"] == "m"
