"""Whole jobs with fake models, and incremental runs."""

import json

import pytest

from graingrid.operators import judges
from graingrid.operators.model import FakeBackend, FakeMediaBackend
from graingrid.plans import jobs
from graingrid.streaming import incremental


def says(text):
    return lambda: FakeBackend(text)


def clever():
    """Answers each kind of question the way its parser expects."""

    def answer(r):
        u = r.user
        if "<score>" in u:
            return "<score>7</score>" if "true or false" not in u else "<score>true</score>"
        if "JSON array of objects" in u:
            return '[{"topic": "t", "prompt": "ask t"}]'
        if "Plan a rewrite" in u:
            return '{"scene": "ui_interface", "language": "en"}'
        if "after the plan" in u:
            return '{"rewritten_prompt": "a better prompt"}'
        if "Check the rewritten" in u:
            return '{"changed": false}'
        if "Compare the rewritten" in u:
            return json.dumps(dict.fromkeys(judges.REWRITE_INT, 9) | dict.fromkeys(judges.REWRITE_BOOL, True))
        if "categories" in u:
            return "<answer>Math</answer>"
        return f"<answer>reply {r.id} {r.index}</answer>"

    return FakeBackend(answer)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", "what is two plus two", "four"), ("b", "name a river in France", "Seine"), ("c", "", "x"), ("d", None, None)], "id string, instruction string, answer string")


def test_there_is_every_job():
    assert len(jobs.JOBS) == 44
    with pytest.raises(ValueError):
        jobs.run("nothing", None)


def test_distill_and_dpo(spark, rows):
    out = jobs.run("instruct_distill", rows, says("Answer: {user}")).collect()
    assert sorted(r.messages[-1].content for r in out) == ["Answer: name a river in France", "Answer: what is two plus two"]
    pairs = jobs.run("dpo_data_build", rows.where("length(instruction) > 0"), clever, n=2).collect()
    assert len(pairs) == 2 and all(r.chosen.endswith("0</answer>") and r.rejected.endswith("1</answer>") for r in pairs)


def test_judged_jobs(rows):
    ok = rows.where("length(instruction) > 0")
    assert jobs.run("advanced_instruct_distill", rows, clever, thresholds={"helpfulness": 7}).count() == 2
    assert jobs.run("advanced_instruct_distill", rows, clever, thresholds={"helpfulness": 8}).count() == 0
    got = jobs.run("instruct_eval", ok, clever).collect()
    assert [(r.helpfulness, r.correctness) for r in got] == [(7, True)] * 2
    assert jobs.run("balanced_instruct_distill", rows, clever, distribution={"Math": 1.0}).count() == 2


def test_rewrite_chain(rows):
    out = jobs.run("agentic_rewrite", rows, clever).collect()
    assert {(r.response, r.scene, r.language, r.agent_trace.reflection) for r in out} == {("a better prompt", "ui_interface", "en", "ok")} and len(out) == 2
    sft = jobs.run("pe_rewrite_distill", rows, clever, rounds=2).collect()
    assert {r.messages[-1].content for r in sft} == {"a better prompt"}


def test_resizing(rows):
    out = jobs.run("cot_long2short", rows, says("short")).collect()
    assert {r.response for r in out} == {"short"} and all(r.simplified_tokens == 1 for r in out)


def test_media(spark):
    seeds = spark.createDataFrame([("p", "a red boat"), ("q", "")], "id string, prompt string")
    out = jobs.run("t2i_distill", seeds, FakeMediaBackend).collect()
    assert len(out) == 1 and json.loads(out[0].messages[1].content)[0]["url"].startswith("https://media.example/p/0")
    assert jobs.run("advanced_t2v_distill", seeds, clever, media=FakeMediaBackend, thresholds={"visual_quality": 5}).count() == 1


def test_a_failing_call_drops_its_row_only(rows):
    bad = lambda: FakeBackend("ok", fail=lambda r, n: r.user.startswith("name"))
    out = jobs.call_model(jobs.loaders.seeds(rows), bad, jobs.F.array(jobs.message("user", jobs.F.col("instruction"))), jobs.F.col("id"), retries=0).collect()
    assert {r.id: r.error is None for r in out} == {"a": True, "b": False}


def test_new_files_are_worked_on_once(spark, tmp_path):
    src, sink, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "1.json").write_text('{"_key": "a", "video_urls": ["old"]}\n{"_key": "b", "video_urls": []}\n')
    go = lambda: incremental.process_new_files(spark, str(src), "_key string, video_urls array<string>", sink, mark, lambda d: d)
    assert go() == 1 and go() == 0
    (src / "2.json").write_text('{"_key": "a", "video_urls": ["new"]}\n{broken\n')
    assert go() == 1
    assert {(r._key, r.video_urls[0]) for r in incremental.completed(spark, sink, "generate").collect()} == {("a", "new")}
