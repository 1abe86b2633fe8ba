"""Pipelines of stages: which are allowed, what each leaves behind, and resuming."""

import json
from pathlib import Path

import pytest

from graingrid.operators.model import Answer, FakeBackend
from graingrid.plans import jobs, stages
from graingrid.sources.jsonl import read_jsonl


def lines(path):
    return [json.loads(t) for p in sorted(Path(path).glob("part-*")) for t in p.read_text().splitlines()]


def says(text):
    return lambda: FakeBackend(text)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", "one two"), ("b", "three")], "id string, instruction string")


def test_unknown_and_misplaced_stages_raise(rows):
    for todo in ([], [{"stage": "generate"}], [{"stage": "cot_distill"}, {"stage": "build_sft"}], [{"stage": "build_sft"}, {"stage": "generate"}]):
        with pytest.raises(ValueError):
            stages.run("advanced_instruct_distill", rows, says("x"), todo)
    with pytest.raises(ValueError):
        stages.run("nothing", rows, says("x"), [{"stage": "build_sft"}])
    assert set(stages.PIPELINES) <= set(jobs.JOBS)


def test_outputs_of_stages_and_recovery(rows, tmp_path):
    todo = [{"stage": "generate", "output_path": str(tmp_path / "answers")}, {"stage": "build_sft"}]
    out = jobs.run("advanced_instruct_distill", rows, says("Answer: {user}"), stages=todo, output=str(tmp_path / "sft"))
    assert out.count() == 2 and {r["response"] for r in lines(tmp_path / "answers")} == {"Answer: one two", "Answer: three"}
    assert {r["messages"][1]["content"] for r in lines(tmp_path / "sft")} == {"Answer: one two", "Answer: three"}
    bad = [{"stage": "generate"}, {"stage": "quality_filter", "config": {"nothing": 1}}, {"stage": "build_sft"}]
    with pytest.raises(TypeError):
        stages.run("advanced_instruct_distill", rows, says("ok {id}"), bad, output=str(tmp_path / "out"))
    saved = lines(f"{tmp_path}/out.recovery.stage_1.quality_filter.jsonl")
    assert {r["response"] for r in saved} == {"ok a", "ok b"}


def test_every_stage_of_reasoning_runs(rows):
    def answer(r):
        if "<score>" in r.user:
            return "<score>8</score>" if "true or false" not in r.user else "<score>true</score>"
        return "<|begin_of_thought|>t<|end_of_thought|><|begin_of_solution|>s<|end_of_solution|>"

    todo = [{"stage": "cot_distill"}, {"stage": "cot_long2short"}, {"stage": "cot_rvcd_score"}, {"stage": "cot_mix_by_rv_cd", "config": {"per_bin": 1}}, {"stage": "build_sft"}]
    out = stages.run("advanced_cot_distill", rows, lambda: FakeBackend(answer), todo).collect()
    assert len(out) == 1 and out[0].messages[0].content == "one two" and json.loads(out[0].metadata)["cd_bin"] == 2


class Counting(FakeBackend):
    """Notes each call in a file; fails where it is told to."""

    def __init__(self, log, bad=""):
        super().__init__()
        self.log, self.bad = log, bad

    def generate(self, request):
        with open(self.log, "a") as f:
            f.write(request.id + "\n")
        if request.id == self.bad:
            raise ValueError("no video")
        return Answer(urls=[f"https://v/{request.id}"])


def test_a_resumed_stage_repeats_no_call(spark, tmp_path):
    seeds = spark.createDataFrame([("a", "red"), ("b", "blue"), ("c", "green")], "id string, prompt string")
    log, path = tmp_path / "log", str(tmp_path / "videos")
    todo = [{"stage": "generate", "resume": True, "output_path": path}, {"stage": "build_t2v_sft"}]
    go = lambda bad: stages.run("advanced_t2v_distill", seeds, lambda: Counting(str(log), bad), todo).collect()
    assert len(go("b")) == 2 and sorted(log.read_text().split()) == ["a", "b", "c"]
    log.write_text("")
    got = go("")
    assert log.read_text().split() == ["b"] and [r.messages[0].content for r in sorted(got, key=lambda r: r._pos)] == ["red", "blue", "green"]
    assert read_jsonl(spark, path).count() == 3
    with pytest.raises(ValueError):
        stages.run("advanced_t2v_distill", seeds, lambda: Counting(str(log)), [{"stage": "quality_filter", "resume": True}, {"stage": "build_t2v_sft"}])
    # a torn last line and an earlier, incomplete row of the same key
    (tmp_path / "videos" / "part-z.json").write_text('{"id": "d", "prompt": "x", "video_urls": []}\n{"id": "e", "vid')
    more = seeds.union(spark.createDataFrame([("d", "x")], "id string, prompt string"))
    log.write_text("")
    assert len(stages.run("advanced_t2v_distill", more, lambda: Counting(str(log)), todo).collect()) == 4 and log.read_text().split() == ["d"]
