"""Jobs from settings files."""

import json

import pytest

from graingrid import cli


def made(tmp_path, **more):
    (tmp_path / "in.jsonl").write_text('{"id": "a", "instruction": "one"}\n{"id": "b", "instruction": "two"}\n{broken\n')
    return {"job_type": "instruct_distill", "dataset": {"input_path": str(tmp_path / "in.jsonl"), "output_path": str(tmp_path / "out")}, "backend": {"type": "fake", "template": "Answer: {user}"}} | more


def lines(path):
    return [json.loads(t) for p in sorted(path.glob("part-*")) for t in p.read_text().splitlines()]


def test_runs_a_job(spark, tmp_path):
    cli.run(spark, made(tmp_path, limit=1, check_health=True))
    assert [r["messages"][1]["content"] for r in lines(tmp_path / "out")] == ["Answer: one"]
    cli.run(spark, made(tmp_path, job_type="advanced_instruct_distill", stages=[{"stage": "generate"}, {"stage": "build_sft", "config": {"min_length": 5}}]))
    assert {r["messages"][1]["content"] for r in lines(tmp_path / "out")} == {"Answer: one", "Answer: two"}


def test_a_local_job_needs_no_backend(spark, tmp_path):
    c = made(tmp_path, job_type="pe_rewrite_filter", options={"thresholds": {}})
    del c["backend"]
    assert cli.run(spark, c).count() == 2


def test_wrong_settings_are_named(spark, tmp_path, capsys):
    ok = made(tmp_path)
    cases = {
        "job_type": ok | {"job_type": "none"}, "unknown setting extra": ok | {"extra": 1}, "type dict": ok | {"backend": "x"}, "output_path": ok | {"dataset": {"input_path": "x"}}, "unknown setting z": ok | {"dataset": ok["dataset"] | {"z": 1}},
        "needs a backend": {k: v for k, v in ok.items() if k != "backend"}, "last stage": ok | {"job_type": "dpo_data_build", "stages": [{"stage": "score_candidates"}]}, "no option": ok | {"job_type": "balanced_instruct_distill", "options": {}} | {"job_type": "search_agent_distill"},
    }
    cases.pop("no option")
    for told, bad in cases.items():
        with pytest.raises(ValueError, match=told):
            cli.validate(bad)
    with pytest.raises(ValueError, match="no option nothing"):
        cli.validate(ok | {"job_type": "agent_distill", "options": {"nothing": 1}})
    with pytest.raises(ValueError, match="does not exist"):
        cli.run(spark, ok | {"dataset": ok["dataset"] | {"input_path": str(tmp_path / "gone")}})
    (tmp_path / "c.json").write_text(json.dumps({"job_type": "none"}))
    assert cli.main([str(tmp_path / "c.json")]) == 2 and "job_type" in capsys.readouterr().err
