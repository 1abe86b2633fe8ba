"""Agents' loops with scripted models: tool calls, limits, failures, and the search evolver's decisions."""

import json

from graingrid.operators import agents
from graingrid.operators.agents import Caller
from graingrid.operators.model import FakeBackend


def caller(f, roles=None):
    return Caller(FakeBackend(f), roles, retries=0)


def test_tool_calls_in_all_their_forms():
    one = '{"name": "t", "arguments": {"a": {"b": "}"}}}'
    for text in (f"<tool_call>{one}</tool_call>", f"<tool_call>\n{one}\n</tool>", f"x<|tool_call_begin|>{one}", f"```json\n{one}\n```", f"<tool_call>{{broken</tool_call><tool_call>{one}</tool_call>"):
        assert agents.tool_call(text) == {"name": "t", "arguments": {"a": {"b": "}"}}}, text
    assert agents.tool_call('functions.look:3 ({"q": 1}) more') == {"name": "look", "arguments": {"q": 1}}
    for text in (None, "", "no call", "<tool_call>[1]</tool_call>", '<tool_call>{"arguments": {}}</tool_call>', "functions.x(1)"):
        assert agents.tool_call(text) is None, text


def test_tools_are_listed_without_their_outputs():
    line = json.loads(agents.tools_text([{"name": "t", "description": "ü", "outputs": {"x": 1}}]))
    assert line == {"type": "function", "function": {"name": "t", "description": "ü"}}


def test_roles_and_their_fallback():
    seen = {}

    def answer(r):
        seen[r.id] = r.options
        return "x"

    call = caller(answer, {"solver": {"model": "big"}, "judge": {"model": "small"}})
    for role in ("solver", "fast_verify", "judge", "gate"):
        call.ask(role, "p", "i")
    assert seen == {"solver:i": {"model": "big"}, "fast_verify:i": {"model": "big"}, "judge:i": {"model": "small"}, "gate:i": {}}


ROW = {"id": "1", "task": "do it", "tools": '[{"name": "t"}]', "task_background": "bg"}


def test_rollout_limits_and_world():
    world = []

    def answer(r):
        if r.id.startswith("tool:"):
            world.append(r.user.split("World:\n")[1].split("\nCall:")[0])
            return "<tool_response_start>fact</tool_response_start><new_bg_introduced>YES</new_bg_introduced>"
        return '<tool_call>{"name": "t", "arguments": {}}</tool_call>'

    got = agents.tool_rollout(caller(answer), ROW, max_steps=10, max_tool_calls=3)
    assert got[-1]["content"].startswith("<answer>") and sum("<tool_response>" in m["content"] for m in got) == 3 and world == ["", "fact", "fact\nfact"]
    steps = agents.tool_rollout(caller(lambda r: "talk"), ROW, max_steps=4)
    assert sum(m["role"] == "assistant" for m in steps) == 5 and steps[0]["role"] == "system"
    assert len(agents.tool_rollout(caller(lambda r: "<answer>\nyes</answer>"), ROW | {"tools": "broken"})) == 3


def test_a_failed_rollout_drops_only_itself(spark):
    def answer(r):
        if "_solution_1" in r.id and "b_" in r.id:
            raise ValueError("down")
        return "<answer>x</answer>"

    rows = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, task string")
    assert sorted(r.solution_id for r in agents.rollouts(rows, lambda: FakeBackend(answer), 2).collect()) == ["a_solution_1.json", "a_solution_2.json", "b_solution_2.json"]


def test_solver_ends():
    end = lambda f, **o: agents.solve(caller(f), "q", **o)[-1]["content"]
    assert end(lambda r: "<answer>a</answer>") == "<answer>a</answer>" and "No answer" in end(lambda r: "hm")
    loop = lambda r: '<tool_call>{"name": "web_search", "arguments": {}}</tool_call>'
    assert "limit" in end(loop, max_steps=3) and len(agents.solve(caller(loop), "q", max_steps=3)) == 2 + 6 + 1


def test_equivalence_by_model_else_by_containment():
    yes, no, lost = (caller(lambda r, s=s: s) for s in ('{"is_correct": true}', '{"is_correct": false}', "?"))
    assert agents.equivalent(yes, "a", [], "zzz") and not agents.equivalent(no, "a", [], "a")
    assert agents.equivalent(lost, "Paris", [], " in paris. ") and agents.equivalent(lost, "x", ["Rome"], "ROME") and not agents.equivalent(lost, "Paris", [], "") and not agents.equivalent(lost, "", [], "x")


class Script:
    """An evolver's model: given decisions, and what each role answers."""

    def __init__(self, actions, **roles):
        self.actions, self.roles = list(actions), roles

    def __call__(self, r):
        role = r.id.split(":")[0]
        if role in self.roles:
            f = self.roles[role]
            return f(r) if callable(f) else f
        if role == "strategist":
            return json.dumps({"action": self.actions.pop(0)}) if self.actions else '{"action": "FINALIZE"}'
        if role == "expander":
            target = r.user.split("bridge to ")[1].split(": a JSON")[0]
            return json.dumps({"bridge": f"b{r.index}", "bridge_fact": "f" * 50, "atomic_question": "who?", "atomic_answer": target, "rewritten_question": f"q{r.index}"})
        return {"gate": '{"passed": true}', "judge": '{"is_correct": true, "difficulty": "too_easy", "action": "EXPAND"}', "refiner": '{"question": "refined"}'}.get(role, "<answer>x</answer>")


SEED = {"id": "s", "question": "q?", "answer": "A", "answer_aliases": [], "_pos": 0}


def evolved(script, **limits):
    return agents.evolve(caller(script), SEED, keep_filtered=True, fast_runs=1, final_runs=1, **limits)[0]


def test_expansions_rollbacks_and_limits():
    got = evolved(Script(["EXPAND", "EXPAND"]))
    assert (got["evolve_level"], got["question"], [e["from_id"] for e in got["graph_edges"]], got["evolve_status"]) == (2, "q2", ["b1", "b2"], "filtered")
    got = evolved(Script(["EXPAND", "EXPAND", "ROLLBACK"]))
    assert (got["evolve_level"], got["question"], [e["from_id"] for e in got["graph_edges"]]) == (1, "q1", ["b1"])
    assert evolved(Script(["ROLLBACK"]))["iterations"] == 0
    assert evolved(Script(["EXPAND"] * 9), max_levels=3)["evolve_level"] == 3 and evolved(Script(["REFINE"] * 9), max_iterations=2)["iterations"] == 2
    got = evolved(Script(["EXPAND", "REFINE"]))
    assert got["question"] == "refined" and got["evolve_level"] == 1
    assert evolved(Script(["REFINE"], refiner="broken"))["question"] == "q?"


def test_a_failed_gate_takes_the_last_step_back():
    seen = []

    def gate(r):
        seen.append(r.user)
        return '{"passed": false}' if len(seen) == 2 else "odd"

    got = evolved(Script(["EXPAND", "REFINE", "FINALIZE"], gate=gate))
    assert got["question"] == "q1" and got["evolve_level"] == 1
    assert evolved(Script(["EXPAND"], gate='{"passed": false}'))["evolve_level"] == 0


def test_guards_of_an_expansion():
    base = {"bridge": "b", "bridge_fact": "f" * 50, "atomic_question": "who?", "atomic_answer": "a", "rewritten_question": "new"}
    for wrong in ({"bridge": "A"}, {"bridge_fact": "short"}, {"atomic_question": "is it A?"}, {"atomic_answer": "B"}, {"rewritten_question": ""}, {"bridge": None}):
        assert evolved(Script(["EXPAND"], expander=json.dumps(base | wrong)))["evolve_level"] == 0, wrong
    assert evolved(Script(["EXPAND"], expander=json.dumps(base)))["evolve_level"] == 1


def test_good_tasks_are_saved_and_others_dropped():
    good = Script(["EXPAND"], judge='{"is_correct": true, "difficulty": "good"}', equivalence='{"is_correct": true}')
    got = evolved(good)
    assert (got["evolve_status"], got["accuracy"], got["filter_reason"], got["id"]) == ("saved", 1.0, None, "s-evolved")
    assert agents.evolve(caller(Script(["EXPAND"])), SEED, fast_runs=1) == []
    # without a strategist's word the rules decide; a judge that can't be read is replaced by rule as well
    got = evolved(Script([], strategist="?", judge="?", equivalence='{"is_correct": true}', fast_verify=lambda r: "<answer>x web_search web_browse</answer>"), max_levels=1, max_iterations=3)
    assert got["difficulty"] == "too_easy" and got["evolve_level"] == 1 and got["iterations"] == 3


def test_generations(spark):
    rows = spark.createDataFrame([("s", "q?", "A", [])], "id string, question string, answer string, answer_aliases array<string>")
    good = lambda: FakeBackend(Script(["EXPAND"], strategist="?", judge='{"is_correct": true, "difficulty": "good"}', equivalence='{"is_correct": true}'))
    got = agents.evolve_tasks(rows, good, generations=3, fast_runs=1, final_runs=2).collect()
    assert sorted((r.id, r.seed_id, r.accuracy) for r in got) == [(f"s#gen{k}-evolved", "s", 1.0) for k in range(3)]
    assert agents.evolve_tasks(rows.union(rows), good, max_tasks=1, fast_runs=1).count() == 1
