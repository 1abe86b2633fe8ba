"""Agents: task synthesis, tool-use rollouts, search tasks and their judging.

A rollout is a loop of calls whose every step depends on the last, so it runs
as Python within one row; rows are spread over partitions, a few threads each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..functions import jsonx, text
from ..functions.rows import POS, with_pos
from .aggregate import first_per_task
from .builders import message
from .joins import fan_out
from .model import Backend, Factory, Request, call_model, with_retries

_MESSAGES = "array<struct<role:string,content:string>>"
RUN = f"solution_id:string,trajectory:{_MESSAGES},predicted_answer:string,is_correct:boolean,turns:int"


def _last(pattern: str, s: str) -> str | None:
    found = re.findall(pattern, s or "", re.S)
    return found[-1].strip() if found else None


def tool_call(answer: str | None) -> dict[str, Any] | None:
    """A tool call in an answer: tagged (also by a wrong closer), special-token, fenced, or functions.NAME({...}); None without one."""
    s = answer or ""
    spots = [m.end() for m in re.finditer(r"<tool_call>|<\|tool_call(?:_begin|_argument_begin)?\|>|```(?:json|tool_call)?", s)]
    for at in reversed(spots):
        raw = jsonx.balanced_object(s[at:], True)
        if raw and isinstance((obj := json.loads(raw)).get("name"), str):
            return {"name": obj["name"], "arguments": obj.get("arguments") or {}}
    if m := re.search(r"functions\.(\w+)(?::\d+)?\s*\(?", s):
        if raw := jsonx.balanced_object(s[m.end() :], True):
            return {"name": m[1], "arguments": json.loads(raw)}
    return None


def tools_text(tools: list[dict[str, Any]]) -> str:
    """Tools as function schemas, a line each, without their outputs."""
    return "\n".join(json.dumps({"type": "function", "function": {k: v for k, v in t.items() if k != "outputs"}}, ensure_ascii=False) for t in tools)


class Caller:
    """Calls of named roles, each with its own options; a role without any takes its fallback's."""

    def __init__(self, backend: Backend, roles: dict[str, dict[str, Any]] | None = None, retries: int = 3):
        self.backend, self.roles, self.retries = backend, roles or {}, retries

    def __call__(self, role: str, messages: list[dict[str, str]], ident: str = "", index: int = 0) -> str:
        options = self.roles.get(role) or self.roles.get({"fast_verify": "solver"}.get(role, ""), {})
        return with_retries(lambda: self.backend.generate(Request(messages, f"{role}:{ident}", index, dict(options)))).text or ""

    def ask(self, role: str, prompt: str, ident: str = "", index: int = 0) -> str:
        return self(role, [{"role": "user", "content": prompt}], ident, index)


def _map_rows(df: DataFrame, make: Factory, work: Callable[[Caller, dict[str, Any]], list[dict[str, Any]]], schema: str, workers: int, roles: dict | None = None) -> DataFrame:
    """Each row through a function that may call the model and gives rows; a row whose work fails gives none."""
    spark = df.sparkSession
    kind = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        call = Caller(backend, roles)

        def one(row: dict[str, Any]) -> list[dict[str, Any]]:
            try:
                return work(call, row)
            except Exception:
                return []

        try:
            with ThreadPoolExecutor(max(1, workers)) as pool:
                for b in batches:
                    out = [r for rows in pool.map(one, b.to_pylist()) for r in rows]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, arrow)
        finally:
            backend.close()

    return checkpointed(df.mapInArrow(run, kind))


# Task synthesis


def _chain(df: DataFrame, make: Factory, words, workers: int) -> DataFrame:
    return call_model(with_pos(df), make, F.array(message("user", words)), F.col(POS), workers=workers).where("error is null")


def synthesize_tasks(df: DataFrame, make: Factory, key: str = "persona", workers: int = 1) -> DataFrame:
    """task, tools, workflow and restriction from a persona (or background); incomplete answers are dropped."""
    key = key if key in df.columns else "background"
    ask = "Invent a task for this person that needs tools. Give <task></task>, <tools></tools> (a JSON array), <workflow></workflow> and <restriction></restriction>.\n\n{p}"
    got = _chain(df, make, text.fill(ask, p=F.col(key)), workers)
    tags = {t: text.last_tag(F.col("response"), t) for t in ("task", "tools", "workflow", "restriction")}
    out = got.withColumns(tags).where("task is not null and tools is not null and workflow is not null").where(F.try_parse_json("tools").isNotNull())
    return out.drop("response", "urls", "prompt_tokens", "completion_tokens", "model", "error")


def blur_tasks(df: DataFrame, make: Factory, workers: int = 1) -> DataFrame:
    """fuzzy_task and task_background: the task as a user would say it, and what the user knows."""
    ask = "Say this task vaguely inside <fuzzy_task></fuzzy_task> and give what the user knows inside <task_background></task_background>.\n\n{t}"
    got = _chain(df, make, text.fill(ask, t=F.col("task")), workers)
    out = got.withColumns({t: text.last_tag(F.col("response"), t) for t in ("fuzzy_task", "task_background")}).where("fuzzy_task is not null and task_background is not null")
    return out.drop("response", "urls", "prompt_tokens", "completion_tokens", "model", "error")


def check_tools(df: DataFrame, make: Factory, workers: int = 1) -> DataFrame:
    """checked_tools: the tools completed for the task, a JSON array; rows without a readable one are dropped."""
    ask = "Complete this tool list for the task. Give a JSON array inside <tools></tools>.\n\nTask:\n{t}\n\nTools:\n{l}"
    got = _chain(df, make, text.fill(ask, t=F.col("task"), l=F.col("tools")), workers)
    out = got.withColumn("checked_tools", text.last_tag(F.col("response"), "tools")).where(F.try_parse_json("checked_tools").isNotNull())
    return out.drop("response", "urls", "prompt_tokens", "completion_tokens", "model", "error")


# Tool-use rollouts


def tool_rollout(call: Caller, row: dict[str, Any], max_steps: int = 10, max_tool_calls: int = 20) -> list[dict[str, str]]:
    """Messages of one rollout: reason, then a simulated tool or user answers, until an <answer> or a limit."""
    try:
        tools = json.loads(row.get("checked_tools") or row.get("tools") or "[]")
    except ValueError:
        tools = []
    system = f"Solve the user's task with these tools. Call one inside <tool_call></tool_call>; finish inside <answer></answer>.\n{tools_text([t for t in tools if isinstance(t, dict)])}\n{row.get('restriction') or ''}"
    messages = [{"role": "system", "content": system}, {"role": "user", "content": row.get("fuzzy_task") or row.get("task") or ""}]
    world: list[str] = []
    ident, steps, calls = str(row.get("solution_id") or row.get("id")), 0, 0
    for _ in range(max(3 * max_steps + 10, 100)):
        if steps >= max_steps or calls >= max_tool_calls:
            messages.append({"role": "assistant", "content": "<answer>The limit of steps is reached.</answer>"})
            break
        said = call("reason", messages, ident, steps)
        steps += 1
        messages.append({"role": "assistant", "content": said})
        if re.search(r"<answer>.*?</answer>", said, re.S):
            break
        if tool := tool_call(said):
            got = call.ask("tool", f"Act as this tool and answer inside <tool_response_start></tool_response_start>; say inside <new_bg_introduced></new_bg_introduced> (YES or NO) whether the world changed.\nWorld:\n{chr(10).join(world)}\nCall:\n{json.dumps(tool, ensure_ascii=False)}", ident, steps)
            reply = _last(r"<tool_response_start>(.+?)</tool_response_start>", got) or got
            if "YES" in (_last(r"<new_bg_introduced>(.+?)</new_bg_introduced>", got) or "").upper():
                world.append(reply)
            calls += 1
            messages.append({"role": "user", "content": f"<tool_response>\n{reply}\n</tool_response>"})
        else:
            got = call.ask("user", f"Act as the user, who knows:\n{row.get('task_background') or ''}\n\nReply to:\n{said}", ident, steps)
            messages.append({"role": "user", "content": got})
    return messages


def rollouts(df: DataFrame, make: Factory, repeat: int = 2, max_steps: int = 10, max_tool_calls: int = 20, workers: int = 1, roles: dict | None = None) -> DataFrame:
    """A row for each task and rollout: solution_id and trajectory. A failed rollout drops only itself."""
    df = with_pos(df)
    many = fan_out(df, repeat, "run", "{id}_solution_{n}.json").withColumnRenamed("request_id", "solution_id")
    many = many.withColumn(POS, F.struct(F.col(POS).alias("task"), "run")).drop("run")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in many.schema) + f", trajectory {_MESSAGES}"
    # many small partitions: rollouts differ much in length
    return _map_rows(many, make, lambda call, row: [row | {"trajectory": tool_rollout(call, row, max_steps, max_tool_calls)}], schema, workers, roles)


def judge_rubrics(df: DataFrame, make: Factory, top_k: int = 3, workers: int = 1) -> DataFrame:
    """A row for each task: its first rollouts, rubrics, and best_solution_id; tasks the model says to discard are dropped."""
    tasks = first_per_task(with_pos(df), k=top_k)
    fields = [f for f in ("task", "tools", "workflow", "restriction", "fuzzy_task", "task_background", "checked_tools") if f in df.columns]
    tasks = tasks.select(F.col("task_id").alias("id"), F.element_at("solutions", 1)[POS].alias(POS), *(F.element_at("solutions", 1)[f].alias(f) for f in fields), "solutions")
    report = F.array_join(F.transform("solutions", lambda s: text.solution_report(s["trajectory"], s["solution_id"])), "\n\n")
    ask = "Write rubrics for the task inside <rubrics></rubrics>, say inside <alignment></alignment> keep or discard, and name the best solution inside <best></best>.\n\nTask:\n{t}\n\n{r}"
    got = _chain(tasks, make, text.fill(ask, t=F.col("task") if "task" in fields else F.lit(""), r=report), workers)
    best = text.solution_file(text.last_tag(F.col("response"), "best"))
    out = got.withColumns({"rubrics": text.last_tag(F.col("response"), "rubrics"), "best_solution_id": best, "__say": F.lower(F.coalesce(text.last_tag(F.col("response"), "alignment"), F.lit("")))})
    runs = F.transform("solutions", lambda s: F.struct(s["solution_id"].alias("solution_id"), s["trajectory"].alias("trajectory"), text.trajectory_answer(s["trajectory"]).alias("predicted_answer"), F.lit(None).cast("boolean").alias("is_correct"), text.assistant_turns(s["trajectory"]).alias("turns")))
    out = out.where(~F.contains("__say", F.lit("discard"))).withColumn("trajectories", runs)
    return out.drop("__say", "solutions", "response", "urls", "prompt_tokens", "completion_tokens", "model", "error")


# Search


class SearchTools:
    """web_search and web_browse, simulated by a model role or given as functions; errors come back as text."""

    def __init__(self, call: Caller, search: Callable[[str, int], list[dict]] | None = None, browse: Callable[[str], str] | None = None, max_results: int = 5, max_chars: int = 4000):
        self.call, self.search, self.browse, self.n, self.cap, self.seen = call, search, browse, max_results, max_chars, []

    def run(self, name: str, arguments: dict[str, Any], ident: str = "", index: int = 0) -> str:
        try:
            if name == "web_search":
                query = str(arguments.get("query") or "").strip()
                if not query:
                    return "Error: web_search needs a query."
                results = self.search(query, self.n) if self.search else self._simulated(query, ident, index)
                self.seen += [{"url": r.get("url"), "snippet": r.get("snippet"), "query": query} for r in results]
                return json.dumps({"results": results[: self.n]}, ensure_ascii=False)
            if name == "web_browse":
                url = str(arguments.get("url") or "").strip()
                if not url:
                    return "Error: web_browse needs a url."
                known = next((s.get("snippet") or s["query"] for s in reversed(self.seen) if s["url"] == url), "")
                page = self.browse(url) if self.browse else self.call.ask("browse", f"Act as the page {url}. Known of it: {known}", ident, index)
                return page if len(page) <= self.cap else page[: self.cap] + "...[TRUNCATED]"
            return f"Error: there is no tool {name}."
        except Exception as e:
            return f"Error: {e}"

    def _simulated(self, query: str, ident: str, index: int) -> list[dict]:
        raw = jsonx.balanced_object(self.call.ask("search", f"Act as a search engine. Answer with a JSON object of results (title, url, snippet).\n\n{query}", ident, index), True)
        results = (json.loads(raw) if raw else {}).get("results")
        if not isinstance(results, list):
            raise ValueError("the search gave no results")
        return [r for r in results if isinstance(r, dict)]


def solve(call: Caller, question: str, ident: str = "", max_steps: int = 12, role: str = "solver", tools: SearchTools | None = None) -> list[dict[str, str]]:
    """Messages of one search rollout of at most ``max_steps`` turns."""
    tools = tools or SearchTools(call)
    messages = [{"role": "system", "content": "Answer the question by web_search and web_browse, called inside <tool_call></tool_call>. Finish inside <answer></answer>."}, {"role": "user", "content": question}]
    for step in range(max_steps):
        said = call(role, messages, ident, step)
        messages.append({"role": "assistant", "content": said})
        if "<answer>" in said:
            return messages
        tool = tool_call(said)
        if not tool:
            messages.append({"role": "assistant", "content": "<answer>No answer was found.</answer>"})
            return messages
        messages.append({"role": "user", "content": f"<tool_response>\n{tools.run(tool['name'], tool['arguments'], ident, step)}\n</tool_response>"})
    messages.append({"role": "assistant", "content": "<answer>The limit of steps is reached.</answer>"})
    return messages


def predicted(messages: list[dict[str, str]]) -> str:
    said = [m["content"] for m in messages if m["role"] == "assistant"]
    tagged = [s for s in said if re.search(r"<answer>.*?</answer>", s, re.S)]
    return re.search(r"<answer>(.*?)</answer>", tagged[-1], re.S)[1].strip() if tagged else (said[-1] if said else "")


def equivalent(call: Caller, answer: str, aliases: list[str], got: str, ident: str = "") -> bool:
    """Whether an answer is right, by a model, else by one containing the other."""
    try:
        raw = jsonx.balanced_object(call.ask("equivalence", f"Is the given answer the same as the right one? Answer with a JSON object: is_correct.\nRight: {answer}\nGiven: {got}", ident), True)
        said = json.loads(raw)["is_correct"] if raw else None
        if isinstance(said, bool):
            return said
    except Exception:
        pass
    g = got.lower().strip()
    return any(a and g and (a in g or g in a) for a in (x.lower().strip() for x in (answer, *aliases)))


def evaluate(call: Caller, row: dict[str, Any], repeat: int, max_steps: int, role: str = "solver", tools: Callable[[Caller], SearchTools] | None = None) -> dict[str, Any]:
    """Repeated rollouts of a task with accuracy and mean turns."""
    runs = []
    for k in range(repeat):
        ident = f"{row.get('id')}_solution_{k + 1}.json"
        try:
            messages = solve(call, row["question"], ident, max_steps, role, tools(call) if tools else None)
        except Exception:
            continue
        got = predicted(messages)
        runs.append({"solution_id": ident, "trajectory": messages, "predicted_answer": got, "is_correct": equivalent(call, row["answer"], row.get("answer_aliases") or [], got, ident), "turns": sum(m["role"] == "assistant" for m in messages)})
    n = len(runs)
    return {"trajectories": runs, "accuracy": sum(r["is_correct"] for r in runs) / n if n else 0.0, "avg_turns": sum(r["turns"] for r in runs) / n if n else 0.0}


def search_rollouts(df: DataFrame, make: Factory, repeat: int = 2, max_steps: int = 12, workers: int = 4, roles: dict | None = None, tools: Callable[[Caller], SearchTools] | None = None) -> DataFrame:
    """Tasks (id, question, answer) with trajectories, accuracy and avg_turns; tools are simulated by the model unless given (see ``web.web_tools``)."""
    df = with_pos(df).drop("trajectories", "accuracy", "avg_turns")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", trajectories array<struct<{RUN}>>, accuracy double, avg_turns double"
    return _map_rows(df, make, lambda call, row: [row | evaluate(call, row, repeat, max_steps, tools=tools)], schema, workers, roles)


def fallback_judgment(is_correct: bool, steps: int, enough: int = 4) -> dict[str, Any]:
    """A task's difficulty and the next action, by rule, where no judge's report can be read."""
    if is_correct:
        return {"is_correct": True, "difficulty": "good" if steps >= enough else "too_easy", "action": "FINALIZE" if steps >= enough else "EXPAND"}
    return {"is_correct": False, "difficulty": "too_hard" if steps >= enough else "broken", "action": "REFINE" if steps >= enough else "ROLLBACK"}


_DIFFICULTY, _ACTIONS = ("good", "too_easy", "too_hard", "broken"), ("EXPAND", "REFINE", "ROLLBACK", "FINALIZE")


def judge_task(call: Caller, question: str, answer: str, got: str, steps: int, is_correct: bool, ident: str = "") -> dict[str, Any]:
    try:
        raw = jsonx.balanced_object(call.ask("judge", f"Judge this search task: a JSON object of is_correct, difficulty ({', '.join(_DIFFICULTY)}), action and suggestions.\nQuestion: {question}\nAnswer: {answer}\nSolver's: {got}\nSteps: {steps}", ident), True)
        report = json.loads(raw)
    except Exception:
        return fallback_judgment(is_correct, steps)
    tips = report.get("suggestions") or []
    return {
        "is_correct": report["is_correct"] if isinstance(report.get("is_correct"), bool) else is_correct,
        "difficulty": report.get("difficulty") if report.get("difficulty") in _DIFFICULTY else "broken",
        "action": report.get("action") if report.get("action") in _ACTIONS else "FINALIZE",
        "suggestions": [tips] if isinstance(tips, str) else tips,
    }


def next_action(state: dict[str, Any]) -> str:
    """The strategist's decision by rule."""
    last = state.get("judgment")
    if not last:
        return "EXPAND"
    if last["is_correct"] and last["difficulty"] == "good":
        return "FINALIZE"
    if last["difficulty"] == "too_easy":
        return "EXPAND" if state["level"] < state["max_level"] else "REFINE"
    return "ROLLBACK" if last["difficulty"] == "broken" and state["level"] else "REFINE"


def _expand(call: Caller, state: dict[str, Any]) -> bool:
    """One layer more: a bridge entity before the target, and the question rewritten around it. False if a guard fails."""
    target, k = state["target"], state["iteration"]
    raw = jsonx.balanced_object(call.ask("expander", f"Find a bridge to {target}: a JSON object of bridge, relation, bridge_fact, atomic_question, atomic_answer, rewritten_question. Not: {', '.join(state['bridges'])}.\nQuestion: {state['question']}", state["id"], k), True)
    got = json.loads(raw) if raw else {}
    text_of = lambda n: str(got.get(n) or "").strip()
    if any(not text_of(n) for n in ("bridge", "bridge_fact", "atomic_question", "atomic_answer", "rewritten_question")):
        return False
    bridge = text_of("bridge")
    forbidden = {x.lower() for x in (*state["bridges"], state["answer"])}
    if text_of("atomic_answer").lower() != target.lower() or target.lower() in text_of("atomic_question").lower() or bridge.lower() in forbidden or len(text_of("bridge_fact")) < 50:
        return False
    state["layers"].append({"question": text_of("rewritten_question"), "target": bridge})
    state["edges"].append({"from_id": bridge, "to_id": target, "relation": text_of("relation") or "related"})
    state["bridges"].append(bridge)
    state.update(question=text_of("rewritten_question"), target=bridge, level=state["level"] + 1)
    return True


def _rollback(state: dict[str, Any]) -> bool:
    if state["pre"] is not None:
        state["question"], state["pre"] = state["pre"], None
        return True
    if not state["level"] or len(state["layers"]) < 2:
        return False
    state["layers"].pop()
    state["level"] -= 1
    state["edges"], state["bridges"] = state["edges"][: state["level"]], state["bridges"][: state["level"]]
    state.update(question=state["layers"][-1]["question"], target=state["layers"][-1]["target"], judgment=None)
    return True


def evolve(call: Caller, row: dict[str, Any], max_levels: int = 4, max_iterations: int = 20, fast_runs: int = 4, final_runs: int = 4, max_steps: int = 12, keep_filtered: bool = False) -> list[dict[str, Any]]:
    """A seed question made harder, layer by layer, until it is good; none if it doesn't get there."""
    state: dict[str, Any] = {"id": str(row["id"]), "question": row["question"], "answer": row["answer"], "target": row["answer"], "level": 0, "max_level": max_levels, "iteration": 0, "layers": [{"question": row["question"], "target": row["answer"]}], "edges": [], "bridges": [], "judgment": None, "pre": None}
    while state["iteration"] < max_iterations:
        try:
            raw = jsonx.balanced_object(call.ask("strategist", f"What next: EXPAND, REFINE, ROLLBACK or FINALIZE? A JSON object of action.\nQuestion: {state['question']}\nLevel: {state['level']}\nLast: {state['judgment']}", state["id"], state["iteration"]), True)
            action = json.loads(raw)["action"]
        except Exception:
            action = None
        action = action if action in _ACTIONS else next_action(state)
        if action == "FINALIZE":
            break
        if action == "ROLLBACK":
            if not _rollback(state):
                break
            state["iteration"] += 1  # bounds rollbacks, too
            continue
        state["iteration"] += 1
        state["pre"] = None
        if action == "EXPAND":
            if state["level"] >= max_levels:
                break
            try:
                if not _expand(call, state):
                    break
            except Exception:
                break
        else:
            state["pre"] = state["question"]
            try:
                raw = jsonx.balanced_object(call.ask("refiner", f"Rewrite the question, same answer: a JSON object of question.\n{state['question']}", state["id"], state["iteration"]), True)
                state["question"] = str((json.loads(raw) if raw else {}).get("question") or "").strip() or state["question"]
            except Exception:
                pass
        try:
            raw = jsonx.balanced_object(call.ask("gate", f"Is this question well formed and free of its answer? A JSON object of passed.\n{state['question']}", state["id"], state["iteration"]), True)
            passed = bool((json.loads(raw) if raw else {}).get("passed", True))
        except Exception:
            passed = True  # the gate fails open
        if not passed:
            if not _rollback(state):
                break
            continue
        runs = evaluate(call, {"id": f"{state['id']}_v{state['iteration']}", "question": state["question"], "answer": state["answer"], "answer_aliases": row.get("answer_aliases")}, fast_runs, max_steps, "fast_verify")["trajectories"]
        steps = sorted(sum("web_search" in m["content"] for m in r["trajectory"] if m["role"] == "assistant") + sum("web_browse" in m["content"] for m in r["trajectory"] if m["role"] == "assistant") for r in runs)
        median = int((steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2) if steps else 0
        right = [r for r in runs if r["is_correct"]]
        got = (right or runs or [{"predicted_answer": ""}])[0]["predicted_answer"]
        state["judgment"] = judge_task(call, state["question"], state["answer"], got, median, bool(right), state["id"])
        if state["judgment"]["is_correct"] and state["judgment"]["difficulty"] == "good":
            break
    last = state["judgment"] or {"is_correct": False, "difficulty": "broken"}
    good = last["is_correct"] and last["difficulty"] == "good"
    if not good and not keep_filtered:
        return []
    final = evaluate(call, {"id": state["id"], "question": state["question"], "answer": state["answer"], "answer_aliases": row.get("answer_aliases")}, final_runs, max_steps) if good else {"accuracy": 0.0, "avg_turns": 0.0}
    return [{
        "_pos": row[POS], "id": f"{state['id']}-evolved", "seed_id": state["id"].split("#gen")[0], "question": state["question"], "answer": state["answer"], "answer_aliases": row.get("answer_aliases") or [], "difficulty": last["difficulty"],
        "evolve_status": "saved" if good else "filtered", "filter_reason": None if good else f"correct={last['is_correct']}, difficulty={last['difficulty']}", "evolve_level": state["level"], "iterations": state["iteration"],
        "graph_edges": state["edges"], "accuracy": final["accuracy"], "avg_turns": final["avg_turns"],
    }]


EVOLVED = f"{POS} long, id string, seed_id string, question string, answer string, answer_aliases array<string>, difficulty string, evolve_status string, filter_reason string, evolve_level int, iterations int, graph_edges array<struct<from_id:string,to_id:string,relation:string>>, accuracy double, avg_turns double"


def evolve_tasks(df: DataFrame, make: Factory, generations: int = 1, max_tasks: int | None = None, workers: int = 2, roles: dict | None = None, **limits: Any) -> DataFrame:
    """Seeds (id, question, answer) evolved to search tasks, each ``generations`` times."""
    df = with_pos(df)
    if max_tasks:
        df = df.orderBy(POS).limit(max_tasks)
    if generations > 1:
        df = df.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(generations - 1)))).withColumn("id", F.concat("id", F.lit("#gen"), F.col("g").cast("string"))).drop("g")
    return _map_rows(df, make, lambda call, row: evolve(call, row, **limits), EVOLVED, workers, roles)

