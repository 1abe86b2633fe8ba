"""Extraction and measuring of text, as column expressions that stay in generated code."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import pystrip


def quoted(literal: str) -> str:
    """A literal for a Java regex."""
    return "".join(c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c for c in literal)


def _nth(text: Column, pattern: str, group: int, n: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(n))


def between(text: Column, begin: str, end: str) -> Column:
    """What stands between the first two delimiters, trimmed; null if they aren't there."""
    return pystrip(_nth(text, f"(?s){quoted(begin)}(.*?){quoted(end)}", 1, 1))


def first_tag(text: Column, tag: str) -> Column:
    """The first tag's content, trimmed, maybe empty; null without the tag."""
    return between(text, f"<{tag}>", f"</{tag}>")


def last_tag(text: Column, tag: str) -> Column:
    """The last non-empty tag's content, trimmed; null without one."""
    return pystrip(_nth(text, f"(?s)<{quoted(tag)}>(.+?)</{quoted(tag)}>", 1, -1))


def all_tags(text: Column, tag: str) -> Column:
    """The contents of all non-empty tags, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)<{quoted(tag)}>(.+?)</{quoted(tag)}>"), F.lit(1)), pystrip)


def thought_and_solution(text: Column) -> tuple[Column, Column]:
    """The sections of a reasoning text; the short tags count only if both long ones are missing."""
    a = between(text, "<|begin_of_thought|>", "<|end_of_thought|>")
    b = between(text, "<|begin_of_solution|>", "<|end_of_solution|>")
    neither = a.isNull() & b.isNull()
    return F.when(neither, first_tag(text, "thinking")).otherwise(a), F.when(neither, first_tag(text, "answer")).otherwise(b)


def score(text: Column) -> Column:
    """A judge's score: tagged integer, else first integer, else first truth word as 1 or 0; null otherwise."""
    word = F.lower(_nth(text, r"(?i)\b(true|false|correct|incorrect)\b", 1, 1))
    return F.coalesce(
        _nth(text, r"<score>\s*(\d+)\s*</score>", 1, 1).try_cast("int"),
        _nth(text, r"\b(\d+)\b", 1, 1).try_cast("int"),
        F.when(word.isin("true", "correct"), 1).when(word.isin("false", "incorrect"), 0),
    )


def category(text: Column, categories: list[str], default: str = "Others") -> Column:
    """The tagged category if it is one, else the first of the list that occurs as a whole word, else the default."""
    tagged = first_tag(text, "answer")
    out = F.when(tagged.isin(categories), tagged)
    for c in categories:
        out = out.when(text.rlike(rf"(?iU)(?<!\w){quoted(c)}(?!\w)"), F.lit(c))
    return out.otherwise(F.lit(default))


def normal_answer(text: Column) -> Column:
    """Lower case, no white space, no dots or dollars at the ends."""
    return F.btrim(F.regexp_replace(F.lower(pystrip(text)), r"(?U)\s+", ""), F.lit(".$"))


def final_answer(text: Column) -> Column:
    """The answer a solution ends in: boxed, after ####, after "answer is", the last number, the last line, or all."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(pystrip(x)) > 0)
    branches = [
        _nth(text, r"\\boxed\{([^{}]*)\}", 1, -1),
        _nth(text, r"(?s)####\s*(.+)", 1, 1),
        _nth(text, r"(?i)the answer is[:\s]*([^\n.]+)", 1, 1),
        _nth(text, r"(-?\d[\d,.]*)", 1, -1),
        F.try_element_at(lines, F.lit(-1)),
    ]
    return F.coalesce(*(F.nullif(pystrip(b), F.lit("")) for b in branches), pystrip(text))


def answer_by(text: Column, pattern: str | None) -> Column:
    """The pattern's group 1, or its whole match without groups; :func:`final_answer` where it isn't found."""
    if not pattern:
        return final_answer(text)
    return F.coalesce(pystrip(_nth(text, pattern, 1 if re.compile(pattern).groups else 0, 1)), final_answer(text))


def fill(template: str, **values: Column) -> Column:
    """The template with its {placeholders} filled, made a concatenation at plan time.

    If one isn't given a value, or the braces don't parse, the template stays as it is.
    """
    try:
        parts = list(Formatter().parse(template))
    except ValueError:
        return F.lit(template)
    if any(name is not None and name not in values for _, name, _, _ in parts):
        return F.lit(template)
    cols = []
    for literal, name, _, _ in parts:
        if literal:
            cols.append(F.lit(literal))
        if name is not None:
            cols.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*cols) if cols else F.lit("")


def parts_text(parts: Column) -> Column:
    """The texts of content parts (type, text, url), joined by a blank."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), " ")


def has_images(parts: Column) -> Column:
    return F.coalesce(F.exists(parts, lambda p: p["type"] == "image_url"), F.lit(False))


def user_parts(text: Column, images: Column) -> Column:
    """Content parts: images first, then the text."""
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), u.cast("string").alias("url"))
    return F.concat(F.transform(images, lambda u: part("image_url", F.lit(None), u)), F.array(part("text", text, F.lit(None))))


def numbered_examples(examples: Column, prefix: str = "Example") -> Column:
    return F.array_join(F.transform(examples, lambda x, i: F.concat(F.lit(prefix + " "), (i + 1).cast("string"), F.lit("\n"), x)), "\n\n")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def cut_at_word(text: Column, n: int) -> Column:
    """At most n characters, of a longer text up to its last blank there."""
    return F.when(F.length(text) > n, pystrip(F.regexp_replace(F.substring(text, 1, n), r" [^ ]*\z", ""))).otherwise(text)


def ratio(new: Column, old: Column) -> Column:
    return F.bround(new / F.nullif(old, F.lit(0)), 4)


def step_count(text: Column) -> Column:
    """Chunks between blank lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda x: F.length(pystrip(x)) > 0))


def language(text: Column) -> Column:
    """zh where there is a CJK ideograph, else en."""
    return F.when(text.rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")


def file_stem(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_-]", "_")


def is_image_reference(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(https?://|data:image/)"), F.lit(False))


def mime_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(ext.isin("jpg", "jpeg"), "image/jpeg")
    for e in ("webp", "gif", "bmp"):
        out = out.when(ext == e, f"image/{e}")
    return out.when(ext.isin("mp4", "webm"), F.concat(F.lit("video/"), ext)).when(ext == "mov", "video/quicktime").otherwise("image/png")


def solution_file(text: Column) -> Column:
    """The solution's file name in an answer: the trimmed text if it looks like one, else the first such name."""
    one = pystrip(F.regexp_replace(text, r"[\r\n]+", " "))
    found = F.nullif(F.regexp_extract(one, r"([\w.-]*solution[\w.-]*)", 1), F.lit(""))
    return F.when(one.rlike(r"^\S+$") & (one.contains(".json") | one.contains("solution")), one).otherwise(found)


def tool_reply(text: Column) -> tuple[Column, Column]:
    """A simulated tool's reply and whether it changes the world state."""
    return last_tag(text, "tool_response_start"), F.coalesce(F.contains(F.upper(last_tag(text, "new_bg_introduced")), F.lit("YES")), F.lit(False))


def trajectory_answer(messages: Column) -> Column:
    """The latest assistant message's tagged answer; else the last assistant message; else empty."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    tagged = F.filter(said, lambda m: m["content"].rlike("(?s)<answer>.*?</answer>"))
    return F.coalesce(first_tag(F.try_element_at(tagged, F.lit(-1))["content"], "answer"), F.try_element_at(said, F.lit(-1))["content"], F.lit(""))


def assistant_turns(messages: Column) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] == "assistant"))


def tool_steps(messages: Column) -> Column:
    """Per assistant message, one for each tool it names."""
    hit = lambda m, t: F.when(m["content"].contains(t), 1).otherwise(0)
    return F.aggregate(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0), lambda a, m: a + hit(m, "web_search") + hit(m, "web_browse"))


def trajectory_text(messages: Column, cap: int = 800, total: int = 15000, lines: int | None = None) -> Column:
    """A readable report of a trajectory: numbered messages, each cut to ``cap`` characters, all to ``total``."""
    short = lambda t: F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap), F.lit("..."))).otherwise(t)
    shown = F.transform(messages, lambda m, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.upper(m["role"]), F.lit(": "), short(m["content"])))
    whole = F.array_join(F.slice(shown, 1, lines) if lines else shown, "\n")
    return F.when(F.length(whole) > total, F.concat(F.substring(whole, 1, total), F.lit("\n[cut]"))).otherwise(whole)


def _cut(t: Column, n: int, mark: str = "... [truncated]") -> Column:
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(mark))).otherwise(t)


def judge_report(messages: Column, cap: int = 15000, total: int = 8000) -> Column:
    """A search rollout for its judge: assistant and user turns by number, tool responses cut to 500 characters, system messages left out."""

    def line(m: Column, i: Column) -> Column:
        c = _cut(F.coalesce(m["content"], F.lit("")), cap)
        reply = _cut(pystrip(F.replace(F.replace(c, F.lit("<tool_response>"), F.lit("")), F.lit("</tool_response>"), F.lit(""))), 500)
        turn = lambda who: F.concat(F.lit(f"### {who} (Turn "), i.cast("string"), F.lit("):\n"), c, F.lit("\n"))
        told = F.when(F.contains(c, F.lit("<tool_response>")), F.concat(F.lit("### Tool Response:\n"), reply, F.lit("\n"))).otherwise(turn("User"))
        return F.when(m["role"] == "assistant", turn("Assistant")).when(m["role"] == "user", told)

    whole = F.array_join(F.array_compact(F.transform(messages, line)), "\n")
    return F.when(F.coalesce(F.size(messages), F.lit(0)) < 1, "No trajectory available").otherwise(_cut(whole, total, "\n\n... [trajectory truncated for length]"))


def action_report(messages: Column, lines: int = 15) -> Column:
    """A search rollout for the strategist: its searches, pages and answer, a line each, at most ``lines``."""

    def steps(m: Column, i: Column) -> Column:
        upto = F.filter(F.slice(messages, 1, i + 1), lambda x: x["role"] == "assistant")
        number = lambda tool: F.size(F.filter(upto, lambda x: F.contains(x["content"], F.lit(tool)))).cast("string")
        c, said = m["content"], m["role"] == "assistant"
        query, url, answer = (_nth(c, p, 1, 1) for p in (r'"query":\s*"([^"]+)"', r'"url":\s*"([^"]+)"', r"(?s)<answer>(.*?)</answer>"))
        return F.array_compact(F.array(
            F.when(said & F.contains(c, F.lit("web_search")), F.concat(F.lit("[Search "), number("web_search"), F.lit("] Query: "), query)),
            F.when(said & F.contains(c, F.lit("web_browse")), F.concat(F.lit("[Browse "), number("web_browse"), F.lit("] URL: "), F.substring(url, 1, 50), F.lit("..."))),
            F.when(said, F.concat(F.lit("[Final Answer] "), F.substring(pystrip(answer), 1, 100))),
            F.when((m["role"] == "user") & F.contains(c, F.lit("<tool_response>")), F.lit(_GOT)),
        ))

    all_steps = F.flatten(F.transform(messages, steps))
    # responses count from the first step on
    first = F.array_position(F.transform(all_steps, lambda x: x != _GOT), True).cast("int")
    shown = F.slice(all_steps, F.greatest(first, F.lit(1)), lines)
    some = F.when(first > 0, F.array_join(shown, "\n")).otherwise("Solver trajectory is empty or unparseable")
    return F.when(F.coalesce(F.size(messages), F.lit(0)) < 1, "No solver trajectory available (first iteration)").otherwise(some)


_GOT = "  \u2514\u2500 Got response..."


def solution_report(messages: Column, solution_id: Column) -> Column:
    """A tool-use rollout for the rubrics' judge: its tools, and its turns cut to 800, 500 and 1000 characters."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    calls = F.flatten(F.transform(said, lambda m: F.split(m["content"], "<tool_call>", -1)))
    n_calls = F.size(calls) - F.size(said)
    names = F.array_compact(F.transform(F.flatten(F.transform(said, lambda m: all_tags(m["content"], "tool_call"))), lambda t: F.try_variant_get(F.try_parse_json(t), "$.name", "string")))

    def line(m: Column, i: Column) -> Column:
        c = F.coalesce(m["content"], F.lit(""))
        reason = pystrip(F.substring_index(c, "<tool_call>", 1))
        call = F.concat(F.lit("<tool_call>"), F.regexp_extract(c, r"(?s)<tool_call>(.*?</tool_call>)", 1))
        step = F.concat(F.lit("\n[Assistant-Step"), F.floor(i / 2).cast("string"), F.lit("]\nReasoning: "), F.substring(reason, 1, 800), F.lit("...\nTool Call: "), call, F.lit("\n"))
        block = lambda name, n: F.concat(F.lit(f"\n[{name}]\n"), F.substring(c, 1, n), F.lit("...\n"))
        heard = F.when(i == 1, block("User Request", 800)).when(F.contains(c, F.lit("tool_response")), block("Tool Response", 500))
        return F.when(m["role"] == "user", heard).when(m["role"] == "assistant", F.when(F.contains(c, F.lit("<tool_call>")), step).otherwise(block("Assistant-Final Answer", 1000)))

    head = F.concat(F.lit("### Solution: "), solution_id, F.lit("\n\n**Tool Call Count**: "), n_calls.cast("string"), F.lit("\n**Tools Used**: "), F.array_join(names, ", "), F.lit("\n\n**Trajectory Summary**:\n"))
    return F.concat(head, F.array_join(F.array_compact(F.transform(messages, line)), ""))


def total_length(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))


def same_answer(a: Column, b: Column) -> Column:
    """Either one contains the other, case folded and trimmed; never for empty ones."""
    x, y = F.lower(pystrip(a)), F.lower(pystrip(b))
    return F.coalesce((F.length(x) > 0) & (F.length(y) > 0) & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def reasoning_length(text: Column, tag: str = "thinking") -> Column:
    return F.coalesce(F.length(F.nullif(first_tag(text, tag), F.lit(""))), F.length(text))


def aspect_ratio(draft: Column) -> Column:
    """The aspect ratio in a draft's JSON, as w:h, if it is one."""
    found = F.get_json_object(F.regexp_extract(draft, r"(?s)(\{.*\})", 1), "$.aspect_ratio")
    return F.when(found.rlike(r"^\s*\d{1,2}\s*:\s*\d{1,2}\s*$"), F.regexp_replace(found, r"\s+", ""))
