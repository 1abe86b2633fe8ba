"""Model calls: one physical operator, a small backend contract, fakes, and a chat connector.

Requests are built and answers parsed by column expressions; only the call
itself runs in Python, over Arrow batches, with a few threads a partition.
A backend is made once a partition from a factory that is shipped, never the
client. Calls aren't idempotent, so their result is checkpointed at once, and
speculation must be off; filters and deduplication belong before the call.
"""

from __future__ import annotations

import base64
import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import checkpointed
from ..journal import FolderCache


@dataclass
class Request:
    """One call: messages of role and content (text or parts), and options."""

    messages: list[dict[str, Any]]
    id: str = ""
    index: int = 0
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def user(self) -> str:
        last = self.messages[-1]["content"] if self.messages else ""
        return last if isinstance(last, str) else " ".join(p.get("text") or "" for p in last if p.get("type") == "text")

    @property
    def system(self) -> str:
        return next((m["content"] for m in self.messages if m["role"] == "system" and isinstance(m["content"], str)), "")


@dataclass
class Answer:
    """A call's result: text, or URLs of media, with token counts where known."""

    text: str = ""
    urls: list[str] = field(default_factory=list)
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    model: str | None = None


class Backend(Protocol):
    """What a model service must do; ``generate`` gives text or media URLs."""

    def generate(self, request: Request) -> Answer: ...

    def healthy(self) -> bool: ...

    def close(self) -> None: ...


class Transient(Exception):
    """A failure that is worth another try."""


class FakeBackend:
    """Answers from a template of {user}, {id} and {index}, or from a function of the request. The same request always gets the same answer."""

    def __init__(self, template: str | Callable[[Request], str] = "Answer: {user}", fail: Callable[[Request, int], bool] | None = None):
        self.template, self.fail, self.tries = template, fail, {}

    def generate(self, request: Request) -> Answer:
        n = self.tries[request.id] = self.tries.get(request.id, 0) + 1
        if self.fail and self.fail(request, n):
            raise Transient(f"fake failure of {request.id}")
        if callable(self.template):
            out = self.template(request)
            if isinstance(out, Answer):
                return out
        else:
            out = self.template.replace("{user}", request.user).replace("{id}", request.id).replace("{index}", str(request.index))
        return Answer(out, prompt_tokens=10, completion_tokens=10, model="fake")

    def healthy(self) -> bool:
        return True

    def close(self) -> None:
        pass


class FakeMediaBackend(FakeBackend):
    """Gives ``n`` made-up URLs."""

    def generate(self, request: Request) -> Answer:
        return Answer(urls=[f"https://media.example/{request.id}/{k}.{request.options.get('suffix', 'png')}" for k in range(int(request.options.get("n", 1)))], model="fake")


def _post(url: str, body: dict | None, headers: dict[str, str], timeout: float) -> Any:
    """A JSON call; busy and failing servers are transient."""
    data = None if body is None else json.dumps(body).encode()
    req = urllib.request.Request(url, data, {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return json.loads(r.read().decode())
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise Transient(f"{url}: HTTP {e.code}") from e
        raise
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Transient(f"{url}: {e}") from e


class ChatBackend:
    """Any service with the common chat completions protocol. ``ping`` says how health is checked: models, call, either (the first, else the second) or key."""

    def __init__(self, url: str, key: str = "", model: str = "", timeout: float = 120.0, ping: str = "models", **options: Any):
        base = url.rstrip("/")
        self.url = base if base.endswith("/v1") else base + "/v1"
        self.key, self.model, self.timeout, self.ping, self.options = key, model, timeout, ping, {"temperature": 0.7, "max_tokens": 2048} | options

    @property
    def _headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key}"} if self.key else {}

    def generate(self, request: Request) -> Answer:
        model = request.options.get("model") or self.model or self._first_model()
        options = self.options | {k: v for k, v in request.options.items() if k not in ("model", "n", "suffix")}
        got = _post(f"{self.url}/chat/completions", {"model": model, "messages": request.messages} | options, self._headers, self.timeout)
        choices, usage = got.get("choices") or [], got.get("usage") or {}
        return Answer((choices[0].get("message") or {}).get("content") or "" if choices else "", prompt_tokens=usage.get("prompt_tokens"), completion_tokens=usage.get("completion_tokens"), model=model)

    def _first_model(self) -> str:
        names = [m["id"] for m in _post(f"{self.url}/models", None, self._headers, self.timeout).get("data", [])]
        if not names:
            raise ValueError(f"{self.url} lists no model, and none is set")
        self.model = names[0]
        return self.model

    def healthy(self) -> bool:
        try:
            if self.ping == "key":
                return bool(self.key)
            if self.ping != "call":
                try:
                    return bool(_post(f"{self.url}/models", None, self._headers, self.timeout))
                except Exception:
                    if self.ping != "either":
                        return False
            return bool(self.generate(Request([{"role": "user", "content": "hi"}], options={"max_tokens": 1})))
        except Exception:
            return False

    def close(self) -> None:
        pass


class TaskBackend:
    """Media services that take a task and are polled until it is done, or answer at once.

    ``submit`` and ``status`` are paths, the latter with {task}. An expired wait is no transient failure: the paid task
    isn't submitted again. A request's first frame goes where ``frame`` says (a field, or ``media`` for a list of typed
    media), and then its size, resolution and ratio stay away, as they follow the frame; without one, a size only goes
    where neither resolution nor ratio is given. Results are URLs; inline bytes become data URLs, or files below
    ``folder``; with ``download`` the URLs' contents do, too.
    """

    def __init__(
        self, url: str, key: str = "", model: str = "", submit: str = "/tasks", status: str = "/tasks/{task}", poll: float = 2.0, wait: float = 300.0, folder: str | None = None, timeout: float = 120.0, frame: str = "img_url",
        download: bool = False, suffix: str = "png", **options: Any,
    ):
        self.url, self.key, self.model, self.submit, self.status = url.rstrip("/"), key, model, submit, status
        self.poll, self.wait, self.folder, self.timeout, self.options = poll, wait, folder, timeout, options
        self.frame, self.download, self.suffix = frame, download, suffix
        if download and not folder:
            raise ValueError("downloads need a folder")

    def body(self, request: Request) -> dict[str, Any]:
        given = {k: v for k, v in (self.options | request.options).items() if k not in ("model", "first_frame_image", "suffix") and v not in (None, "")}
        inputs: dict[str, Any] = {"prompt": request.user}
        if first := request.options.get("first_frame_image"):
            inputs |= {"media": [{"type": "first_frame", "url": first}]} if self.frame == "media" else {self.frame: first}
            given = {k: v for k, v in given.items() if k not in ("size", "resolution", "ratio")}
        elif "resolution" in given or "ratio" in given:
            given.pop("size", None)
        return {"model": request.options.get("model") or self.model, "input": inputs, "parameters": given}

    def generate(self, request: Request) -> Answer:
        headers = {"X-Async": "enable"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        got, until = _post(self.url + self.submit, self.body(request), headers, self.timeout), time.monotonic() + self.wait
        task = self._find(got, "task_id")
        while not (urls := self._urls(got, request.id)):
            state = str(self._find(got, "task_status") or self._find(got, "status") or "").upper()
            if state in ("FAILED", "CANCELED", "ERROR") or not task:
                raise ValueError(f"media task of {request.id} failed: {state or 'no result'}")
            if time.monotonic() > until:
                raise ValueError(f"media task {task} isn't done after {self.wait} s")
            time.sleep(self.poll)
            try:
                got = _post(self.url + self.status.replace("{task}", task), None, headers, self.timeout)
            except Transient:
                continue
        if self.download:
            urls = [self._fetch(u, f"{request.id}-{k}") if u.startswith("http") else u for k, u in enumerate(urls)]
        return Answer(urls=urls, model=self.model)

    @classmethod
    def _find(cls, value: Any, key: str) -> Any:
        if isinstance(value, dict):
            return value.get(key) or next((f for v in value.values() if (f := cls._find(v, key))), None)
        return next((f for v in value if (f := cls._find(v, key))), None) if isinstance(value, list) else None

    def _urls(self, value: Any, ident: str) -> list[str]:
        out: list[str] = []
        if isinstance(value, dict):
            for k, v in value.items():
                if k in ("url", "video_url", "image_url") and isinstance(v, str):
                    out.append(v)
                elif k == "b64_json" and isinstance(v, str):
                    out.append(self._keep(base64.b64decode(v), f"{ident}-{len(out)}"))
                else:
                    out += self._urls(v, ident)
        elif isinstance(value, list):
            for n, v in enumerate(value):
                out += self._urls(v, f"{ident}-{n}")
        return out

    def _fetch(self, url: str, name: str) -> str:
        try:
            with urllib.request.urlopen(url, timeout=self.timeout) as r:
                return self._keep(r.read(), name)
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            return url  # the result is there, and paid; only its copy isn't

    def _keep(self, data: bytes, name: str) -> str:
        if not self.folder:
            return f"data:image/png;base64,{base64.b64encode(data).decode()}"
        path = Path(self.folder) / f"{re.sub('[^a-zA-Z0-9_-]', '_', name)}.{self.suffix}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        return str(path)

    def healthy(self) -> bool:
        return bool(self.url)

    def close(self) -> None:
        pass


Factory = Callable[[], Backend]
_KINDS: dict[str, tuple[Callable[..., Backend], dict[str, Any]]] = {
    "fake": (FakeBackend, {}),
    "fake_media": (FakeMediaBackend, {}),
    "chat": (ChatBackend, {}),  # health by the list of models
    "chat_endpoint": (ChatBackend, {"ping": "either"}),  # by that list, else by a call
    "chat_token": (ChatBackend, {"ping": "key"}),  # by having a key
    "image_task": (TaskBackend, {"poll": 2.0, "wait": 300.0}),
    "image_direct": (TaskBackend, {"submit": "/images/generations", "status": "/tasks/{task}", "poll": 2.0, "wait": 300.0}),
    "diffusion": (TaskBackend, {"poll": 5.0, "wait": 300.0}),
    "video_task": (TaskBackend, {"poll": 5.0, "wait": 1800.0, "frame": "media", "suffix": "mp4"}),
    "video_direct": (TaskBackend, {"submit": "/videos/generations", "poll": 10.0, "wait": 1800.0, "suffix": "mp4"}),
    "task": (TaskBackend, {}),
}
#: Settings that a service without them takes from the environment.
_ENV = {"url": "MODEL_BASE_URL", "key": "MODEL_API_KEY", "model": "MODEL_NAME"}
_BOUNDS = {"timeout": (0, 3600), "poll": (0, 600), "wait": (0, 86400), "temperature": (-1e-9, 5), "max_tokens": (0, 1 << 20)}


def number(config: dict[str, Any], name: str, default: float | None = None, low: float | None = None, high: float | None = None) -> float | None:
    """A setting as a number (what is missing or null is the default); raises for other values, and out of bounds."""
    v = config.get(name)
    if v is None:
        return default
    try:
        v = float(v) if not isinstance(v, bool) else float("nan")
    except (TypeError, ValueError):
        v = float("nan")
    if v != v or low is not None and v <= low or high is not None and v > high:
        raise ValueError(f"{name} must be a number" + (f" above {low:g}" if low is not None else "") + (f" and at most {high:g}" if high is not None else ""))
    return int(v) if v == int(v) and not isinstance(config[name], float) else v


def backend_factory(config: dict[str, Any], env: dict[str, str] | None = None) -> Factory:
    """From settings (``type`` and that type's arguments) to a factory that can be shipped; URL, key and model may come from the environment."""
    kind = config.get("type", "chat")
    if kind not in _KINDS:
        raise ValueError(f"backend type {kind} is none of {', '.join(_KINDS)}")
    make, preset = _KINDS[kind]
    options = preset | {k: v for k, v in config.items() if k != "type" and v is not None}
    for name, (low, high) in _BOUNDS.items():
        if name in options:
            options[name] = number(options, name, low=low, high=high)
    if make in (ChatBackend, TaskBackend):
        env = dict(os.environ) if env is None else env
        options |= {k: env[v] for k, v in _ENV.items() if not options.get(k) and env.get(v)}
        if not options.get("url"):
            raise ValueError(f"a backend of type {kind} needs a url, or {_ENV['url']} in the environment")
    return lambda: make(**options)


def check_health(makes: dict[str, Factory]) -> dict[str, bool]:
    """Whether each service answers; services are closed again."""
    out = {}
    for name, make in makes.items():
        backend = make()
        try:
            out[name] = bool(backend.healthy())
        finally:
            backend.close()
    return out


def with_retries(call: Callable[[], Answer], retries: int = 3, base: float = 1.0, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The call, tried again after transient failures with growing, jittered waits."""
    for n in range(retries + 1):
        try:
            return call()
        except Transient:
            if n == retries:
                raise
            sleep(min(base * 2**n * (0.5 + random.random()), cap))
    raise AssertionError


def _messages(raw: str | None) -> list[dict[str, Any]]:
    out = json.loads(raw) if raw else []
    for m in out:
        c = m.get("content")
        if isinstance(c, str) and c.startswith('[{"type":'):
            try:
                m["content"] = [{"type": p["type"], "text": p.get("text")} if p["type"] == "text" else {"type": p["type"], p["type"]: {"url": p.get("url")}} for p in json.loads(c)]
            except (ValueError, KeyError):
                pass
    return out


#: The setting that names a shared folder in which finished calls are kept one by one.
JOURNAL = "spark.graingrid.journal.dir"


def call_model(
    df: DataFrame, make: Factory, messages: Column, ident: Column | None = None, index: Column | None = None, options: dict[str, Any] | Column | None = None, workers: int = 1, retries: int = 3, base: float = 1.0, keep: bool = True,
    journal: str | None = None,
) -> DataFrame:
    """The frame with ``response``, ``urls``, ``prompt_tokens``, ``completion_tokens``, ``model`` and ``error``.

    ``messages`` is an array of (role, content). A failed call leaves nulls and its error, and the row stays, for the
    caller to drop. ``keep`` checkpoints the result so that no later action calls again. With a ``journal`` folder (or the
    session's, see ``JOURNAL``) each finished call is kept at once, so that a task that is lost and run again, or a job that is
    started again, makes only the calls that weren't finished.
    """
    journal = journal or df.sparkSession.conf.get(JOURNAL, None)
    new = ["response", "urls", "prompt_tokens", "completion_tokens", "model", "error"]
    rows = df.drop(*new)
    opts = options if isinstance(options, Column) else F.lit(json.dumps(options or {}))
    rows = rows.withColumns({"__messages": F.to_json(messages), "__id": (ident if ident is not None else F.lit("")).cast("string"), "__index": (index if index is not None else F.lit(0)).cast("int"), "__options": opts})
    types = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        done = FolderCache(journal) if journal else None

        def one(args: tuple) -> tuple:
            raw, rid, k, o = args
            key = json.dumps([raw, rid, k, o])
            if done and (held := done.get(key)):
                return (*held, None)
            try:
                a = with_retries(lambda: backend.generate(Request(_messages(raw), rid or "", k or 0, json.loads(o or "{}"))), retries, base)
                if done:
                    done.set(key, [a.text, a.urls, a.prompt_tokens, a.completion_tokens, a.model])
                return a.text, a.urls, a.prompt_tokens, a.completion_tokens, a.model, None
            except Exception as e:  # a failed call is a result, too
                return None, None, None, None, None, f"{type(e).__name__}: {e}"

        try:
            with ThreadPoolExecutor(max(1, workers)) as pool:
                for b in batches:
                    n = b.num_columns - 4
                    got = list(pool.map(one, zip(*(c.to_pylist() for c in b.columns[n:]))))
                    cols = [pa.array(c, t) for c, t in zip(zip(*got), types)] if got else [pa.array([], t) for t in types]
                    yield pa.RecordBatch.from_arrays([*b.columns[:n], *cols], [*b.schema.names[:n], *new])
        finally:
            backend.close()

    schema = rows.drop("__messages", "__id", "__index", "__options").schema
    for name, kind in zip(new, (T.StringType(), T.ArrayType(T.StringType()), T.LongType(), T.LongType(), T.StringType(), T.StringType())):
        schema = schema.add(name, kind)
    out = rows.mapInArrow(run, schema)
    return checkpointed(out) if keep else out
