"""Services against a small HTTP server of our own; web tools and their cache; counts."""

import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from graingrid.operators import counts, joins, model, web
from graingrid.operators.agents import Caller, SearchTools
from graingrid.operators.model import ChatBackend, FakeBackend, Request, TaskBackend, Transient, backend_factory, with_retries


class Server(BaseHTTPRequestHandler):
    seen: list = []
    polls: dict = {}

    def answer(self, value, code=200, kind="application/json"):
        data = value if isinstance(value, bytes) else json.dumps(value).encode()
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if self.path.endswith("/models"):
            return self.answer({"data": [{"id": "first"}, {"id": "second"}]}) if "nolist" not in self.path else self.answer({}, 404)
        if "/tasks/" in self.path:
            task = self.path.rsplit("/", 1)[1]
            n = self.polls[task] = self.polls.get(task, 0) + 1
            if task == "flaky" and n == 1:
                return self.answer({}, 503)
            if task == "bad":
                return self.answer({"output": {"task_status": "FAILED"}})
            return self.answer({"output": {"task_status": "SUCCEEDED", "results": [{"url": f"http://{self.headers['Host']}/file/{task}"}]}} if n > 1 else {"output": {"task_status": "RUNNING"}})
        if self.path.startswith("/file/"):
            return self.answer(b"bytes of " + self.path[6:].encode(), kind="video/mp4")
        return self.answer(b"<html><script>no</script><h1>Head</h1><p>One &amp; two</p><p>three</p></html>", kind="text/html; charset=utf-8")

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.seen.append((self.path, body, self.headers.get("Authorization")))
        text = json.dumps(body)
        if "busy" in text:
            return self.answer({}, 429)
        if "wrong" in text:
            return self.answer({}, 400)
        if self.path.endswith("/chat/completions"):
            return self.answer({"choices": [] if "nothing" in text else [{"message": {"content": f"by {body['model']}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}})
        if self.path == "/search":
            return self.answer({"organic": [{"title": "t", "link": "https://l", "content": "c"}] * 9})
        prompt = body["input"]["prompt"]
        if prompt == "now":
            return self.answer({"data": [{"b64_json": "QUJD"}, {"url": "http://u/1"}]})
        return self.answer({"output": {"task_id": prompt, "task_status": "PENDING"}})

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ask(text, **options):
    return Request([{"role": "system", "content": "s"}, {"role": "user", "content": text}], "r/1", 0, options)


def test_chat(url):
    got = ChatBackend(url, "k").generate(ask("hi", max_tokens=5))
    assert (got.text, got.prompt_tokens, got.completion_tokens, got.model) == ("by first", 3, 4, "first")
    path, body, auth = Server.seen[-1]
    assert path == "/v1/chat/completions" and body["max_tokens"] == 5 and body["temperature"] == 0.7 and auth == "Bearer k" and body["messages"][0]["role"] == "system"
    assert ChatBackend(url + "/v1/", model="mine").generate(ask("nothing")).text == "" and ChatBackend(url, model="mine").generate(ask("x", model="other")).text == "by other"
    with pytest.raises(Transient):
        ChatBackend(url).generate(ask("busy"))
    with pytest.raises(Exception) as e:
        ChatBackend(url).generate(ask("wrong"))
    assert not isinstance(e.value, Transient)
    assert ChatBackend(url).healthy() and not ChatBackend("http://127.0.0.1:1").healthy() and not ChatBackend(url + "/nolist").healthy()
    assert ChatBackend(url + "/nolist", model="m", ping="either").healthy() and ChatBackend(url, ping="key", key="k").healthy() and not ChatBackend(url, ping="key").healthy()
    assert model.check_health({"a": lambda: ChatBackend(url), "b": lambda: ChatBackend("http://127.0.0.1:1")}) == {"a": True, "b": False}


def test_media_tasks(url, tmp_path):
    go = lambda text, **o: TaskBackend(url, poll=0.01, **o).generate(ask(text))
    assert go("cat").urls == [f"{url}/file/cat"] and go("flaky").urls == [f"{url}/file/flaky"]
    with pytest.raises(ValueError, match="FAILED"):
        go("bad")
    with pytest.raises(ValueError, match="isn't done"):
        TaskBackend(url, poll=0.01, wait=-1).generate(ask("slow"))
    assert go("now").urls == ["data:image/png;base64,QUJD", "http://u/1"]
    kept = go("now", folder=str(tmp_path)).urls[0]
    assert open(kept, "rb").read() == b"ABC"
    kept = go("dog", folder=str(tmp_path), download=True, suffix="mp4").urls[0]
    assert kept.endswith(".mp4") and open(kept, "rb").read() == b"bytes of dog"
    with pytest.raises(ValueError):
        TaskBackend(url, download=True)


def test_first_frames_go_before_sizes():
    body = lambda b, **o: (lambda x: (x["input"], x["parameters"]))(b.body(ask("p", **o)))
    assert body(TaskBackend("u", size="1x1"), resolution="720p", ratio="16:9") == ({"prompt": "p"}, {"resolution": "720p", "ratio": "16:9"})
    assert body(TaskBackend("u", size="1x1"), resolution="") == ({"prompt": "p"}, {"size": "1x1"})
    assert body(TaskBackend("u", size="1x1", seed=3), first_frame_image="f", ratio="1:1") == ({"prompt": "p", "img_url": "f"}, {"seed": 3})
    assert body(TaskBackend("u", frame="media"), first_frame_image="f")[0]["media"] == [{"type": "first_frame", "url": "f"}]


def test_settings_of_backends():
    env = {"MODEL_BASE_URL": "http://e", "MODEL_API_KEY": "k", "MODEL_NAME": "m"}
    b = backend_factory({"type": "chat_token", "model": "own", "timeout": "5"}, env)()
    assert (b.url, b.key, b.model, b.timeout, b.ping) == ("http://e/v1", "k", "own", 5, "key")
    v = backend_factory({"type": "video_task", "url": "http://v", "wait": None}, {})()
    assert (v.wait, v.poll, v.frame) == (1800.0, 5.0, "media")
    for bad in ({"type": "nothing"}, {"type": "chat"}, {"url": "x", "timeout": 0}, {"url": "x", "timeout": "soon"}, {"url": "x", "max_tokens": True}, {"url": "x", "temperature": 9}):
        with pytest.raises(ValueError):
            backend_factory(bad, {})
    assert model.number({}, "n", 4) == 4 and model.number({"n": "7"}, "n") == 7 and model.number({"n": 0.5}, "n", low=0, high=1) == 0.5


def test_waits_grow_and_end():
    waits, tries = [], []

    def call():
        tries.append(1)
        raise Transient("x")

    with pytest.raises(Transient):
        with_retries(call, 4, base=2.0, cap=10.0, sleep=waits.append)
    assert len(tries) == 5 and len(waits) == 4
    assert all(min(10, 2 * 2**n * 0.5) <= w <= min(10, 2 * 2**n * 1.5) for n, w in enumerate(waits))
    with pytest.raises(ValueError):
        with_retries(lambda: (_ for _ in ()).throw(ValueError()), 4, sleep=waits.append)
    assert len(waits) == 4


def test_web_tools(url, tmp_path):
    cache = web.FolderCache(str(tmp_path / "c"))
    search, browse = web.searcher(f"{url}/search", "k", cache), web.browser(12, cache)
    assert search("q", 2) == [{"title": "t", "url": "https://l", "snippet": "c"}] * 2
    n = len(Server.seen)
    assert search("q", 2) == search("q", 2) and len(Server.seen) == n and len(search("q", 3)) == 3 and len(Server.seen) == n + 1
    assert browse(f"{url}/page") == "Head\nOne & t...[TRUNCATED]"
    assert web.FolderCache(str(tmp_path / "c")).get(f"browse::{url}/page::12") == "Head\nOne & t...[TRUNCATED]"
    tools = web.web_tools(f"{url}/search", folder=str(tmp_path / "d"))(Caller(FakeBackend()))
    assert len(json.loads(tools.run("web_search", {"query": "z"}))["results"]) == 5 and tools.run("web_browse", {"url": f"{url}/page"}).startswith("Head")
    assert tools.run("web_browse", {"url": "file:///etc/passwd"}).startswith("Error") and tools.run("other", {}).startswith("Error") and tools.run("web_search", {}).startswith("Error")


def test_simulated_tools_know_what_was_found():
    said = []

    def answer(r):
        said.append(r.user)
        return '{"results": [{"title": "t", "url": "u", "snippet": "known"}]}' if "search engine" in r.user else "p" * 5000

    tools = SearchTools(Caller(FakeBackend(answer)))
    tools.run("web_search", {"query": "q"})
    page = tools.run("web_browse", {"url": "u"})
    assert "known" in said[-1] and page.endswith("...[TRUNCATED]") and len(page) == 4014


def test_cache_computes_a_key_once(spark):
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "key string, n int")
    cache = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("z", "zz", 3)], "key string, value string, _pos long")
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.select("key", F.concat(F.lit("got "), "key").alias("value"))

    out, fresh = joins.through_cache(asked, cache, compute)
    assert sorted(map(tuple, out.collect())) == [("a", "new"), ("b", "got b"), ("b", "got b"), ("c", "got c")]
    assert sorted(r.key for r in fresh.collect()) == ["b", "c"] and calls == [2]


def test_counts_and_the_alarm(spark):
    for bound, level in ((10, logging.NOTSET), (6, logging.WARNING), (4, logging.ERROR)):
        c = counts.Counted("test")
        assert c.keep(spark.range(10), F.when(F.col("id") < bound, True)).count() == bound
        assert (c.rows, c.kept, c.skipped, c.report()) == (10, bound, 10 - bound, level)
    assert counts.duplicates(10, 7) == 3


def test_finished_calls_are_kept(spark, tmp_path):
    log = tmp_path / "log"

    def answer(r):
        with open(log, "a") as f:
            f.write(r.id + "\n")
        if r.id == "3" and not (tmp_path / "up").exists():
            raise ValueError("down")
        return f"got {r.user}"

    rows = spark.range(6).select(F.col("id"), F.concat(F.lit("q"), "id").alias("q"))
    words = F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content")))
    go = lambda: {r.id: r.response for r in model.call_model(rows, lambda: FakeBackend(answer), words, F.col("id"), journal=str(tmp_path / "j")).collect()}
    assert go() == {k: None if k == 3 else f"got q{k}" for k in range(6)} and len(log.read_text().split()) == 6
    (tmp_path / "up").write_text("")
    log.write_text("")
    assert go() == {k: f"got q{k}" for k in range(6)} and log.read_text().split() == ["3"]
