"""Search and page reading over HTTP, and a cache of their results that all tasks share."""

from __future__ import annotations

import html
import re
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Any

from ..journal import FolderCache
from .agents import Caller, SearchTools
from .model import _post

_GONE = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->")


def page_text(raw: str) -> str:
    """What a page shows, without its tags, in lines."""
    bare = re.sub(r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n", _GONE.sub(" ", raw))
    lines = (re.sub(r"\s+", " ", t).strip() for t in html.unescape(re.sub(r"<[^>]*>", " ", bare)).splitlines())
    return "\n".join(t for t in lines if t)


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "...[TRUNCATED]"


def searcher(endpoint: str, key: str = "", cache: FolderCache | None = None, timeout: float = 30.0) -> Callable[[str, int], list[dict[str, Any]]]:
    """web_search by a service that takes a query and a number and gives results (title, url or link, snippet or content) as JSON."""

    def search(query: str, n: int) -> list[dict[str, Any]]:
        name = f"search::{query}::{n}"
        if cache and (held := cache.get(name)) is not None:
            return held
        got = _post(endpoint, {"query": query, "q": query, "num": n}, {"Authorization": f"Bearer {key}"} if key else {}, timeout)
        found = next((v for k in ("results", "organic", "data", "items") if isinstance(v := got.get(k), list)), []) if isinstance(got, dict) else got
        results = [{"title": r.get("title") or "", "url": r.get("url") or r.get("link") or "", "snippet": r.get("snippet") or r.get("content") or ""} for r in found if isinstance(r, dict)][:n]
        if cache and results:
            cache.set(name, results)
        return results

    return search


def browser(max_chars: int = 4000, cache: FolderCache | None = None, timeout: float = 30.0) -> Callable[[str], str]:
    """web_browse: a page's text, cut to ``max_chars``; only web addresses are opened."""

    def browse(url: str) -> str:
        if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
            raise ValueError(f"{url} is no web address")
        name = f"browse::{url}::{max_chars}"
        if cache and (held := cache.get(name)) is not None:
            return held
        request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; reader)"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            raw = r.read(4 << 20).decode(r.headers.get_content_charset() or "utf-8", "replace")
            shown = page_text(raw) if "html" in (r.headers.get("Content-Type") or "html") else raw
        text = cut(shown, max_chars)
        if cache and text:
            cache.set(name, text)
        return text

    return browse


def web_tools(endpoint: str, key: str = "", folder: str | None = None, max_results: int = 5, max_chars: int = 4000) -> Callable[[Caller], SearchTools]:
    """Tools for rollouts that search and read the web, for ``agents.search_rollouts``; made anew for each rollout, with one cache."""

    def make(call: Caller) -> SearchTools:
        cache = FolderCache(folder) if folder else None
        return SearchTools(call, searcher(endpoint, key, cache), browser(max_chars, cache), max_results, max_chars + 20)

    return make
