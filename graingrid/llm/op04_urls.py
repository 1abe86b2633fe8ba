"""URL filter: host word segmentation and naive Bayes.

Host names run words together. Each run of letters in a host is split by
unigram Viterbi: a word costs -log of its share among all words of all pages'
texts (and a few of ``lexicon``), an unknown one as much as its length makes
it unlikely (10 / (N * 10**length)). Multinomial naive Bayes then scores the
segmented host words and the path's words.

It learns from labels of pages (page_id, label: 1 unwanted, 0 wanted; of a page
labelled twice the larger). ``weak_labels`` makes such a table of what the
labelled documents teach about texts: a page is unwanted if its visible text is
more likely toxic or of low quality than not. Words of ``seeds`` are held to be
``seed_weight`` times as likely in unwanted pages beforehand, a prior that
labels can outweigh. Classes count tokens over all labelled pages; every page
is scored.

The vocabulary is counted by a shuffle, and of it only what occurs inside a
host name is joined, by hash, to the substrings of the distinct names (63
letters at most, as in a name of a host). Tokens' odds are broadcast below a
checked size, and joined beyond it.

Defined results: hosts are folded to lower case, user info and port left out;
null or relative URLs, and URLs without letters, have no tokens, score only the prior and aren't
flagged; of equally likely splits the one with the longer last word counts;
repeated pages each count and are each scored alike; labels of null or unknown
pages are ignored, and without any label the seeds alone decide; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import op07_mixing
from .durable import BROADCAST_BYTES, checkpointed, small
from .textcore import Words, as_longs, blocks, flat, spans_hash, word_hash

SEEDS = tuple("adult porn sex xxx escort escorts hentai nude casino casinos bet bets betting poker slots jackpot lottery pills viagra cialis pharma pharmacy spam warez keygen torrent torrents malware phishing replica loan loans payday".split())
#: Ordinary words that go with them; known to the segmenter even if the pages' texts lack them.
COMMON = tuple("cheap free best online shop store buy sale deal deals news blog farm site web world live video games play win home get top my the for and".split())
MAX_WORD, SEED_COUNT, SEED_WEIGHT = 63, 50, 20


def _visible(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bytes with tags blanked."""
    at = np.arange(len(data))
    opened = np.maximum.accumulate(np.where(data == 60, at, -1)) if len(data) else at
    closed = np.where(data == 62, at, -1)
    first = off[:-1][off[:-1] < len(data)]
    closed[first] = np.where(data[first] == 60, first - 1, first)
    closed = np.maximum.accumulate(closed) if len(data) else closed
    return np.where((opened > closed) | (data == 62), 32, data).astype(np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in blocks(*flat(batch.column(0))):
            w = Words(_visible(data, off), off)
            h, n = np.unique(w.hash[w.end - w.start <= MAX_WORD], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_longs(h)), pa.array(n.astype(np.int64))], ["h", "n"])


def vocabulary(pages: DataFrame, html_col: str = "html", seeds: tuple[str, ...] = SEEDS, lexicon: tuple[str, ...] = COMMON) -> DataFrame:
    """h, n: hashes of words and how often all pages' texts have them, reliably stored."""
    counted = pages.select(F.col(html_col).cast("string").alias("t")).mapInArrow(_count, "h long, n long")
    known = [(int(np.uint64(word_hash(w)).astype(np.int64)), SEED_COUNT) for w in dict.fromkeys((*seeds, *lexicon))]
    return checkpointed(counted.union(pages.sparkSession.createDataFrame(known, "h long, n long")).groupBy("h").agg(F.sum("n").alias("n")))


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in blocks(*flat(batch.column(0)), size=1 << 14):
            size = np.diff(off)
            start = np.arange(len(data))
            stop = np.repeat(off[1:], size)
            a = np.concatenate([start[start + k <= stop] for k in range(1, MAX_WORD + 1)])
            b = np.concatenate([start[start + k <= stop] + k for k in range(1, MAX_WORD + 1)])
            row = np.searchsorted(off, a, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array((a - off[row]).astype(np.int32)), pa.array((b - off[row]).astype(np.int32)), pa.array(as_longs(spans_hash(data, a, b)))], ["name", "a", "b", "h"])


def viterbi(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most likely words of a name, from the counts of its known substrings; linear in the name's length."""
    log_n, step = float(np.log(max(total, 2))), 2.302585092994046
    ends: dict[int, list[tuple[int, float]]] = {}
    for (a, b), n in sorted(known.items()):
        ends.setdefault(b, []).append((a, float(np.log(n)) - log_n))
    best, back = [0.0] + [-np.inf] * len(name), [0] * (len(name) + 1)
    # the best begin of an unknown word doesn't depend on where it ends
    top, top_at = -np.inf, 0
    for b in range(1, len(name) + 1):
        if best[b - 1] + step * (b - 1) > top + 1e-12:
            top, top_at = best[b - 1] + step * (b - 1), b - 1
        best[b], back[b] = top + step * (1 - b) - log_n, top_at
        for a, p in ends.get(b, ()):
            p += best[a]
            if p > best[b] + 1e-12 or p > best[b] - 1e-12 and a < back[b]:
                best[b], back[b] = p, a
    out, b = [], len(name)
    while b:
        out.append(name[back[b] : b])
        b = back[b]
    return out[::-1]


def _split(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [viterbi(r["name"], {(k["a"], k["b"]): k["n"] for k in r["known"]}, total) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return run


def segment(names: DataFrame, words: DataFrame) -> DataFrame:
    """name and its words, for a frame of distinct names of letters a-z and the vocabulary."""
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = names.mapInArrow(_substrings, "name string, a int, b int, h long")
    found = parts.join(words, "h").groupBy("name").agg(F.collect_list(F.struct("a", "b", "n")).alias("known"))
    none = F.array().cast("array<struct<a:int,b:int,n:bigint>>")
    return names.join(found, "name", "left").select("name", F.coalesce("known", none).alias("known")).mapInArrow(_split(total), "name string, words array<string>")


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def weak_labels(pages: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and label of the pages with words: 1 where the text is more likely toxic or of low quality, as labelled documents have it."""
    sent = pages.sparkSession.sparkContext.broadcast(op07_mixing.train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in blocks(*flat(batch.column(1))):
                p, n = sent.value.posteriors(_visible(data, off), off)
                label = (p[:, op07_mixing.DOMAINS.index("high")] < 0.5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(label)], ["page_id", "label"]).filter(pa.array(n > 0))

    return pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("t")).mapInArrow(run, "page_id long, label int")


def score(
    pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seeds: tuple[str, ...] = SEEDS, seed_weight: int = SEED_WEIGHT,
    lexicon: tuple[str, ...] = COMMON, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """page_id, url, host_words, score (log odds of being unwanted) and flagged (score > 0), a row for each page."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    words = vocabulary(pages, "html", seeds, lexicon)
    urls = pages.where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    path = F.lower(F.regexp_replace("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""))
    runs = lambda c: F.filter(F.split(c, "[^a-z]+"), lambda x: x != "")
    parsed = checkpointed(urls.select("url", runs(host).alias("names"), runs(path).alias("paths")))
    split = checkpointed(segment(parsed.select(F.explode("names").alias("name")).distinct(), words))
    # host words in order: place of the name, then of the word in it
    named = parsed.select("url", F.posexplode("names").alias("place", "name")).join(F.broadcast(split) if small(split, 200, broadcast_bytes) else split, "name")
    hosts = named.groupBy("url").agg(F.expr("flatten(transform(sort_array(collect_list(struct(place, words))), x -> x.words))").alias("host_words"))
    none = F.array().cast("array<string>")
    tokens = checkpointed(parsed.join(hosts, "url", "left").select("url", F.coalesce("host_words", none).alias("host_words"), F.concat(F.coalesce("host_words", none), "paths").alias("tokens")))
    # labelled pages by URL and class
    if labelled is None:
        labelled = spark.createDataFrame([], "page_id long, label int")
    told = labelled.where("page_id is not null and label is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("label").alias("label"))
    marks = pages.where("url is not null").select("page_id", "url").join(told, "page_id").groupBy("url").agg(F.count_if(F.col("label") > 0).alias("n1"), F.count_if(F.col("label") <= 0).alias("n0"))
    marks = checkpointed(marks)
    each = tokens.join(marks, "url").select("n1", "n0", F.explode("tokens").alias("token"))
    known = spark.createDataFrame([(w, 0, 0) for w in dict.fromkeys(seeds)], "token string, n1 long, n0 long")
    counts = checkpointed(each.select("token", "n1", "n0").union(known).groupBy("token").agg(F.sum("n1").alias("c1"), F.sum("n0").alias("c0")))
    t = counts.agg(F.sum("c1"), F.sum("c0"), F.count("*")).first()
    t1, t0, v = (x or 0 for x in t)
    d = marks.agg(F.sum("n1"), F.sum("n0")).first()
    prior = float(np.log((d[0] or 0) + 1) - np.log((d[1] or 0) + 1))
    before = F.when(F.col("token").isin(list(seeds)), float(np.log(seed_weight))).otherwise(0.0)
    odds = counts.select("token", (F.log((F.col("c1") + 1) / F.lit(float(t1 + v))) - F.log((F.col("c0") + 1) / F.lit(float(t0 + v))) + before).alias("odds"))
    # a token that no labelled page has
    new = F.lit(float(np.log(1 / (t1 + v)) - np.log(1 / (t0 + v))) if v else 0.0)
    side = F.broadcast(odds) if small(counts, 40, broadcast_bytes) else odds
    found = tokens.select("url", F.explode("tokens").alias("token")).groupBy("url", "token").count().join(side, "token", "left")
    scores = found.groupBy("url").agg(F.sum(F.col("count") * F.coalesce("odds", new)).alias("s"))
    done = tokens.join(scores, "url", "left").select("url", F.array_join("host_words", " ").alias("host_words"), "s")
    out = pages.select("page_id", "url").join(done, "url", "left")
    total = F.coalesce("s", F.lit(0.0)) + F.lit(prior)
    return out.select("page_id", "url", F.coalesce("host_words", F.lit("")).alias("host_words"), F.round(total, 9).alias("score"), (F.col("s").isNotNull() & (total > 0)).alias("flagged"))
