import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from graingrid.llm import op04_urls as U

PAGES = "page_id long, url string, html string, host_words string, n long"


def best_split(name, counts, total):
    """The likeliest of all splits."""
    cost = lambda w: math.log(counts[w]) - math.log(max(total, 2)) if counts.get(w) else math.log(10) * (1 - len(w)) - math.log(max(total, 2))
    best = None
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(name)]
        words = [name[a:b] for a, b in zip(at, at[1:])]
        p = sum(map(cost, words))
        if best is None or p > best[0] + 1e-9:
            best = (p, [words])
        elif p > best[0] - 1e-9:
            best[1].append(words)
    return best[1]


def test_viterbi_is_the_best_of_all_splits():
    counts = {"free": 40, "bet": 9, "bets": 12, "the": 500, "rapist": 2, "therapist": 3, "therapists": 1, "s": 30, "a": 90, "at": 44}
    total = 4000
    for name in ("freebets", "therapists", "thebets", "zzbets", "abc", "a", "sat", "freethea"):
        known = {(a, b): counts[name[a:b]] for a in range(len(name)) for b in range(a + 1, len(name) + 1) if name[a:b] in counts}
        assert U.viterbi(name, known, total) in best_split(name, counts, total)


def test_scores_match_a_plain_model(spark):
    html = "<html><body><p>free bets and the casino win the game</p><b class='bets'>game game</b></body></html>"
    urls = ["http://freebets.example.com/win/1", "http://freegame.example.com/play", "http://casinowin.example.org/a", "http://user:p@thegame.example.org:80/play/b.html?x=y", "https://x.example.net/", "http://freebets.example.com/win/1"]
    rows = [(k, u, html, "z", k) for k, u in enumerate(urls)] + [(90, None, html, None, None), (91, "", None, "z", 1), (92, "not a url 123", html, "z", 1), (93, "http://1.2.3.4/5", html, "z", 1), (0, urls[0], html, "z", 0), (None, urls[1], None, "z", 1)]
    labels = {0: 1, 1: 0, 2: 1, 3: 0, 92: 0, 93: None, 500: 1}
    table = spark.createDataFrame([*labels.items(), (0, 0), (None, 1)], "page_id long, label int")
    got = U.score(spark.createDataFrame(rows, PAGES), table).collect()
    assert len(got) == len(rows)
    for limit in (0,):
        assert sorted(map(str, U.score(spark.createDataFrame(rows, PAGES), table, broadcast_bytes=limit).collect())) == sorted(map(str, got))
    words = {r.url: r.host_words for r in got}
    assert words[urls[0]] == "free bets example com" and words[urls[2]] == "casino win example org" and words[urls[3]] == "the game example org"
    # naive Bayes over the given words
    import re

    toks = {u: (words[u].split() + [w for w in re.split("[^a-z]+", re.sub(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "", u).lower()) if w]) for u in words if u is not None}
    marked = [(r[1], labels[r[0]]) for r in rows if r[1] is not None and labels.get(r[0]) is not None]
    c1, c0 = dict.fromkeys(U.SEEDS, 0), {}
    for u, b in marked:
        for t in toks[u]:
            (c1 if b else c0)[t] = (c1 if b else c0).get(t, 0) + 1
    v, t1, t0 = len(set(c1) | set(c0)), sum(c1.values()), sum(c0.values())
    bad = sum(b for _, b in marked)
    prior = math.log(bad + 1) - math.log(len(marked) - bad + 1)
    for r in got:
        want = prior + sum(math.log((c1.get(t, 0) + 1) / (t1 + v)) - math.log((c0.get(t, 0) + 1) / (t0 + v)) + (math.log(U.SEED_WEIGHT) if t in U.SEEDS else 0) for t in toks.get(r.url, []))
        assert abs(r.score - want) < 1e-6
        assert r.flagged == (want > 0 and bool(toks.get(r.url)))
    assert [r.flagged for r in got if r.url == urls[0]] == [True] * 3


def test_tags_are_not_counted():
    data = np.frombuffer(b"<a href='x'>hi</a> yo<b", np.uint8)
    assert bytes(U._visible(data, np.array([0, len(data)]))).split() == [b"hi", b"yo"]


def test_empty_table_and_long_host(spark):
    assert U.score(spark.createDataFrame([], PAGES)).count() == 0
    r = U.score(spark.createDataFrame([(1, "http://" + "ab" * 400 + ".com/", "ab " * 20000, "", 1)], PAGES)).first()
    assert r.host_words.replace(" ", "") == "ab" * 400 + "com" and not r.flagged


def test_learns_words_that_are_no_seeds_and_holds_on_unseen_hosts(spark):
    """Hosts made of words that only labels tell apart, run together; half of the pages are labelled, none of the others' hosts is."""
    rng = random.Random(3)
    bad, good = ["winners", "luck", "wheel", "jack", "spins", "crypto", "moon"], ["garden", "history", "music", "school", "river", "bread", "letters"]
    text = "<p>" + " ".join(f"{w} " * 30 for w in bad + good) + "</p>"
    rows, truth = [], {}
    for k in range(400):
        words = [rng.choice(bad if k % 2 else good) for _ in range(2)] + [rng.choice(bad + good)] * (k % 3 == 0)
        rows.append((k, f"http://{'x' * (k // 200)}{''.join(words)}{rng.choice(['.example.com', '.example.org'])}/{rng.choice(['a', 'b', 'page'])}/{k}", text, "z", k))
        truth[k] = k % 2
    train = spark.createDataFrame([(k, truth[k]) for k in range(200)], "page_id long, label int")
    got = {r.page_id: r.flagged for r in U.score(spark.createDataFrame(rows, PAGES), train, seeds=()).collect()}
    hosts = {r[1].split("/")[2] for r in rows[:200]}
    held = [r[0] for r in rows[200:] if r[1].split("/")[2] not in hosts]
    assert len(held) > 150 and sum(got[k] == bool(truth[k]) for k in held) / len(held) >= 0.95


def test_labels_from_texts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.page_id: r.label for r in U.weak_labels(pages, docs, labels).collect()}
    assert len(got) == pages.count() and 0 < sum(got.values()) < len(got)
    # a labelled document's text, as a page, mostly gets the document's own label
    own = docs.join(labels, "doc_id").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("want"))
    told = U.weak_labels(own, docs, labels).join(own, "page_id")
    assert told.where("label = want").count() >= 0.85 * told.count()
    assert U.weak_labels(spark.createDataFrame([(1, None), (None, "x"), (2, "<p>")], "page_id long, html string"), docs, labels).count() == 0
