import time
import itertools
import random
import re

import pyarrow as pa
import pytest

from graingrid.llm import op03_decontaminate as D
from graingrid.llm.textcore import Words, flat


def sentence(rng, n):
    return [rng.choice("ka lo mi ten sar vul pem dor nif gat hul wex".split()) + rng.choice("a e i o u".split()) + str(rng.randint(0, 99)) for _ in range(n)]


def brute(docs, items, min_words=D.MIN_WORDS, penalty=D.PENALTY):
    """Best aligned stretch over all diagonals."""
    tok = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    found = {}
    for d, dt in docs:
        dw = tok(dt)
        for i, it in items:
            iw = tok(it)
            if len(iw) < D.LEAST_WORDS:
                continue
            best = 0
            for diag in range(-len(iw) + 1, len(dw)):
                same = [0 <= diag + k < len(dw) and dw[diag + k] == iw[k] for k in range(len(iw))]
                inside = [0 <= diag + k < len(dw) for k in range(len(iw))]
                score = low = 0
                run_best, start, span, matched_at = 0, 0, (0, 0), 0
                for k in range(len(iw)):
                    score += 1 if same[k] else (-penalty if inside[k] else -(1 << 20))
                    if score - low > run_best:
                        run_best, span = score - low, (start, k + 1)
                    if score <= low:
                        low, start = score, k + 1
                matched_at = sum(same[span[0] : span[1]])
                total = sum(same)
                whole = all(inside) and len(iw) < min_words and (total == len(iw) if len(iw) < 10 else 5 * total >= 4 * len(iw))
                if matched_at >= min_words or whole:
                    best = max(best, total if whole else matched_at)
            if best:
                found[d, i] = best
    return found


def fixture():
    rng = random.Random(11)
    items = [(k, sentence(rng, n)) for k, n in enumerate([40, 30, 14, 11, 9, 6, 4, 25, 60])]
    docs, n = [], 0
    for _ in range(12):
        docs.append((n, sentence(rng, rng.randint(0, 200))))
        n += 1
    for k, item in items:
        for edits in (0, 1, 3):
            copy = list(item)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = "other"
            docs.append((n, sentence(rng, 30) + copy + sentence(rng, 20)))
            n += 1
    docs.append((n, items[0][1][:20] + sentence(rng, 10)))
    docs.append((n + 1, items[8][1][30:] ))
    return [(i, " ".join(w)) for i, w in items], [(i, ", ".join(w).upper()) for i, w in docs]


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 50])
def test_leaks_match_brute_force(spark, block_words):
    items, docs = fixture()
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in got} == brute(docs, items)
    assert len(got) >= 20


def test_places(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    text = "one two " + item.replace("eta theta", "eta OTHER") + " three"
    r = D.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [tuple(x) for x in r] == [(1, 5, 14, 15, 2, 0)]


@pytest.mark.parametrize("n", [10, 11, 12, 13, 14, 15, 17, 20])
def test_a_fifth_may_be_replaced_anywhere_at_any_length(n):
    item = [f"w{k}" for k in range(n)]
    block = D.Block([7], [" ".join(item)])
    for many in range(n // 5 + 2):
        places = list(itertools.combinations(range(n), many))[:5000]
        texts = [" ".join(["before", *("other" if k in p else w for k, w in enumerate(item)), "after"]) for p in places]
        got = D.overlaps(block, Words(*flat(pa.array(texts))), D.MIN_WORDS, D.PENALTY)
        if 5 * many <= n:
            assert got["row"].tolist() == list(range(len(places)))
        elif n - many < D.MIN_WORDS:
            assert not len(got["row"])


def test_no_way_to_replace_a_fifth_escapes_all_masks():
    # fewest replaced words that leave no place for any mask, by what the last words were; 1 is a replaced word
    masks = [(len(m), int(m, 2)) for m in D.MASKS]
    span = max(map(len, D.MASKS))
    fewest = {0: 0}
    for n in range(1, 101):
        new = {}
        for last, c in fewest.items():
            for b in (0, 1):
                w = last << 1 | b
                if all(n < size or w & m for size, m in masks):
                    k = w & ((1 << span - 1) - 1)
                    new[k] = min(new.get(k, n), c + b)
        fewest = new
        assert n < span or min(fewest.values()) > n // 5


def test_edges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, "the of and"), (None, "alpha beta gamma delta epsilon"), (5, "alpha beta gamma delta epsilon")], "item_id long, text string")
    schema = "doc_id long, text string, matched string, item_id long"
    docs = spark.createDataFrame([(1, "x Alpha, beta; gamma delta-epsilon y", "k", 9), (1, "x Alpha, beta; gamma delta-epsilon y", "k", 9), (2, None, "k", 9), (3, "", None, None), (4, "the of and " * 30000, "k", 9), (None, "alpha beta gamma delta epsilon", "k", 9)], schema)
    got = sorted(((r.doc_id or 0, r.item_id) for r in D.leaks(docs, items).collect()))
    assert got == [(0, 1), (0, 5), (1, 1), (1, 1), (1, 5), (1, 5)]
    kept = D.remove(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    none = items.where("false")
    assert D.leaks(docs, none).count() == 0 and D.remove(docs, none).count() == 6
    assert D.leaks(docs.where("false"), items).count() == 0


def test_repetitive_items_and_documents(spark):
    """Every place of the item fits every place of the document."""
    bench = spark.createDataFrame([(1, "ha " * 300), (2, " ".join(f"w{k}" for k in range(20000))), (3, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "ha " * 12000), (2, "ho " * 12000), (3, " ".join(f"w{k}" for k in range(5000, 5040))), (4, "na na one two three four five six na")], "doc_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id): r.matched for r in D.leaks(docs, bench).collect()}
    assert got == {(1, 1): 300, (3, 2): 40, (4, 3): 6} and time.time() - began < 40
    assert {r.doc_id for r in D.remove(docs, bench).collect()} == {2}
