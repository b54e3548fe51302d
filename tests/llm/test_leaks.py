import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import leaks

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, window):
    out = set()
    grams = {}
    for i, t in items:
        if i is not None and t is not None:
            w = WORD.findall(t.lower())
            for k in range(len(w) - window + 1):
                grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    for d, t in docs:
        if d is not None and t is not None:
            w = WORD.findall(t.lower())
            for k in range(len(w) - window + 1):
                out |= {(d, i) for i in grams.get(tuple(w[k : k + window]), ())}
    return out


def found(spark, docs, items, **kw):
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("item_id", "item_text", "word")})
    b = spark.createDataFrame(items, "item_id bigint, item_text string").withColumns({"doc_id": F.lit(1), "text": F.lit("y")})
    rows = [(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(a, b, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)] + ["Größe", "été", "Ünicode9", "ΣΟΦΟΣ", "a_b", "don't", "İstanbul"]

    def text(n):
        return " ".join(rng.choice(words, n))

    items = [(i, text(int(rng.integers(1, 30)))) for i in range(30)] + [(90, None), (None, text(20)), (91, ""), (92, "same start of a phrase " + text(20)), (93, "same start of a phrase " + text(20))]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(60)]
    for i in range(40):
        item = items[int(rng.integers(30))][1].split(" ")
        a = int(rng.integers(0, max(1, len(item) - 5)))
        docs.append((100 + i, text(9) + "\n\t*" + ", ".join(item[a:]).upper() + " ... " + text(9)))
    docs += [(200, None), (201, ""), (202, " \n"), (None, items[5][1]), (203, text(40_000) + " " + (items[92 - 60][1] or "")), docs[70]]
    return docs, items


@pytest.mark.parametrize("window", [1, 3, 8, 12])
def test_equals_brute_force(spark, window):
    docs, items = corpus(window)
    assert found(spark, docs, items, window=window) == brute(docs, items, window)


@pytest.mark.parametrize(("index_bytes", "part_words"), [(6_000, 4096), (1 << 30, 5), (6_000, 1)])
def test_blocks_of_items_and_parts_of_long_ones(spark, index_bytes, part_words):
    docs, items = corpus(4)
    assert found(spark, docs, items, window=8, index_bytes=index_bytes, part_words=part_words) == brute(docs, items, 8)


def test_parts_hold_every_window_once(spark):
    text = " ".join(f"u{i}" for i in range(50))
    rows = leaks.item_parts(spark.createDataFrame([(1, text), (2, "a b"), (3, "")], "item_id bigint, item_text string"), 4, 10).collect()
    windows = [" ".join(w[k : k + 4]) for r in rows for w in [r["item_text"].split()] for k in range(r["n"] - 3)]
    assert sorted(windows) == sorted(" ".join(text.split()[k : k + 4]) for k in range(47))


def test_a_passage_does_not_cross_documents(spark):
    item = " ".join(f"u{i}" for i in range(12))
    docs = [(1, " ".join(item.split()[:6])), (2, " ".join(item.split()[6:])), (3, item)]
    assert found(spark, docs, [(7, item)], window=12) == {(3, 7)}


def test_edited_passages(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"v{k}" for k in rng.integers(0, 2000, 12))) for i in range(60)]
    docs, truth = [], set()
    for i, text in items:
        w = text.split()
        for e in (1, 2, 5):
            x = list(w)
            for k in rng.choice(12, e, replace=False):
                x[k] = f"new{rng.integers(1000)}"
            docs.append((100 * i + e, "some words before " + " ".join(x) + " and some after"))
            if e <= 2:
                truth.add((100 * i + e, i))
    got = found(spark, docs, items, window=12, max_edits=2)
    assert got <= truth  # what is found is verified
    assert len(got) >= 0.9 * len(truth)


def near_brute(docs, items, window, edits):
    """All pairs of a passage and an item's window, by the same distance; no index."""
    out = set()
    for i, t in items:
        w = WORD.findall(t.lower())
        for d, u in docs:
            v = WORD.findall((u or "").lower())
            if any(leaks.passage_distance(w[k : k + window], v[p : p + window + edits]) <= edits for k in range(len(w) - window + 1) for p in range(len(v))):
                out.add((d, i))
    return out


def test_inserted_and_deleted_words_against_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"v{k}" for k in rng.integers(0, 400, 14))) for i in range(25)]
    docs = []
    for i, text in items:
        for kind in range(8):
            w = text.split()[1:13]
            for _ in range(1 + kind % 3):
                k = int(rng.integers(0, len(w)))
                w[k : k + 1] = ([], [w[k], "new"], ["other"])[int(rng.integers(3))]
            docs.append((100 * i + kind, " ".join((["before"] if kind % 2 else []) + w + (["after", "that"] if kind % 4 < 2 else []))))
    want = near_brute(docs, items, 12, 2)
    got = found(spark, docs, items, window=12, max_edits=2)
    assert len(want) > 100 and got <= want and len(got) >= 0.97 * len(want)


def test_distances_of_many_at_a_time():
    rng = np.random.default_rng(2)
    items, texts, length = rng.integers(0, 5, (300, 12)), rng.integers(0, 5, (300, 14)), rng.integers(0, 15, 300)
    texts[:150, :12] = items[:150]
    texts[:150, rng.integers(0, 12, 150)] = 9
    got = leaks.passage_distances(items, texts, length)
    assert got.tolist() == [leaks.passage_distance(a.tolist(), b.tolist()[:n]) for a, b, n in zip(items, texts, length)]


def test_passage_distance():
    assert leaks.passage_distance(list("kitten"), list("sitting")) == 2  # sitti, and what follows is free
    assert leaks.passage_distance([], ["a"]) == 0 and leaks.passage_distance(["a"], ["a", "b"]) == 0 and leaks.passage_distance(["a", "b"], []) == 2


def test_empty_tables(spark):
    docs, items = corpus()
    assert found(spark, docs, [(90, None)]) == set()
    assert found(spark, [(1, None)], items) == set()
