import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import codepoints, textstats

COMMON = [("the", "en"), ("a", "en"), ("a", "fr"), ("de", "fr"), ("été", "fr"), ("straße", "de"), (None, "de"), ("i̇n", "tr"), ("ος", "el")]
WORDS = {w for w, _ in COMMON if w}


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[ \t\r\n]+", t) if w]
    kinds = [unicodedata.category(c)[0] for w in words for c in w]
    lines = [x for x in (line.strip(" \t\r\n") for line in t.split("\n")) if x]

    def core(w):
        at = [i for i, c in enumerate(w.lower()) if unicodedata.category(c)[0] == "L"]
        return w.lower()[at[0] : at[-1] + 1] if at else ""

    return (len(words), sum(map(len, words)), sum(k not in "LN" for k in kinds), len(lines), sum(x[-1] in ".!?" for x in lines), sum(core(w) in WORDS for w in words))


TEXTS = ["The cat, a dog. \n\n- été!\r\n", None, "", " \t\r\n", "x", "...", "«De» été? THE the a", "ΛΌΓΟΣ ΟΣ İn 'the' _a_ 12 a1 1a", "line\x0bone\x0ctwo\x85three four .\nok!", "👍🏽 é ́", "x" * 50_000 + "\n" + "the a " * 30_000, "a\n.\n!\n", "straße STRASSE Straße."]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("x") for c in ("id", "n_words", "grp", "stat", "value")})


def common(spark):
    return spark.createDataFrame(COMMON, "word string, lang string")


def test_counts_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    letters = list("aAé .!?\n\t\r-_1²½ΣİtThe漢") + ["the ", " a ", " ", "ß"]
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(300)]
    df = frame(spark, [(i, t, None if i % 5 == 0 else "en") for i, t in enumerate(texts)])
    got = {r["doc_id"]: tuple(r[c] for c in textstats.COUNTS) for r in textstats.text_statistics(df, common(spark)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_portions_keep_texts_whole(spark, monkeypatch):
    import pyarrow as pa

    texts = ["ab " * n for n in range(30)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(31)), pa.array(texts)], names=["id", "text"])
    parts = list(codepoints.in_portions([batch.slice(3), batch.slice(0, 0)], most=60))
    assert [t for _, p in parts for t in p] == [t or "" for t in texts[3:]]
    assert all(b.num_rows == len(p) for b, p in parts)


def test_marks(spark):
    rows = [(1, None, "en"), (2, "The cat sat. A dog ran!", "en"), (3, "### ||| %%%", None), (4, "pneumonoultramicroscopic " * 3, "en"), (4, "pneumonoultramicroscopic " * 3, "en")]
    found = textstats.quality_marks(textstats.text_statistics(frame(spark, rows), common(spark))).distinct().collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).add(r["mark"])
    assert got == {1: {"no_words"}, 2: {"prose"}, 3: {"symbols", "no_line_end", "no_common"}, 4: {"long_words", "no_line_end", "no_common"}}


def test_ranked_marks_are_the_marks(spark, monkeypatch):
    from murmuration import joins

    monkeypatch.setattr(joins.join_sized, "__defaults__", (3,))
    rng = np.random.default_rng(7)
    rows = []
    for i in range(150):
        words = ["the", "a", "%%", "wordwordwordwordword", "x1", "end.", "fine", "\n"]
        text = " ".join(rng.choice(words, int(rng.integers(0, 9)), p=rng.dirichlet(np.ones(8))))
        rows.append((i, text, [None, "en", "de", "one"][int(rng.integers(4))] if i else "alone"))
    rows += [(900, "aaaaaaaaaaaaaaa.", "en"), (901, "aaaaaaaaaaaaaaaa.", "en"), (902, None, None), (None, "the end.", "en"), (5, rows[5][1], rows[5][2])]
    stats = textstats.text_statistics(frame(spark, rows), common(spark))
    got = sorted(map(tuple, textstats.ranked_marks(stats).collect()), key=str)
    assert got == sorted(map(tuple, textstats.quality_marks(stats).collect()), key=str)
    assert {m for _, m in got} == {*textstats.MARKS, "no_words"}
    assert textstats.ranked_marks(stats.limit(0)).count() == 0


def test_ranks_equal_brute_force_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"g{rng.integers(3)}", f"s{rng.integers(2)}", float(rng.integers(0, 50)) / 7) for _ in range(3000)]
    rows += [("hot", "s0", 1.0)] * 1000 + [("hot", "s0", None)]
    got = {(r["grp"], r["stat"], r["value"]): (r["n"], r["n_below"], r["total"]) for r in textstats.value_ranks(spark.createDataFrame(rows, "grp string, stat string, value double")).collect()}
    groups = {}
    for g, s, v in rows:
        if v is not None:
            groups.setdefault((g, s), []).append(v)
    assert got == {(g, s, v): (vs.count(v), sum(u < v for u in vs), len(vs)) for (g, s), vs in groups.items() for v in set(vs)}


def test_outlier_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 9))) + rng.choice([".", ""]), rng.choice(["en", "de"])) for i in range(80)]
    rows += [(900, "%%%% " * 40, "en"), (901, None, "en"), (902, "lonely", None)]
    stats = textstats.text_statistics(frame(spark, [(i, t, None if g is None else str(g)) for i, t, g in rows]), common(spark))
    score = {r["doc_id"]: r["outlier_score"] for r in textstats.outlier_scores(stats).collect()}
    assert len(score) == len(rows) and score[901] is None and score[902] == pytest.approx(0.0)
    assert max((s for s in score.values() if s is not None)) == score[900]
    one = {r["doc_id"]: r for r in stats.collect()}
    want = 0.0
    for s in textstats.SHARES:
        vs = [float(r[s]) for r in one.values() if r["lang"] == "en" and r["n_words"] > 0]
        v = float(one[900][s])
        want -= math.log(min(1.0, 2 * min(sum(u <= v for u in vs), sum(u >= v for u in vs)) / len(vs)))
    assert score[900] == pytest.approx(want)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x", "en")]).limit(0)
    assert textstats.text_statistics(none, common(spark)).count() == 0
    assert textstats.outlier_scores(textstats.text_statistics(none, common(spark).limit(0))).count() == 0
    assert textstats.text_statistics(frame(spark, [(1, "the", "en")]), common(spark).limit(0)).first()["common_words"] == 0
