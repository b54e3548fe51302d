"""Statistics of each text, exact ranks of them within a language, and marks for prose and junk.

The statistics of a batch of texts come from one array of code points. Ranks are exact over all documents of a
language: the different values of a statistic, with their counts, are range-partitioned and sorted; each
partition sums the counts below a value, and the totals of the partitions before it are added as offsets. From the
ranks follow the empirical tail probabilities of each value, and a document's outlier score is the sum of their
negative logarithms over all statistics. A mark is a limit in some statistic; the limit has a rank as well, and a
document has the mark if its own rank lies beyond, so that each mark comes with the share of documents that it cuts
off. What is compared are different values: documents only look theirs up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..joins import join_sized
from ..session import write_table
from .codepoints import BLANK, FEED, LETTER, NUMBER, STOP, classes, in_portions, span_hashes, spans, to_codepoints

#: Most different common words that are sent to all tasks.
MAX_COMMON = 1_000_000
COUNTS = ("n_words", "word_chars", "symbol_chars", "n_lines", "ended_lines", "common_words")
SHARES = ("n_words", "mean_word_length", "symbol_share", "line_end_share", "common_share")
_SCHEMA = pa.schema([("id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in COUNTS)])


def common_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words."""
    if not words:
        return np.zeros(0, np.uint64)
    _, cps, ends = to_codepoints(words)
    return np.unique(span_hashes(cps, np.append(0, ends[:-1] + 1), ends))


def count_texts(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text. ``common``: sorted hashes of the common words."""
    table, n = classes(), len(texts)
    joined, cps, ends = to_codepoints(texts)
    kind = table[cps]
    starts, stops = spans((kind & BLANK) == 0)
    text = np.searchsorted(ends, starts)  # the text of each word
    symbol = np.append(0, np.cumsum((kind & (BLANK | LETTER | NUMBER)) == 0))
    line = np.cumsum((kind & FEED) != 0)[starts]  # every text ends with a line feed, so lines do not cross texts
    last = np.append(line[1:] != line[:-1], True)[: len(starts)]  # the last word of its line

    low = joined.lower()
    low_cps = cps if low == joined else np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    low_kind = table[low_cps]
    a, b = (starts, stops) if len(low_cps) == len(cps) else spans((low_kind & BLANK) == 0)
    letters = np.flatnonzero(low_kind & LETTER)
    first, past = np.searchsorted(letters, a), np.searchsorted(letters, b)
    worded = np.flatnonzero(past > first)
    hashes = span_hashes(low_cps, letters[first[worded]], letters[past[worded] - 1] + 1)
    is_common = np.zeros(len(a), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        is_common[worded] = common[at] == hashes

    def per_text(weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(text, weights, n).astype(np.int64)

    return {"n_words": per_text(), "word_chars": per_text(stops - starts), "symbol_chars": per_text(symbol[stops] - symbol[starts]), "n_lines": per_text(last), "ended_lines": per_text(last & ((kind[np.maximum(stops - 1, 0)] & STOP) != 0)), "common_words": per_text(is_common)}


def text_statistics(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and shares of each document, in one pass without a shuffle.

    Words are the longest runs of characters other than space, tab, CR and LF; lengths are in code points. Symbols
    are characters of words that are neither letters nor numbers. Lines are split at LF, stripped of blanks, and
    counted if not empty; one is ended if its last character is ``.``, ``!`` or ``?``. A common word is one that,
    in lower case and without what is no letter at either end, is a ``word`` of ``common_words``, whatever its
    language. Words are compared by 64-bit hashes.

    The result has one row for each row of ``documents``: the id, the language, the six counts and
    ``mean_word_length, symbol_share, line_end_share, common_share``, which are null where there is no word. A
    null text counts as empty; a null id or language stays null; other columns are not read. If there are more than
    ``MAX_COMMON`` different common words, an error is raised.
    """
    words = common_words.where("word is not null").select("word").distinct().limit(MAX_COMMON + 1).toArrow()["word"].to_pylist()
    if len(words) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    common = common_hashes(words)
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_portions(batches):
            counts = count_texts(texts, common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(counts[c]) for c in COUNTS)], schema=_SCHEMA)

    counted = rows.mapInArrow(count, "id bigint, lang string, " + ", ".join(f"{c} bigint" for c in COUNTS))

    def share(part: str, whole: str) -> F.Column:
        return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole))

    return counted.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), *COUNTS, share("word_chars", "n_words").alias("mean_word_length"), share("symbol_chars", "word_chars").alias("symbol_share"), share("ended_lines", "n_lines").alias("line_end_share"), share("common_words", "n_words").alias("common_share"))


#: What each mark demands: a document without words has none of them.
MARKS = {
    "long_words": (("mean_word_length", ">", 15.0),),
    "symbols": (("symbol_share", ">", 0.28),),
    "no_line_end": (("line_end_share", "<", 0.02),),
    "no_common": (("common_share", "<", 0.01),),
    "prose": (("line_end_share", ">=", 0.5), ("mean_word_length", "<=", 8.0), ("symbol_share", "<=", 0.12)),
}


def _beyond(op: str, at: str) -> F.Column:
    """Whether a value lies beyond a limit, by the numbers of rows below and up to each; the value is that of a row."""
    below, upto = F.col("n_below"), F.col("n_below") + F.col("n")
    return {">": below >= F.col(f"upto_{at}"), ">=": below >= F.col(f"below_{at}"), "<": upto <= F.col(f"below_{at}"), "<=": upto <= F.col(f"upto_{at}")}[op]


def ranked_marks(statistics: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """``id_col, mark``, as ``quality_marks``, by ranks within the language: values and limits are compared by how many
    documents lie below them. A null language is one of its own."""
    stats = write_table(statistics.select(F.col(id_col).alias("id"), F.col(lang_col).alias("grp"), *SHARES).withColumn("row", F.monotonically_increasing_id()), "statistics").df
    pairs = ", ".join(f"'{s}', {s}" for s in SHARES[1:])
    long = stats.where("n_words > 0").select("row", "grp", F.expr(f"stack({len(SHARES) - 1}, {pairs}) as (stat, value)")).where("value is not null")
    ranks = write_table(value_ranks(long), "value-ranks").df
    parts = [(f"c{i}", *c) for i, c in enumerate(dict.fromkeys(c for cs in MARKS.values() for c in cs))]
    limits = ranks.groupBy("grp", "stat").agg(F.count("*").alias("n_values"), *(F.coalesce(F.sum(F.when(F.col("value") < limit, F.col("n"))), F.lit(0)).alias(f"below_{c}") for c, _, _, limit in parts), *(F.coalesce(F.sum(F.when(F.col("value") <= limit, F.col("n"))), F.lit(0)).alias(f"upto_{c}") for c, _, _, limit in parts))
    judged = join_sized(ranks, limits, ["grp", "stat"], "n_values")
    flags = write_table(judged.select("grp", "stat", "value", "n", *(((F.col("stat") == stat) & _beyond(op, c)).alias(c) for c, stat, op, _ in parts)), "judged-values").df
    found = join_sized(long, flags, ["grp", "stat", "value"], "n").groupBy("row").agg(*(F.max(c).alias(c) for c, *_ in parts))
    name = {(stat, op, limit): c for c, stat, op, limit in parts}
    holds = [F.when(reduce(lambda a, b: a & b, (F.col(name[c]) for c in conditions)), mark) for mark, conditions in MARKS.items()]
    marked = found.join(stats.select("row", "id"), "row").select("id", F.explode(F.array_compact(F.array(*holds))).alias("mark"))
    return marked.unionByName(stats.where("n_words = 0").select("id", F.lit("no_words").alias("mark"))).distinct().withColumnRenamed("id", id_col)


def quality_marks(statistics: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, mark``: a row for each mark that holds; repeated documents count once. A document without words
    has the mark ``no_words`` alone. The limits are compared with the values themselves."""
    holds = [F.when(reduce(lambda a, b: a & b, (F.expr(f"{stat} {op} {limit}D") for stat, op, limit in conditions)), mark) for mark, conditions in MARKS.items()]
    marks = F.array(F.when(F.col("n_words") == 0, "no_words"), *holds)
    return statistics.select(id_col, F.explode(F.array_compact(marks)).alias("mark")).distinct()


def value_ranks(values: DataFrame) -> DataFrame:
    """Exact ranks of the different values of each group.

    ``values`` has ``grp string, stat string, value double``; rows with a null value are left out, a null ``grp``
    is a group of its own, and NaN is the largest value. The result has, for each different (grp, stat, value), the
    number of rows ``n`` with it, ``n_below`` with a smaller value, and ``total`` of its group and statistic. Rows
    are counted by value before anything is sorted, so ties cost one row, and a group that holds a third of all
    rows is spread over many partitions.
    """
    distinct = values.where("value is not null").groupBy("grp", "stat", "value").agg(F.count("*").alias("n"))

    def cumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the group and statistic that are open, and their rows so far
        for batch in batches:
            grp, stat = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            n = batch.column(3).to_numpy()
            keys = list(zip(grp, stat))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            below = np.zeros(len(keys), np.int64)
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                so_far = held[1] if held and held[0] == keys[a] else 0
                sums = so_far + np.cumsum(n[a:b])
                below[a:b] = sums - n[a:b]
                held = (keys[a], int(sums[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(below)], names=["grp", "stat", "value", "n", "pid", "within"])

    ordered = distinct.repartitionByRange("grp", "stat", "value").sortWithinPartitions("grp", "stat", "value")
    # Written once: the offsets and the ranks must see the same partitions.
    local = write_table(ordered.withColumn("pid", F.spark_partition_id()).mapInArrow(cumulate, "grp string, stat string, value double, n bigint, pid int, within bigint"), "ranks").df
    parts = local.groupBy("grp", "stat", "pid").agg(F.sum("n").alias("rows"))
    key = Window.partitionBy("grp", "stat")
    offsets = parts.select("grp", "stat", "pid", (F.sum("rows").over(key.orderBy("pid")) - F.col("rows")).alias("offset"), F.sum("rows").over(key).alias("total"))
    joined = local.alias("l").join(offsets.alias("o"), F.expr("l.grp <=> o.grp and l.stat = o.stat and l.pid = o.pid"))
    return joined.select("l.grp", "l.stat", "l.value", "l.n", (F.col("l.within") + F.col("o.offset")).alias("n_below"), "o.total")


def outlier_scores(statistics: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """``id_col, lang, outlier_score``: how unusual a document's statistics are within its language.

    For each statistic the smaller of both empirical tail probabilities, of values at most and at least as large,
    is doubled and kept below 1; the score is the sum of the negative natural logarithms. Documents without words
    have a null score and do not enter the ranks; those of a null language are ranked among themselves. Repeated
    rows are expected to have been dropped.
    """
    # Read three times below: the texts are not.
    stats = write_table(statistics.select(F.col(id_col).alias("id"), F.col(lang_col).alias("grp"), *(F.col(s).cast("double").alias(s) for s in SHARES)), "statistics").df
    pairs = ", ".join(f"'{s}', {s}" for s in SHARES)
    long = stats.where("n_words > 0").select("id", "grp", F.expr(f"stack({len(SHARES)}, {pairs}) as (stat, value)")).where("value is not null")
    ranks = write_table(value_ranks(long), "value-ranks").df
    tail = F.least(F.col("n_below") + F.col("n"), F.col("total") - F.col("n_below")) * 2.0 / F.col("total")
    cost = ranks.select("grp", "stat", "value", "n", (-F.log(F.least(tail, F.lit(1.0)))).alias("cost"))
    scored = join_sized(long, cost, ["grp", "stat", "value"], "n").groupBy("id").agg(F.sum("cost").alias("score"))
    return stats.alias("s").join(scored.alias("t"), F.expr("s.id = t.id"), "left").select(F.col("s.id").alias(id_col), F.col("s.grp").alias("lang"), F.col("t.score").alias("outlier_score"))
