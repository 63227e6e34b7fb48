"""Quality rules whose thresholds come from the corpus.

Four measures of every text (mean word length, share of symbols, share of repeated lines, share of
repeated words) are integers. Their distribution in each (language, source) is kept as a quantile
sketch: counts over bins that are exact below 1,024 and have a relative width of 1/512 beyond.
Sketches merge by adding counts, so they come from one aggregate with partial sums, and sketches of
a language or of the corpus are sums of the finer ones. Groups of fewer than `least` documents use
the sketch of their language, then that of the corpus; a smaller corpus has no thresholds. A
threshold lies `spread` interquartile ranges, and at least `slack`, beyond the upper quartile (for
word length also below the lower): it follows each group's own middle half, so a group without
outliers loses nothing. Measures and thresholds meet in a join.

Null texts, and texts without words, measure 0 and fail the base rule. Null languages and sources
are groups like others. Repeated rows count and are judged as often as they stand. Texts without
words take no part in sketches. Only the named columns are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut, slices
from codestrata.llm.words import Words

#: Documents that a group needs for thresholds of its own.
LEAST_DOCUMENTS = 200
#: Interquartile ranges between the quartile and the threshold.
SPREAD = 6
LEAST_WORDS = 10
#: In percent of words.
MOST_REPEATED = 20
WIDTH = 5
SYMBOLS = "#*$%&|<>"

#: Measure -> (numerator, denominator, units of one, least distance from the quartile in units).
MEASURES: dict[str, tuple[str, str, int, int]] = {
    "word_length": ("word_chars", "n_words", 100, 300),
    "symbols": ("n_symbols", "word_chars", 1000, 50),
    "repeated_lines": ("n_dup_lines", "n_lines", 1000, 350),
    "repeated_words": ("n_repeat_words", "n_words", 1000, 150),
}
TWO_SIDED = ("word_length",)

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_BLANKS = " \t\n\v\f\r"


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def repeated_words(words: Words, n_texts: int) -> np.ndarray:
    """Words of each text that lie in a window of five that occurs twice or more in it."""
    h, text, at = words.windows(WIDTH)
    if not len(h):
        return np.zeros(n_texts, np.int64)
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WIDTH, -1)
    return _sums(np.cumsum(cover)[:-1] > 0, words.first_word)


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those among them equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(lines), len(lines) - len(set(lines))


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the group columns, and the counts of each whole text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, end, data, bounds in slices(texts):
                words, n = Words(data, bounds, fold=False), end - first
                inside = np.zeros(len(data) + 1, np.int64)
                np.add.at(inside, words.starts, 1)
                np.add.at(inside, words.ends, -1)
                chars = (np.cumsum(inside)[:-1] > 0) & ((data & 0xC0) != 0x80)
                lines = np.array([_lines(t) if t else (0, 0)
                                  for t in texts.slice(first, n).to_pylist()], np.int64).reshape(n, 2)
                columns = [words.per_text, _sums(chars, bounds), _sums(_SYMBOL[data], bounds),
                           lines[:, 0], lines[:, 1], repeated_words(words, n)]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(first, n) for c in batch.columns[:-1]]
                    + [pa.array(c, pa.int64()) for c in columns],
                    names=["doc_id", *group, *_COUNTS])

    kinds = dict(docs.dtypes)
    schema = [f"doc_id {kinds[key]}", *(f"`{g}` {kinds[g]}" for g in group), *(f"{c} long" for c in _COUNTS)]
    return docs.select(key, *group, text).mapInArrow(count, ", ".join(schema))


def measure(name: str) -> Column:
    above, below, units, _ = MEASURES[name]
    return F.expr(f"CASE WHEN {below} > 0 THEN {units} * {above} DIV {below} ELSE 0 END")


def sketch_bin(value: Column) -> Column:
    """Values below 1,024 as they are, larger ones with their ten leading bits."""
    low = F.greatest(F.length(F.bin(value)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(counts: DataFrame, group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(group, measure, bin, n): a mergeable sketch of each measure in each group."""
    one = F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), sketch_bin(measure(m)).alias("bin")) for m in MEASURES)))
    return (counts.filter("n_words > 0").select(*group, one.alias("x")).select(*group, "x.measure", "x.bin")
            .groupBy(*group, "measure", "bin").agg(F.count("*").alias("n")))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, q1, q3); a sketch's bins are bounded in number."""
    by = [*keys, "measure"]
    below = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
    at = sketch.select(*by, "bin", below.alias("below"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))
    return at.groupBy(*by).agg(
        F.max("total").alias("total"),
        F.min(F.when(F.expr("4 * below >= total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.expr("4 * below >= 3 * total"), F.col("bin"))).alias("q3"))


def thresholds(sketch: DataFrame, group: tuple[str, ...] = ("lang", "source"),
               least: int = LEAST_DOCUMENTS, spread: int = SPREAD) -> DataFrame:
    """(group, and low and high of each measure); null where even the corpus is too small."""
    names = list(group)
    levels = [quartiles(sketch, names)]
    for k in range(len(names) - 1, -1, -1):
        levels.append(quartiles(merge(sketch, names[:k]), names[:k]))
    slack = F.create_map(*(F.lit(x) for m, v in MEASURES.items() for x in (m, v[3])))
    out = levels[0].select(*names, "measure", *_fence(slack, least, spread, 0))
    for depth, level in enumerate(levels[1:], 1):
        keys = names[:len(names) - depth]
        coarser = level.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("measure").alias("_measure"),
                               *_fence(slack, least, spread, depth))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        condition = F.col("measure") == F.col("_measure")
        for s in same:
            condition = condition & s
        out = out.join(coarser, condition, "left").drop("_measure", *(f"_{k}" for k in keys))
    depths = range(len(levels))
    limits = out.select(
        *names, "measure", F.coalesce(*(F.col(f"low{d}") for d in depths)).alias("low"),
        F.coalesce(*(F.col(f"high{d}") for d in depths)).alias("high"))
    return limits.groupBy(*names).agg(*(
        F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
        for m in MEASURES for side in ("low", "high")))


def _fence(slack: Column, least: int, spread: int, depth: int) -> list[Column]:
    reach = F.greatest(F.lit(spread) * (F.col("q3") - F.col("q1")), slack[F.col("measure")])
    enough = F.col("total") >= least
    return [F.when(enough & F.col("measure").isin(*TWO_SIDED), F.col("q1") - reach).alias(f"low{depth}"),
            F.when(enough, F.col("q3") + reach).alias(f"high{depth}")]


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text",
          group: tuple[str, ...] = ("lang", "source"), least: int = LEAST_DOCUMENTS,
          spread: int = SPREAD) -> DataFrame:
    """doc_id, group, counts, base_failed, the thresholds of its group, and kept."""
    counts = cut(base_counts(docs, key, text, group))
    limits = thresholds(sketches(counts, group), group, least, spread)
    renamed = limits.select(*(F.col(g).alias(f"_{g}") for g in group), *limits.columns[len(group):])
    condition = F.lit(True)
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(measure(m) <= F.col(f"{m}_high"), F.lit(True))
        inside = inside & F.coalesce(measure(m) >= F.col(f"{m}_low"), F.lit(True))
    failed = F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    return (counts.join(renamed, condition, "left").drop(*(f"_{g}" for g in group))
            .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside))
