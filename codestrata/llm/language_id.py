"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three letters, words padded by a blank on
either side), most frequent first. A text's own profile is compared with that of each language by
out-of-place distance: the sum over the text's n-grams of how far apart their two ranks are, or the
greatest distance where the language's profile lacks one. The nearest language is predicted, ties go
to the first in order; the score is 1 - distance / greatest possible distance.

Profiles are counted over all training rows, in partial sums per task; the first `top` of each
language pass through the driver, 8 bytes an n-gram (2.4 KB a language), and are sent to the tasks
LANGUAGES_SENT languages at a time, one pass over the texts' rows after the other. A task compares a
text with LANGUAGES_COMPARED of them at a time, so its tables stay small however many values the
language column holds.

Null texts, texts without a letter, and any text when nothing was learned, are `und` with score 0.
Texts are lower-cased and taken whole. Training rows without a language or a letter teach nothing;
rows without a key are not held out. Repeated rows count as often as they stand. Ties of counts go to
the smaller n-gram. Only the named columns are read; prediction sees the text alone."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
LONGEST = 3
#: Languages whose profiles one pass takes along, and that a task compares with at a time.
LANGUAGES_SENT, LANGUAGES_COMPARED = 20_000, 64
UNKNOWN = "und"
#: What a text is called before it has met a profile; no value of a language column holds this alone.
UNKNOWN_YET = "\0"
#: Characters that a task turns into n-grams at a time (one longer text is taken whole).
SLICE_CHARS = 1 << 20
#: Cells of a table of n-gram counts; alphabets that need more are counted by sorting.
MOST_CELLS = 1 << 20

_BITS = 21  # of a code point
_BLANK = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Grams:
    """n-grams of several texts: `code` (an index into `grams`) and `bounds` of each text."""

    def __init__(self, texts: list[str]):
        joined = "".join([t.lower() + "\0" for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t.lower()) + 1 for t in texts])
        is_letter = letters()[points]
        after = np.concatenate(([False], is_letter[:-1]))
        keep = is_letter | after  # a word and one blank behind it
        stream = np.where(is_letter, points, _BLANK)[keep]
        self.text_bounds = np.concatenate(([0], np.concatenate(([0], np.cumsum(keep)))[ends]))
        used = np.zeros(0x110000, bool)
        used[stream] = True
        used[_BLANK] = True
        self.alphabet = np.flatnonzero(used)  # the blank is among the first
        place = np.zeros(0x110000, np.int64)
        place[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.base = len(self.alphabet) + 1
        self.stream, self.blank = place[stream], int(place[_BLANK])

    def of(self, first: int, end: int) -> np.ndarray:
        """Codes of the n-grams of texts first to end - 1 (whole words, so of the stream between)."""
        x = self.stream[self.text_bounds[first]:self.text_bounds[end]]
        if not len(x):
            return x
        x = np.concatenate(([self.blank], x))
        inner = x != self.blank
        one = x[inner]
        two = x[:-1] * self.base + x[1:]
        three = (two[:-1] * self.base + x[2:])[inner[1:-1]]
        return np.concatenate((one, two, three))

    @property
    def cells(self) -> int:
        return self.base ** LONGEST

    def counts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, count) of each n-gram that occurs, by code."""
        if self.cells > MOST_CELLS:
            return np.unique(codes, return_counts=True)
        n = np.bincount(codes, minlength=0)
        at = np.flatnonzero(n)
        return at, n[at]

    def portable(self, codes: np.ndarray) -> np.ndarray:
        """n-grams as code points, which mean the same in every task."""
        points = np.concatenate(([0], self.alphabet))
        out = np.zeros(len(codes), np.int64)
        for power in (2, 1, 0):
            out = (out << _BITS) | points[codes // self.base ** power % self.base]
        return out

    def local(self, portable: np.ndarray) -> np.ndarray:
        """The codes of portable n-grams here; -1 where a letter does not occur."""
        place = np.full(0x110000, -1, np.int64)
        place[self.alphabet] = np.arange(1, self.base)
        place[0] = 0
        out, known = np.zeros(len(portable), np.int64), np.ones(len(portable), bool)
        for power in (2, 1, 0):
            at = place[(portable >> (_BITS * power)) & ((1 << _BITS) - 1)]
            known &= at >= 0
            out = out * self.base + at
        return np.where(known, out, -1)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    held: list[str] = []
    first = size = 0
    for t in texts.to_pylist():
        held.append(t or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def gram_counts(rows: DataFrame, text: str, language: str) -> DataFrame:
    """(language, gram, n) over all rows, n-grams as numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            gram, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return gram, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(gram)).astype(np.int64)

        for batch in batches:
            languages = np.array(batch.column(1).to_pylist(), object)
            for first, texts in _slices(batch.column(0)):
                grams = Grams(texts)
                own = languages[first:first + len(texts)]
                for name in sorted(set(own)):
                    rows_ = np.flatnonzero(own == name)
                    code, n = grams.counts(np.concatenate([grams.of(i, i + 1) for i in rows_]))
                    totals.setdefault(name, []).append((grams.portable(code), n))
            for name, parts in totals.items():
                totals[name] = [merged(parts)]
        for name, parts in sorted(totals.items()):
            gram, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)],
                names=["language", "gram", "n"])

    counted = rows.filter(F.col(language).isNotNull()).select(text, language).mapInArrow(
        count, "language string, gram long, n long")
    return counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, text: str = "text", language: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """The profile of each language: its most frequent n-grams in order."""
    by = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    ranked = gram_counts(rows, text, language).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    found = ranked.select("language", "rank", "gram").toArrow().sort_by([("language", "ascending"), ("rank", "ascending")])
    profiles: dict[str, np.ndarray] = {}
    if not found.num_rows:
        return profiles
    names, grams = found.column("language").combine_chunks().dictionary_encode(), found.column("gram").to_numpy()
    code = names.indices.to_numpy()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    for a, b in zip(first, [*first[1:], len(code)], strict=True):
        profiles[names.dictionary[int(code[a])].as_py()] = grams[a:b]
    return profiles


def _distances(code: np.ndarray, n: np.ndarray, names: np.ndarray, ranks: np.ndarray, ranked: np.ndarray, top: int
               ) -> tuple[np.ndarray, int]:
    """Out-of-place distance of a text to every language, and the greatest there can be.

    ranked: the sorted local codes of all profiles; ranks[l, i]: the place of ranked[i] in profile l."""
    first = np.lexsort((names, -n))[:top]
    own = code[first]
    at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
    there = np.where(ranked[at] == own, ranks[:, at], top)
    place = np.arange(len(first))
    return np.where(there < top, np.abs(there - place), top).sum(1), top * len(first)


class Profiles:
    """A block of profiles, ready to be compared with texts."""

    def __init__(self, profiles: list[np.ndarray], top: int):
        self.every = np.unique(np.concatenate(profiles))
        self.ranks = np.full((len(profiles), len(self.every)), top, np.int32)
        for row, own in zip(self.ranks, profiles, strict=True):
            row[np.searchsorted(self.every, own)] = np.arange(len(own))

    def local(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams as codes of these texts, sorted, and their ranks in each profile."""
        codes = grams.local(self.every)
        order = np.argsort(codes)
        return codes[order], self.ranks[:, order]


def _nearest_of(docs: DataFrame, profiles: dict[str, np.ndarray], keys: tuple[str, ...], top: int) -> DataFrame:
    """The key columns, lang_pred, score and text: the nearer of what they say and these profiles."""
    languages = sorted(profiles)
    kept = len(keys)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(first, Profiles([profiles[x] for x in languages[first:first + LANGUAGES_COMPARED]], top))
                  for first in range(0, len(languages), LANGUAGES_COMPARED)]
        for batch in batches:
            names, scores = batch.column(kept).to_pylist(), batch.column(kept + 1).to_pylist()
            for at, texts in _slices(batch.column(kept + 2)):
                grams = Grams(texts)
                counted = [grams.counts(c) if len(c) else None for c in (grams.of(i, i + 1) for i in range(len(texts)))]
                portable = [grams.portable(c[0]) if c else None for c in counted]
                for first, block in blocks:
                    ranked, ranks = block.local(grams)
                    for i, own in enumerate(counted):
                        if own is None:
                            continue
                        distance, most = _distances(*own, portable[i], ranks, ranked, top)
                        best = int(distance.argmin())
                        score = 1 - float(distance[best]) / most
                        if names[at + i] == UNKNOWN_YET or score > scores[at + i]:
                            names[at + i], scores[at + i] = languages[first + best], score
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(names, pa.string()), pa.array(scores, pa.float64()), batch.column(kept + 2)],
                names=[*keys, "lang_pred", "score", "__text"])

    return docs.mapInArrow(nearest, docs.schema)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keys: tuple[str, ...] = ("doc_id",),
            text: str = "text", top: int = TOP) -> DataFrame:
    """The key columns, lang_pred and score."""
    languages = sorted(profiles)
    found = docs.select(*keys, F.lit(UNKNOWN_YET).alias("lang_pred"), F.lit(0.0).alias("score"), F.col(text).alias("__text"))
    for first in range(0, len(languages), LANGUAGES_SENT):
        block = {x: profiles[x] for x in languages[first:first + LANGUAGES_SENT]}
        found = _nearest_of(found, block, keys, top)
    pred = F.when(F.col("lang_pred") == UNKNOWN_YET, UNKNOWN).otherwise(F.col("lang_pred"))
    return found.select(*keys, pred.alias("lang_pred"), "score")


def held_out(key: str = "doc_id") -> Column:
    """Rows that training leaves out: a third by the checksum of the key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score: learned from the rows that are not held out."""
    profiles = learn(docs.filter(~held_out(key)), text, language)
    rows = docs.select(key, held_out(key).alias("held_out"), text)
    return predict(rows, profiles, (key, "held_out"), text)
