"""Ranked lexical search: the best documents for each item of a query set.

A term is a run of ASCII letters and digits and of all characters beyond ASCII, A-Z folded, known by
its 64-bit hash. With N documents that hold a term, L terms in all, df documents of a term, tf its
occurrences in a document of n terms, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))) and a
document m = 100 - 75 + 75 n N div L; the score is the sum over the item's terms, repeats included, of
w * (10**9 tf div (1000 tf + 8 m)), in whole numbers.

Documents are indexed where they are read: each task writes segments of up to SEGMENT_DOCS documents
or POSTINGS postings, a posting list (document, tf) for each term that some item asks for. Segments
are stored; N, L and df are sums over them. Then every task searches its own segments for all items,
carrying the kth score of an item from segment to segment; the best of all tasks are merged by item.

Search in a segment is a hybrid. The short lists of an item are merged term at a time: their summed
scores, in document order, form one list of accumulators whose greatest sum bounds it. It then takes
part, as one iterator among the long lists, in a document-at-a-time pass over windows of documents.
Each iterator has a bound in every window. Windows whose bounds sum up to less than the kth score are
skipped; in the others the iterators of small bounds, which together stay below it, are only looked
up for documents that the rest have brought within reach. A bound equal to the kth score never ends a
search, so ties are whole. Lists of weight 0 add nothing to any score.

Items are taken in blocks of about ITEM_TERMS (item, term) pairs, which bound what the tasks are sent
and what the driver holds; each block reads the documents anew. Rows with the same item id and text
are one item; rows of one id and different texts are ranked each for itself. A null text has no term,
and neither is it counted in N nor found. Equal scores go to the smaller doc_id, null last; repeated
rows are documents of their own. Empty tables give no rows. Only the named columns are read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut, slices
from codestrata.llm.words import Words

K = 10
SEGMENT_DOCS, POSTINGS = 1 << 16, 1 << 22
ITEM_TERMS = 1 << 18
#: A list of at most one document in so many of its segment is short.
SHORT = 64
#: Documents that the long lists are walked by at a time.
WINDOW = 4096

OUTSIDE = np.ones(256, bool)
OUTSIDE[128:] = False
for _a, _b in ("09", "AZ", "az"):
    OUTSIDE[ord(_a):ord(_b) + 1] = False


def items_of(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, name, term, times): the terms of each item; name tells items of one id apart."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in slices(batch.column(2)):
                words = Words(data, bounds, fold=True, outside=OUTSIDE)
                found, times = np.unique(np.stack((words.text.astype(np.uint64), words.hashes)), axis=1, return_counts=True)
                rows = pa.array(found[0].astype(np.int64) + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found[1].view(np.int64)), pa.array(times)],
                    names=["item_id", "name", "term", "times"])

    rows = queries.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    return rows.select("item_id", F.xxhash64("item_id", "text").alias("name"), "text").mapInArrow(
        terms, "item_id long, name long, term long, times long")


@dataclass
class Building:
    """The documents and postings of the segment that a task is at."""
    ids: list = field(default_factory=list)
    sizes: list = field(default_factory=list)
    docs: list = field(default_factory=list)
    terms: list = field(default_factory=list)
    tfs: list = field(default_factory=list)
    n_docs: int = 0
    n_postings: int = 0


_SEGMENT = ("n_docs long, n_terms long, ids array<long>, sizes binary, terms array<int>, counts array<long>, "
            "docs binary, tfs binary")


def segments(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray,
             most_docs: int = SEGMENT_DOCS, most_postings: int = POSTINGS) -> DataFrame:
    """A row a segment: ids and sizes of its documents, and for each term of the ascending hashes
    `vocabulary` that occurs (by its number) the count of its postings; docs and tfs hold the lists
    one after the other, as 32-bit numbers."""
    names = [c.split()[0] for c in _SEGMENT.split(", ")]

    def flush(b: Building) -> pa.RecordBatch:
        sizes = np.concatenate(b.sizes)
        docs, terms, tfs = (np.concatenate(x) for x in (b.docs, b.terms, b.tfs))
        order = np.argsort(terms, kind="stable")  # documents ascend already
        found, counts = np.unique(terms, return_counts=True)
        ids = pa.chunked_array(b.ids).combine_chunks()
        one = lambda x, t: pa.array([x], t)
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([
            one(int((sizes > 0).sum()), pa.int64()), one(int(sizes.sum()), pa.int64()), whole(ids),
            one(sizes.astype(np.int64).tobytes(), pa.binary()), whole(pa.array(found.astype(np.int32))),
            whole(pa.array(counts.astype(np.int64))), one(docs[order].astype(np.int32).tobytes(), pa.binary()),
            one(tfs[order].astype(np.int32).tobytes(), pa.binary())], names=names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Building()
        for batch in batches:
            for first, end, data, bounds in slices(batch.column(1)):
                words = Words(data, bounds, fold=True, outside=OUTSIDE)
                number = np.minimum(np.searchsorted(vocabulary, words.hashes), max(0, len(vocabulary) - 1))
                asked = np.flatnonzero(vocabulary[number] == words.hashes) if len(vocabulary) else np.empty(0, np.int64)
                pair, tf = np.unique(words.text[asked] * len(vocabulary) + number[asked], return_counts=True)
                b.ids.append(batch.column(0).slice(first, end - first))
                b.sizes.append(words.per_text)
                b.docs.append(pair // max(1, len(vocabulary)) + b.n_docs)
                b.terms.append(pair % max(1, len(vocabulary)))
                b.tfs.append(tf)
                b.n_docs += end - first
                b.n_postings += len(pair)
                if b.n_docs >= most_docs or b.n_postings >= most_postings:
                    yield flush(b)
                    b = Building()
        if b.n_docs:
            yield flush(b)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(index, _SEGMENT)


@dataclass
class Items:
    """A block of items: item i asks for terms[at[i]:at[i + 1]], `times` each."""
    ids: list
    names: list
    at: np.ndarray
    terms: np.ndarray
    times: np.ndarray


@dataclass
class Postings:
    """An iterator: ascending documents, the score that each gives per unit of weight."""
    docs: np.ndarray
    impacts: np.ndarray
    weight: int
    #: first posting of each window, and the greatest impact there
    at: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)

    def by_windows(self, n_docs: int) -> Postings:
        self.at = np.searchsorted(self.docs, np.arange(0, n_docs + WINDOW, WINDOW))
        own = np.flatnonzero(np.diff(self.at))
        self.most = np.zeros(len(self.at) - 1, np.int64)
        if len(own):
            self.most[own] = np.maximum.reduceat(self.impacts, self.at[own])
        return self


@dataclass
class Best:
    """The k best documents of an item: scores fall, ids rise among equals (null, last, is the greatest)."""
    k: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int64))

    @property
    def kth(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids[:, 1], ids[:, 0], -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]


class Segment:
    def __init__(self, row: dict, n_documents: int, n_terms: int):
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.n_docs = len(sizes)
        ids = row["ids"]
        self.ids = np.stack((np.array([i is None for i in ids], np.int64),
                             np.array([0 if i is None else i for i in ids], np.int64)), 1) if ids else np.empty((0, 2), np.int64)
        distinct, which = np.unique(sizes, return_inverse=True)
        m = np.array([25 + 75 * int(n) * n_documents // max(1, n_terms) for n in distinct], np.int64)[which] if len(sizes) else sizes
        self.docs = np.frombuffer(row["docs"], np.int32)
        tf = np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.numbers = np.array(row["terms"], np.int64)
        self.ends = np.cumsum(np.array(row["counts"], np.int64))
        self._lists: dict[int, Postings] = {}

    def list_of(self, place: int, weight: int) -> Postings:
        a, b = (int(self.ends[place - 1]) if place else 0), int(self.ends[place])
        known = self._lists.get(place)
        if known is None:
            known = self._lists[place] = Postings(self.docs[a:b], self.impacts[a:b], 1).by_windows(self.n_docs)
        one = Postings(known.docs, known.impacts, weight)
        one.at, one.most = known.at, known.most
        return one

    def accumulators(self, places: np.ndarray, weights: np.ndarray) -> Postings:
        """The summed scores of the short lists, term at a time, as one iterator."""
        spans = [(int(self.ends[p - 1]) if p else 0, int(self.ends[p])) for p in places]
        docs = np.concatenate([self.docs[a:b] for a, b in spans])
        scores = np.concatenate([self.impacts[a:b] * w for (a, b), w in zip(spans, weights, strict=True)])
        order = np.argsort(docs, kind="stable")
        docs, scores = docs[order], scores[order]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        return Postings(docs[first], np.add.reduceat(scores, first), 1).by_windows(self.n_docs)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds the documents of this segment to `best`; returns how many windows were looked into."""
        places = np.searchsorted(self.numbers, terms)
        here = places < len(self.numbers)
        here[here] = self.numbers[places[here]] == terms[here]
        here &= weights > 0
        places, weights = places[here], weights[here]
        if not len(places):
            return 0
        lengths = self.ends[places] - np.where(places > 0, self.ends[places - 1], 0)
        short = lengths * SHORT <= self.n_docs
        iterators = [self.list_of(int(p), int(w)) for p, w in zip(places[~short], weights[~short], strict=True)]
        if short.any():
            iterators.append(self.accumulators(places[short], weights[short]))
        bounds = np.stack([i.most * i.weight for i in iterators])
        looked = 0
        for window in np.flatnonzero(bounds.sum(0) >= best.kth):
            order = np.argsort(bounds[:, window], kind="stable")
            sums = np.cumsum(bounds[order, window])
            if sums[-1] < best.kth:  # the kth score has risen since
                continue
            looked += 1
            helpers = int(np.searchsorted(sums, best.kth))  # these alone stay below the kth score
            low = int(window) * WINDOW
            scores = np.zeros(min(WINDOW, self.n_docs - low), np.int64)
            for i in order[helpers:]:
                it = iterators[i]
                a, b = it.at[window], it.at[window + 1]
                scores[it.docs[a:b] - low] += it.weight * it.impacts[a:b]
            found = np.flatnonzero(scores)
            for j in range(helpers - 1, -1, -1):
                found = found[scores[found] + sums[j] >= best.kth]
                it = iterators[order[j]]
                a, b = it.at[window], it.at[window + 1]
                if not len(found) or a == b:
                    continue
                docs = it.docs[a:b]
                at = np.minimum(np.searchsorted(docs, found + low), len(docs) - 1)
                hit = docs[at] == found + low
                scores[found[hit]] += it.weight * it.impacts[a:b][at[hit]]
            found = found[scores[found] >= best.kth]
            best.add(scores[found], self.ids[found + low])
        return looked


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def _best_of_tasks(stored: DataFrame, items: Items, weights: np.ndarray, n_documents: int, n_terms: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch.slice(i, 1).to_pylist()[0], n_documents, n_terms)
                for n, b in enumerate(best):
                    one = slice(items.at[n], items.at[n + 1])
                    segment.search(items.terms[one], weights[items.terms[one]] * items.times[one], b)
        per = np.array([len(b.scores) for b in best], np.int64)
        which = pa.array(np.repeat(np.arange(len(best)), per))
        ids = np.concatenate([b.ids for b in best])
        yield pa.RecordBatch.from_arrays([
            pa.array(items.ids, pa.int64()).take(which), pa.array(items.names, pa.int64()).take(which),
            pa.array(ids[:, 1], mask=ids[:, 0] == 1), pa.array(np.concatenate([b.scores for b in best]))],
            names=["item_id", "name", "doc_id", "score"])

    return stored.select("sizes", "ids", "terms", "counts", "docs", "tfs").mapInArrow(
        run, "item_id long, name long, doc_id long, score long")


def _block(docs: DataFrame, rows: pa.Table, key: str, text: str, k: int, most_docs: int) -> DataFrame:
    rows = rows.combine_chunks().sort_by([("name", "ascending"), ("item_id", "ascending"), ("term", "ascending")])
    names, hashes = rows.column("name").to_numpy(), rows.column("term").to_numpy().view(np.uint64)
    ids = rows.column("item_id").to_pylist()
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    first = np.flatnonzero(np.diff(names, prepend=names[0] - 1 if names[0] > -(1 << 63) else names[0] + 1))
    items = Items([ids[i] for i in first], [int(names[i]) for i in first], np.append(first, len(names)),
                  terms, rows.column("times").to_numpy())
    stored = cut(segments(docs, key, text, vocabulary, most_docs))
    total = stored.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_documents, n_terms = total[0] or 0, total[1] or 0
    counted = (stored.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
               .groupBy("t.terms").agg(F.sum("t.counts").alias("df")).toArrow())
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), strict=True):
        weights[term] = weight(n_documents, df)
    return _best_of_tasks(stored, items, weights, n_documents, n_terms, k)


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = K, item_terms: int = ITEM_TERMS, most_docs: int = SEGMENT_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    asked = cut(items_of(queries, item, item_text))
    blocks = -(-asked.count() // item_terms)
    found = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).toArrow()
        if rows.num_rows:
            found.append(_block(docs, rows, key, text, k, most_docs))
    if not found:
        found = [docs.sparkSession.createDataFrame([], "item_id long, name long, doc_id long, score long")]
    by = Window.partitionBy("item_id", "name").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return (reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
