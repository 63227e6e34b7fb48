"""Removal of repeated byte strings by longest-previous-factor arrays.

A start is a byte position at which `length` bytes of a text begin. Equal strings of that length hold
the same least hash among their half-length grams, so
1. every text is cut into runs of neighbouring starts with the same least gram; runs are grouped by
   gram. Groups of one run hold no repeat and go, unless the run has its gram twice.
2. Runs of equal bytes (same gram, same hash of all bytes that their strings cover) are one class:
   all its starts repeat, its first run is the earliest.
3. Where a gram has several classes (or occurs twice in a run), one run of each is fetched and suffix-sorted with the others of
   its gram: prefix doubling gives ranks, ranks the suffix order and common prefixes, and the
   previous and next smaller position in suffix order the longest previous factor of every start.
   A start whose factor has `length` bytes or more repeats an earlier one.
4. A gram with more than `most` classes (a string that very many texts share, each in other
   surroundings) is not sorted in one task: its starts are grouped by the hash of their string over
   all tasks, with partial counts; the least position of a group is the earliest. Only starts whose
   band of neighbours shares its bytes with another band get that far; strings that hold the gram
   twice are bands of their own.
With keep_first, bytes covered by strings that stand earlier too are removed and the first copy
stays; without, every copy goes (a source of a factor is marked as well). Earlier means: smaller
(doc_id, text hash, position).

Null texts are empty. Matches never cross texts. Rows that repeat id and text are copies of one
another. Only the two named columns are read; extra columns come back through `rest`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from codestrata.llm.common import cut, slices
from codestrata.llm.words import BYTES, mix, powers

#: Classes of a gram that are sorted together in one task.
MOST_CLASSES = 1000
#: Neighbouring starts of a spread gram that are looked at together first.
BAND = 32
#: Bytes of runs that a task sorts at a time; the runs of one gram stay together.
SORT_BYTES = 2 << 20

_ROW = ["id", "h"]


class Hashes:
    """Hashes of any byte range of one array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * power[:len(data)], out=self.sums[1:])

    def of(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        h = (self.sums[at + length] - self.sums[at]) * self.inverse[at]
        return mix(h + np.asarray(length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, gram, hash of the covered bytes, whether the gram occurs twice
    in them) of every run."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2 + (np.empty(0, bool),)
    if len(data) < length:
        return none
    hashes = Hashes(data)
    gram = max(1, length // 2)
    n = len(data) - length + 1
    width = length - gram + 1
    grams = hashes.of(np.arange(len(data) - gram + 1), gram)
    least = sliding_least(grams, width)
    starts = np.arange(n)
    text = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + length <= bounds[text + 1]
    new = np.ones(n + 1, bool)
    new[1:n] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    at = np.flatnonzero(new[:n] & inside)
    if not len(at):
        return none
    ends = np.flatnonzero(inside & (new[1:] | ~np.append(inside[1:], False)))
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)
    first = at + (windows[at] == least[at, None]).argmax(1)
    last = ends + width - 1 - (windows[ends] == least[at, None])[:, ::-1].argmax(1)
    return (text[at], at - bounds[text[at]], ends - bounds[text[at]], least[at],
            hashes.of(at, ends - at + length), first < last)


class Suffixes:
    """Ranks of all positions of an array by their first 8, 16, 32, … bytes, by prefix doubling."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        n = len(data)
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | self.data[j:n + j]
        self.levels = [(8, np.unique(key, return_inverse=True)[1].astype(np.int64))]
        while 2 * self.levels[-1][0] <= depth:
            width, rank = self.levels[-1]
            self.levels.append((2 * width, self._joined(rank, width)))

    @staticmethod
    def _joined(rank: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        if step < len(rank):
            after[:-step] = rank[step:] + 1
        return np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)

    def order(self, positions: np.ndarray, depth: int) -> np.ndarray:
        """The positions by their first `depth` bytes."""
        width, rank = self.levels[-1]
        if depth < width:  # less than eight bytes
            return positions[np.argsort(rank[positions], kind="stable")]
        later = np.minimum(positions + depth - width, len(rank) - 1)
        return positions[np.lexsort((rank[later], rank[positions]))]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each two positions, up to `most`."""
        n, out, last = len(self.data) - 8, np.zeros(len(x), np.int64), len(self.data) - 9
        for width, rank in reversed(self.levels):
            for _ in range(2 if width == self.levels[-1][0] else 1):
                a, b = x + out, y + out
                out += width * ((a < n) & (b < n) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)]))
        open_ = np.ones(len(x), bool)
        for _ in range(8):
            a, b = np.minimum(x + out, last), np.minimum(y + out, last)
            open_ &= self.data[a] == self.data[b]
            out += open_
        return np.minimum(out, most)


def nearest_smaller(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the order the nearest place before, and after, that holds a smaller position
    (-1 and n where there is none), by jumping along places already known to be passed."""
    n = len(order)
    held = np.concatenate((order, [-1]))  # place n (also -1) ends every walk
    before = np.arange(n) - 1
    after = np.arange(1, n + 1)
    for jump in (before, after):
        moving = np.flatnonzero(held[jump] > order)
        while len(moving):
            jump[moving] = jump[jump[moving]]
            moving = moving[held[jump[moving]] > order[moving]]
    return before, after


def previous_factors(data: np.ndarray, positions: np.ndarray, most: np.ndarray, depth: int
                     ) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest previous factor of each position: the longest string there that
    also begins at a smaller one of the positions, and where. most: bytes of each position's text
    from it on; lengths beyond `depth` may come out shorter."""
    suffixes = Suffixes(data, depth)
    room = np.zeros(len(data), np.int64)
    room[positions] = most
    order = suffixes.order(positions, depth)
    length, source = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
    for near in nearest_smaller(order):
        there = (near >= 0) & (near < len(order))
        x, y = order[there], order[near[there]]
        common = suffixes.common(x, y, np.minimum(room[x], room[y]))
        better = common > length[x]
        length[x[better]], source[x[better]] = common[better], y[better]
    return length[positions], source[positions]


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers, as (first, last)."""
    gaps = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, gaps + 1)].tolist(), starts[np.append(gaps, len(starts) - 1)].tolist(),
                    strict=True)) if len(starts) else []


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, h (hash of the text) and the text's bytes."""
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64(bytes_).alias("h"), bytes_.alias("bytes"))


def _run_table(keyed: DataFrame, length: int) -> DataFrame:
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in slices(batch.column(2)):
                text, lo, hi, gram, cover, twice = runs(data, bounds, length)
                rows = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c).take(pa.array(text)) for c in (0, 1)), pa.array(lo), pa.array(hi),
                     pa.array(gram.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(twice)],
                    names=["id", "h", "lo", "hi", "gram", "cover", "twice"])

    return keyed.filter(F.length("bytes") >= length).mapInArrow(
        cut_up, "id long, h long, lo long, hi long, gram long, cover long, twice boolean")


def bands(hashes: Hashes, lo: int, hi: int, gram: int, length: int) -> list[tuple[int, int, int, list[int]]]:
    """(first start, gram, hash of what the band's strings share, hash of each string) of a run, in
    bands counted from the gram, so that equal strings lie in bands of equal hash. A string that holds
    the gram twice has no one place to count from and is a band of its own; the string alone decides."""
    starts, width = np.arange(lo, hi + 1), max(1, length // 2)
    strings = hashes.of(starts, length)
    near = np.arange(lo, hi + length - width + 1)
    held = near[hashes.of(near, width).view(np.int64) == gram]
    first = np.searchsorted(held, starts)
    once = np.searchsorted(held, starts + length - width, "right") - first == 1
    if length <= BAND:
        once[:] = False
    place = held[np.minimum(first, len(held) - 1)]
    number = (place - starts) // BAND
    shared = strings.copy()
    shared[once] = hashes.of((place - BAND * number)[once], length - BAND + 1) + number[once].astype(np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = ~(once[1:] & once[:-1] & (place[1:] == place[:-1]) & (number[1:] == number[:-1]))
    cuts = np.append(np.flatnonzero(new), len(starts))
    return [(int(starts[a]), gram, int(shared[a:a + 1].view(np.int64)[0]), strings[a:b].view(np.int64).tolist())
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _fetch(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(id, h, lo, gram, band, strings, piece): the bytes of the wanted runs. For spread grams, instead
    of bytes, bands of neighbouring starts: a hash of the bytes that all strings of the band hold, and
    the hash of each string."""
    lists = wanted.groupBy(*_ROW).agg(F.collect_list(F.struct("lo", "hi", "gram", "spread")).alias("runs"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                hashes = None
                out: list[list] = [[], [], [], [], []]
                for r in batch.column(3)[i].as_py():
                    if not r["spread"]:
                        piece = data[r["lo"]:r["hi"] + length].tobytes()
                        rows = [(r["lo"], r["gram"], None, None, piece)]
                    else:
                        hashes = hashes or Hashes(data)
                        rows = [(*band, None) for band in bands(hashes, r["lo"], r["hi"], r["gram"], length)]
                    for row in rows:
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                n = len(out[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[i].as_py()] * n, pa.int64()) for c in (0, 1)]
                    + [pa.array(c, pa.int64()) for c in out[:3]]
                    + [pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.binary())],
                    names=["id", "h", "lo", "gram", "band", "strings", "piece"])

    return keyed.join(lists, _ROW).select("id", "h", "bytes", "runs").mapInArrow(
        take, "id long, h long, lo long, gram long, band long, strings array<long>, piece binary")


def _sorted_repeats(pieces: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(id, h, lo, hi): repeating starts among the runs of each gram."""
    def factors(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        keys = [rows.column(c).to_numpy() for c in ("id", "h", "lo")]
        order = np.lexsort(keys[::-1])
        fresh = np.ones(len(order), bool)  # repeated rows bring a run twice
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        rows = rows.take(pa.array(order[fresh]))
        piece = [np.frombuffer(b.as_buffer(), np.uint8) for b in rows.column("piece").combine_chunks()]
        sizes = np.array([len(b) for b in piece])
        at = np.concatenate(([0], np.cumsum(sizes)))
        n_starts = sizes - length + 1
        owner = np.repeat(np.arange(len(piece)), n_starts)
        position = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(n_starts)))[owner] + at[owner]
        found, source = previous_factors(np.concatenate(piece), position, at[owner + 1] - position, length)
        hit = np.zeros(at[-1], bool)
        hit[position[found >= length]] = True
        if not keep_first:
            hit[source[found >= length]] = True
        out: list[tuple] = []
        for i in np.unique(owner[hit[position]]):
            lo = rows.column("lo")[i].as_py()
            own = np.flatnonzero(hit[at[i]:at[i] + n_starts[i]])
            out += [(rows.column("id")[i].as_py(), rows.column("h")[i].as_py(), lo + a, lo + b) for a, b in _spans(own)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "h", "lo", "hi"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, batch.num_rows)
            bytes_ = np.concatenate(([0], np.cumsum(np.array([len(b.as_buffer()) for b in batch.column("piece")]))))
            first = 0
            for end in ends:  # a gram may go on from the batch before, so flush before a new one begins
                if held and size >= SORT_BYTES and held[-1].column("gram")[-1].as_py() != gram[first]:
                    yield factors(pa.concat_tables(held))
                    held, size = [], 0
                held.append(pa.Table.from_batches([batch.slice(first, end - first)]))
                size += bytes_[end] - bytes_[first]
                first = end
        if held:
            yield factors(pa.concat_tables(held))

    return (pieces.filter("piece IS NOT NULL").repartition("gram").sortWithinPartitions("gram")
            .select("id", "h", "lo", "gram", "piece").mapInArrow(sort, "id long, h long, lo long, hi long"))


def _spread_repeats(pieces: DataFrame, keep_first: bool) -> DataFrame:
    """(id, h, lo, hi): repeating starts of grams that are not sorted in one task."""
    bands_ = pieces.filter("band IS NOT NULL").dropDuplicates(["id", "h", "gram", "lo"])
    met = bands_.groupBy("gram", "band").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    starts = bands_.join(met, ["gram", "band"]).select(
        "id", "h", "lo", "gram", F.posexplode("strings").alias("step", "string")).select(
        "id", "h", (F.col("lo") + F.col("step")).alias("lo"), "gram", "string")
    place = F.struct("id", "h", "lo")
    groups = starts.groupBy("gram", "string").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    hits = starts.join(groups, ["gram", "string"])
    if keep_first:
        hits = hits.filter(place != F.col("first"))
    return hits.select("id", "h", "lo", F.col("lo").alias("hi"))


def repeats(docs: DataFrame, key: str, text: str, length: int, keep_first: bool,
            most: int = MOST_CLASSES) -> DataFrame:
    """(id, h, starts): the repeating starts of each text, as (lo, hi) runs."""
    keyed = _keyed(docs, key, text)
    table = _run_table(keyed, length)
    grams = table.groupBy("gram").agg(
        F.count("*").alias("n"), (F.expr("min(cover) < max(cover) OR bool_or(twice)")).alias("mixed"))
    shared = cut(table.drop("twice").join(grams.filter("n > 1 OR mixed").select("gram", "mixed"), "gram"))
    run = F.struct("id", "h", "lo", "hi")
    classes = shared.groupBy("gram", "cover").agg(
        F.count("*").alias("n"), F.min(run).alias("first"), F.first("mixed").alias("mixed"))
    copies = shared.join(classes.filter("n > 1").select("gram", "cover", "first"), ["gram", "cover"])
    if keep_first:
        copies = copies.filter(run != F.col("first"))
    mixed = classes.filter("mixed")
    counts = mixed.groupBy("gram").agg((F.count("*") > most).alias("spread"))
    wanted = mixed.join(counts, "gram").select("first.*", "gram", "spread")
    pieces = cut(_fetch(keyed, wanted, length))
    found = (copies.select(*_ROW, "lo", "hi").unionByName(_sorted_repeats(pieces, length, keep_first))
             .unionByName(_spread_repeats(pieces, keep_first)))
    return found.groupBy(*_ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))


def _kept_parts(whole_characters: bool, length: int):
    """(n_removed, n_spans, parts): what stays of a text after its repeating starts' strings go."""
    @arrow_udf("removed long, spans long, parts array<struct<at:int,size:int>>")
    def parts(starts: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for own, bytes_ in zip(starts.to_pylist(), data, strict=True):
            n = len(bytes_.as_buffer())
            spans: list[list[int]] = []
            for x in sorted(own, key=lambda x: x["lo"]):
                if spans and x["lo"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x["hi"] + length)
                else:
                    spans.append([x["lo"], x["hi"] + length])
            if whole_characters:  # a character that is only partly covered stays
                raw = np.frombuffer(bytes_.as_buffer(), np.uint8)
                inner = lambda i: i < n and raw[i] & 0xC0 == 0x80
                for span in spans:
                    while inner(span[0]):
                        span[0] += 1
                    while inner(span[1]):
                        span[1] -= 1
                spans = [s for s in spans if s[0] < s[1]]
            ends = [0, *(b for _, b in spans)]
            begins = [*(a for a, _ in spans), n]
            out.append({"removed": sum(b - a for a, b in spans), "spans": len(spans),
                        "parts": [{"at": a + 1, "size": b - a} for a, b in zip(ends, begins, strict=True) if a < b]})
        return pa.array(out, pa.struct([("removed", pa.int64()), ("spans", pa.int64()), (
            "parts", pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32())])))]))

    return parts


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400,
                   keep_first: bool = True, whole_characters: bool = True, rest: tuple[str, ...] = ()) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (bytes), and the columns named in `rest`."""
    found = repeats(docs, key, text, length, keep_first)
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key), F.struct(*rest).alias("__rest") if rest else F.lit(None).alias("__rest"), bytes_.alias("__bytes"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(bytes_).alias("h"))
    joined = rows.join(found, _ROW, "left")
    parts = F.when(F.col("starts").isNotNull(), _kept_parts(whole_characters, length)(
        F.coalesce("starts", F.array().cast("array<struct<lo:long,hi:long>>")),
        F.when(F.col("starts").isNotNull(), F.col("__bytes")).otherwise(F.lit(b""))))
    piece: Column = F.expr("aggregate(transform(__p.parts, p -> substring(__bytes, p.at, p.size)), X'', (s, b) -> concat(s, b))")
    return joined.withColumn("__p", parts).select(
        key, F.length("__bytes").cast("long").alias("n_bytes"),
        F.coalesce("__p.removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__p.spans", F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("starts").isNull(), F.col("__bytes")).otherwise(piece).alias("kept"),
        *([f"__rest.{c}" for c in rest]))
