"""Document fingerprints: every shingle hash below a fixed fraction of all hashes.

A fingerprint is the ascending set of the 64-bit hashes of a text's five-word shingles that lie below
`fraction` of the hash range. The bound is the same for all texts, so fingerprints merge by union
(the fingerprint of two texts' shingles taken together), and the shares of common hashes estimate
resemblance and, for texts of any unequal sizes, containment. A text none of whose hashes lies below
the bound keeps its least hash alone; a union drops such hashes as soon as it holds one below the
bound, and so merges the same way.

Words are runs other than space and U+0009 to U+000D, as they are written. A text of fewer words is
one shingle; a null text is an empty one, and texts without words have an empty fingerprint. The
likeness of two fingerprints is the share of common hashes among all (1 if both are empty). The share
of a document's hashes that the other holds is null where none of its hashes lies below the bound.

`against_edits` compares each document with an edited text of its own and with the next document.
Rows follow one another by id, null first, rows of one id by a hash of the text; equal rows follow
themselves, the last of them the next text. The last row is followed by the first, a lone row by
itself. An empty table gives none. Texts are shuffled once: ids and hashes alone are numbered first,
every so many-th of them bounds a block, and each text goes to its block (the first of a block to the
one before as well), where neighbours meet in order. Rows repeated beyond HOT times are counted
before they are sent. Tasks get the bounds and the often repeated names, MOST_BLOCKS of either at
most, 25 bytes each. Only the named columns are read."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, slices
from codestrata.llm.words import Words
from codestrata.operators.ranking import numbered

SHINGLE = 5
#: One hash in so many is retained.
FRACTION = 8
#: Rows of a block, unless there would be more than MOST_BLOCKS.
BLOCK_ROWS, MOST_BLOCKS = 1000, 1 << 20
#: Rows of one id and text that are sent one by one.
HOT = 1000


def limit(fraction: int = FRACTION) -> int:
    return ((1 << 64) - 1) // fraction


def retain(hashes: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The fingerprint of these shingle hashes, or the union of the fingerprints that they come from."""
    below = np.unique(hashes[hashes < np.uint64(limit(fraction))])
    return below if len(below) or not len(hashes) else hashes.min(keepdims=True)


def fingerprints(texts: pa.Array, fraction: int = FRACTION) -> list[np.ndarray]:
    found = []
    for first, end, data, bounds in slices(texts):
        h, text = Words(data, bounds, fold=False).shingles(SHINGLE)
        at = np.searchsorted(text, np.arange(end - first + 1))
        found += [retain(h[a:b], fraction) for a, b in zip(at[:-1], at[1:], strict=True)]
    return found


def packed(fingerprint: np.ndarray) -> bytes:
    return fingerprint.astype(">u8").tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def contained(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> float | None:
    """The share of a's shingles that b holds, as far as the retained ones tell."""
    if not len(a) or a[0] >= np.uint64(limit(fraction)):
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def _names(null: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """25 bytes that sort as (null first, id, a, b)."""
    out = np.empty((len(ids), 25), np.uint8)
    out[:, 0] = ~null
    for n, x in enumerate((np.where(null, 0, ids), a, b)):
        out[:, 1 + 8 * n:9 + 8 * n] = (x.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S25").ravel()


def _names_of(columns: list[pa.Array]) -> np.ndarray:
    ids, a, b = columns
    return _names(ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(),
                  a.to_numpy(), b.to_numpy())


def _dealer(bounds: np.ndarray, often: np.ndarray):
    """block of a row, whether it is its first name, whether it is often repeated."""
    @F.arrow_udf("block int, first boolean, often boolean")
    def deal(ids: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        names = _names_of([ids, a, b])
        block = np.searchsorted(bounds, names, "right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(block.astype(np.int32)), pa.array(bounds[block] == names), pa.array(np.isin(names, often))],
            names=["block", "first", "often"])

    return deal


_OUT = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, held_by_edited double, held_by_next double")


def _follow(fraction: int):
    """Rows of (block, border, id, times, text) in order -> what each shares with its next."""
    def compared(rows: list[tuple], prints: list[np.ndarray]) -> pa.RecordBatch:
        """All rows but the last, each against the one behind it (if of the same block)."""
        chosen = []  # (row, next row)
        for n, row in enumerate(rows[:-1]):
            if row[1]:
                continue  # a border is there for the row before it alone
            chosen += [(n, n)] * (row[3] - 1)
            if rows[n + 1][0] == row[0]:
                chosen.append((n, n + 1))
        edited = []
        for n, following in chosen:
            text, half = rows[n][4], len(rows[n][4]) // 2
            edited.append(text[:len(text) - half] + rows[following][4][:half])
        other = fingerprints(pa.array(edited, pa.large_string()), fraction)
        text_of = lambda f: base64.b64encode(packed(f)).decode()
        own, after = [prints[n] for n, _ in chosen], [prints[m] for _, m in chosen]
        columns = [
            pa.array([rows[n][2] for n, _ in chosen], pa.int64()), pa.array([len(rows[n][4]) for n, _ in chosen], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array(map(text_of, own), pa.string()), pa.array(map(text_of, other), pa.string()),
            *(pa.array([share(x, y) for x, y in zip(own, z, strict=True)], pa.float64())
              for share in (likeness, lambda x, y: contained(x, y, fraction)) for z in (other, after))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        prints: list[np.ndarray] = []
        for batch in batches:
            for first, end, _, _ in slices(batch.column(4)):
                part = batch.slice(first, end - first)
                held += list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                prints += fingerprints(part.column(4), fraction)
                yield compared(held, prints)
                held, prints = held[-1:], prints[-1:]

    return run


def against_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", fraction: int = FRACTION,
                  block_rows: int = BLOCK_ROWS, hot: int = HOT) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and what they share.

    The edited text ends in the first code points of the next document instead of its own last half
    (in fewer, if that has fewer)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    name = [F.col("id").isNull(), F.col("id"), F.col("text")]
    named = rows.select("id", "text", F.xxhash64(*name).alias("a"), F.xxhash64(F.lit(1), *name).alias("b"))
    once = named.groupBy("a", "b").agg(F.first("id").alias("id"), F.count("*").alias("times"))
    places = cut(numbered(once, [F.col("id").asc_nulls_first(), "a", "b"], "place"))
    n, total = places.agg(F.count("*"), F.sum("times")).first()
    size = max(block_rows, n // MOST_BLOCKS + 1)
    starts = places.filter((F.col("place") - 1) % size == 0).orderBy("place")
    repeated = places.filter(F.col("times") > max(hot, (total or 0) // MOST_BLOCKS))
    bounds, often = (_names_of([c.combine_chunks() for c in x.select("id", "a", "b").toArrow().columns]) for x in (starts, repeated))
    if not len(bounds):
        return docs.sparkSession.createDataFrame([], _OUT).withColumnRenamed("id", key)

    dealt = named.withColumn("d", _dealer(bounds, often)("id", "a", "b"))
    sent = dealt.filter("NOT d.often").select("id", "a", "b", "text", "d", F.lit(1).cast("long").alias("times"))
    if len(often):
        sent = sent.unionByName(dealt.filter("d.often").groupBy("a", "b").agg(
            F.first("id").alias("id"), F.first("text").alias("text"), F.first("d").alias("d"), F.count("*").alias("times")))
    here = F.struct(F.col("d.block").alias("block"), F.lit(False).alias("border"))
    before = F.struct(F.pmod(F.col("d.block") - 1, F.lit(len(bounds))).alias("block"), F.lit(True).alias("border"))
    goes = F.explode(F.when(F.col("d.first"), F.array(here, before)).otherwise(F.array(here)))
    met = (sent.select("id", "a", "b", "text", "times", goes.alias("to")).select("to.*", "id", "a", "b", "times", "text")
           .repartition("block").sortWithinPartitions("block", "border", F.col("id").asc_nulls_first(), "a", "b"))
    return (met.select("block", "border", "id", "times", "text").mapInArrow(_follow(fraction), _OUT)
            .withColumnRenamed("id", key))
