"""Byte-level BPE by a tokenization automaton.

A state stands for the last token read; an arc carries a token. The automaton starts with one state
and an arc for every byte. Each merge (u, v), in order, adds one gadget: an arc u+v wherever u and
then v could be read, ending where v ended, and a cut of the arc v after u. A new state is thus a
snapshot of its right part's state, changed only by later cuts of its own. The gadgets are kept as
(left, right, time) of each arc and (state, arc) -> time of each cut; whether an arc is open after a
state follows from them by walking back in time, and is memoised, so only transitions that texts
use are ever tabulated. Exactly one path spells a word, and its arcs are the tokens of BPE.

Texts are first split at special strings and then into words by the pattern of the public
byte-level tokenizer. Decoding emits the arc labels and reads them as UTF-8 (bad bytes: U+FFFD).

Null and empty texts have no tokens; null ids decode to an empty text. Very long words take time in
proportion to their length. Rows are neither dropped nor changed
otherwise; repeated rows are encoded alike. Added columns replace columns of the same name."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words, and transitions, that a worker keeps before it starts anew; only speed depends on it.
CACHE = 250_000
#: Rows whose ids a worker holds as Python numbers at a time.
ROWS = 256

# The pattern that splits text before the merges of byte-level BPE.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]],
                 special: dict[str, int]):
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        self.left, self.right, self.time = [-1] * size, [-1] * size, [-1] * size
        self.cuts: dict[tuple[int, int], int] = {}
        self._open: dict[int, bool] = {}
        self.arcs: dict[bytes, int] = {b: t for b, t in vocabulary.items() if len(b) == 1}
        for label, t in vocabulary.items():
            self.labels[t] = label
        for time, (u, v) in enumerate(merges):
            self._add_gadget(time, vocabulary[u], vocabulary[v], vocabulary[u + v])
        self.special = special
        for text, t in special.items():
            self.labels[t] = text.encode()
        self.reach: dict[bytes, int] = {}  # the longest arc that begins with three bytes
        for label in self.arcs:
            if len(label) > 2:
                self.reach[label[:3]] = max(len(label), self.reach.get(label[:3], 0))
        self._words: dict[str, tuple[int, ...]] = {}
        self._pattern = regex.compile(WORD_PATTERN)
        self._specials = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _add_gadget(self, time: int, u: int, v: int, t: int) -> None:
        if self.time[t] >= 0:
            raise ValueError(f"two merges give token {t}")
        read = self.labels[u] in self.arcs and self.labels[v] in self.arcs and self._walk(u, v, time)
        self.cuts.setdefault((u, v), time)
        self.left[t], self.right[t], self.time[t] = u, v, time
        if read:  # otherwise u, v never stand side by side and the arc would lead nowhere
            self.arcs[self.labels[t]] = t

    def _walk(self, state: int, arc: int, now: int) -> bool:
        """Whether the arc is open after the state just before the gadget `now`."""
        time = self.time
        while True:
            cut = self.cuts.get((state, arc))
            if cut is not None and cut < now:
                return False
            made, joined = time[state], time[arc]
            if made > joined:
                state, now = self.right[state], made
            elif joined >= 0:  # of equal merges the one further left comes first
                arc, now = self.left[arc], joined + 1
            else:
                return True

    def follows(self, state: int, arc: int) -> bool:
        key = state << 32 | arc
        known = self._open.get(key)
        if known is None:
            if len(self._open) >= CACHE:
                self._open.clear()
            known = self._open[key] = self._walk(state, arc, len(self.time))
        return known

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Tokens of one word: its path, found along the longest open arcs.

        The path to a prefix is unique, so a prefix from which no arc goes on is never tried again."""
        arcs, follows, reach, n = self.arcs, self.follows, self.reach, len(word)
        path: list[int] = []
        dead, at = set(), 0
        while at < n:
            for size in range(min(n - at, reach.get(word[at:at + 3], 2)), 0, -1):
                t = arcs.get(word[at:at + size])
                if t is not None and at + size not in dead and (not path or follows(path[-1], t)):
                    path.append(t)
                    at += size
                    break
            else:
                dead.add(at)
                at -= len(self.labels[path.pop()])
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._specials.split(text) if self._specials else (text,):
            if part in self.special:
                out.append(self.special[part])
            else:
                words = self._words
                for w in self._pattern.findall(part):
                    known = words.get(w)
                    if known is None:
                        if len(words) >= CACHE:
                            words.clear()
                        known = self.encode_word(w.encode())
                        if len(w) <= 64:
                            words[w] = known
                    out += known
        return out

    def decode(self, ids) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file of byte-level BPE; built once in each Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = byte_names()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    raw = lambda s: bytes(names[c] for c in s)
    vocabulary = {raw(s): t for s, t in spec["model"]["vocab"].items() if s not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return Automaton(vocabulary, [(raw(u), raw(v)) for u, v in merges], special)


def lists(rows: list[list[int]]) -> pa.Array:
    """Lists of ids as one Arrow column, without a Python object for each id in Arrow's builder."""
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.empty(int(bounds[-1]), np.int32)
    for r, at in zip(rows, bounds[:-1], strict=True):
        flat[at:at + len(r)] = r
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))


def encode(text: Column | str, path: str) -> Column:
    """Token ids of a text column, as an array of int."""
    @arrow_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        built = automaton(path)
        for texts in batches:
            parts = [lists([built.encode(t) if t else [] for t in texts.slice(i, ROWS).to_pylist()])
                     for i in range(0, len(texts), ROWS)]
            yield pa.concat_arrays(parts or [lists([])])

    return ids(text)


def decode(ids: Column | str, path: str) -> Column:
    """The text of a column of token ids."""
    @arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        built = automaton(path)
        for rows in batches:
            bounds = rows.offsets.to_numpy()
            flat = rows.values.to_numpy(zero_copy_only=False)
            yield pa.array([built.decode(flat[a:b].tolist()) if ok else "" for a, b, ok in zip(
                bounds[:-1], bounds[1:], rows.is_valid().to_pylist(), strict=True)], pa.string())

    return text(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text", into: str = "ids",
                     decoded: str | None = None) -> DataFrame:
    """The documents with their token ids and, if a name is given for it, the text that these decode to.

    One Python worker does both; it holds the ids of few rows at a time."""
    added = [into, *([decoded] if decoded else [])]
    rest = docs.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton(path)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                rows = batch.slice(first, ROWS)
                ids = [built.encode(t) if t else [] for t in rows.column(text).to_pylist()]
                columns = [lists(ids)]
                if decoded:
                    columns.append(pa.array([built.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *added])

    schema = StructType([*rest.schema.fields, StructField(into, ArrayType(IntegerType()), False),
                         *([StructField(decoded, StringType(), False)] if decoded else [])])
    return rest.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The documents with the text of their token ids."""
    return docs.withColumn(into, decode(F.col(ids), path))
