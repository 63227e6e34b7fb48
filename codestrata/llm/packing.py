"""Hierarchical packing of token sequences into windows of several sizes.

Every document's ids, closed by an end id, are cut into full windows; what remains is routed to the
shortest tier that holds it. Tiers are then packed from long to short: a window opens with the
longest piece left, and the gap is filled from shorter tiers, best fit first; a gap that no whole
piece fits is closed by cutting the shortest longer piece. What the last window of a lane cannot
fill is cut into powers of two, so no window has padding. A lane is one Spark partition: rows are
packed as they stream through the task, at most `buffer` remainders are held, and there is no
shuffle. Windows are dealt to step groups of nearly equal numbers of tokens (longest first, each to
the group with the fewest), so steps of different tiers cost the same.

Null and empty texts are one piece holding the end id. Repeated rows and ids are packed once for
each row. Windows are numbered by (lane, order in the lane). The rows of a lane must not change
between attempts of its task: pass a stored table or a checkpoint, as files keep their order."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.bpe import WORD_PATTERN, automaton, byte_names

#: Tokens of one step of training, over which windows are balanced.
STEP_TOKENS = 16 * 1024
#: Remainders that a task holds before it packs them.
BUFFER_PIECES = 4096

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The vocabulary file for a fast encoder; its ids are also the ranks of the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = byte_names()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(names[c] for c in s): t for s, t in spec["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoded(path: str, text: str) -> np.ndarray:
    """The ids of a text. The fast encoder's patterns fail on runs of about a million blanks; the
    automaton gives the same ids for texts of that kind."""
    try:
        return tokenizer(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(automaton(path).encode(text), np.uint32)


class Lane:
    """Packs the pieces of one task. A piece is (row, start, ids); a window is a list of pieces."""

    def __init__(self, window: int, tiers: tuple[int, ...]):
        self.window, self.tiers = window, sorted(tiers)
        self.stock: list[list] = [[] for _ in range(window)]
        self.filled = 0  # bit n: pieces of n ids are in stock
        self.held = 0
        self.full: list[tuple[int, list]] = []

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.stock[n].append(piece)
        self.filled |= 1 << n
        self.held += 1

    def _take(self, n: int) -> tuple:
        piece = self.stock[n].pop()
        if not self.stock[n]:
            self.filled ^= 1 << n
        self.held -= 1
        return piece

    def add(self, row: int, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.full.append((self.window, [(row, start, ids[start:start + self.window])]))
        if whole < len(ids):
            self._put((row, whole, ids[whole:]))

    def pack(self, last: bool) -> None:
        """Fill windows until the stock cannot fill one; with `last`, cut up what is left too."""
        while self.filled:
            longest = self.filled.bit_length() - 1
            tier = next(t for t in self.tiers if t >= longest)
            pieces = [self._take(longest)]
            gap = tier - longest
            while gap and self.filled:
                fits = (self.filled & ((2 << gap) - 1)).bit_length() - 1
                if fits > 0:
                    pieces.append(self._take(fits))
                    gap -= fits
                else:
                    over = self.filled >> (gap + 1)
                    row, start, ids = self._take(gap + 1 + (over & -over).bit_length() - 1)
                    pieces.append((row, start, ids[:gap]))
                    self._put((row, start + gap, ids[gap:]))
                    gap = 0
            if not gap:
                self.full.append((tier, pieces))
            elif not last:  # wait for more rows
                for piece in pieces:
                    self._put(piece)
                return
            else:
                self._cut_up(pieces)

    def _cut_up(self, pieces: list[tuple]) -> None:
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = room = 1 << (left.bit_length() - 1)
            window = []
            while room:
                row, start, ids = pieces.pop(0)
                window.append((row, start, ids[:room]))
                if len(ids) > room:
                    pieces.insert(0, (row, start + room, ids[room:]))
                room -= len(window[-1][2])
            self.full.append((size, window))
            left -= size

    def step_groups(self, step_tokens: int) -> list[int]:
        """A group for each full window; the groups' sums of tokens differ by a window at most."""
        total = sum(t for t, _ in self.full)
        groups = [(0, g) for g in range(max(1, -(-total // step_tokens)))]
        out = [0] * len(self.full)
        for i in sorted(range(len(out)), key=lambda i: -self.full[i][0]):
            tokens, g = groups[0]
            heapq.heapreplace(groups, (tokens + self.full[i][0], g))
            out[i] = g
        return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = 1024,
         tiers: tuple[int, ...] = (128, 256, 512, 1024), end_id: int = 0,
         step_tokens: int = STEP_TOKENS, buffer: int = BUFFER_PIECES) -> DataFrame:
    """One row for each piece: its ids (little-endian unsigned 32 bit), its place in the document
    and in its window, the window's tier and step group."""
    if max(tiers) != window or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two, the longest of them the window")

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        base = TaskContext.get().partitionId() << 40
        lane, done, groups_done = Lane(window, tiers), 0, 0
        rows: dict[int, tuple] = {}
        seen = 0

        def out() -> pa.RecordBatch:
            nonlocal done, groups_done
            groups = lane.step_groups(step_tokens)
            got = [(*rows[row], start, ids, base + done + i, offset, tier, base + groups_done + groups[i])
                   for i, (tier, pieces) in enumerate(lane.full)
                   for (row, start, ids), offset in zip(
                       pieces, np.cumsum([0, *(len(p[2]) for p in pieces)])[:-1].tolist(), strict=True)]
            done += len(lane.full)
            groups_done += max(groups, default=-1) + 1
            lane.full = []
            held = {p[0] for s in lane.stock for p in s}
            for row in [r for r in rows if r not in held]:
                del rows[row]
            doc, tokens, start, ids, sequence, offset, tier, group = zip(*got, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(tokens, pa.int64()),
                pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(tier, pa.int32()),
                pa.array(group, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                ids = encoded(path, t) if t else end[:0]
                ids = np.concatenate((ids.astype("<u4", copy=False), end))
                rows[seen] = (doc, len(ids))
                lane.add(seen, ids)
                seen += 1
                if lane.held >= buffer or len(lane.full) >= buffer:
                    lane.pack(last=False)
                    if lane.full:
                        yield out()
        lane.pack(last=True)
        if lane.full:
            yield out()

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(lanes, PIECES)
