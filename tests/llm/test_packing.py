import random
import struct
from collections import defaultdict

import numpy as np
import pytest

from codestrata.llm import bpe, packing
from codestrata.llm.queries import VOCABULARY


def check(pieces, texts, window=1024):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
        assert p.length == len(p.ids) // 4 > 0
    own = bpe.automaton(VOCABULARY)
    for doc, text in texts.items():
        parts = sorted(by_doc[doc], key=lambda p: p.start)
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        ids = [x for p in parts for x in struct.unpack(f"<{p.length}I", p.ids)]
        assert ids == [*own.encode(text or ""), 0]
        assert {p.doc_tokens for p in parts} == {len(ids)}
    assert set(by_doc) == set(texts)
    for parts in by_window.values():
        parts.sort(key=lambda p: p.offset)
        used = sum(p.length for p in parts)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert used == parts[0].tier <= window and used & (used - 1) == 0, "no padding"
        assert len({(p.tier, p.step_group) for p in parts}) == 1


def test_every_id_once_and_no_padding(docs, odd_texts):
    r = random.Random(3)
    texts = odd_texts + [" ".join(r.choice(["one", "two", "three"]) for _ in range(r.randint(0, 900))) for _ in range(300)]
    for buffer in (4096, 7):
        pieces = packing.pack(docs(texts).repartition(3).sortWithinPartitions("doc_id"), VOCABULARY, buffer=buffer).collect()
        check(pieces, dict(enumerate(texts)))


def test_long_gaps_take_short_tiers():
    lane = packing.Lane(1024, (128, 256, 512, 1024))
    for row, n in enumerate((700, 300, 200, 100, 24)):
        lane.add(row, np.arange(n, dtype=np.uint32))
    lane.pack(last=True)
    tier, pieces = lane.full[0]
    assert tier == 1024 and [p[0] for p in pieces][:2] == [0, 1]
    assert sum(len(p[2]) for t, w in lane.full for p in w) == 1324
    assert all(sum(len(p[2]) for p in w) == t for t, w in lane.full)


def test_step_groups_are_balanced():
    lane = packing.Lane(1024, (128, 256, 512, 1024))
    r = random.Random(4)
    for row in range(500):
        lane.add(row, np.zeros(r.randint(1, 1500), np.uint32))
    lane.pack(last=True)
    sums = defaultdict(int)
    for (tier, _), g in zip(lane.full, lane.step_groups(16384), strict=True):
        sums[g] += tier
    assert max(sums.values()) - min(sums.values()) <= 1024


def test_runs_of_millions_of_blanks(docs):
    runs = [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n" * 1_000_000 + "b c"]
    with pytest.raises(ValueError):
        packing.tokenizer(VOCABULARY).encode_to_numpy(runs[0] + "b", allowed_special="all")
    texts = [*(r + end for r in runs for end in ("", "b", " <|endoftext|> b")), "plain words"]
    check(packing.pack(docs(texts).coalesce(1).sortWithinPartitions("doc_id"), VOCABULARY).collect(), dict(enumerate(texts)))


def test_both_encoders_give_the_same_ids(odd_texts):
    r = random.Random(5)
    parts = ["a", "the", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "é", "中", "'s", "<|endoftext|>", "99", "-", "\x00"]
    for text in [x for x in odd_texts if x] + ["".join(r.choice(parts) for _ in range(40)) for _ in range(2000)]:
        assert packing.encoded(VOCABULARY, text).tolist() == bpe.automaton(VOCABULARY).encode(text)
    blanks = "x" + " \n" * 60_000  # short enough for both
    assert packing.encoded(VOCABULARY, blanks + "y").tolist() == bpe.automaton(VOCABULARY).encode(blanks + "y")


def test_empty_table_and_bad_tiers(docs):
    assert packing.pack(docs([]), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(["a"]), VOCABULARY, tiers=(100, 1024))
