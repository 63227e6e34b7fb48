import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import queries
from codestrata.llm import suffix_dedup as s


def plain(texts, length, keep_first):
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, b in enumerate(data):
        for at in range(len(b) - length + 1):
            places[b[at:at + length]].append((i, at))
    gone = [np.zeros(len(b), bool) for b in data]
    for where in places.values():
        for i, at in (where[1:] if keep_first else where) if len(where) > 1 else ():
            gone[i][at:at + length] = True
    return [(i, len(b), int(g.sum()), int((g & ~np.append([False], g[:-1])[:len(g)]).sum()),
             bytes(np.frombuffer(b, np.uint8)[~g])) for i, (b, g) in enumerate(zip(data, gone, strict=True))]


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 220))) for _ in range(25)]
    own = lambda: "".join(r.choice("abx") for _ in range(r.randint(0, 40)))
    texts = ["".join(r.choice([r.choice(base)[r.randint(0, 40):], own()]) for _ in range(r.randint(0, 4))) for _ in range(60)]
    return texts + ["a" * 300, "ab" * 150, "ab" * 150]


@pytest.mark.parametrize("keep_first", (False, True))
@pytest.mark.parametrize(("length", "most"), ((24, 1000), (24, 1), (70, 0)))
def test_removes_what_brute_force_removes(docs, odd_texts, keep_first, length, most, monkeypatch):
    texts = corpus(length) + odd_texts
    repeats = s.repeats
    monkeypatch.setattr(s, "repeats", lambda *a: repeats(*a, most=most))
    rows = s.remove_repeats(docs(texts), length=length, keep_first=keep_first, whole_characters=False).orderBy("doc_id").collect()
    # equal texts come in the order of ids, others by (id, hash), which is the order of ids too
    assert [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in rows] == plain(texts, length, keep_first)


@pytest.mark.parametrize("keep_first", (False, True))
def test_strings_in_runs_with_the_gram_once_and_often(docs, keep_first, monkeypatch):
    """A = X + a long rule, B = X + a shorter rule + other text: what they share goes, wherever it stands."""
    r = random.Random(14)
    own = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    # of all rules the one whose gram has the least hash, so that it is the gram of the strings around it
    rule = min(map(chr, range(0x21, 0x61)), key=lambda c: s.Hashes(np.frombuffer(c.encode() * 35, np.uint8)).of(np.array([0]), 35)[0])
    texts = [own(30) + rule * 60 + own(30) for _ in range(5)]
    for _ in range(60):
        x, y = own(60), own(60)
        texts += [own(9) + x + rule * 60, own(9) + x + rule * r.randint(35, 37) + own(40)]
        texts += [rule * 60 + y + own(9), own(40) + rule * r.randint(35, 37) + y + own(9)]
    repeats = s.repeats
    monkeypatch.setattr(s, "repeats", lambda *a: repeats(*a, most=0))
    rows = s.remove_repeats(docs(texts), length=70, keep_first=keep_first, whole_characters=False).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in rows] == plain(texts, 70, keep_first)


def test_longest_previous_factors():
    r = random.Random(8)
    for _ in range(150):
        n = r.randint(1, 90)
        data = np.array([r.choice(b"ab") for _ in range(n)], np.uint8)
        at = np.array(sorted(r.sample(range(n), r.randint(1, n))))
        length, source = s.previous_factors(data, at, n - at, 128)
        for p, got, src in zip(at, length, source, strict=True):
            common = {q: next((k for k in range(n - p) if data[q + k] != data[p + k]), n - p) for q in at[at < p]}
            assert got == max(common.values(), default=0)
            assert got == 0 or common[src] == got


def test_characters_stay_whole(docs):
    passage = "é" * 40
    texts = [f"a{passage}b", f"cc{passage}d", passage[:10]]
    rows = s.remove_repeats(docs(texts), length=31, rest=("lang", "text")).orderBy("doc_id").collect()
    kept = [bytes(x.kept).decode() for x in rows]  # no half character is left
    assert kept[2] == passage[:10] and kept[1][:2] == "cc" and kept[1][-1] == "d"
    assert rows[1].n_removed > 60 and rows[0].lang == "en"


def test_repeated_rows_null_ids_and_empty_table(docs):
    text = "some words that are long enough"
    rows = s.remove_repeats(docs([(1, text, "a", "b"), (1, text, "a", "b"), (None, text, None, None), (None, None, None, None)])
                            .withColumn("n_bytes", F.lit("clash")), length=10, keep_first=False).collect()
    assert sorted((x.n_bytes, x.n_removed) for x in rows) == [(0, 0), (31, 31), (31, 31), (31, 31)]
    assert s.remove_repeats(docs([]), length=10).count() == 0


def test_query_removes_by_400_bytes_whatever_the_words(spark, docs, tmp_path):
    """Passages of over 50 words stay at 399 bytes; from 400 on every copy goes, and digest and text show the same."""
    r = random.Random(5)
    own = lambda n: " ".join(r.choice("abcdefgh") * 5 + r.choice("ijklmnop") for _ in range(60))[:n]
    short, even, wide = own(399), own(400), own(380) + " éé" * 4
    assert min(len(x.split()) for x in (short, even)) > 50 and len(wide) < 400 == len(wide.encode())
    split = own(399)  # é and è begin with the same byte, the 400th
    texts = [f"1{short}2", f"3{short}4", f"5{even}6", f"7{even}8", f"9{wide}A", f"B{wide}C", f"D{split}é", f"E{split}è", None, "F"]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.REGISTRY["op5_suffix_array_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()
    want = plain(texts, 400, False)
    assert [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows] == [
        (*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want]
    assert [x.text for x in rows] == [w[4].decode(errors="replace") for w in want]
    assert [x.text for x in rows[:8]] == [*texts[:2], "56", "78", "9A", "BC", "D\ufffd", "E\ufffd"]
