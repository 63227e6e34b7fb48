import math
import random
import re
import string

import numpy as np
import pytest

from codestrata.llm import lexical
from codestrata.llm.words import Words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ITEMS = "item_id long, text string, n_docs int"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    texts = [(i, t) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, total = len(texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for x, d in df.items()}
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, t in texts:
            m = 25 + 75 * len(t) * n // total
            score = sum(weight[x] * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms(text) if x in t)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def collected(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(n, seed, words=300):
    r = random.Random(seed)
    names = [f"{c}{i}" for i in range(words // 3) for c in ("a", "É", "中")]
    return [" ".join(names[min(int(r.expovariate(0.03)), words - 1)] for _ in range(r.choice([0, 2, 10, 60, 200]))) for _ in range(n)]


@pytest.mark.parametrize("segment", [1 << 16, 50, 7])
def test_equals_a_plain_ranking(spark, docs, segment):
    texts = corpus(260, 1)
    items = [(i, t) for i, t in enumerate(corpus(25, 2)) if t]
    got = collected(lexical.search(docs(texts).repartition(3), spark.createDataFrame([(*i, 0) for i in items], ITEMS), most_docs=segment))
    assert got == plain(list(enumerate(texts)), items)


def segment_of(texts, vocabulary):
    rows = {"sizes": b"", "ids": [], "docs": [], "tfs": [], "terms": [], "counts": []}
    postings = {}
    sizes = []
    for i, t in enumerate(texts):
        own = terms(t)
        sizes.append(len(own))
        rows["ids"].append(i)
        for x in set(own):
            if x in vocabulary:
                postings.setdefault(vocabulary[x], []).append((i, own.count(x)))
    for x in sorted(postings):
        rows["terms"].append(x)
        rows["counts"].append(len(postings[x]))
        rows["docs"] += [d for d, _ in postings[x]]
        rows["tfs"] += [f for _, f in postings[x]]
    rows["sizes"] = np.array(sizes, np.int64).tobytes()
    rows["docs"], rows["tfs"] = (np.array(rows[c], np.int32).tobytes() for c in ("docs", "tfs"))
    return rows, sum(n > 0 for n in sizes), sum(sizes)


@pytest.mark.parametrize("window,short", [(8, 64), (8, 3), (64, 10 ** 9), (1, 2)])
def test_windows_are_skipped_without_loss(monkeypatch, window, short):
    """The search of one segment, in this process: any window and any division into short and long lists."""
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "SHORT", short)
    texts = corpus(400, 4)
    names = sorted({x for t in texts for x in terms(t)})
    vocabulary = {x: i for i, x in enumerate(names)}
    row, n, total = segment_of(texts, vocabulary)
    segment = lexical.Segment(row, n, total)
    df = {x: sum(x in terms(t) for t in texts) for x in names}
    skipped = 0
    for number, item in enumerate(t for t in corpus(30, 6) if t):
        asked = sorted({x for x in terms(item) if x in vocabulary}, key=vocabulary.get)
        best = lexical.Best(10)
        times = np.array([terms(item).count(x) for x in asked])
        looked = segment.search(np.array([vocabulary[x] for x in asked]),
                                np.array([lexical.weight(n, df[x]) for x in asked]) * times, best)
        skipped += -(-len(texts) // window) - looked
        want = [(d, s) for _, _, d, s in sorted(plain(list(enumerate(texts)), [(number, item)]), key=lambda r: r[1])]
        assert [(int(i), int(s)) for (_, i), s in zip(best.ids, best.scores, strict=True)] == want
    assert skipped > 0 or window > 8


def test_odd_rows(spark, docs, odd_texts):
    rows = [(i, t, "en", "s") for i, t in enumerate(odd_texts)] + [(None, "same text here", "en", "s")] * 2 + [(3, "same text here", "en", "s")] * 15
    items = [(1, "same HERE text"), (1, "same HERE text"), (2, None), (3, ""), (4, "--- ,,"), (None, "alpha beta x"), (6, "delta délta " + "x" * 50_000)]
    got = collected(lexical.search(docs(rows), spark.createDataFrame([(*i, 0) for i in items], ITEMS)))
    assert got == plain([(r[0], r[1]) for r in rows], items)
    none = spark.createDataFrame([], ITEMS)
    assert lexical.search(docs(rows), none).count() == 0
    assert lexical.search(docs([]), spark.createDataFrame([(1, "a", 0)], ITEMS)).count() == 0


def test_items_in_blocks(spark, docs):
    texts, items = corpus(120, 8), [(i, t) for i, t in enumerate(corpus(40, 9)) if t]
    got = collected(lexical.search(docs(texts), spark.createDataFrame([(*i, 0) for i in items], ITEMS), item_terms=100))
    assert got == plain(list(enumerate(texts)), items)


def test_terms_are_those_of_the_pattern():
    text = "Ab_c9-d\x7fé ü中 ſK\x00z{|}~^`@[/:"
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), fold=True, outside=lexical.OUTSIDE)
    got = [data[a:b].tobytes().decode().translate(LOWER) for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == terms(text)
