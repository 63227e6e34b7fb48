import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codestrata.llm import sketch


def shingles(text, width=5):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def plain(rows):
    """(doc_id, n_chars, edited sha, exact resemblance to the edited and to the next text), as a sorted list."""
    def resemblance(a, b):
        a, b = shingles(a), shingles(b)
        return 1.0 if a == b else len(a & b) / len(a | b)

    rows = [(i, t or "") for i, t in rows]
    out = []
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    round(resemblance(text, edited), 9), round(resemblance(text, following), 9)))
    return sorted(out, key=repr)


def collected(frame):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in frame.collect()), key=repr)


def texts(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(200)]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 8, 40, 300]))) for _ in range(n)]


def test_all_hashes_retained_give_exact_shares(docs):
    some = texts(80) + ["same words as the next one here", "same words as the next one here"]
    frame = docs(some).repartition(5)
    for block_rows in (1000, 7, 1):
        assert collected(sketch.against_edits(frame, fraction=1, block_rows=block_rows)) == plain(list(enumerate(some)))


def test_often_repeated_rows_are_counted_first(docs):
    rows = [(7, "a b c d e f g", "en", "s")] * 40 + [(None, "x y", "en", "s")] * 30 + [(i, f"t{i} u v w x y", "en", "s") for i in range(9, 20)]
    want = plain(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)))
    for hot, block_rows in ((5, 2), (1000, 2), (5, 1000)):
        assert collected(sketch.against_edits(docs(rows).repartition(4), fraction=1, hot=hot, block_rows=block_rows)) == want


def test_odd_rows(spark, docs, odd_texts):
    frame = docs(odd_texts).withColumn("half", F.lit(1)).withColumn("place", F.lit("x"))
    assert collected(sketch.against_edits(frame, fraction=1)) == plain(list(enumerate(odd_texts)))
    # null ids come first; equal rows follow one another
    rows = [(None, "n n n n n n", "en", "s")] * 3 + [(4, "a b c d e f g", "en", "s")] * 2 + [(5, None, "en", "s")]
    assert collected(sketch.against_edits(docs(rows), fraction=1)) == plain([(r[0], r[1]) for r in rows])
    one = sketch.against_edits(docs(["one text alone, short"])).first()
    assert one.near_next == 1.0 and one.n_chars == 21
    assert sketch.against_edits(docs([])).count() == 0


def test_rows_of_one_id_and_several_texts(docs):
    rows = [(1, t, "en", "s") for t in ("a", "b", "c", "b")] + [(2, "z", "en", "s")]
    out = sketch.against_edits(docs(rows)).collect()
    assert sorted(r.doc_id for r in out) == [1, 1, 1, 1, 2]


def test_equal_texts_have_equal_fingerprints(docs):
    some = texts(50)
    by_text = {}
    for r in sketch.against_edits(docs(some + some[::-1])).collect():
        by_text.setdefault((some + some[::-1])[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({f for fs in by_text.values() for f in fs}) == len({frozenset(shingles(t)) for t in some})


def test_fingerprints_hold_all_hashes_below_the_bound_and_merge(docs):
    some = texts(60, 9)
    whole = sketch.fingerprints(pa.array(some), 1)
    kept = sketch.fingerprints(pa.array(some), 8)
    bound = np.uint64(sketch.limit(8))
    for a, b in zip(whole, kept, strict=True):
        below = a[a < bound]
        assert np.array_equal(b, below if len(below) else a[:1])
    for a, b in zip(range(0, 60, 2), range(1, 60, 2), strict=True):  # the union of two is that of both texts' shingles
        merged = sketch.retain(np.concatenate((kept[a], kept[b])))
        assert np.array_equal(merged, sketch.retain(np.concatenate((whole[a], whole[b]))))
    stored = [base64.b64decode(r.fingerprint) for r in sketch.against_edits(docs(some)).orderBy("doc_id").collect()]
    assert all(np.array_equal(sketch.unpacked(s), k) for s, k in zip(stored, kept, strict=True))


def test_shares_of_unequal_texts_are_estimated(docs):
    r = random.Random(5)
    long = [f"v{r.randrange(10 ** 6)}" for _ in range(40_000)]
    part = long[1000:3000]  # a twentieth of the long text
    mixed = part[:1000] + [f"u{i}" for i in range(1000)]
    a, b, c = sketch.fingerprints(pa.array([" ".join(x) for x in (long, part, mixed)]), sketch.FRACTION)
    assert sketch.contained(b, a) == 1.0 and abs(sketch.contained(c, a) - 0.5) < 0.12
    assert abs(sketch.contained(a, b) - 0.05) < 0.01 and abs(sketch.likeness(a, b) - 0.05) < 0.01
