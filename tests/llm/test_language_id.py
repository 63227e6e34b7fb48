import random
import zlib
from collections import Counter

import pytest

from codestrata.llm import language_id as l


def grams(text):
    """Ranked n-grams by a plain count."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    n = Counter()
    for w in words:
        p = f" {w} "
        n.update(w)
        n.update(p[i:i + 2] for i in range(len(p) - 1))
        n.update(p[i:i + 3] for i in range(len(p) - 2))
    number = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return [g for g, _ in sorted(((number(g), k) for g, k in n.items()), key=lambda x: (-x[1], x[0]))]


def plain(rows, top):
    counts = {}
    for i, text, lang, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1 and lang and text:
            counts.setdefault(lang, []).append(text)
    profiles = {}
    for lang, texts in counts.items():
        ranked = grams(" ".join(texts))[:top]
        if ranked:
            profiles[lang] = ranked
    out = {}
    for i, text, _, _ in rows:
        own = grams(text or "")[:top]
        if not own or not profiles:
            out[i] = ("und", 0.0)
            continue
        distance = {k: sum(abs(p.index(g) - r) if g in p else top for r, g in enumerate(own)) for k, p in sorted(profiles.items())}
        best = min(distance, key=distance.get)
        out[i] = (best, 1 - distance[best] / (top * len(own)))
    return out


def rows(seed, alphabets=("abcdeé", "bcdfgö", "xyzaeñ")):
    r = random.Random(seed)
    out = []
    for i in range(90):
        letters = alphabets[i % len(alphabets)]
        text = " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 60)))
        out.append((i, text + r.choice([".", " 12", "! ", "\n"]), f"l{i % len(alphabets)}", "s"))
    return out


@pytest.mark.parametrize("cells", (1 << 20, 1))
def test_equals_plain_distances(docs, odd_texts, cells, monkeypatch):
    monkeypatch.setattr(l, "MOST_CELLS", cells)
    table = rows(1) + [(100 + i, t, None, None) for i, t in enumerate(odd_texts)]
    got = l.identify(docs(table)).collect()
    expected = plain(table, l.TOP)
    for x in got:
        assert (x.lang_pred, round(x.score, 9)) == (expected[x.doc_id][0], round(expected[x.doc_id][1], 9))
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = l.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.95 * len(got)


def test_other_columns_do_not_count_in_predictions(docs):
    table = rows(2)
    profiles = l.learn(docs(table))
    shuffled = [(i + 1000, t, "l0", "z") for i, t, _, _ in table]
    a = [x.lang_pred for x in l.predict(docs(table), profiles).orderBy("doc_id").collect()]
    assert a == [x.lang_pred for x in l.predict(docs(shuffled), profiles).orderBy("doc_id").collect()]


def test_nothing_learned_null_keys_and_empty_table(docs):
    got = l.identify(docs([(None, "abc", None, None), (1, None, "en", "s"), (2, "123", "en", "s")])).collect()
    assert {x.lang_pred for x in got} == {"und"} and not [x for x in got if x.doc_id is None and x.held_out]
    assert l.identify(docs([])).count() == 0


def test_five_thousand_languages(docs, monkeypatch):
    """As many values as rows; compared in blocks and sent in several passes."""
    monkeypatch.setattr(l, "LANGUAGES_SENT", 2000)
    r = random.Random(5)
    table = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(4)), f"l{i:05d}", "s") for i in range(7500)]
    got = l.identify(docs(table)).collect()
    learned = {lang for i, _, lang, _ in table if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(learned) > 4900 and {x.lang_pred for x in got} <= learned
    # a text that was learned alone is nearest to itself, up to the first of equal profiles
    own = [x for x in got if not x.held_out]
    assert all(x.score == 1.0 for x in own)
    some = r.sample(got, 25)
    profiles = {lang: grams(text)[:l.TOP] for i, text, lang, _ in table if lang in learned}
    for x in some:
        mine = grams(table[x.doc_id][1])[:l.TOP]
        place = {k: {g: n for n, g in enumerate(p)} for k, p in profiles.items()}
        distance = {k: sum(abs(place[k][g] - n) if g in place[k] else l.TOP for n, g in enumerate(mine)) for k in sorted(profiles)}
        assert x.lang_pred == min(distance, key=distance.get)
