import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from codestrata.llm import minhash as m
from codestrata.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(texts, percent):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return [(i, len(s), top(i), top(i) == i) for i, s in sets.items()]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(1, 5)))
    bases = [[word() for _ in range(r.randint(1, 120))] for _ in range(25)]
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(250):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w = [word() for _ in range(30)] + passage
        texts.append(r.choice([" ", "\n"]).join(w if r.random() < 0.9 else [x.upper() for x in w]))
    return texts


@pytest.mark.parametrize("percent", (85, 80))
def test_components_equal_all_pairs(docs, odd_texts, percent):
    texts = corpus(percent) + odd_texts
    rows = m.near_duplicates(docs(texts), percent=percent).orderBy("doc_id").collect()
    assert [tuple(x) for x in rows] == plain(texts, percent)


def test_blocks_find_every_link(docs, monkeypatch):
    """Families split into many blocks give the same components."""
    texts = corpus(3)
    monkeypatch.setattr(m, "BLOCK", 4)
    rest = m.rest_links
    monkeypatch.setattr(m, "rest_links", lambda *a: rest(*a, block=4))
    monkeypatch.setattr(m, "hub_pairs", lambda family, *a: family.sparkSession.createDataFrame([], "a long, b long"))
    rows = m.near_duplicates(docs(texts)).orderBy("doc_id").collect()
    assert [tuple(x) for x in rows] == plain(texts, 85)


def test_the_match_threshold_loses_next_to_nothing():
    for percent in (80, 85, 95):
        assert m.miss_chance(m.match_threshold(percent), percent) <= 1e-8 < m.miss_chance(m.match_threshold(percent) + 1, percent)


def test_null_ids_repeated_rows_and_empty_table(docs):
    one, two = "a b c d e f g", "h i j k l m n"
    rows = m.near_duplicates(docs([(7, one, "x", "y"), (7, one, "x", "y"), (None, one, "x", "y"), (None, two, None, None),
                                   (9, None, "x", "y")]).withColumn("component_id", F.lit(1))).collect()
    assert sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1, x.kept) for x in rows) == [
        (-1, 3, -1, True), (-1, 3, 7, True), (7, 3, 7, True), (7, 3, 7, True), (9, 0, 9, True)]
    assert m.near_duplicates(docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(5, i) for i in range(200, 230)] + [(3, 5), (3, 3), (5, 3)]
    out = dict(components(spark.createDataFrame(chain + star, "a long, b long")).distinct().collect())
    assert out == {i: 100 for i in range(100, 141)} | {i: 3 for i in (3, 5, *range(200, 230))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_stray_in_a_large_family_moves_few_rows(spark):
    """Members of the largest component meet the others only; every pair across components shares a pair of blocks."""
    n = 4000
    family = spark.range(n + 3).select(F.lit(0).cast("long").alias("hub"), "id", F.lit(1).alias("met"))
    labels = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    rows = m.meetings(family, labels, block=16).collect()
    assert len(rows) == n + 3 and sum(len(r.others) for r in rows) == n + 3 * (n // 16 + 1)
    own = {r.id: r.own for r in rows}
    meets = {r.id: set(r.others) for r in rows}
    for stray in range(n, n + 3):
        for other in (*range(0, n, 97), *range(n, n + 3)):
            assert own[other] in meets[stray] and own[stray] in meets[other]
    alone = spark.range(n).select(F.lit(0).cast("long").alias("hub"), "id", F.lit(1).alias("met"))
    assert m.meetings(alone, labels).count() == 0
