import random
import re
from collections import Counter

from pyspark.sql import functions as F

from codestrata.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines),
            len(lines) - len(set(lines)), len(covered))


def test_counts_equal_plain_ones(docs, odd_texts):
    r = random.Random(5)
    texts = odd_texts + ["".join(r.choice(["a ", "b ", "c\n", "é# ", "\t", "\xa0"]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    rows = q.base_counts(docs(texts)).orderBy("doc_id").collect()
    assert [tuple(x)[3:] for x in rows] == [counts(t) for t in texts]


def test_bins():
    import pyspark.sql as s
    spark = s.SparkSession.getActiveSession()
    for v, b in ((0, 0), (1, 1), (1023, 1023), (1024, 1024), (1025, 1024), (2047, 2046), (10 ** 9, 999292928)):
        assert spark.range(1).select(q.sketch_bin(F.lit(v).cast("long"))).first()[0] == b


def plain_quartile(values, share):
    values = sorted(values)
    return next(v for i, v in enumerate(values, 1) if 4 * i >= share * len(values))


def test_thresholds_follow_groups_and_merge(spark):
    r = random.Random(6)
    rows = [("en", "big", r.randint(0, 900)) for _ in range(40)] + [("en", "small", r.randint(0, 900)) for _ in range(5)]
    rows += [("de", "tiny", r.randint(0, 900)) for _ in range(3)] + [(None, None, 1)]
    sketch = spark.createDataFrame(rows, "lang string, source string, bin long").groupBy("lang", "source", "bin").agg(
        F.count("*").alias("n")).withColumn("measure", F.lit("symbols"))
    found = {(x.lang, x.source): x.symbols_high for x in q.thresholds(sketch, least=20, spread=2).collect()}
    own = lambda keep: [v for a, b, v in rows if keep(a, b)]
    for key, values in {("en", "big"): own(lambda a, b: b == "big"), ("en", "small"): own(lambda a, b: a == "en"),
                        ("de", "tiny"): own(lambda a, b: True), (None, None): own(lambda a, b: True)}.items():
        low, high = plain_quartile(values, 1), plain_quartile(values, 3)
        assert found[key] == high + max(2 * (high - low), 50)


def test_outliers_go_and_clean_documents_stay(docs):
    r = random.Random(7)
    clean = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(60))
    texts = [clean() for _ in range(300)]
    junk = {5: "### " * 5 + clean().replace("a", "#$%"), 9: "same words again and " * 20, 11: "few words",
            13: "\n".join(["one line of words"] * 3 + [clean()] * 1 + ["another line"] * 4), 17: None}
    for i, t in junk.items():
        texts[i] = t
    kept = {x.doc_id: x for x in q.judge(docs(texts).withColumn("kept", F.lit(1)), least=100).collect()}
    assert {i for i, x in kept.items() if not x.kept} == set(junk)
    assert {i for i, x in kept.items() if x.base_failed} == {9, 11, 13, 17}


def test_null_groups_and_empty_table(docs):
    rows = [(i, "some words " * 3, None, None) for i in range(3)] + [(None, "x", "en", None)]
    assert len(q.judge(docs(rows)).collect()) == 4
    assert q.judge(docs([])).count() == 0
