import random

import pytest

import __spark_entry__
import corpus_pipeline
from codestrata.llm import queries
from codestrata.llm.common import shared_folder


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture
def planted(docs):
    r = random.Random(12)
    rows = [(i, words(r, 80), "en", f"s{i % 3}") for i in range(300)]
    passage = words(r, 60)
    text = {i: rows[i][1] for i in range(300)}
    text[10] = text[4]  # an exact copy
    near = text[5].split()
    near[40] = "changed"
    text[11] = " ".join(near)
    for i in (20, 21, 22):
        text[i] += "\n" + passage
    text[30] += " mail: some.one12@example.org, card 4111111111111111"
    text[40], text[41] = "too short", "the very same five words " * 30
    return docs([(i, text[i], a, b) for i, _, a, b in rows] + [(None, None, None, None)]), passage


def test_stages_find_what_was_planted(spark, planted):
    docs, passage = planted
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"{shared_folder(spark)}/stage-{random.random()}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
    clean = set(range(300)) - {40, 41}
    assert set(seen["quality rules"]) == clean
    assert set(seen["near duplicates"]) == clean - {10, 11}
    texts = seen["repeated passages"]
    assert passage in texts[20] and passage not in texts[21] and passage not in texts[22]
    assert all(texts[i] == seen["near duplicates"][i] for i in texts if i not in (21, 22))
    final = seen["pseudonyms"]
    assert "4111111111111111" not in final[30] and "some.one12" not in final[30] and "@example.org" in final[30]
    assert all(final[i] == texts[i] for i in texts if i != 30)
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == set(final)


def test_rejected_rows_take_no_others_with_them(spark, docs):
    r = random.Random(15)
    good = [words(r, 80) for _ in range(300)]
    rows = [(i, t, "en", "s") for i, t in enumerate(good[:250])] + [
        (None, good[250], "en", "s"), (None, "too short", "en", "s"), (None, None, None, None), (None, good[251], None, None),
        (7, "too short", "en", "s"), (300, good[252], "en", "s"), (300, "the very same five words " * 30, "en", "s"), (300, good[253], "de", "t")]
    out = corpus_pipeline.quality(spark, docs(rows), "")
    assert out.columns == docs(rows).columns
    assert sorted(map(repr, ((x.doc_id, x.text) for x in out.collect()))) == sorted(
        map(repr, [*enumerate(good[:250]), (None, good[250]), (None, good[251]), (300, good[252]), (300, good[253])]))


def test_one_row_of_each_group_whatever_its_id(spark, docs):
    r = random.Random(16)
    rows = [(i, words(r, 80), "en", "s") for i in range(250)]
    null, both, twice, near, two = (words(r, 80) for _ in range(5))
    changed = near.split()
    changed[40] = "changed"
    rows += [(None, null, "en", "s")] * 5  # copies without an id
    rows += [(None, both, "en", "s"), (400, both, "en", "s"), (None, both, None, None)]  # with one, too
    rows += [(401, twice, "en", "s")] * 4  # repeated rows
    rows += [(None, near, "en", "s"), (None, " ".join(changed), "en", "s")]
    rows += [(402, two, "en", "s"), (402, words(r, 80), "en", "s"), (402, two, "de", "t")]  # rows of one id
    table = docs(rows)
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, table, "")
        path = f"{shared_folder(spark)}/stage-{random.random()}"
        out.write.parquet(path)
        table = spark.read.parquet(path)
    got = [(x.doc_id, x.text) for x in table.collect()]
    assert sorted(x for x in got if x[0] is not None and x[0] < 400) == [x[:2] for x in rows[:250]]
    rest = [x for x in got if x[0] is None or x[0] >= 400]
    assert rest.count((None, null)) == rest.count((400, both)) == rest.count((401, twice)) == rest.count((402, two)) == 1
    assert sum(t in (near, " ".join(changed)) for _, t in rest) == 1
    assert len(rest) == 6 and len([x for x in rest if x[0] == 402]) == 2
    pieces = corpus_pipeline.pack(spark, corpus_pipeline.pseudonyms(spark, table, ""), "").collect()
    assert sum(p.start == 0 for p in pieces) == 256


def test_registered(spark):
    found = __spark_entry__.queries()
    assert set(queries.REGISTRY) < set(found) and "pipeline" in found and len(queries.REGISTRY) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ("op1_minhash_near_dedup", "op4_adaptive_quality", "op8_cover_tree_top_k"))
def test_equals_sql(spark, name):
    import duckdb
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, folder)
    result = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(x)) for x in got.select(columns).collect())
