import random

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codestrata.llm import bpe
from codestrata.llm.queries import VOCABULARY

PARTS = ["a", "aa", "the", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", "　",
         "é", "é", "١", "Ⅷ", "²", "中", "文", "😀", "'s", "'re", "'LL", "'", "ing", "tion", "<|endoftext|>", "<|", "0", "99",
         "_", "-", "==", "﻿", "\x00", "ǅ", "ª"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_equals_the_library(library):
    r = random.Random(2)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(r.choice("abcdeht ") for _ in range(60)) for _ in range(1000)]
    texts += [x[0] for x in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    own = bpe.automaton(VOCABULARY)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_exactly_one_path():
    """Of all ways to spell a word by tokens one alone has open arcs throughout."""
    merges = [(b"a", b"b"), (b"ab", b"a"), (b"b", b"a"), (b"a", b"a"), (b"ab", b"ab"), (b"aa", b"b")]
    labels = [b"a", b"b", *(u + v for u, v in merges)]
    own = bpe.Automaton({x: i for i, x in enumerate(labels)}, merges, {})

    def plain(word):  # merges in order, leftmost first
        parts = [bytes([c]) for c in word]
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i:i + 2] = [u + v]
                i += 1
        return parts

    def spelled(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in own.arcs:
                yield from ([own.arcs[word[:k]], *rest] for rest in spelled(word[k:]))

    for n in range(1, 9):
        for x in range(2 ** n):
            word = bytes(b"ab"[x >> i & 1] for i in range(n))
            paths = [p for p in spelled(word) if all(own.follows(a, b) for a, b in zip(p, p[1:]))]
            assert paths == [list(own.encode_word(word))]
            assert [own.labels[t] for t in paths[0]] == plain(word)


def test_two_merges_of_one_token_are_refused():
    with pytest.raises(ValueError):
        bpe.Automaton({b"a": 0, b"aa": 1, b"aaa": 2}, [(b"a", b"a"), (b"aa", b"a"), (b"a", b"aa")], {})


def test_round_trip_of_odd_texts(docs, odd_texts, library):
    table = docs(odd_texts).withColumn("ids", F.lit("clash"))
    rows = bpe.encode_documents(table, VOCABULARY, decoded="decoded").orderBy("doc_id").collect()
    again = bpe.decode_documents(bpe.encode_documents(table, VOCABULARY), VOCABULARY).orderBy("doc_id").collect()
    columns = table.withColumn("by", bpe.encode("text", VOCABULARY)).orderBy("doc_id").collect()
    for text, row, other, column in zip(odd_texts, rows, again, columns, strict=True):
        assert row.ids == library.encode(text or "", add_special_tokens=False).ids == column.by
        assert row.decoded == (text or "") == other.decoded
    assert bpe.encode_documents(docs([]), VOCABULARY).count() == 0


def test_bad_bytes_and_null_ids(spark):
    half = bpe.automaton(VOCABULARY).encode("é")
    table = spark.createDataFrame([(None,), ([],), ([half[0]][:1] if len(half) > 1 else [188],)], "ids array<int>")
    assert [r.t for r in table.select(bpe.decode("ids", VOCABULARY).alias("t")).collect()][:2] == ["", ""]
