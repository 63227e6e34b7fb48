import random

import pytest

from codestrata.llm.common import importable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _importable(spark):
    importable(spark)


@pytest.fixture
def docs(spark):
    """docs(texts) -> documents; texts are texts or (doc_id, text, lang, source)."""
    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t, "en", "s") for i, t in enumerate(texts)]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS)
    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, repeated, very long, and texts with every kind of white space."""
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "délta", "中文"]) for _ in range(30_000))
    return [None, "", " \t\n", "same text here", "same text here", "x" * 50_000, long,
            "a\x0bb\x0cc\rd\x85e\xa0f", "#*$%&|<>" * 20, "line\nline\nline\n"]
