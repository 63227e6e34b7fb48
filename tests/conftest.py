import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codestrata.session import local_session  # noqa: E402

FILES = "file_id long, path string, content string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, shuffle_partitions=4,
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="codestrata-"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="codestrata-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """files(contents) -> a corpus; contents are (path, content) pairs or texts of Go files."""
    def make(contents):
        rows = []
        for n, c in enumerate(contents):
            path, content = c if isinstance(c, tuple) else (f"f{n}.go", c)
            rows.append((n, path, content))
        return spark.createDataFrame(rows, FILES)
    return make
