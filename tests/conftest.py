from __future__ import annotations

import pytest

from trailmark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        spark__master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over a column ``c`` of texts, in order."""

    def run(texts, expression, kind="string"):
        rows = list(enumerate(texts))
        df = spark.createDataFrame(rows, f"i int, c {kind}").coalesce(1)
        return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]

    return run
