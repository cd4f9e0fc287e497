import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from losslens.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def docs(spark):
    """Odd rows: nulls, empty texts, ties, repeats, one long text, extra columns with clashing names."""
    long = "alpha beta gamma delta " * 30_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog by the river.", "en"), (2, None, None), (3, "", "en"), (4, "  \n\t \n", "xx"), (5, long, "en"),
        (6, "same text here and there", "de"), (6, "same text here and there", "de"), (7, "same text here and there", "fr"), (None, "row without an id", "es"), (None, None, None),
        (8, "ÉÀ ünïcode Straße naïve \U0001f600 x́", "fr"), (9, "<|endoftext|> don't <|startoftext|>", "en"), (10, "line one\nline two\nLINE ONE \n", "en"),
    ]
    wide = [(i, t, g, None if t is None else len(t), 1, "row", 0.5, "fp") for i, t, g in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, n_chars long, toxic int, row string, score double, hash string")


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)


def faded(values):
    """Each value mixed into the mean so far; the mean's weight grows with the number of values, from 0 to 0.9."""
    weight = 1.8 / (1 + 2.718281828459045 ** (-len(values) / 20)) - 0.9
    out = []
    for value in values:
        mean = out[-1] if out else value
        out.append(value + (mean - value) * weight)
    return out
