import random

import numpy as np
import pytest

from losslens.functions import codecs
from losslens.plans import coding

TEXTS = ["", "a", "E", "F", "EFEF" * 5, "a" * 16, "abcdefghijklmnop", "ponmlkjihgfedcba" * 3, "é😀\x00\n" * 21, "to be or not to be, that is the question"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    return TEXTS + ["".join(draw.choices("abcDEFgé😀 \n", k=draw.randrange(200))) for _ in range(60)]


def test_pieces_come_back_as_their_fractions_do(texts):
    for text in texts:
        pieces = [text[i : i + 16] for i in range(0, len(text), 16)]
        assert codecs.piecewise_round_trip(text) == (len(pieces), sum(map(coding.comes_back, pieces)))
        full = text + "x" * (-len(text) % 8)
        assert codecs.piecewise_lower_decimals(text) == [codecs.ae_lower_decimal(full[i : i + 8]) for i in range(0, len(full), 8)]


def test_a_decoded_piece_is_read_from_its_value(monkeypatch):
    """Where the decoder's symbols stand in another order than the encoder's, the piece is another."""
    points = np.array([[ord(c) for c in "lossless pieces!"]])
    assert codecs.pieces_come_back(points).all()
    right = codecs.symbol_counts
    monkeypatch.setattr(codecs, "symbol_counts", lambda keys: (*right(keys)[:2], len(keys) - 1 - right(keys)[2]))
    assert not codecs.pieces_come_back(points).any()


def test_null_and_empty_texts_have_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 33)], "doc_id long, text string")
    assert sorted(map(tuple, coding.arithmetic_round_trips(docs).collect())) == [(1, None, None), (2, 0, 0), (3, 3, 3)]


def test_pieces_stay_out_of_the_columns_sent_to_python(spark):
    """Whole texts go to the workers and digests come back: no array of pieces, whose texts took gigabytes, in any plan."""
    turns = spark.createDataFrame([(1, 0, "a text of some length")], "conv_id long, turn int, text string")
    plan = coding.arithmetic_bounds(turns)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "ArrowEvalPython" in plan
    assert codecs.piecewise_lower_digest("a text of some length")[0] == 3
