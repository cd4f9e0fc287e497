import json

import duckdb

from losslens.functions import answers, codecs
from losslens.plans import catalog

ODD = ['"', "\\", "\\\\u0041 u", 'say ""no""', "a\n\n\tb\x01\x01c", "\\n\n\\\\n", "é😀😀\u2028x", "'[]{}'", "aaa  111", "x]", "\\u00e9\u00e9", "12,,3"]


def test_odd_texts_are_judged_as_in_sql(spark, tmp_path):
    rows = [(kind + 8 * i, 0, "user", t) for i, t in enumerate(ODD) for kind in range(8)] + [(0, 1, "user", ""), (1, 1, "user", None)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    conversations.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(catalog.SQL["judged_texts"])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in catalog.QUERIES["judged_texts"](spark, str(tmp_path)).collect()) == want


def test_right_pairs_are_not_read_as_literals(monkeypatch):
    calls = []
    read = answers.ast.literal_eval
    monkeypatch.setattr(answers.ast, "literal_eval", lambda x: calls.append(x) or read(x))
    pairs = [list(p) for p in codecs.rle_encode("some text of a turn" * 20)]
    said = json.dumps({"output": pairs})
    assert answers.verdict(said, pairs, "rle") == "correct"
    assert answers.deep_equal({"a": ["text"]}, {"a": ["text"]}) and not calls
