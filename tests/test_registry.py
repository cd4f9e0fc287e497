import json

import pytest

from losslens.operators import mixing
from losslens.sources import scans


@pytest.fixture
def folder(spark, tmp_path):
    place = f"file://{tmp_path}"
    talk = [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "nobody", "value": "x"}]
    spark.createDataFrame([(i, f"t{i}", talk) for i in range(10)], "i int, instruction string, conversations array<struct<from:string,value:string>>").write.parquet(f"{place}/rows/eval")
    info = {
        "few": {"file_name": "rows", "split": "eval", "num_samples": 4}, "many": {"file_name": "rows", "split": "eval", "num_samples": 25, "columns": {"place": "i"}},
        "talks": {"file_name": "rows", "split": "eval", "formatting": "sharegpt"}, "odd": {"file_name": "rows", "split": "eval", "formatting": "other"}, "ranked": {"file_name": "rows", "split": "eval", "ranking": True},
    }
    (tmp_path / "dataset_info.json").write_text(json.dumps(info))
    return place


def test_entries_say_how_their_rows_are_read(spark, folder):
    few = [r.prompt for r in scans.load_dataset(spark, folder, "few").collect()]
    assert len(set(few)) == 4 and sorted(few) == sorted(r.prompt for r in scans.load_dataset(spark, folder, "few").collect())
    assert {tuple(sorted(r.prompt for r in scans.load_dataset(spark, folder, "few", seed=s).collect())) for s in range(5)} != {tuple(sorted(few))}
    many = [r.place for r in scans.load_dataset(spark, folder, "many").collect()]
    assert len(many) == 25 and set(many) == set(range(10))
    talks = scans.load_dataset(spark, folder, "talks").first()
    assert [(m.role, m.content) for m in talks.messages] == [("user", "q"), ("assistant", "a"), (None, "x")]
    assert scans.load_dataset(spark, folder, "ranked", stage="rm").count() == 10
    for name in ("odd", "ranked", "missing"):
        with pytest.raises(ValueError):
            scans.load_dataset(spark, folder, name)


def test_samples(spark):
    rows = spark.range(7)
    assert mixing.sampled(rows, "id", 0).count() == 0 and mixing.sampled(rows.limit(0), "id", 5).count() == 0
    got = mixing.sampled(rows, "id", 30).collect()
    assert sorted(r.sample for r in got) == list(range(30)) and sorted(r.id for r in got if r.sample < 7) == list(range(7))
    with pytest.raises(ValueError):
        mixing.sampled(rows, "id", -1)
