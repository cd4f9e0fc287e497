import json
import subprocess
import sys

from pyspark.sql import functions as F

from losslens.sources import files
from losslens.streaming import incremental


def test_json_lines(spark, tmp_path):
    path = tmp_path / "algo" / "model_temp_0.2_n5k_verified.jsonl"
    path.parent.mkdir()
    path.write_text('{"a": 1}\n\n  \nnot json\n{"a": 2, "b": "x"}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(path), "a long, b string").collect()) == [1, 2]
    rows = spark.read.schema("a long").json(str(path))
    seen = files.with_path_columns(rows).first()
    assert seen.algo == "algo" and seen.model == "model"
    files.write_jsonl(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"a": 1, "b": None}]
    assert files.read_by_extension(spark, str(path), "jsonl").count() >= 2
    assert [r.category for r in files.model_registry(spark, [{"id": "m"}, {"size": "7b"}]).collect()] == ["unknown"]


def test_stream_skips_what_is_done(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    verify = lambda d: d.withColumn("status", F.when(F.col("k") % 2 == 0, "correct").otherwise("wrong"))

    def run(name, keys):
        (source / name).write_text("".join(json.dumps({"k": k}) + "\n" for k in keys))
        incremental.verify_stream(spark, str(source), "k long", verify, out, str(tmp_path / "check"), ["k"]).awaitTermination()

    run("1.json", [1, 2, 2])
    run("2.json", [2, 3])
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_reflection_keeps_the_first_right_answer(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q\n7"), (2, "q\nno"), (3, None)], "id long, prompt string")
    score = lambda d: d.withColumn("em", F.col("answer").startswith("7").cast("int"))

    def save(d, n):
        d.write.parquet(f"{tmp_path}/{n}")
        return spark.read.parquet(f"{tmp_path}/{n}")

    got = {r.id: (r.answer, r.resolved) for r in incremental.reflect(rows, incremental.ModelClient(), score, save, 2).collect()}
    assert got[1] == ("7", 0) and got[2] == ("no", None)


def test_hourly_counts_of_a_stream(spark):
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    query = incremental.hourly_counts(events).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM hours").first().n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_library_works_without_the_llm_package(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/losslens", tmp_path / "losslens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_numbers_follow_the_order(spark):
    from losslens.sources.saved import numbered

    rows = spark.range(500).selectExpr("(id * 7919) % 500 AS k", "1 AS other").repartition(7)
    got = {r.k: r.n for r in numbered(rows, "k").collect()}
    assert got == {k: k for k in range(500)}
    assert numbered(rows.limit(0), "k").count() == 0


def test_a_hot_series_is_smoothed_in_pieces(spark):
    import pytest

    from tests.conftest import faded

    from losslens.operators.sft import smoothed

    data = [(1, i, float(i * i % 97)) for i in range(400)] + [(2, 0, 5.0), (2, 1, None), (None, 3, 1.0), (None, 4, 9.0)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((r.s, r.smoothed) for r in smoothed(spark.createDataFrame(data, "k int, s int, v double").repartition(5), "k", "s", "v").where("k = 1").collect())
        others = smoothed(spark.createDataFrame(data, "k int, s int, v double"), "k", "s", "v").where("k IS NULL OR k = 2").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [x for _, x in got] == pytest.approx(faded([v for k, _, v in data if k == 1]))
    assert sorted(r.smoothed for r in others if r.k is None) == pytest.approx(sorted(faded([1.0, 9.0]))) and [r.smoothed for r in others if r.k == 2] == [5.0]


def test_arrow_files_and_plain_pickles(spark, tmp_path):
    import pickle

    import pyarrow as pa
    import pytest

    table = pa.table({"id": [1, 2], "t": ["a", None]})
    for name, make in (("f", pa.ipc.new_file), ("s", pa.ipc.new_stream)):
        (tmp_path / name).mkdir()
        with make(str(tmp_path / name / "x.arrow"), table.schema) as w:
            w.write_table(table)
        got = files.read_files(spark, str(tmp_path / name), "id long, t string, more string").collect()
        assert sorted((r.id, r.t, r.more) for r in got) == [(1, "a", None), (2, None, None)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pkl").write_bytes(pickle.dumps([{"id": 5, "t": "z"}]))
    assert [tuple(r) for r in files.read_files(spark, str(tmp_path / "p"), "id long, t string").collect()] == [(5, "z")]
    with pytest.raises(pickle.UnpicklingError):
        list(files.pickle_batches(pickle.dumps([print]), table.schema))
    (tmp_path / "p" / "y.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        files.extension_of(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path / "f"))
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        files.extension_of(spark, str(tmp_path / "none"))


def test_strict_json_lines_raise(spark, tmp_path):
    import pytest

    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(path), "a long", strict=True).collect()
    path.write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(path), "a long", strict=True).collect()) == [1, 2]


def test_newest_snapshot(spark, tmp_path):
    import os

    for i, name in enumerate(["b", "a", "c"]):
        (tmp_path / name).mkdir()
        mark = tmp_path / name / ("config.json" if name != "c" else "other.json")
        mark.write_text("{}")
        os.utime(mark, (1_700_000_000 + i * 100,) * 2)
    assert files.newest_snapshot(spark, str(tmp_path)).endswith("/a")
    assert files.newest_snapshot(spark, str(tmp_path / "c")) is None


def test_csv_keeps_any_text(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith lines\\'), (2, ""), (3, None), (4, "\\\\N x")]
    files.write_csv(spark.createDataFrame(rows, "id long, t string"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "id long, t string").collect()) == rows


def test_lessons_are_a_snapshot(spark, tmp_path):
    memory = incremental.Lessons(spark, str(tmp_path / "l"), "k string, at long")
    memory.append(spark.createDataFrame([("a", 1), ("a", 2)], "k string, at long"))
    assert memory.newest("k", "at", 1).count() == 0
    again = incremental.Lessons(spark, str(tmp_path / "l"), "k string, at long")
    again.append(spark.createDataFrame([("a", 3)], "k string, at long"))
    assert [r["at"] for r in again.newest("k", "at", 1).collect()] == [2]
