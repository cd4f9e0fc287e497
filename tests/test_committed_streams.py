import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from losslens.sources import appends, scans
from losslens.streaming import verification
from losslens.streaming.incremental import ModelClient, call_bounded, leases

SCHEMA = "id long, text string"


def read(spark, path):
    return sorted((tuple(r) for r in appends.committed_lines(spark, path, SCHEMA).collect()), key=str)


def test_appends_count_once_committed(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    some = spark.createDataFrame([(i, f"t{i}\n") for i in range(7)], SCHEMA).repartition(2)
    appends.append_lines(some, path, chunk=2)
    assert read(spark, path) == [(i, f"t{i}\n") for i in range(7)]
    files = os.listdir(tmp_path / "sink" / "chunks")
    assert len(files) == 4 and all(len(open(tmp_path / "sink" / "chunks" / f).readlines()) <= 2 for f in files)
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("text")).repartition(3)
    with pytest.raises(Exception):
        appends.append_lines(bad, path, chunk=5)
    assert len(read(spark, path)) == 7  # whatever the failed tasks have left
    appends.append_lines(some.limit(0), path)
    appends.append_lines(spark.createDataFrame([(None, None)], SCHEMA), path)
    assert read(spark, path)[-1] == (None, None) and len(read(spark, path)) == 8
    appends.append_lines(some.where("id = 1"), path, overwrite=True)
    assert read(spark, path) == [(1, "t1\n")]
    with pytest.raises(ValueError):
        appends.LinesWriter({"path": path, "chunk": "0"}, StructType())


def test_a_repeated_epoch_and_a_failed_attempt_add_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    writer = appends.StreamLinesWriter({"path": path, "chunk": "2"}, spark.createDataFrame([], SCHEMA).schema)

    def failing():
        yield (1, "a")
        yield (2, "b")
        yield (3, "c")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writer.write(failing())
    first = writer.write(iter([(1, "a"), (2, "b"), (3, "c")]))
    assert first.rows == 3 and len(first.files) == 2
    writer.commit([first, None], 0)
    writer.commit([writer.write(iter([(1, "a"), (2, "b"), (3, "c")]))], 0)
    gone = writer.write(iter([(9, "z")]))
    writer.abort([gone, None], 1)
    writer.abort([gone], 1)
    assert read(spark, path) == [(1, "a"), (2, "b"), (3, "c")]
    assert not os.path.exists(tmp_path / "sink" / "chunks" / gone.files[0])


def test_verification_goes_on_after_a_failure(spark, tmp_path):
    base = f"file://{tmp_path}"
    flag = str(tmp_path / "well")

    def judge(row):
        if row["v"] == 13 and not os.path.exists(flag):
            raise RuntimeError("down")
        return "even" if row["v"] % 2 == 0 else "odd"

    def run():
        verification.run_verification(spark, f"{base}/in", "k long, o long, v long", ["k"], "o", judge, f"{base}/out", f"{base}/check", files=1, chunk=3)

    spark.createDataFrame([(i % 2, i, i) for i in range(10)] + [(0, 4, 4)], "k long, o long, v long").coalesce(1).write.parquet(f"{base}/in/a")
    run()
    spark.createDataFrame([(i % 2, i, i) for i in range(5, 20)], "k long, o long, v long").coalesce(1).write.parquet(f"{base}/in/b")
    with pytest.raises(Exception):
        run()
    done = lambda: appends.committed_lines(spark, f"{base}/out", "k long, part int, o long, status string, so_far long")
    assert sorted(r.o for r in done().collect()) == list(range(10))
    open(flag, "w").close()
    run()
    run()  # nothing new
    assert sorted((r.k, r.o, r.status) for r in done().collect()) == sorted((i % 2, i, "even" if i % 2 == 0 else "odd") for i in range(20))
    assert sorted(tuple(r) for r in verification.status_counts(done(), ["k"]).collect()) == [(0, "even", 10), (1, "odd", 10)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != verification.ROCKS


def test_offsets_of_a_paged_source(spark, tmp_path):
    path = f"file://{tmp_path}"

    def page(name, starts, following):
        body = {"data": [{"start_time": s, "results": [{"model": "m", "num_model_requests": 1}]} for s in starts], "has_more": following is not None, "next_page": following}
        (tmp_path / f"{name}.json").write_text(json.dumps(body))

    page("first", [1, 2], "p1")
    page("p1", [3], None)
    reader = scans.PagedStreamReader(scans.FolderPages({"path": path}))
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"page": "p1", "buckets": 1}
    got = lambda a, b: [r[0] for p in reader.partitions(a, b) for r in reader.read(p)]
    assert got(start, end) == [1, 2, 3] and got(end, end) == []
    page("p1", [3, 4], "p2")
    page("p2", [], None)
    more = reader.latestOffset()
    assert more == {"page": "p2", "buckets": 0} and got(end, more) == [4]
    page("p2", [5, 6], None)
    assert got(more, reader.latestOffset()) == [5, 6] and got(end, reader.latestOffset()) == [4, 5, 6]
    again = scans.PagedStreamReader(scans.FolderPages({"path": path}))  # a restart knows its offset only
    assert [r[0] for p in again.partitions(end, again.latestOffset()) for r in again.read(p)] == [4, 5, 6]
    with pytest.raises(ValueError):
        reader.partitions({"page": "p2", "buckets": 0}, {"page": "p1", "buckets": 1})


def test_pages_are_laid_out_by_tasks(spark, tmp_path):
    rows = [(s, m, s * 10) for s in range(20) for m in "ab"]
    path = f"file://{tmp_path}/pages"
    assert scans.write_pages(spark.createDataFrame(rows, "start_time long, model string, num_model_requests long").repartition(4), path) == 20
    assert sorted(os.listdir(tmp_path / "pages")) == ["first.json", "p1.json", "p2.json"]
    assert sorted((r.start, r.model, r.requests) for r in scans.read_pages(spark, client="folder", path=path).collect()) == rows
    none = f"file://{tmp_path}/none"
    assert scans.write_pages(spark.createDataFrame([], "start_time long, model string, num_model_requests long"), none) == 0
    assert scans.read_pages(spark, client="folder", path=none).count() == 0


def test_leases_are_fair_and_bounded():
    assert leases([5, 5, 5], 4) == [2, 1, 1] and leases([5, 5, 5], 4, 1) == [1, 2, 1]
    assert leases([0, 9, 0], 4) == [0, 4, 0] and leases([0, 0], 4) == [0, 0] and leases([1, 1], 9) == [1, 1]


class CountingClient(ModelClient):
    """Notes when each call began and ended."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, prompts):
        began = time.time_ns()
        time.sleep(0.01)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{began} {time.time_ns()}")
        if prompts == ["down"]:
            raise OSError
        return super().complete(prompts)


def test_calls_never_pass_the_bound_of_the_cluster(spark, tmp_path):
    rows = [(i, f"a\nq{i}" if i % 50 else "down") for i in range(149)] + [(1000, None)]
    got = call_bounded(spark.createDataFrame(rows, "id long, prompt string").repartition(7), CountingClient(str(tmp_path)), 3, quantum=5, tries=2, pause=0.0).collect()
    assert {r.id: r.answer for r in got} == {i: None if p == "down" else (p or "").split("\n")[-1] for i, p in rows}
    times = sorted((t, step) for f in os.listdir(tmp_path) for t, step in zip(map(int, (tmp_path / f).read_text().split()), (1, -1)))
    running = most = 0
    for _, step in times:
        running += step
        most = max(most, running)
    assert 1 < most <= 3 and len(times) == 2 * (len(rows) + 3)
    assert call_bounded(spark.createDataFrame([], "id long, prompt string"), ModelClient(), 2).count() == 0
    with pytest.raises(ValueError):
        call_bounded(spark.range(1).selectExpr("id", "'x' AS prompt"), ModelClient(), 0)
