"""The sink of whole parts: killed tasks, replayed runs, row groups."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from ticklake.sources.parts import PartSink, read_parts, write_parts


def files(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-")), sorted(f for f in os.listdir(path) if f.startswith("."))


def test_parts_have_row_groups_and_runs_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000, numPartitions=3).select("id", F.array("id").alias("a"), F.lit(None).cast("string").alias("s"))
    write_parts(rows, path, run="day1", group_rows=100)
    write_parts(rows, path, run="day1", group_rows=100)  # again: nothing changes
    names, hidden = files(path)
    assert len(names) == 3 and not hidden
    groups = pq.ParquetFile(f"{path}/{names[0]}").metadata
    assert [groups.row_group(k).num_rows for k in range(groups.num_row_groups)] == [100, 100, 100, groups.num_rows - 300]
    write_parts(rows.limit(0), path, run="day2")
    write_parts(rows.limit(5), path, run="day3")
    assert read_parts(spark, path, rows.schema).count() == 1005
    assert sorted(read_parts(spark, path, rows.schema).where("id >= 500").select("id").collect())[0]["id"] == 500


def test_a_run_that_dies_between_moving_and_listing_moves_the_same_names_again(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100, numPartitions=2)
    write_parts(rows, path, run="x")
    os.remove(f"{path}/_runs/x.json")
    write_parts(rows, path, run="x")
    assert read_parts(spark, path, rows.schema).count() == 100 and len(files(path)[0]) == 2


def test_a_killed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")

    def dies(batches):
        for b in batches:
            yield b
            if TaskContext.get().partitionId() == 1:
                raise RuntimeError("killed midway")

    rows = spark.range(100_000, numPartitions=2).mapInArrow(dies, "id long")
    with pytest.raises(Exception, match="killed midway"):
        write_parts(rows, path, group_rows=1000)
    assert not os.path.exists(path) or files(path) == ([], [])


def test_a_stream_batch_counts_once(spark, tmp_path):
    spark.dataSource.register(PartSink)
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    path = str(tmp_path / "t")
    stream = spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: stream.writeStream.format("parts").option("path", path).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert read_parts(spark, path, "id long").count() == 30
    for name in ("2", ".2.crc"):
        os.remove(tmp_path / f"ck/commits/{name}")  # as if it had died after the sink's commit: the batch runs again
    run()
    rows = [r["id"] for r in read_parts(spark, path, "id long").collect()]
    assert sorted(rows) == list(range(30)) and len(files(path)[0]) == 3 and not files(path)[1]
