"""The partitioned stream source: every line once, whatever is cut, killed or started again."""

import json
import os
import random

import pytest

from ticklake.streaming.capture import CaptureReader, CaptureSource, Stretch, retried


def lines(a, b, pad=0):
    return "".join(json.dumps({"recv_ns": i, "raw": f"message {i} é" + "x" * pad}, ensure_ascii=False) + "\n" for i in range(a, b))


def reader(path, **options):
    return CaptureReader({"path": str(path)} | {k: str(v) for k, v in options.items()})


def everything(r, start, end):
    return [row for p in r.partitions(start, end) for row in r.read(p)]


@pytest.mark.parametrize("split", [1, 7, 40, 1000, 1 << 20])
def test_splits_of_any_size_give_every_line_once(tmp_path, split):
    rng = random.Random(split)
    (tmp_path / "a.ndjson").write_text("".join(lines(i, i + 1, rng.randrange(60)) for i in range(40)) + "\n\n" + lines(40, 42))
    r = reader(tmp_path, split_bytes=split)
    got = everything(r, r.initialOffset(), r.latestOffset())
    assert sorted(x[2] for x in got) == list(range(42)) and {x[1] for x in got} == {"message"}
    data = (tmp_path / "a.ndjson").read_bytes()
    assert all(json.loads(data[x[4] : x[5]])["recv_ns"] == x[2] for x in got)


def test_offsets_end_after_lines_and_batches_are_bounded(tmp_path):
    f = tmp_path / "day/a.ndjson"
    f.parent.mkdir()
    f.write_text(lines(0, 10) + '{"recv_ns": 10, "ra')  # a line still being written
    r = reader(tmp_path)
    first = r.latestOffset()
    assert [x[2] for x in everything(r, {}, first)] == list(range(10))
    f.write_text(lines(0, 12))
    assert [x[2] for x in everything(r, first, r.latestOffset())] == [10, 11]
    small, at, got = reader(tmp_path, batch_bytes=50), {}, []
    for _ in range(100):  # less than two lines a batch
        to = small.latestOffset()
        new = everything(small, at, to)
        assert len(new) <= 2
        got += [x[2] for x in new]
        at = to
    assert got == list(range(12))


def test_what_is_missing_is_a_gap_and_what_is_damaged_is_shown(tmp_path):
    f = tmp_path / "a.ndjson"
    f.write_text(lines(0, 5) + "no json\n" + '{"recv_ns": 1}\n')
    r = reader(tmp_path, split_bytes=30)
    end = r.latestOffset()
    assert sorted(x[1] for x in everything(r, {}, end)) == ["damaged"] * 2 + ["message"] * 5
    f.write_text(lines(0, 2))  # cut short after it was planned
    got = everything(r, {}, end)
    assert [x[2] for x in got if x[1] == "message"] == [0, 1] and {x[6] for x in got if x[1] == "gap"} == {"cut short"}
    anew = r.latestOffset()
    got = everything(r, end, anew)
    assert [x[1] for x in got].count("gap") == 1 and [x[2] for x in got if x[1] == "message"] == [0, 1]
    f.unlink()
    assert {x[6] for x in everything(r, {}, end)} == {"gone"}


def test_failed_reads_are_tried_again():
    waits, left = [], [3]

    def fails():
        left[0] -= 1
        if left[0]:
            raise OSError("reset")
        return "read"

    assert retried(fails, 4, 0.5, waits.append) == "read" and waits == [0.5, 1.0]
    left[0] = 9
    with pytest.raises(OSError):
        retried(fails, 2, 0.5, waits.append)
    assert Stretch("a", 0, 1, True).gap is None


def test_a_killed_query_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(CaptureSource)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.ndjson").write_text(lines(0, 300))
    (folder / "b.ndjson").write_text(lines(300, 500) + '{"recv_ns": 500, ')

    def run(die):
        stream = spark.readStream.format("capture").option("path", str(folder)).option("split_bytes", "2000").option("batch_bytes", "6000").load()

        def batch(df, epoch):
            if die and epoch == 2:
                raise RuntimeError("killed")
            df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={epoch}")

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).start()

    q = run(True)
    with pytest.raises(Exception, match="killed"):
        q.processAllAvailable()
    with open(folder / "b.ndjson", "a") as f:  # the line is finished, more come
        f.write('"raw": "message 500"}\n' + lines(501, 600))
    q = run(False)
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["recv_ns"] for r in rows) == list(range(600)) and {r["kind"] for r in rows} == {"message"}
    assert len(os.listdir(tmp_path / "out")) > 3
