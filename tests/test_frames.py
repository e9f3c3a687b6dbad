"""Logs of zstd frames: splits anywhere, cut frames, filters before parsing."""

import json
import random

import pytest
import zstandard

from ticklake.sources import frames, raw


def line(i, text="tick"):
    return json.dumps({"recv_ns": i, "raw": f'{{"coin": "{"BTC" if i % 3 else "ETH"}", "n": {i}, "t": "{text}"}}'}) + "\n"


def frame(a, b, rng, level=3):
    text = "".join(line(i, "".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(200)))) for i in range(a, b))
    return zstandard.ZstdCompressor(level=level, write_content_size=False).compress(text.encode())


def write(folder, venue, date, hour, data):
    path = folder / f"venue={venue}/date={date}/hour={hour}"
    path.mkdir(parents=True, exist_ok=True)
    (path / "messages.ndjson.zst").write_bytes(data)
    return str(path / "messages.ndjson.zst")


def read(path, split):
    r = frames.FrameReader({"path": str(path), "split_bytes": str(split)})
    return [row for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]


@pytest.mark.parametrize("split", [97, 1000, 5000, 1 << 25])
def test_a_split_anywhere_gives_the_same_rows(tmp_path, split):
    rng = random.Random(1)
    parts = [frame(k * 50, k * 50 + 50, rng) for k in range(8)]
    write(tmp_path, "v", "2026-01-01", "00", b"".join(parts))
    rows = read(tmp_path, split)
    assert sorted(r["recv_ns"] for r in rows) == list(range(400))
    assert len({r["frame"] for r in rows}) == 8


@pytest.mark.parametrize("split", [700, 1 << 25])
def test_cut_frames_keep_their_whole_lines(tmp_path, split):
    rng = random.Random(2)
    big = [frame(k * 6000, k * 6000 + 6000, rng) for k in range(3)]
    cut = [x[: int(len(x) * 0.6)] for x in big]
    # A cut one first, then a whole one, then one cut at the file's end.
    write(tmp_path, "v", "2026-01-01", "00", cut[0] + big[1] + cut[2])
    rows = read(tmp_path, split)
    got = sorted(r["recv_ns"] for r in rows)
    first, last = [i for i in got if i < 6000], [i for i in got if i >= 12000]
    assert [i for i in got if 6000 <= i < 12000] == list(range(6000, 12000))
    assert first == list(range(len(first))) and 2000 < len(first) < 5000
    assert last == list(range(12000, 12000 + len(last))) and 2000 < len(last) < 5000
    assert all(json.loads(r["raw"])["n"] == r["recv_ns"] for r in rows)


def test_bytes_that_are_no_frames_are_passed_over(tmp_path):
    rng = random.Random(3)
    noise = frames.MAGIC + b"\x08garbage" + frames.MAGIC + b"\x24\x05\xff\xff\xff" + rng.randbytes(500)
    write(tmp_path, "v", "d", "00", noise + frame(0, 5, rng) + noise + frame(5, 9, rng) + frames.MAGIC)
    assert sorted(r["recv_ns"] for r in read(tmp_path, 64)) == list(range(9))
    assert not frames.starts_frame(b"") and not frames.starts_frame(frames.MAGIC)


def test_filters_reach_the_scan(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    for venue in ("a", "b"):
        for date in ("2026-01-01", "2026-01-02", "2026-01-03"):
            write(tmp_path, venue, date, "07", frame(0, 30, rng))
    some = frames.framed_messages(spark, str(tmp_path), venue="a", dates=["2026-01-02", "2026-01-03"], coin='"ETH"')
    rows = some.collect()
    assert len(rows) == 20 and {(r["venue"], r["date"]) for r in rows} == {("a", "2026-01-02"), ("a", "2026-01-03")}
    assert frames.framed_messages(spark, str(tmp_path)).count() == 180
    assert frames.framed_messages(spark, str(tmp_path), venue="none").count() == 0
    # What the reader is told: folders that aren't asked for aren't listed, other coins' lines aren't parsed.
    from pyspark.sql.datasource import EqualTo, In, StringContains

    r = frames.FrameReader({"path": str(tmp_path)})
    assert len(list(r.pushFilters([EqualTo(("venue",), "a"), In(("date",), ("2026-01-02",)), StringContains(("raw",), "ETH"), StringContains(("raw",), "é")]))) == 4
    parts, seen = r.partitions(), []
    assert [(p.venue, p.date) for p in parts] == [("a", "2026-01-02")] and r.texts == [b"ETH"]
    real = json.loads
    monkeypatch.setattr(frames.json, "loads", lambda x: seen.append(x) or real(x))
    assert sum(b.num_rows for p in parts for b in r.read(p)) == len(seen) == 10


def test_frames_hold_what_the_plain_reader_reads(spark, tmp_path):
    rng = random.Random(5)
    write(tmp_path, "v", "2026-01-01", "01", frame(0, 40, rng) + frame(40, 90, rng))
    text = "".join(line(i) for i in range(90))
    plain = tmp_path / "plain/venue=v/date=2026-01-01/hour=01"
    plain.mkdir(parents=True)
    (plain / "m.ndjson").write_text(text)
    want = sorted(r["recv_ns"] for r in raw.raw_messages(spark, str(tmp_path / "plain"), "v").collect())
    assert sorted(r["recv_ns"] for r in frames.framed_messages(spark, str(tmp_path), venue="v", split_bytes=300).collect()) == want


def test_bronze_appends_frames_and_a_batch_again_replaces_its_own(spark, tmp_path):
    from ticklake.streaming import live

    (tmp_path / "in").mkdir()
    hour = 3_600 * 10**9
    (tmp_path / "in/a.ndjson").write_text("".join(json.dumps({"recv_ns": i * hour // 4, "raw": f"é{i}"}) + "\n" for i in range(20)))
    run = lambda: live.bronze(live.raw_stream(spark, str(tmp_path / "in")), "v", str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in/b.ndjson").write_text(json.dumps({"recv_ns": 5, "raw": "late"}) + "\n")
    run()
    back = frames.framed_messages(spark, str(tmp_path / "log")).collect()
    assert sorted((r["recv_ns"], r["raw"]) for r in back) == sorted([(i * hour // 4, f"é{i}") for i in range(20)] + [(5, "late")])
    assert {(r["date"], r["hour"]) for r in back} == {("1970-01-01", f"{h:02d}") for h in range(5)}
    made = frames.write_frames(spark.createDataFrame([("w", "1970-01-01", "00", 1, "x")], "venue string, date string, hour string, recv_ns long, raw string"), str(tmp_path / "log"), "r")
    assert [r["lines"] for r in made.collect()] == [1] and frames.write_frames(frames.framed_messages(spark, str(tmp_path / "log"), venue="none"), str(tmp_path / "log")).count() == 0
