"""The vendor's binary files: bytes built here and read back, split anywhere."""

import random
import struct

import numpy as np
import pytest
import zstandard

from ticklake.sources import raw, vendor_files as V

DAY = 86_400 * 10**9
NONE = 2**63 - 1


def header(version, mappings):
    width = 22 if version == 1 else 71
    text = lambda s: s.encode().ljust(width, b"\0")
    body = b"TEST.DATA".ljust(16, b"\0") + struct.pack("<HQQQ", 1, 0, 0, 0) + (struct.pack("<Q", 0) if version == 1 else b"") + bytes([0, 1, 0])
    body += b"" if version == 1 else struct.pack("<H", width)
    body += bytes(47 if version == 1 else 53) + struct.pack("<I", 0)
    body += struct.pack("<I", 1) + text("ES.c.0") + struct.pack("<II", 0, 0) + struct.pack("<I", len(mappings))
    for name, days in mappings.items():
        body += text(name) + struct.pack("<I", len(days)) + b"".join(struct.pack("<II", a, b) + text(i) for a, b, i in days)
    return b"DBN" + bytes([version]) + struct.pack("<I", len(body)) + body


def records(rtype, n, seed=1):
    rng = random.Random(seed)
    kind = V.record_type(rtype)
    rows = np.zeros(n, kind)
    rows["length"], rows["rtype"] = kind.itemsize // 4, rtype
    for i in range(n):
        rows[i]["instrument_id"], rows[i]["ts_event"], rows[i]["sequence"] = rng.choice([11, 12, 13]), i * DAY // 7 + 3 * DAY, i
        rows[i]["ts_recv"], rows[i]["price"], rows[i]["size"], rows[i]["side"], rows[i]["action"] = rows[i]["ts_event"] + 5, rng.randrange(10**12), rng.randrange(9), rng.choice([b"A", b"B", b"N"]), b"T"
        if "levels" in kind.names:
            for k in range(len(rows[i]["levels"])):
                rows[i]["levels"][k] = (10**11 - k * 10**9, 10**11 + (k + 1) * 10**9 if k < 8 else NONE, k + 1, k + 2, 1, 1)
    return rows


MAP = {"ESH0": [(19700101, 19700106, "11"), (19700106, 19700201, "12")], "ESM0": [(19700101, 19700106, "12")]}


def symbol(instrument, ts):
    early = ts < 5 * DAY
    return {11: "ESH0" if early else None, 12: "ESM0" if early else "ESH0"}.get(instrument)


def read(path, split):
    r = V.VendorReader({"path": str(path), "split_bytes": str(split)})
    parts = r.partitions()
    return parts, [row for p in parts for b in r.read(p) for row in b.to_pylist()]


@pytest.mark.parametrize(("version", "rtype"), [(1, 0), (2, 1), (2, 10), (3, 10)])
def test_splits_anywhere_give_the_same_rows(tmp_path, version, rtype):
    rows = records(rtype, 90)
    (tmp_path / "x.dbn").write_bytes(header(version, MAP) + rows.tobytes() + rows[:1].tobytes()[:7])  # the last one is cut
    (tmp_path / "x.txt").write_text("no such file")
    for split in (1, 500, 4000, 1 << 30):
        parts, got = read(tmp_path, split)
        assert len(parts) == -(-90 // max(1, split // rows.dtype.itemsize))
        assert [(r["record"], r["sequence"], r["price"], r["side"], r["ts_event"]) for r in got] == [(i, i, int(x["price"]), x["side"].decode(), int(x["ts_event"])) for i, x in enumerate(rows)]
        assert [r["symbol"] for r in got] == [symbol(int(x["instrument_id"]), int(x["ts_event"])) for x in rows]
        assert all(len(r["levels"]) == V.LEVELS[rtype] for r in got)


def test_compressed_files_are_streams(tmp_path):
    rows = records(10, 5000)
    data = header(2, MAP) + rows.tobytes()
    (tmp_path / "x.dbn.zst").write_bytes(zstandard.compress(data[:90_000]) + zstandard.compress(data[90_000:]))
    parts, got = read(tmp_path, 100)
    assert len(parts) == 1 and [r["sequence"] for r in got] == list(range(5000)) and got[4999]["levels"][9]["ask_px"] == NONE


def test_what_is_no_such_file_raises(tmp_path):
    bad = tmp_path / "x.dbn"
    for data in (b"", b"ABC" + bytes(30), b"DBN\x09" + bytes(30), header(2, {}) + bytes([99, 10]) + bytes(400), header(2, {}) + bytes([12, 77]) + bytes(60)):
        bad.write_bytes(data)
        with pytest.raises(ValueError):
            read(tmp_path, 100)
    one, two = records(0, 2), records(0, 2)
    two["length"] = 20
    bad.write_bytes(header(2, {}) + one.tobytes() + two.tobytes())
    with pytest.raises(ValueError):
        read(tmp_path, 1 << 20)
    bad.write_bytes(header(2, {}))  # no records
    assert read(tmp_path, 100)[1] == []


def test_files_become_books_and_trades(spark, tmp_path):
    (tmp_path / "book").mkdir()
    (tmp_path / "book/x.dbn").write_bytes(header(2, MAP) + records(10, 40).tobytes())
    (tmp_path / "trades.dbn").write_bytes(header(2, MAP) + records(0, 40).tobytes())
    books = raw.vendor_records(V.vendor_files(spark, str(tmp_path / "book"), 1000), "ES").collect()
    assert len(books) == 40 and books[0]["best_bid"] == 100.0 and len(books[0]["bid_prices"]) == 10 and len(books[0]["ask_prices"]) == 8
    trades = raw.vendor_trades(V.vendor_files(spark, str(tmp_path / "trades.dbn")), "ES")
    assert trades.count() == 40 and {r["venue_side"] for r in trades.select("venue_side").distinct().collect()} == {"sell", "buy", None}
