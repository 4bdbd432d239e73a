"""Binary event logs, line numbers, streams, and expressions."""

import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.functions import times
from timeloom.schema import Context
from timeloom.sources.evtx import CHUNK, FILE_HEADER, records_in
from timeloom.sources.lines import read_lines


class Chunk:
    """Writes one chunk with one record whose template is defined in place."""

    def __init__(self):
        self.data = bytearray(b"ElfChnk\0".ljust(512, b"\0"))

    def name(self, text):
        at = len(self.data) + 4
        self.data += struct.pack("<I", at) + struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def open(self, name, attributes=()):
        self.data += bytes([0x41 if attributes else 0x01]) + struct.pack("<HI", 0xFFFF, 0)
        self.name(name)
        if attributes:
            self.data += struct.pack("<I", 0)
            for i, (key, value) in enumerate(attributes):
                self.data += bytes([0x46 if i + 1 < len(attributes) else 0x06])
                self.name(key)
                value()
        self.data += b"\x02"

    def text(self, value):
        self.data += struct.pack("<BBH", 5, 1, len(value)) + value.encode("utf-16-le")

    def slot(self, index, kind):
        self.data += struct.pack("<BHB", 0x0D, index, kind)

    def close(self):
        self.data += b"\x04"


def make_evtx():
    c = Chunk()
    start = len(c.data)
    c.data += struct.pack("<IIQQ", 0x2A2A, 0, 7, 133265610450000000) + b"\x0f\x01\x01\x00" + b"\x0c\x01" + struct.pack("<I", 1)
    c.data += struct.pack("<I", len(c.data) + 4)
    body = len(c.data)
    c.data += struct.pack("<I16sI", 0, b"g" * 16, 0) + b"\x0f\x01\x01\x00"
    c.open("Event")
    c.open("System")
    c.open("Provider", [("Guid", lambda: c.text("{1}")), ("Name", lambda: c.text("Prov"))])
    c.close()
    c.open("EventID")
    c.slot(0, 6)
    c.close()
    c.open("TimeCreated", [("SystemTime", lambda: c.slot(1, 17))])
    c.close()
    c.open("Channel")
    c.text("Security")
    c.close()
    c.open("Security", [("UserID", lambda: c.slot(2, 19))])
    c.close()
    c.close()
    c.close()
    c.data += b"\0"
    struct.pack_into("<I", c.data, body + 20, len(c.data) - body - 24)
    sid = bytes([1, 1, 0, 0, 0, 0, 0, 5]) + struct.pack("<I", 18)
    c.data += struct.pack("<I", 3) + struct.pack("<HBB", 2, 6, 0) + struct.pack("<HBB", 8, 17, 0) + struct.pack("<HBB", len(sid), 19, 0)
    c.data += struct.pack("<HQ", 4624, 133265610450000000) + sid
    size = len(c.data) - start + 4
    struct.pack_into("<I", c.data, start + 4, size)
    c.data += struct.pack("<I", size)
    return b"ElfFile\0".ljust(FILE_HEADER, b"\0") + bytes(c.data).ljust(CHUNK, b"\0")


def test_event_log_records():
    ((number, written, fields),) = records_in(make_evtx())
    assert (number, written) == (7, datetime(2023, 4, 21, 14, 30, 45, tzinfo=timezone.utc))
    assert fields == {"Provider@Guid": "{1}", "Provider@Name": "Prov", "EventID": "4624", "TimeCreated@SystemTime": "2023-04-21T14:30:45.000000Z", "Channel": "Security", "Security@UserID": "S-1-5-18"}
    assert list(records_in(b"junk")) == [] and list(records_in(make_evtx()[:5000])) in ([], [(number, written, fields)])


def test_event_log_events(spark, tmp_path):
    from timeloom.plans.timeline import build_timeline

    (tmp_path / "a.evtx").write_bytes(make_evtx())
    (tmp_path / "b.evtx").write_bytes(b"")
    (r,) = build_timeline(spark, str(tmp_path)).events.collect()
    assert (r.event_type, r.event_id, r.user, r.message) == ("Security", 4624, "S-1-5-18", "Event ID: 4624 (Provider: Prov)")


def test_line_numbers_over_splits(spark, tmp_path):
    a = [f"line {i}" if i % 7 else "" for i in range(1, 5001)]
    (tmp_path / "a.log").write_text("\n".join(a))
    (tmp_path / "b c+%.log").write_text("x\ry\r\n\nz\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = read_lines(spark, [str(tmp_path)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.line_no, r.line) for r in rows if r.source == "a.log"} == {(i, x) for i, x in enumerate(a, 1) if x}
    assert {(r.line_no, r.line) for r in rows if r.source == "b c+%.log"} == {(1, "x\ry"), (3, "z")}


def test_patterns():
    assert tx.java_regex(r"^a.\s[\s\]]$") == r"(?du)^a.[\t\n\f\r ][\t\n\f\r \]]\z"


PATTERNS = [
    (r"\p{L}+", "a", "1"), (r"\pN", "1", "a"), (r"end\z", "the end", "end\n"), ("a(?i)B", "ab", "Ab"), ("(?P<x>a)", "a", "b"), ("[[:digit:]]+", "2", "d"), ("[[:^digit:]]", "x", "2"),
    ("^[]a]$", "]", "b"), ("[a[]", "[", "b"), ("(?m)^x$", "a\nx\nb", "ax"), ("(?m:^x$)\ny$", "x\ny", "x\ny\n"), ("x$", "x", "x\n"), ("[a&&b]", "&", "c"), ("(?i)é", "É", "e"), (r"\Qa.b$\E", "a.b$", "axb"), (r"[a]+b", "aab", "a"),
]


def test_patterns_of_a_linear_engine(spark):
    got = spark.range(1).select(*[F.struct(F.lit(y).rlike(tx.java_regex(p)), F.lit(n).rlike(tx.java_regex(p))) for p, y, n in PATTERNS]).first()
    assert [tuple(x) for x in got] == [(True, False)] * len(PATTERNS)


def test_expressions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(tx.cut_bytes(F.lit("é" * 60), 100, 10)) == "é" * 5 + "..."
    assert get(tx.tail_bytes(F.lit("a" * 101), 100, 97)) == "..." + "a" * 97
    assert get(times.rfc3339(F.lit("2023-01-01"))) is None
    assert get(F.unix_micros(times.rfc3339(F.lit("2023-01-01T00:00:00.123456789+01:00")))) == 1672527600123456
    assert get(times.offset_minutes(F.lit("x-0730"))) == -450 and get(times.offset_minutes(F.lit("x"))) is None
    assert get(times.elapsed(F.lit(3661))) == "1h1m1s" and get(times.elapsed(F.lit(60))) == "1m0s" and get(times.elapsed(F.lit(0))) == "0s"
    assert get(F.unix_micros(times.epoch_text(F.lit("1682087445.1234567")))) == 1682087445123456 and get(times.epoch_text(F.lit("x"))) is None


def test_streams(spark, tmp_path):
    from timeloom.streaming import arrivals

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "cbs.log").write_text("2023-04-21 15:30:45, Info a\n2023-04-21 15:31:45, Info b\n\nraw\n")
    events = arrivals.stream_events(spark, str(folder), "windows_text", Context(datetime(2024, 1, 1, tzinfo=timezone.utc)))
    q = arrivals.counts_by_window(events).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.events) for r in spark.sql("select * from counted").collect()} == {("WindowsLog", 2), ("WindowsLogRaw", 1)}
    got = []
    arrivals.stream_timeline(spark, str(folder), lambda e, n: got.extend(e.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert len(got) == 3


@pytest.mark.parametrize("line", ["2023-04-21 15:30:45, Info " + "x" * 70_000])
def test_long_lines(spark, tmp_path, line):
    from timeloom.plans.timeline import build_timeline

    (tmp_path / "cbs.log").write_text(line + "\n")
    (r,) = build_timeline(spark, str(tmp_path)).events.collect()
    assert r.event_type == "WindowsLog" and len(r.message) < 65_536
