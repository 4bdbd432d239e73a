"""CSV files in splits: which lines make a record, against one pass over the whole file."""

import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import csv_artifacts
from timeloom.operators.segments import Records
from timeloom.sources.manifest import first_lines


def plain(text, sep=","):
    """Records of a text: line by line, character by character."""
    out, is_open, number = [], False, 0
    for line in text.removesuffix("\n").split("\n"):
        if not is_open and line == "":
            continue
        if is_open:
            out[-1] += "\n" + line
        else:
            out.append(line)
        i, start = 0, not is_open
        while i < len(line) or is_open:
            if is_open:
                end = i
                while end < len(line) and not (line[end] == '"' and line[end + 1 : end + 2] != '"'):
                    end += 2 if line[end] == '"' else 1
                if end >= len(line):
                    break
                is_open, i, start = False, end + 1, False
            elif start and line[i:].lstrip(" \t").startswith('"'):
                is_open, i = True, i + len(line[i:]) - len(line[i:].lstrip(" \t")) + 1
            else:
                cut = line.find(sep, i)
                if cut < 0:
                    break
                i, start = cut + 1, True
    return out


def make_text(rng, sep, lines):
    cell = lambda: rng.choice(["a", "", "x y", '"q"', '"a,b;c"', '"two\nlines"', '"three\n\nlines ""x"""', '5" disk', ' "led"', '"', '"a"b', "é"]) if rng.random() < 0.4 else "v"
    return "\n".join(rng.choice(["", sep.join(cell() for _ in range(rng.randint(1, 4)))]) if rng.random() < 0.1 else sep.join(cell() for _ in range(3)) for _ in range(lines)) + "\n"


@pytest.mark.parametrize("seed, sep", [(1, ","), (2, ";"), (3, ",")])
def test_records_over_splits(spark, tmp_path, seed, sep):
    rng = random.Random(seed)
    texts = {f"f{i}.csv": make_text(rng, sep, 400) for i in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = csv_artifacts.read_lines(spark, [str(tmp_path)], blank=True, numbered=False)
        got = csv_artifacts.records_of(lines, sep).collect()
        assert lines.rdd.getNumPartitions() > 8
        dealt = csv_artifacts.records_of(csv_artifacts.read_lines(spark, [str(tmp_path)], blank=True, numbered=False, most_broadcast=0), sep).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(name, i, r) for name, text in texts.items() for i, r in enumerate(plain(text, sep), 1)}
    assert {(r.source, r.line_no, r.text) for r in got} == want == {(r.source, r.line_no, r.text) for r in dealt}
    assert len(got) == len(want) and any("\n" in r.text for r in got)


def test_fields_are_those_of_the_reader(spark, tmp_path):
    """The same rows as the reader that takes a file in one task, for files that it reads as they are meant."""
    rng = random.Random(5)
    cell = lambda: rng.choice(["a", "", "x y", '"q"', '"a,b;c"', '"two\nlines"', '"th\n\nree ""x"""', ' "led"', "é", '"crlf\r\nx"'])
    text = "A,B,C\r\n" + "".join(",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))) + "\r\n" for _ in range(500))
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = csv_artifacts.read_csv(spark, [str(path)], ["A", "B", "C"], ",").orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = spark.read.schema("c0 string, c1 string, c2 string").csv(str(path), header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True).collect()
    assert [tuple(r)[3:] for r in got] == [tuple(r) for r in want] and [r.line_no for r in got] == list(range(2, len(want) + 2))
    assert first_lines(spark, [str(path)]) == ["A,B,C"]


@pytest.mark.parametrize("cut", [0, 3, 20])
def test_effects_of_records_compose(cut):
    import pyarrow as pa

    rng = random.Random(cut)
    rows = [(rng.random() < 0.3, rng.random() < 0.6, rng.random() < 0.1) for _ in range(20)]
    columns = lambda part: [pa.array(x, pa.bool_()) for x in zip(*part, strict=True)] if part else [pa.array([], pa.bool_())] * 3
    for before in ((False, 0), (True, 4)):
        m, state = Records(), before
        for part in (rows[:cut], rows[cut:]):
            take, done = m.effect()
            take(columns(part))
            state = m.after(done(), state)
        is_open, n, want = *before, []
        for opens, stays, blank in rows:
            begins = not is_open and not blank
            n += begins
            want.append(n if begins else -n if is_open else 0)
            is_open = stays if is_open else opens and not blank
        assert m.run(before)(columns(rows)).to_pylist() == want and tuple(state) == (is_open, n)


def test_long_first_lines(spark, tmp_path):
    (tmp_path / "a").write_text("x" * 200_000 + "\r\nsecond")
    (tmp_path / "b").write_text("")
    assert first_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == ["x" * 200_000, ""]


def test_records_are_read_and_joined_once(spark, tmp_path):
    """Lines are read twice, once to find where records begin, and are shuffled once for all passes that follow."""
    from timeloom.plans.timeline import build_timeline
    from timeloom.schema import Context

    (tmp_path / "a b.csv").write_text("Time,Message\n" + "".join(f'2024-01-02 03:04:{i % 60:02},"x\n{i}"\n' for i in range(300)))
    events = build_timeline(spark, str(tmp_path), context=Context()).events
    rows = events.orderBy("event_id").collect()
    assert [(r.source, r.event_id, r.message) for r in rows] == [("a b.csv", i + 2, f"x\n{i}") for i in range(300)]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = events.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert plan.count("FileScan text") == 2 and "ReusedExchange" in plan


def test_records_over_batches(spark, tmp_path):
    """Records that go on over many batches between Spark and Python."""
    texts = {f"f{i}.csv": make_text(random.Random(i), ",", 300) for i in range(2)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = csv_artifacts.records_of(csv_artifacts.read_lines(spark, [str(tmp_path)], blank=True, numbered=False), ",").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(r.source, r.line_no, r.text) for r in got} == {(name, i, r) for name, text in texts.items() for i, r in enumerate(plain(text), 1)}


def test_nul_in_fields(spark, tmp_path):
    """NUL within a field is a character like others, in quoted fields too."""
    fields = ["a\0b", "\0", '\0"', '"\0', 'x\0"\0"y', "\0\n\0", "é\0\0"]
    path = tmp_path / "a.csv"
    path.write_text("A,B\n" + "".join(f'"{f.replace(chr(34), chr(34) * 2)}",b\0{i}\n' for i, f in enumerate(fields)))
    got = csv_artifacts.read_csv(spark, [str(path)], ["A", "B"], ",").orderBy("line_no").collect()
    assert [(r.c0, r.c1) for r in got] == [(f, f"b\0{i}") for i, f in enumerate(fields)]
