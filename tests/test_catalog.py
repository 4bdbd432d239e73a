"""Queries of the catalogue against their SQL, on whole tables."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from timeloom.operators import sequence, xml_logs
from timeloom.plans import catalog, file_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def compared(spark, name):
    """The query's rows, which are those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert Counter(got) == Counter(want.fetchall())
    return got


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_route_pages(spark):
    rows = compared(spark, "route_files")
    assert Counter(r[0] for r in rows) == {r.page_id: 1 + len(catalog._ROUTES) for r in table(spark, "pages").collect()}


def test_sysmon_names(spark):
    parts, events = compared(spark, "sysmon_type_map"), compared(spark, "sysmon_parse")
    assert len(parts) == table(spark, "part").count() and len(events) == table(spark, "orders").count()
    kinds = {k for _, k in parts} | {r[1] for r in events}
    assert {f"Sysmon:{n}" for n in xml_logs.MONITOR_EVENTS.values()} <= kinds


def test_web_raw_lines(spark):
    rows = compared(spark, "web_raw_fallback")
    assert len(rows) == sum(x.strip() != "" for r in table(spark, "documents").collect() for x in (r.text or "").split("\n"))


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n.startswith("files_")))
def test_through_files(spark, name):
    assert compared(spark, name)


@pytest.mark.parametrize("name", ["web_raw_lines", "sysmon_type_names", "sysmon_all_events", "route_pages", "filter_patterns", "csv_quoted_texts", "log_sticky_pattern"])
def test_whole_tables(spark, name):
    assert compared(spark, name)


@pytest.mark.parametrize("name", ["zeek_conn", "zeek_mystery", "iis_parse", "syslog_3164_year", "csv_role_inference"])
def test_along_files(spark, name):
    assert compared(spark, name)


def test_state_of_headers(spark):
    """Headers that change, repeat and follow each other, against a loop over the lines; counts across stretches."""
    rng, rows, want = random.Random(3), [], []
    for f in range(4):
        names = other = None
        n, no = 0, 0
        for _ in range(150):
            no += rng.choice([1, 1, 2])
            kind = rng.choice(["data"] * 6 + ["name", "other", "none"]) if _ or f else "data"
            value = rng.choice("ab")
            rows.append((f"f{f}", no, kind, value))
            names = value if kind == "name" else names
            other = value if kind == "other" else other
            if kind == "data" and names is not None:
                n += 1
                want.append((f"f{f}", no, names, other, n))
    lines = spark.createDataFrame(rows, "path string, line_no bigint, kind string, value string").repartition(5)
    heads = sequence.last_value(lines.where("kind <> 'data'"), names=F.when(F.col("kind") == "name", F.col("value")), other=F.when(F.col("kind") == "other", F.col("value")))
    got = sequence.counted(sequence.headed(lines.where("kind = 'data'"), heads, "names", "other"), "ordinal", stretch=7)
    assert sorted(tuple(r) for r in got.select("path", "line_no", "names", "other", "ordinal").collect()) == want


def test_web_raw_lines_whole(spark):
    """A row for each line, not for each document."""
    rows = compared(spark, "web_raw_lines")
    assert len(rows) == sum(x.strip() != "" for r in table(spark, "documents").collect() for x in (r.text or "").split("\n"))


def test_sysmon_type_names_whole(spark):
    """A row for each part, not for each type."""
    assert len(compared(spark, "sysmon_type_names")) == table(spark, "part").count()


def test_sysmon_all_events_whole(spark):
    """A row for each order, not for each type."""
    assert len(compared(spark, "sysmon_all_events")) == table(spark, "orders").count()


def test_route_pages_whole(spark):
    """A row for each path of each page, not for each parser."""
    assert len(compared(spark, "route_pages")) == table(spark, "pages").count() * (1 + len(catalog._ROUTES))


def test_heads_of_stretches(spark):
    """The same found by stretches, with numbers, and lines of a long file dealt to many tasks before anything is added to them."""
    rng, rows, want = random.Random(4), [], []
    for f in range(5):
        names, n, no, header = None, 0, 0, f == 4
        for i in range(200):
            no += rng.choice([1, 1, 2, 30])
            kind = "name" if header or i == (0, 20, 60, 199, 7)[f] else rng.choice(["data"] * 9 + ["name"] * (names is not None))
            header = False
            value = rng.choice("abc")
            rows.append((f"f{f}", no, kind, value))
            names = value if kind == "name" else names
            if kind == "data" and names is not None:
                n += 1
                want.append((f"f{f}", no, names, n))
    lines = spark.createDataFrame(rows, "path string, line_no bigint, kind string, value string").repartition(3)
    heads = sequence.last_value(lines.where("kind <> 'data'"), names=F.col("value"))
    data = lines.where("kind = 'data'")
    got = sequence.headed(data, heads, "names", number="ordinal", stretch=7)
    assert sorted(tuple(r) for r in got.select("path", "line_no", "names", "ordinal").collect()) == want
    got = sequence.headed(data, heads, "names", stretch=7)
    assert sorted(tuple(r) for r in got.select("path", "line_no", "names").collect()) == [w[:3] for w in want]


def test_a_long_sensor_log_is_many_tasks(spark):
    """No exchange deals lines by their file alone, and those that are sorted hold nothing of the headers."""
    from timeloom.operators import header_logs

    head = ["#separator \\x09", "#path\tmystery", "#fields\tts\thost"]
    lines = spark.range(4, 200_000).select(F.lit("/z/mystery.log").alias("path"), F.lit("mystery.log").alias("source"), F.col("id").alias("line_no"), F.concat(F.lit("1.0\th"), "id").alias("line"))
    lines = lines.union(spark.createDataFrame([("/z/mystery.log", "mystery.log", i, x) for i, x in enumerate(head)], lines.schema))
    events = header_logs.sensor(lines, catalog.CTX)
    r = events.groupBy().agg(F.count("*"), F.max("event_id"), F.countDistinct("event_id")).first()
    assert tuple(r) == (199_996,) * 3
    tasks = events.groupBy(F.spark_partition_id()).count().count()
    assert tasks > 1
    plan = events._jdf.queryExecution().sparkPlan().toString().split("\n")
    sorted_lines = [x for x in plan if "row_number" in x]
    assert sorted_lines and not any("places" in x or "layout" in x for x in sorted_lines)
    assert not any("SortMergeJoin [path#" in x and "stretch" not in x for x in plan)


@pytest.mark.parametrize("name", ["files_event_xml", "files_monitor_events"])
def test_event_files_are_written_apart(spark, monkeypatch, name):
    """More events are more documents, each with its ends, not larger ones."""
    from timeloom.plans import timeline

    found = []
    windows = timeline.PARSERS["windows_xml"]
    monkeypatch.setitem(timeline.PARSERS, "windows_xml", lambda spark, paths, ctx: found.extend(paths) or windows(spark, paths, ctx))
    monkeypatch.setattr(file_queries, "SLICE", 400)
    compared(spark, name)
    keys = {(r.o_orderkey // 400, r.o_orderkey % file_queries.PARTS) for r in table(spark, "orders").collect()}
    assert {tuple(map(int, p.split("/")[-3:-1])) for p in found} == keys and len(keys) > file_queries.PARTS


def test_monitor_events_are_parsed_once(spark):
    """A filter that Spark moves doesn't parse them once more."""
    plan = catalog.QUERIES["sysmon_parse"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("xml_to_struct|from_xml", plan, re.IGNORECASE)) == 1


def test_files_are_put_in_order_by_stretches(spark, tmp_path, monkeypatch):
    """The task that writes a file gets a row for each stretch of places, not each row; the file's lines come in order of place."""
    monkeypatch.setattr(file_queries, "STRETCH_BITS", 4)
    places = [-1, (1 << 63) - 1, *range(0, 1000, 3)]
    rows = spark.createDataFrame([(p % 2, p, f"v{p}\nw" if p % 5 else None) for p in places], "part long, place long, value string").repartition(7)
    file_queries._write(rows, f"file://{tmp_path}/out", "x.log")
    for part in (0, 1):
        want = "".join(f"v{p}\nw\n" if p % 5 else "\n" for p in sorted(places) if p % 2 == part)
        assert (tmp_path / "out" / str(part) / "x.log").read_text() == want


def test_paths_are_found_once_a_split(spark, tmp_path):
    """Not for each line: what decodes them is below the broadcast of the table of splits."""
    from timeloom.sources.lines import read_lines

    (tmp_path / "a+b %41.log").write_bytes(b"x\r\n \t\n\ny\r\n\r\n")
    lines = read_lines(spark, [str(tmp_path)])
    assert [(r.path, r.source, r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == [(str(tmp_path / "a+b %41.log"), "a+b %41.log", n, x) for n, x in ((1, "x"), (4, "y"))]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lines.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert "decode" in plan and "decode" not in plan[: plan.index("BroadcastExchange")]


def test_tasks_without_a_declaration_are_not_rewritten(spark):
    """Only a text that begins with a declaration is copied without it; both give the same events."""
    body = '<Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><URI>/t</URI></RegistrationInfo><Actions><Exec><Command>c</Command></Exec></Actions></Task>'
    texts = {"a": body, "b": '<?xml version="1.0" encoding="UTF-16"?>' + body, "c": '\n <?xml version="1.0" encoding="UTF-16"?>\n' + body, "d": None}
    rows = spark.createDataFrame([(k, k, v) for k, v in texts.items()], "path string, source string, text string")
    events = xml_logs.scheduled_tasks(rows, catalog.CTX)
    got = {k: sorted((r.event_type, r.message) for r in events.collect() if r.path == k) for k in texts}
    assert got["a"] == got["b"] == got["c"] and ("ScheduledTask:Action", "Task: /t | Command: c") in got["a"]
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN RLIKE\(text#\d+, [^)]*xml\)", plan)
    assert "sort_array(" in catalog.task_explode_union(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_lines_with_the_mark(spark):
    """What is put between groups to part them may be in the line; a line feed in a text is no end of a group."""
    from timeloom.functions.text import groups

    texts = ["a \x01\x17\x01 b", "a\nb c", "\n", "a  ", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")
    got = [r.g for r in rows.select("i", groups(F.col("line"), r"^([^ ]*) (.*)$").alias("g")).orderBy("i").collect()]
    assert got == [["a", "\x01\x17\x01 b"], ["a\nb", "c"], None, ["a", " "], None, None]


def test_no_groups_go_through_python(spark, tmp_path):
    """What carries years along a file gets times and finished texts, not lists of groups; the second form is tried where the first doesn't match."""
    from timeloom.plans.timeline import build_timeline

    texts = {"syslog": "2024-01-02T03:04:05+02:00 h p[1]: full\nJan  3 04:05:06 g q: old\nneither\n", "system.log": "Jan  3 04:05:06 g q[7] <Error>: with\nJan  3 04:05:07 g q <Error>: plain\nneither\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    events = build_timeline(spark, str(tmp_path), context=catalog.CTX).events
    got = [(r.event_type, r.host, r.message, r.tz_offset_min) for r in events.orderBy("source", "event_id").collect()]
    syslog = [("Syslog", "h", "[p[1]] full", 120), ("Syslog", "g", "[q] old", None), ("SyslogRaw", "", "neither", None)]
    assert got == [*syslog, ("ASL", "g", "[q(7)] <Error> with", None), ("ASL", "g", "[q] <Error> plain", None), ("ASLRaw", "", "neither", None)]
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    passes = [x for x in plan.splitlines() if "MapInArrow ran(" in x]
    assert len(passes) == 2 and not any(re.search(r"\b(full|old|a|b|line)#", x) for x in passes)


@pytest.mark.parametrize("kind", ["long", "int"])
def test_csv_quoted_texts_that_are_odd(spark, tmp_path, kind):
    """Empty texts, characters that parsers give a meaning, ids that documents share or don't have, and of another type."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(6)
    pieces = ['"', '""', ",", "\n", "\r", "\r\n", "\0", '\0"', "\\", '\\"', " ", "\t", "a", "é", "\ufeff", "😀"]
    texts = ["", "", None, "\0", "\n", "\r\n", '"', '"\0"', 'a\n"b\n' * 50_000, *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(500))]
    rows = [*enumerate(texts), (3, ""), (3, "same"), (3, "same"), (None, "same"), (None, "same"), (None, 'x\n"y"'), (None, None), (-1, "a"), (-1, 'two\n"lines')]
    spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(catalog.ORACLES["csv_quoted_texts"])
    columns = [c[0] for c in want.description]
    df = catalog.QUERIES["csv_quoted_texts"](spark, str(tmp_path)).select(*columns)
    got = [tuple(r) for r in df.collect()]
    assert dict(df.dtypes)["doc_id"] == {"long": "bigint", "int": "int"}[kind]
    assert len(got) == sum(t is not None for _, t in rows) and Counter(got) == Counter(want.fetchall())
