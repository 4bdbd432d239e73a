"""Filter patterns: what a linear-time engine takes, refuses, and finds."""

import pytest
from pyspark.sql import functions as F

from timeloom.functions.patterns import PatternError, translated
from timeloom.operators import filters
from timeloom.operators.filters import check_pattern, matching
from timeloom.plans import catalog

#: (pattern, texts with a match, texts without one)
FOUND = [
    (r"\p{L}+", ["a", "é"], ["1"]), (r"\pN", ["1"], ["a"]), (r"\PN", ["a"], ["1"]), (r"\p{^L}", ["1"], ["é"]), (r"\p{Greek}", ["α"], ["a"]), (r"[\p{Greek}x]", ["α", "x"], ["a"]), (r"\p{Any}", ["\n"], [""]),
    (r"end\z", ["the end"], ["end\n"]), ("a(?i)B", ["ab", "aB"], ["Ab"]), ("(?i:a)b", ["Ab"], ["AB"]), ("(?i)é", ["É"], ["e"]), ("(?i)[a-c]x", ["BX"], ["D"]), ("(?P<x_1>a)(?P<x_2>b)", ["ab"], ["a"]), ("(?<n>a)", ["a"], ["b"]),
    ("[[:digit:]]+", ["2"], ["d"]), ("[[:^digit:]]", ["x"], ["2"]), ("[[:space:]]", ["\v"], ["x"]), ("[[:punct:]]", ["[", "/", "~"], ["a", " "]), ("^[]a]$", ["]", "a"], ["b"]), ("^[^]a]$", ["b"], ["]"]), ("[a[]", ["["], ["b"]), ("[a&&b]", ["&", "a"], ["c"]), ("[a-]", ["-"], ["b"]), (r"[\]\-x]", ["]", "-"], ["y"]),
    ("(?m)^x$", ["a\nx\nb"], ["ax"]), ("(?m:^x$)\ny$", ["x\ny"], ["x\ny\n"]), ("x$", ["x"], ["x\n"]), ("(?m)b\n^$", ["b\n"], ["b"]), ("a.b", ["axb"], ["a\nb"]), ("(?s)a.b", ["a\nb"], ["ab"]), ("(?s-s:a.b)", ["axb"], ["a\nb"]), ("a.b", ["a\rb", "a b"], []),
    (r"\s", [" ", "\f"], ["\v", "é"]), (r"\S", ["\v", "x"], [" \t\n"]), (r"[\S]", ["\v"], [" \n"]), (r"[^\S]", [" "], ["\v"]), (r"[\D5]", ["5", "a"], ["4"]), (r"(?U)\w", ["a"], ["é"]), (r"\w", ["_"], ["é"]), (r"\d", ["3"], ["٣"]), ("(?U)a+b", ["aab"], ["b"]),
    (r"\bé", ["aé"], ["é"]), (r"\Bé", ["é"], ["aé"]), (r"x\b", ["xé"], ["xy"]), (r"\Qa.b$\E", ["a.b$"], ["axb"]), (r"\Qab\E*c", ["ac", "abbc"], ["bc"]), (r"\Q(", ["("], ["a"]),
    ("a{2,3}", ["aa"], ["a"]), ("a{,2}", ["a{,2}"], ["aa"]), ("{", ["{"], ["a"]), ("a{1000}", ["a" * 1000], ["a" * 999]), ("(a{10}){100}", ["a" * 1000], ["a" * 999]), ("a+?b*?c??", ["a"], ["b"]), ("a|b|", ["", "x"], []), ("(|a)b", ["b"], ["a"]), ("^*a", ["a"], ["b"]), ("()", ["", "a"], []), ("(?)a", ["a"], ["b"]),
    (r"\x41\x{1F600}", ["A\U0001f600"], ["A"]), (r"\101\0", ["A\0"], ["A"]), (r"\.\-\_\ ".replace(r"\_", "_"), [".-_ "], ["a"]), ("\U0001f600?x", ["x"], ["y"]), ("[\U0001f600-\U0001f610]", ["\U0001f605"], ["x"]), ("漢+", ["漢漢"], ["字"]), ("#a b", ["#a b"], ["ab"]), ("[#]", ["#"], ["a"]),
]
REFUSED = [
    r"\Z", r"\h", r"\R", r"\G", r"\e", r"\C", r"\k<a>", r"\1", r"(a)\1", r"\8", r"\é", "\\", r"\x{110000}", r"\xg", r"\cA", r"\N{DIGIT ONE}", r"\u0041", "(?x)a b", "(?d)a", "(?u)a", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", "(?#a)", "(?-)", "(?P<a>x)(?P<a>y)", "(?P<a-b>x)", "(?P<>x)", "(?P=a)", "(?P>a)",
    "[[:foo:]]", "[a", "[]", "[b-a]", r"[\Z]", r"[\b]", r"\p{IsAlphabetic}", r"\p{Alphabetic}", r"\p{greek}", r"\p{Grek}", r"\p{L1}", r"\p{javaLowerCase}", r"\pX", r"\p{", "(", ")", "a)", "(a", "*", "a|*", "(*a)", "?", "a**", "a*+", "a++", "a?+", "a???", "a{2}+", "a{2}{3}", "a{1001}", "a{2,1}", "a{2,1001}", "(a{100}){11}", "((a{10}){10}){11}", "(?i)*", "(" * 1001 + ")" * 1001,
]


def test_what_patterns_find(spark):
    checks = [(p, t, want) for p, yes, no in FOUND for texts, want in ((yes, True), (no, False)) for t in texts]
    got = spark.range(1).select(*[F.lit(t).rlike(translated(p)[0]).alias(f"c{i}") for i, (p, t, _) in enumerate(checks)]).first()
    assert [c for c, g in zip(checks, got, strict=True) if c[2] != g] == []


@pytest.mark.parametrize("pattern", REFUSED)
def test_what_patterns_refuse(spark, pattern):
    with pytest.raises(PatternError, match="invalid filter pattern"):
        check_pattern(spark, pattern)


def test_filters_of_events(spark):
    events = spark.createDataFrame([("ann", "h", "Failed", "s.log"), ("bob", "h", "ok é", "s.log"), ("", "", "", "x.log")], "user string, host string, message string, source string")
    found = lambda p: sorted(r.user for r in matching(events, p).collect())
    assert found("^(?i)failed$") == ["ann"] and found(r"\p{Latin}.log") == ["", "ann", "bob"] and found(r"é\z") == ["bob"] and found(None) == ["", "ann", "bob"]
    with pytest.raises(ValueError):
        matching(events, r"\Z")


def test_numbered_matches(spark):
    """Many patterns over long texts: the rows that each would filter, without a pass of the row-wise engine for each of them."""
    texts = ["", None, "The end.", "a\nb c\n", "x é1", "É", "naïve\r\nthe", "ÀÉ\x00", "..!", "x" * 40, "tab\t\t", "ſ K"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {r.id: r.found for r in filters.numbered_matches(rows, "text", catalog._PATTERNS, "found").collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, p in enumerate(catalog._PATTERNS):
        want = {r.id for r in rows.where(F.col("text").rlike(filters.check_pattern(spark, p))).collect()}
        assert {k for k, v in got.items() if i in v} == want, p
    with pytest.raises(filters.PatternError):
        filters.numbered_matches(rows, "text", ["(?=a)"], "found")
    cases = [(i, x, hit) for i, (_, yes, no) in enumerate(FOUND) for hit, xs in ((True, yes), (False, no)) for x in xs]
    rows = spark.createDataFrame([(j, i, x, hit) for j, (i, x, hit) in enumerate(cases)], "j int, i int, text string, hit boolean")
    got = filters.numbered_matches(rows, "text", [p for p, _, _ in FOUND], "found").collect()
    assert len(got) == len(cases) and [FOUND[r.i] for r in got if (r.i in r.found) != r.hit] == []
    plan = catalog.filter_patterns(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and plan.count("MapInArrow") == 1
