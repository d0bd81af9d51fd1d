import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.operators.rowparse import cheapest, clean_fields, fields_of, mend, mended, parse_rows, read_line, typed, valid

EDGE = [("s", "id"), ("t", "id"), ("weight", "number"), ("note", "text")]
LABEL = [("a", "id"), ("l", "id"), ("note", "text")]
STRICT = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', re.S)


def count(line):
    """Fields of a line that breaks no quoting rule, by walking over it."""
    n, inside = 1, False
    for ch in line:
        inside ^= ch == '"'
        n += ch == "," and not inside
    return n


@given(st.text(alphabet='a",\n', max_size=14), st.integers(1, 5))
@settings(max_examples=600, deadline=None)
def test_reason_is_the_rule_that_is_broken(line, columns):
    quotes, delimiters, ops = cheapest(line, columns)
    clean = bool(STRICT.fullmatch(line))
    assert (quotes == 0) == clean
    assert (fields_of(line) is not None) == clean
    if clean:
        assert delimiters == abs(count(line) - columns)
        assert len(fields_of(line)) == count(line)
    assert len(ops) == quotes + delimiters


@given(st.text(alphabet='a",\n', max_size=14), st.integers(1, 5))
@settings(max_examples=400, deadline=None)
def test_edits_mend_the_line(line, columns):
    whole, more = mended(line, "; ".join(cheapest(line, columns)[2]))
    fields = fields_of(whole)
    assert fields is not None and len(fields) + more == columns


def least_quote_edits(line, most=3):
    """By trying all insertions and deletions of quotes, fewest first."""
    seen, front = {line}, {line}
    for k in range(most + 1):
        if any(STRICT.fullmatch(x) for x in front):
            return k
        front = {y for x in front for i in range(len(x) + 1) for y in ([x[:i] + '"' + x[i:]] + ([x[:i] + x[i + 1 :]] if x[i : i + 1] == '"' else []))} - seen
        seen |= front
    return most + 1


@pytest.mark.parametrize("line", ["".join(x) for n in (3, 4, 5) for x in itertools.product('a",', repeat=n)][::5])
def test_quote_edits_are_fewest(line):
    assert cheapest(line, count(line.replace('"', "")))[0] >= least_quote_edits(line)
    assert min(cheapest(line, k)[0] for k in range(1, 7)) == least_quote_edits(line)


@pytest.mark.parametrize("line,rule,reason", [
    ("1,2,0.5,", EDGE, None), ('"1",2,,"a, ""b"""', EDGE, None), (' 1 ,002, +1.5e-3 ,"x\ny"', EDGE, None), ("1,9223372036854775807,", LABEL, None),
    ("1,9223372036854775808,", LABEL, "value"), ("1,000000000000000000000000007,x", LABEL, None), ("1,,x", LABEL, "value"), ("1,-2,x", LABEL, "value"),
    ("1,２,x", LABEL, "value"), ("1,\t2,x", LABEL, "value"), ("1,2,inf,", EDGE, "value"), ("1,2,1e999,", EDGE, "value"), ("1,2,.,", EDGE, "value"), ("1,2,3.,", EDGE, None),
    ("", LABEL, "columns"), ("1,2", LABEL, "columns"), ("1,2,3,4", LABEL, "columns"), ('1,2,"a" b', LABEL, "quoting"), ('1,2,a"b', LABEL, "quoting"), ('1,2,"a', LABEL, "quoting"),
    ('x,2,"a', LABEL, "quoting"), ("x,2", LABEL, "columns"), ('1,2, "a"', LABEL, "quoting"), (None, LABEL, "columns"),
])
def test_lines(line, rule, reason):
    got, edits, fields = read_line(line, rule)
    assert got == reason
    assert (edits is None) == (reason is None) == (fields is not None)


def test_edits_name_the_place():
    assert read_line('1,2,"ab', LABEL)[1] in ("insert quote at 7", "delete quote at 4")
    assert read_line("1,2", LABEL)[1] == "insert delimiter at 3"
    assert read_line("1,2,3,4", LABEL)[1].startswith("delete delimiter at ")


def test_very_long_lines():
    long = "1,2," + "ab," * 20_000
    assert cheapest(long, 3)[:2] == (0, 20_000)
    assert read_line('1,2,"' + 'x""' * 50_000 + '"', LABEL)[0] is None
    assert read_line('1,2,"' + "x" * 200_000, LABEL)[0] == "quoting"


def test_valid():
    assert valid("", "number") and not valid(" ", "number") and not valid("", "id") and valid("anything", "text")


def test_parse_rows(spark):
    rows = [(1, "e", "1,2,0.5,n", "x"), (2, "e", "1,2,,", "x"), (3, "l", '7,8,"q', "x"), (4, "l", None, "x"), (5, None, "1,2,3", "x"), (6, "l", "7,0008,z", "x")]
    df = spark.createDataFrame(rows, "row_id long, kind string, line string, reason string")
    parsed = parse_rows(df, {"e": EDGE, "l": LABEL})
    assert {r.row_id: r.reason for r in parsed.collect()} == {1: None, 2: None, 3: "quoting", 4: "columns", 5: "kind", 6: None}
    assert [tuple(r) for r in typed(parsed, "e", EDGE).orderBy("row_id").collect()] == [(1, 1, 2, 0.5, "n"), (2, 1, 2, None, "")]
    assert [tuple(r) for r in typed(parsed, "l", LABEL).collect()] == [(6, 7, 8, "z")]
    assert parse_rows(df.limit(0), {"e": EDGE}).count() == 0


def test_jvm_reads_like_python(spark):
    """Lines of both routes give what the parser gives for every line, and as many long ones."""
    rng = random.Random(4)
    parts = ["1", " 23 ", "0007", "9223372036854775807", "9223372036854775808", '"4"', '" 5"', "", "x", "-1", "1.5", ".5e3", "1e400", '"a, ""b"""', '"q', 'a"b', "n\n2", "9" * 120, "1e99", '""', "3.", "\u0662"]
    lines = [",".join(rng.choice(parts) for _ in range(rng.choice([2, 3, 4, 4, 4, 5]))) for _ in range(3000)]
    lines += ['1,2,,"' + 'x""' * 50_000 + '"', "1,2,3," + "y" * 300_000, '1,2,,"' + "z" * 300_000, "", ",,,", '"1","2","","' + "\n," * 1000 + '"']
    df = spark.createDataFrame(list(enumerate(lines)), "row_id long, line string").withColumn("kind", F.lit("e"))
    got = {r.row_id: (r.reason, r.edits, r.fields) for r in parse_rows(df, {"e": EDGE}).collect()}
    assert got == {i: read_line(x, EDGE) for i, x in enumerate(lines)}
    assert {r.row_id: r.f for r in df.select("row_id", clean_fields(F.col("line")).alias("f")).collect()} == {i: fields_of(x) for i, x in enumerate(lines)}
    fixed = mend(df, parse_rows(df, {"e": EDGE})).collect()
    assert fixed and all(len(fields_of(r.line)) + r.more == 4 for r in fixed)


def test_few_lines_reach_python(spark):
    plan = parse_rows(spark.createDataFrame([(1, "e", "1,2,3,")], "row_id long, kind string, line string"), {"e": EDGE}).where("reason IS NOT NULL")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Union" not in text and "RLIKE" in text
