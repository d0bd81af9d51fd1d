"""Loading delimited lines, with a reason for every line that breaks the rules.

A line is read by the cheapest parse: an automaton with four states (field start, plain field, inside quotes,
after a quote) reads it, and dynamic programming may insert or delete quotes and delimiters at a cost. Costs
are ordered: first as few quote edits as possible, then as few delimiter edits. A parse without edits, whose
fields have valid values, loads. Else the edits state the reason: ``quoting`` if quotes had to be edited,
``columns`` if only delimiters, ``value`` if nothing had to be and a field can't be read as its type.

A deleted delimiter joins two fields, an inserted one adds an empty field beside a delimiter or at the line's
end, so neither can hide broken quoting. The bound grows with the cost: lines that the automaton reads at
cost 0 never reach the table of the dynamic program. Most of these never reach Python: a pattern that only lines
without edits and with valid values can match, of ids and numbers of a common length, is tried in the JVM first.

Defined results: a null line is read as an empty one; a line of an unknown kind has the reason ``kind``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
#: The automaton at cost 0.
CLEAN = re.compile(rf"{FIELD}(?:,{FIELD})*+", re.S)
SPLIT = re.compile(rf"({FIELD})(?:,|\Z)", re.S)
DIGITS = re.compile(r" *([0-9]+) *")
NUMBER = re.compile(r" *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *")

START, PLAIN, QUOTED, AFTER = range(4)
INF = 1 << 60
QUOTE_EDIT = 1 << 30
NONE = 255


def valid(value: str, kind: str) -> bool:
    """id: ASCII digits up to 2^63-1; number: empty or a finite decimal; text: anything. Blanks around do no harm."""
    if kind == "id":
        m = DIGITS.fullmatch(value)
        return bool(m) and len(d := m[1].lstrip("0")) <= 19 and int(d or 0) <= LONG_MAX
    if kind == "number":
        return value == "" or bool(NUMBER.fullmatch(value)) and math.isfinite(float(value))
    return True


def fields_of(line: str) -> list[str] | None:
    """The fields at cost 0, quotes taken off; None if the line can't be read without quote edits."""
    if not CLEAN.fullmatch(line):
        return None
    out, at = [], 0
    while True:
        m = SPLIT.match(line, at)
        f = m[1]
        out.append(f[1:-1].replace('""', '"') if f[:1] == '"' else f)
        at = m.end()
        if m.end(1) == len(line):
            return out


def cheapest(line: str, columns: int) -> tuple[int, int, list[str]]:
    """(quote edits, delimiter edits, the edits) of the cheapest parse of line into that many fields."""
    tokens = [(m.start(), m[0][0] if m[0] in '",' else "c") for m in re.finditer(r'[",]|[^",]+', line, re.S)]
    width = 4 * columns  # state and number of fields begun, less one
    cost = [INF] * width
    cost[START] = 0
    eps, took, edits = [], [], []

    def relax(nxt: str | None) -> None:
        came = bytearray([NONE]) * width
        changed = True
        while changed:
            changed = False
            for i in range(width):
                if cost[i] >= INF:
                    continue
                s, c = i & 3, i >> 2
                moves = [] if s == PLAIN else [(i - s + (QUOTED if s != QUOTED else AFTER), QUOTE_EDIT)]
                if s != QUOTED and nxt in (",", None) and c + 1 < columns:
                    moves.append((4 * (c + 1) + START, 1))
                for j, price in moves:
                    if cost[i] + price < cost[j]:
                        cost[j], came[j], changed = cost[i] + price, i, True
        eps.append(came)

    for _, what in tokens:
        relax(what)
        new, come, edit = [INF] * width, bytearray([NONE]) * width, bytearray(width)

        def go(i: int, j: int, price: int, op: int) -> None:
            if cost[i] + price < new[j]:
                new[j], come[j], edit[j] = cost[i] + price, i, op  # noqa: B023

        for i in range(width):
            if cost[i] >= INF:
                continue
            s, c = i & 3, i >> 2
            if what == "c":
                if s != AFTER:
                    go(i, i - s + (QUOTED if s == QUOTED else PLAIN), 0, 0)
            elif what == '"':
                if s != PLAIN:
                    go(i, i - s + (AFTER if s == QUOTED else QUOTED), 0, 0)
                go(i, i, QUOTE_EDIT, 1)
            elif s == QUOTED:
                go(i, i, 0, 0)
            else:
                if c + 1 < columns:
                    go(i, 4 * (c + 1) + START, 0, 0)
                go(i, 4 * c + START, 1, 2)
        cost = new
        took.append(come)
        edits.append(edit)
    relax(None)
    i = min((4 * (columns - 1) + s for s in (START, PLAIN, AFTER)), key=lambda j: cost[j])
    total, ops = cost[i], []
    for k in range(len(tokens), -1, -1):
        at = tokens[k][0] if k < len(tokens) else len(line)
        while eps[k][i] != NONE:
            j = eps[k][i]
            ops.append(f"insert {'delimiter' if i >> 2 != j >> 2 else 'quote'} at {at}")
            i = j
        if k:
            if op := edits[k - 1][i]:
                ops.append(f"delete {'quote' if op == 1 else 'delimiter'} at {tokens[k - 1][0]}")
            i = took[k - 1][i]
    return total // QUOTE_EDIT, total % QUOTE_EDIT, ops[::-1]


EDIT = re.compile(r"(insert|delete) (quote|delimiter) at ([0-9]+)")


def mended(line: str, edits: str) -> tuple[str, int]:
    """The line with its quote edits made, and how many fields the delimiter edits add.

    A deleted delimiter leaves two values in one field, which no line can say; so these are counted, not made.
    """
    out, at, more = [], 0, 0
    for m in EDIT.finditer(edits):
        place = int(m[3])
        if m[2] == "delimiter":
            more += 1 if m[1] == "insert" else -1
            continue
        out += [line[at:place], '"'] if m[1] == "insert" else [line[at:place]]
        at = place + (m[1] == "delete")
    return "".join([*out, line[at:]]), more


def mend(df: DataFrame, parsed: DataFrame, row_id: str = "row_id", line: str = "line") -> DataFrame:
    """(row_id, kind, reason, line, more): the lines that don't split into fields; see ``mended``."""
    edited = parsed.where(F.col("reason").isin("quoting", "columns")).select("row_id", "kind", "reason", "edits")
    rows = edited.join(df.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(line), F.lit("")).alias("line")), "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [mended(t, e) for t, e in zip(b.column(4).to_pylist(), b.column(3).to_pylist())]
            lines, more = zip(*made) if made else ((), ())
            columns = [*b.columns[:3], pa.array(lines, pa.string()), pa.array(more, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "kind", "reason", "line", "more"])

    return rows.select("row_id", "kind", "reason", "edits", "line").mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, kind string, reason string, line string, more int")


def read_line(line: str | None, rule: Sequence[tuple[str, str]]) -> tuple[str | None, str | None, list[str] | None]:
    """(reason, edits, fields): the reason null and the fields given for a line that loads."""
    line = line or ""
    fields = fields_of(line)
    if fields is not None and len(fields) == len(rule):
        wrong = [name for (name, kind), f in zip(rule, fields) if not valid(f, kind)]
        return ("value", "read " + ", ".join(wrong), None) if wrong else (None, None, fields)
    quotes, _, ops = cheapest(line, len(rule))
    return "quoting" if quotes else "columns", "; ".join(ops), None


# What a line that loads looks like, for values of a length that can't be too large; other lines may load too.
PLAINLY = {
    "id": r'(?: *0*[0-9]{1,18} *|" *0*[0-9]{1,18} *")',
    "number": r'(?:| *[+-]?(?:[0-9]{1,100}(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]{1,2})? *|""|" *[+-]?(?:[0-9]{1,100}(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]{1,2})? *")',
    "text": FIELD,
}


def _plainly(kind: Column, line: Column, rules: Mapping[str, Sequence[tuple[str, str]]]) -> Column:
    """Whether the line surely loads."""
    out = F.lit(False)
    for k, rule in rules.items():
        out = F.when(kind == k, line.rlike(r"(?s)\A" + ",".join(PLAINLY[what] for _, what in rule) + r"\z")).otherwise(out)
    return out


def _split(line: Column) -> Column:
    """The fields of a line without edits, quotes taken off."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f"(?s),({FIELD})"), F.lit(1))
    bare = lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(fields, bare)


def clean_fields(line: Column) -> Column:
    """The fields of a line, null if it can't be read without quote edits."""
    return F.when(line.rlike(rf"\A{FIELD}(?:,{FIELD})*+\z"), _split(line))


def parse_rows(df: DataFrame, rules: Mapping[str, Sequence[tuple[str, str]]], row_id: str = "row_id", kind: str = "kind", line: str = "line") -> DataFrame:
    """(row_id, kind, reason, edits, fields), one row per row of df.

    rules: for each kind of line its fields in order, as (name, "id" | "number" | "text"). reason and edits are
    null for lines that load, fields for the others. A narrow pass; nothing is shuffled.
    """
    rules = {k: list(v) for k, v in rules.items()}
    picked = df.select(F.col(row_id).alias("row_id"), F.col(kind).alias("kind"), F.coalesce(F.col(line), F.lit("")).alias("line"))
    plain = F.coalesce(_plainly(F.col("kind"), F.col("line"), rules), F.lit(False))
    none = F.lit(None).cast("string")
    good = picked.where(plain).select("row_id", "kind", none.alias("reason"), none.alias("edits"), _split(F.col("line")).alias("fields"))
    out = pa.schema([("reason", pa.string()), ("edits", pa.string()), ("fields", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [
                read_line(t, rules[k]) if k in rules else ("kind", None, None)
                for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            ]
            made = [pa.array(c, f.type) for c, f in zip(zip(*got) if got else ([], [], []), out)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["row_id", "kind", *out.names])

    kinds = f"row_id {picked.schema['row_id'].dataType.simpleString()}, kind string, reason string, edits string, fields array<string>"
    return good.unionByName(picked.where(~plain).mapInArrow(run, kinds))


def typed(parsed: DataFrame, kind: str, rule: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows of one kind that load, with their fields as columns of their types."""
    def column(i: int, name: str, what: str):
        f = F.col("fields")[i]
        if what == "id":
            return F.trim(f).cast("long").alias(name)
        if what == "number":
            return F.when(f != "", F.trim(f).cast("double")).alias(name)
        return f.alias(name)

    return parsed.where((F.col("kind") == kind) & F.col("reason").isNull()).select("row_id", *(column(i, n, w) for i, (n, w) in enumerate(rule)))
