"""One form for texts that look the same.

A text loses its invisible characters, gets plain spaces and plain ASCII for full-width forms, and is composed
(NFC). Each token with a character beyond ASCII is then spelled in one script: every letter has the set of
scripts in which it can be drawn (a Cyrillic or Greek letter drawn like a Latin one shares that letter's set),
the sets are intersected over the token, and the token is spelled in the first of Latin, Cyrillic and Greek that
is left. Where none is (a token that really mixes scripts), letters that can be Latin become Latin. Tokens of mixed
scripts, and those of another script that look like Latin as a whole, can be counted per text. The sets of
look-alikes are equal, so texts that look the same get the same form; a form's letters say which look they have,
so others don't.

Defined results: a null text has a null form and stands for nothing; empty texts are equal to each other. What
can be seen still differs: accents, case, raised digits, the number of blanks, tabs and line ends, and ASCII
characters among themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import counted, stored

# Letters drawn like Latin ones, and characters that are not drawn at all.
# Where two letters of a script are drawn like one Latin letter, the commoner comes first.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜѴҮӀаеһіјорсԁѕухԛԝѵ", "ABESIJKMHOPCTYXGQWVYIaehijopcdsyxqwv"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj"))
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

SPACES = ((0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

LATIN, CYR, GRE, OTHER = 1, 2, 4, 8
PLAIN = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
PLAIN |= {c: None for lo, hi in INVISIBLE for c in range(lo, hi + 1)}
PLAIN |= {c: " " for lo, hi in SPACES for c in range(lo, hi + 1)}
ODD = re.compile("[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in (*INVISIBLE, *SPACES, (0xFF01, 0xFF5E))) + "]")
# A word with a character beyond ASCII; found at a word's start only, so long ASCII words are passed once.
TOKEN = re.compile(r"(?<![\ẁ-ͯ])[A-Za-z0-9_]*+(?:[^\x00-\x7f\W]|[̀-ͯ])[\ẁ-ͯ]*+")
TWIN = {c: (CYRILLIC.get(c) or GREEK.get(c)) for c in [*CYRILLIC, *GREEK]}
INTO = {CYR: {v: k for k, v in reversed(CYRILLIC.items())}, GRE: {v: k for k, v in reversed(GREEK.items())}}
MARKS = ("Mn", "Mc", "Me")


@lru_cache(maxsize=100_000)
def _scripts(ch: str) -> int:
    """The scripts in which a letter can be drawn; all of them for what is no letter."""
    if not ch.isalpha():
        return LATIN | CYR | GRE | OTHER
    latin = TWIN.get(ch, ch)
    if ch in TWIN or ch.isascii():
        return LATIN | (latin in INTO[CYR] and CYR) | (latin in INTO[GRE] and GRE)
    return _script(ch)


@lru_cache(maxsize=100_000)
def _script(ch: str) -> int:
    """The script that a letter is of."""
    name = unicodedata.name(ch, "")
    return LATIN if ch.isascii() or name.startswith("LATIN") else CYR if name.startswith("CYRILLIC") else GRE if name.startswith("GREEK") else OTHER


@lru_cache(maxsize=200_000)
def spell(token: str) -> str:
    """The token in the one script that all its letters can be drawn in, else in Latin as far as that goes."""
    letters = unicodedata.normalize("NFD", token)
    common = LATIN | CYR | GRE | OTHER
    for ch in letters:
        if unicodedata.category(ch) not in MARKS:
            common &= _scripts(ch)
    letters = "".join(TWIN.get(ch, ch) for ch in letters)
    into = None if common & LATIN or not common else INTO.get(CYR if common & CYR else GRE if common & GRE else 0)
    if into:
        letters = "".join(into.get(ch, ch) for ch in letters)
    return unicodedata.normalize("NFC", letters)


def _spelled(m: re.Match) -> str:
    token = m[0]
    return spell(token) if len(token) <= 200 else spell.__wrapped__(token)


def form(text: str) -> str:
    if text.isascii():
        return text
    if ODD.search(text):
        text = text.translate(PLAIN)
    if text.isascii():
        return text
    return TOKEN.sub(_spelled, unicodedata.normalize("NFC", text))


def forms(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, form): every text in its one form."""
    picked = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if t is None else form(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "form"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, form string")


def _hashed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, c1, c2, r1, r2) of non-empty texts: 128 bits of the form and of the text itself."""
    picked = df.where(F.col(text) != "").select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    half = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                raw = xxhash.xxh3_128_intdigest(t.encode())
                f = form(t)
                rows.append((raw if f is t or f == t else xxhash.xxh3_128_intdigest(f.encode()), raw))
            parts = [pa.array([(r[i] >> s & half) - (1 << 63) for r in rows], pa.int64()) for i in (0, 1) for s in (64, 0)]
            yield pa.RecordBatch.from_arrays([b.column(0), *parts], names=["doc_id", "c1", "c2", "r1", "r2"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, c1 bigint, c2 bigint, r1 bigint, r2 bigint")


def lookalike_pairs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_a, doc_b): documents that look the same but differ in their characters.

    Classes with one text only, however many copies it has, are left before anything is joined, and so are their
    documents; the others are paired text by text, and these pairs meet their documents, so work follows the number of
    pairs that come out.
    """
    hashed = stored(_hashed(df, doc_id, text))
    ends = hashed.groupBy("c1", "c2").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("r1", "r2") for f in (F.min, F.max)))
    mixed = stored(ends.where("min_r1 <> max_r1 OR min_r2 <> max_r2").select("c1", "c2"))
    docs = stored(hashed.join(counted(mixed, mixed.count()), ["c1", "c2"], "left_semi"))
    texts = docs.select("c1", "c2", "r1", "r2").distinct()
    a, b = texts.alias("a"), texts.alias("b")
    pairs = a.join(b, (F.col("a.c1") == F.col("b.c1")) & (F.col("a.c2") == F.col("b.c2")) & (F.struct("a.r1", "a.r2") < F.struct("b.r1", "b.r2")))
    pairs = pairs.select(F.col("a.r1").alias("a1"), F.col("a.r2").alias("a2"), F.col("b.r1").alias("b1"), F.col("b.r2").alias("b2"))
    left = docs.select(F.col("doc_id").alias("x"), F.col("r1").alias("a1"), F.col("r2").alias("a2"))
    right = docs.select(F.col("doc_id").alias("y"), F.col("r1").alias("b1"), F.col("r2").alias("b2"))
    found = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"])
    return found.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def confusables(text: str) -> tuple[int, int]:
    """(mixed, whole): the tokens with letters of several scripts, and those of letters of one script other than Latin
    that can all be drawn in Latin; counted in the text without invisible characters, composed."""
    if text.isascii():
        return 0, 0
    mixed = whole = 0
    for m in TOKEN.finditer(unicodedata.normalize("NFC", text.translate(PLAIN))):
        letters = [ch for ch in unicodedata.normalize("NFD", m[0]) if ch.isalpha()]
        own = {_script(ch) for ch in letters} - {OTHER}
        mixed += len(own) > 1
        whole += len(own) == 1 and LATIN not in own and all(_scripts(ch) & LATIN for ch in letters)
    return mixed, whole


def suspects(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_mixed, n_whole) of the texts with such tokens; see ``confusables``."""
    picked = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [confusables(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1))], names=["doc_id", "n_mixed", "n_whole"])

    found = picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_mixed bigint, n_whole bigint")
    return found.where("n_mixed > 0 OR n_whole > 0")


def skeleton(form: str) -> str:
    """A form with every look-alike as Latin: what two texts share that look the same, whatever script they are in."""
    if form.isascii():
        return form
    return unicodedata.normalize("NFC", "".join(TWIN.get(ch, ch) for ch in unicodedata.normalize("NFD", form)))


def classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(class_id, n_docs, n_texts) of each class of texts that look the same; class_id is its smallest document."""
    hashed = _hashed(df, doc_id, text).groupBy("c1", "c2", "r1", "r2").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("n"))
    out = hashed.groupBy("c1", "c2").agg(F.min("d").alias("class_id"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))
    return out.select("class_id", "n_docs", "n_texts")
