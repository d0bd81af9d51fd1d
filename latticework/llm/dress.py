"""Records that say the same in different dress: collapse them and count the copies.

A record is brought to one form (full-width characters, letter case, digit grouping, whatever surrounds or separates
its fields, field order), hashed to 128 bits by two 64-bit hashes, and counted per hash with map-side combining. A
third hash of the form is carried as its smallest and largest value: where they differ, two forms share the 128
bits, and these groups are counted again by the form itself. Two forms are here: of a graph's edge lines, and of
records in general, given as columns or as text with delimiters.

Defined results: values of an edge line count as written apart from the above, so 7 and 07, 3 and +3, 16 and 0x10
differ. A line without two ends, or with more than three values and no names, is no edge; it is a copy of the lines
with the same lower-case text without outer white space. A null line is a copy of the other null lines, not of empty
ones. In the general form a value is its letters and digits; values without any are left out, and a record without
values is a copy of the other such records.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.session import counted, stored

#: Full-width forms and the ASCII characters that they stand for.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))

NUMBER = r"(?:(?<![-0-9a-z.])[+-])?(?:0x[0-9a-f]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)"
GROUPING = "(?<=[0-9a-f])[_'’](?=[0-9a-f])"
NAMED = "(?<![a-z0-9])[stw](?![a-z0-9])"


def _plain(text: Column) -> Column:
    """text in lower case, with ASCII characters for full-width ones; most texts have none and are only looked at."""
    return F.lower(F.when(text.rlike("[\uff01-\uff5e]"), F.translate(text, WIDE, NARROW)).otherwise(text))


def record_form(*fields: Column) -> Column:
    """The one form of a record given as columns: its values' letters and digits, in text order."""
    return _joined(F.array(*(f.cast("string") for f in fields)))


def text_form(text: Column, delimiters: str = r"[,;|\t\r\n]") -> Column:
    """The one form of a record given as text, its fields split at the delimiters."""
    return _joined(F.split(text, delimiters))


def _joined(fields: Column) -> Column:
    values = F.transform(fields, lambda f: F.trim(F.regexp_replace(_plain(f), r"[^\p{L}\p{M}\p{N}]+", " ")))
    return F.coalesce(F.array_join(F.array_sort(F.filter(values, lambda v: v != "")), "\x1f"), F.lit(""))


def edge_form(line: str) -> Column:
    """The one form of an edge line: its ends in text order and its weight, or the bare text if it has no two ends."""
    text = F.regexp_replace(_plain(F.col(line)), GROUPING, "")

    def values(x: Column) -> Column:
        named = F.array(*(F.regexp_extract(x, rf"(?<![a-z0-9]){name}[^0-9a-z<.+-]*({NUMBER})", 1) for name in "stw"))
        return F.when(x.rlike(NAMED), named).otherwise(F.regexp_extract_all(x, F.lit(f"({NUMBER})"), 1))

    def joined(v: Column) -> Column:
        s, t, w = (F.coalesce(F.get(v, F.lit(i)), F.lit("")) for i in range(3))
        return F.when(F.size(v).between(2, 3) & (s != "") & (t != ""), F.concat_ws(" ", F.least(s, t), F.greatest(s, t), w))

    edge = F.transform(F.transform(F.array(text), values), joined)[0]  # variables, so that nothing is matched twice
    return F.coalesce(edge, F.concat(F.lit("text "), F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")), F.lit("null"))


HASHES = ("h1", "h2")


def _with_hashes(df: DataFrame, record: str, form: Column) -> DataFrame:
    rows = df.select(F.col(record).alias("record"), form.alias("form"))
    return rows.select("record", "form", *(F.xxhash64(F.lit(i), "form").alias(f"h{i}") for i in (1, 2)), F.hash(F.lit(3), "form").alias("h3"))


class Collapsed:
    """df's records by form. groups: (first_id, copies, h1, h2), one row per form; copies(): the records but the first.

    The forms are made once; their hashes and the records' ids are written beside the checkpoints, as are the groups
    that are asked for.
    """

    def __init__(self, df: DataFrame, record: str, form: Column):
        self._full = _with_hashes(df, record, form)

    @cached_property
    def _rows(self) -> DataFrame:
        return stored(self._full.drop("form"))

    def _counted(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*HASHES).agg(
            F.min("record").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("h3").alias("lo"), F.max("h3").alias("hi")
        )

    @cached_property
    def groups(self) -> DataFrame:
        found = stored(self._counted(self._full.drop("form")))
        out = found.where("lo = hi").select("first_id", "copies", *HASHES)
        again = self._by_form(found)
        return out if again is None else out.unionByName(again[1].select("first_id", "copies", *HASHES))

    def _by_form(self, found: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """The records, and their groups by the form itself, of those groups that hold two forms; none was seen yet."""
        unsure = found.where("lo <> hi").select(*HASHES)
        if unsure.isEmpty():
            return None
        rows = self._full.join(unsure, list(HASHES), "left_semi")
        return rows, rows.groupBy(*HASHES, "form").agg(F.min("record").alias("first_id"), F.count(F.lit(1)).alias("copies"))

    def copies(self, hot_share: float = 0.001) -> DataFrame:
        """(first_id, copy_id): every record but the first of its form.

        Only forms with copies are kept of the count. Those with at least ``hot_share`` of all records, of which there
        are at most 1/hot_share, meet their records by a broadcast; the rest is joined by hash, so no group of copies
        makes a task long.
        """
        found = stored(self._counted(self._rows).where("copies > 1"))
        many = found.where("lo = hi").drop("lo", "hi")
        least = max(1000, int(hot_share * self._rows.count()))
        hot = many.where(F.col("copies") >= least).collect()
        near = F.broadcast(many.sparkSession.createDataFrame(hot, many.schema).withColumnRenamed("first_id", "hot_first").drop("copies"))
        rows = self._rows.drop("h3").join(near, list(HASHES), "left")
        few = counted(many.where(F.col("copies") < least).drop("copies"), found.count())
        rest = rows.where("hot_first IS NULL").join(few, list(HASHES)).select("first_id", F.col("record").alias("copy_id"))
        out = rest.unionByName(rows.where("hot_first IS NOT NULL").select(F.col("hot_first").alias("first_id"), F.col("record").alias("copy_id")))
        if (again := self._by_form(found)) is not None:
            out = out.unionByName(again[0].join(again[1], [*HASHES, "form"]).select("first_id", F.col("record").alias("copy_id")))
        return out.where("first_id <> copy_id")
