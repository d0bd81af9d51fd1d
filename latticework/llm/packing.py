"""Filling containers of one capacity with texts, by minimum bin slack.

What has to be decided depends on sizes only, so it is decided on their histogram, which has at most
``capacity`` entries however many texts there are. For one container the largest size left is set, and a bitset
of reachable sums, grown by one available size at a time, finds the fullest feasible combination; it is then
taken out as many times as the counts allow. The resulting plan is a list of (size, first rank, last rank,
container), bounded by the capacity as well, and is broadcast. Texts get their rank among all of their size
from counts per hash group, so that the most frequent size is never numbered by one task.

Defined results: a text larger than the capacity is cut into full pieces and a rest; no other text is cut. A
null or empty text has no tokens and takes no room: it is listed once, with a null container.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.tokens import VOCABULARY, sent, token_counts
from latticework.session import cut

#: Pieces per hash group, in which ranks are counted by one task.
GROUP_ROWS = 50_000
MOST_CAPACITY = 16_384


def fullest(counts: dict[int, int], sizes: list[int], capacity: int) -> Counter:
    """The fullest combination of available sizes up to capacity that has the largest size; sizes: descending."""
    room = capacity - sizes[0]
    mask, goal = (1 << room + 1) - 1, 1 << room
    reach, steps = 1, []
    for size in sizes:
        if size > room:
            continue
        for _ in range(min(counts[size] - (size == sizes[0]), room // size)):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            steps.append((size, reach))
            reach = more
            if reach & goal:
                break
        if reach & goal:
            break
    total = reach.bit_length() - 1
    chosen = Counter({sizes[0]: 1})
    for size, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] += 1
            total -= size
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end of ranks, first container, of that size in a container) until no size is left."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(counts, reverse=True)
    used: Counter = Counter()
    rows, container = [], 0
    while sizes:
        chosen = fullest(counts, sizes, capacity)
        times = min(counts[s] // k for s, k in chosen.items())
        for s, k in chosen.items():
            rows.append((s, used[s], used[s] + k * times, container, k))
            used[s] += k * times
            counts[s] -= k * times
        container += times
        sizes = [s for s in sizes if counts[s]]
    return rows


def pack(df: DataFrame, doc_id: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, doc_id, part, first_token, n_tokens), one row per piece; containers are numbered from 0."""
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity must be between 1 and {MOST_CAPACITY}")
    sized = cut(token_counts(df.select(F.col(doc_id).alias("doc_id"), text), text, ["doc_id"], vocabulary))
    last = F.when(F.col("n_tokens") > 0, F.expr(f"(n_tokens - 1) div {capacity}")).otherwise(F.lit(0)).cast("int")
    pieces = sized.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.withColumn("first_token", F.col("part").cast("long") * capacity)
    pieces = pieces.withColumn("size", F.least(F.col("n_tokens") - F.col("first_token"), F.lit(capacity)).cast("int")).drop("n_tokens")
    some = pieces.where("size > 0")
    histogram = {r["size"]: r["count"] for r in some.groupBy("size").count().collect()}
    groups = max(1, sum(histogram.values()) // GROUP_ROWS)
    grouped = some.withColumn("g", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("size").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.groupBy("size", "g").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("size", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("size", "g").orderBy("doc_id", "part")) - 1
    if groups == 1:
        ranked = grouped.withColumn("rank", within.cast("long"))
    else:
        ranked = grouped.withColumn("within", within).join(offsets.hint("merge"), ["size", "g"]).withColumn("rank", F.col("offset") + F.col("within"))
    steps = df.sparkSession.createDataFrame(plan(histogram, capacity), "size int, lo long, hi long, base long, each int")
    placed = ranked.join(F.broadcast(steps.withColumnRenamed("size", "size_")), (F.col("size") == F.col("size_")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select(
        (F.col("base") + F.expr("(rank - lo) div each")).alias("container"), "doc_id", "part", "first_token", F.col("size").cast("long").alias("n_tokens")
    )
    none = pieces.where("size = 0").select(F.lit(None).cast("long").alias("container"), "doc_id", "part", "first_token", F.lit(0).cast("long").alias("n_tokens"))
    return placed.unionByName(none)


def contents(df: DataFrame, doc_id: str, text: str, packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, doc_id, part, content): each piece's bytes; a text's parts in order give its UTF-8 bytes again.

    Bytes, as a cut between tokens can fall within a character. Document ids must be unique. A text is tokenized once
    more only if it was cut; a null text has a null content.
    """
    piece = F.struct("container", "part", "first_token", "n_tokens")
    pieces = packed.groupBy("doc_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))  # as many as one text has
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(pieces, "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary_of = sent(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = vocabulary_of()
        for b in batches:
            out = []
            for i, t, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = e.encode_ordinary(t) if t and len(some) > 1 else None
                for x in some:
                    lo = x["first_token"]
                    body = None if t is None else t.encode() if ids is None else e.decode_bytes(ids[lo : lo + x["n_tokens"]])
                    out.append((x["container"], i, x["part"], body))
            columns = list(zip(*out)) if out else [[]] * 4
            types = (pa.int64(), b.schema.field(0).type, pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["container", "doc_id", "part", "content"])

    return rows.select("doc_id", "text", "pieces").mapInArrow(run, f"container bigint, doc_id {kind}, part int, content binary")


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(container, n_items, n_tokens, slack) per container."""
    out = packed.where(F.col("container").isNotNull()).groupBy("container")
    out = out.agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return out.withColumn("slack", F.lit(capacity) - F.col("n_tokens"))
