"""Mixing sources to target shares of the total size, by thresholds on a hash.

Every document has a hash of its id. Sizes are summed per source and range of hash; from these histograms the
driver finds, for each source, how often all its documents are used and below which hash they are used once
more. The range in which the budget runs out is split again, and only its documents are read for that, until it
holds one document. Nothing is sorted; the documents are then chosen by comparing hashes. Histograms have at
most ``sources * 1024`` rows. A smaller budget chooses a subset of what a larger one does.

Defined results: documents without a source, or of one without a target, are not used. A source with a target
but no documents gives nothing and is reported with a share of 0; the others then share the total in
proportion. Documents without tokens are used like the others. Documents with equal ids have equal hashes and
are chosen together. Several targets for one source are added up, with the smaller repeat limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.tokens import VOCABULARY, token_counts
from latticework.session import cut

HASH_BITS, STEP = 63, 10


@dataclass
class Budget:
    share: float
    max_repeat: int
    available: int = 0
    wanted: float = 0.0
    full: int = 0  # times every document is used
    rest: float = 0.0  # tokens to be chosen by the hash
    below: int = 0  # documents with a smaller hash are used once more
    #: The range of hashes in which the budget runs out, as its first hash and its bits; none: bits is 0.
    bits: int = HASH_BITS


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> dict[str, Budget]:
    """Each target source's budget and threshold. sized: (source, n_tokens, h)."""
    plans: dict[str, Budget] = {}
    for r in targets.where("source IS NOT NULL AND share > 0").collect():
        had = plans.get(r.source)
        plans[r.source] = Budget(r.share + (had.share if had else 0), min(r.max_repeat or 0, had.max_repeat) if had else r.max_repeat or 0)
    open_ = dict(plans)
    first = True
    while open_:
        inside = F.lit(False)
        shift = F.lit(0)
        for name, b in open_.items():
            here = (F.col("source") == name) & (F.col("h") >= b.below) & (F.col("h") <= b.below + (1 << b.bits) - 1)
            inside = inside | here
            shift = F.when(F.col("source") == name, F.shiftright(F.col("h") - b.below, max(0, b.bits - STEP))).otherwise(shift)
        cells = sized.where(inside).groupBy("source", shift.alias("cell")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
        if first:
            for r in cells:
                plans[r.source].available += r.n
            able = [b for b in plans.values() if b.available and b.max_repeat > 0]
            shares = sum(b.share for b in able)
            if not able:
                return plans
            most = min(b.available * b.max_repeat * shares / b.share for b in able)
            size = most if total is None else total
            for b in able:
                b.wanted = min(size * b.share / shares, b.available * b.max_repeat)
                b.full = min(int(b.wanted / b.available + 1e-12), b.max_repeat)
                b.rest = max(0.0, b.wanted - b.full * b.available) if b.full < b.max_repeat else 0.0
            first = False
            open_ = {s: b for s, b in open_.items() if b.rest > 0}
        for name, b in list(open_.items()):
            width = max(0, b.bits - STEP)
            for r in sorted((r for r in cells if r.source == name), key=lambda r: r.cell):
                if r.n > b.rest:
                    b.below += r.cell << width
                    b.bits = width if r.docs > 1 else 0
                    break
                b.rest -= r.n
            else:
                b.below, b.bits = b.below + (1 << b.bits), 0
            if not b.bits:
                del open_[name]
    return plans


def mix(df: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, total: int | None = None, seed: int = 11, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (doc_id, source, n_tokens, repeats) of each document used. shares: (source, share, max_repeat,
    available_tokens, used_tokens, actual_share) per target source. targets: (source, share, max_repeat). total:
    tokens wanted; by default as many as let every source with documents keep its share within its limit.
    """
    spark = df.sparkSession
    names = [r[0] for r in targets.where("source IS NOT NULL").select("source").distinct().collect()]
    picked = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isin(names) if names else F.lit(False))
    sized = token_counts(picked, "text", ["doc_id", "source"], vocabulary)
    sized = cut(sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)))
    plans = budgets(sized, targets, total)
    repeats = F.lit(0)
    for name, b in plans.items():
        extra = F.lit(0) if b.max_repeat <= b.full else (F.col("h") < b.below).cast("int") if b.below <= (1 << HASH_BITS) - 1 else F.lit(1)
        repeats = F.when(F.col("source") == name, F.lit(b.full) + extra).otherwise(repeats)
    chosen = sized.withColumn("repeats", repeats.cast("int")).where("repeats > 0").drop("h")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    wanted = spark.createDataFrame([(s, b.share, b.max_repeat, b.available) for s, b in plans.items()], "source string, share double, max_repeat int, available_tokens long")
    found = {r.source: r.used_tokens for r in used.collect()}
    all_used = sum(found.values())
    rows = [(*r, found.get(r.source, 0), found.get(r.source, 0) / all_used if all_used else None) for r in wanted.collect()]
    shares = spark.createDataFrame(rows, "source string, share double, max_repeat int, available_tokens long, used_tokens long, actual_share double")
    return chosen, shares
