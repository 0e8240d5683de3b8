"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources share a budget by weight; a target stops at a multiple of its source's
size and the excess is shared again by weight, until none is above. Schedule: slot i has
the point (i * m mod 2^31) / 2^31, m / 2^31 being the golden ratio's fraction, and takes
the source in whose part of the cumulative targets the point falls; so any run of slots is
close to the targets. Slots are ranked within their source, and slot rank k takes the k-th
block of the source's shuffled line: its documents in the order of a hash, laid end to end
and repeated as often as a target may need.

Scale: ranks and line offsets are counts per share (a range of slots, of hashes or of sources) plus the
sums of the shares before, in two levels, so no source is one task's load, however large, and there may be any number of them. The
targets' level is found by sums over the sources, whose totals alone reach the driver. Targets are laid on the
schedule's ring as whole numbers, so sums don't depend on the layout.

Defined results: null or blank text has size 0 and nothing taken; very long texts are cut by blocks like any other; null is a source like
any other, last in order; rows with one doc_id are documents of their own; ties in the shuffled order go by doc_id; extra
columns are ignored, whatever their names; an empty table gives an empty result; the same rows give the same result in any layout.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize, ship

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MAX_REPEAT = 1.5, 2
#: Blocks hold 1/LEAST_SLOTS of the budget, but no more than MAX_BLOCK words.
LEAST_SLOTS, MAX_BLOCK = 1 << 16, 4096
RING, GOLDEN = 1 << 31, 1327217885
SLOT_BITS, ROWS_PER_SHARE = 12, 128
#: Neighbouring shares that are summed together (as a power of two).
OVER_BITS = 12
#: Targets count in such parts of a word on the ring.
UNITS = 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _settle(budget: float, max_repeat: float, measure: Callable[[float, float], tuple[float, int]]) -> tuple[float, float]:
    """What sources below their limit share, and their weights' sum.

    ``measure`` gives, for such a pair, the weights' sum of sources whose share is within the limit, and the size of the others.
    """
    left, weight = budget, measure(0.0, 1.0)[0]
    while weight:
        within, full = measure(left, weight)
        if within == weight:
            break
        left, weight = budget - max_repeat * full, within
    return left, weight


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float = BUDGET, max_repeat: float = MAX_REPEAT) -> list[float]:
    """Shares of budget * sum(sizes) by weight, none above max_repeat times its size."""

    def measure(left: float, weight: float) -> tuple[float, int]:
        full = [left * w / weight > max_repeat * n for n, w in zip(sizes, weights, strict=True)]
        return sum(w for w, f in zip(weights, full, strict=True) if not f), sum(n for n, f in zip(sizes, full, strict=True) if f)

    left, weight = _settle(budget * sum(sizes), max_repeat, measure)
    return [min(left * w / weight, max_repeat * n) if weight else float(max_repeat * n) for n, w in zip(sizes, weights, strict=True)]


def block_words(total: float) -> int:
    return max(1, min(MAX_BLOCK, int(total) // LEAST_SLOTS))


def _before(rows: DataFrame, key: list[str], share: Column, value: Column, order: list) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the rows before in ``order`` (which the shares follow), by ``key``.

    Sums are taken of shares, and of OVER_BITS' worth of neighbouring shares, so a window holds the rows of a share, the shares of a neighbourhood, or the
    neighbourhoods of a key: none grows as fast as the rows.
    """

    def upto(sums: DataFrame, within: list[str], at: str, name: str) -> DataFrame:
        before = F.sum("all").over(Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
        return sums.withColumn(name, F.coalesce(before, F.lit(0)))

    rows = rows.withColumn("share", share).withColumn("value", value)
    sums = rows.groupBy(*key, "share").agg(F.sum("value").alias("all")).withColumn("over", F.shiftright(F.col("share").cast("long"), OVER_BITS))
    overs = upto(sums.groupBy(*key, "over").agg(F.sum("all").alias("all")), key, "over", "overs").drop("all")
    sums = upto(sums, [*key, "over"], "share", "shares").join(overs, [*key, "over"])
    sums = sums.select(*key, "share", (F.col("shares") + F.col("overs")).alias("upto"))
    own = F.sum("value").over(Window.partitionBy(*key, "share").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).join(sums, [*key, "share"])
    return rows.withColumn("before", F.col("own") + F.col("upto")).drop("own", "upto", "value", "share")


def _sources(rows: DataFrame, weights: Sequence[float], budget: float) -> DataFrame:
    """``src, source, source_size, n, target, low, high`` for each source: its number, target and part of the ring."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = [F.col("source").isNull(), F.col("source")]
    found = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    found = materialize(found, "sources")
    parts = found.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("all"))
    upto = F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    parts = parts.select("part", F.coalesce(upto, F.lit(0)).alias("upto"))
    number = F.col("upto") + F.col("at").bitwiseAND((1 << 33) - 1)
    found = found.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part").withColumn("src", number)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    found = found.withColumn("weight", weight.cast("double"))

    most = MAX_REPEAT * F.col("source_size")
    share = lambda left, weight: F.lit(left) * F.col("weight") / F.lit(weight)

    def measure(left: float, weight: float) -> tuple[float, int]:
        full = share(left, weight) > most
        got = found.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("source_size")))).first()
        return got[0] or 0.0, got[1] or 0

    total = found.agg(F.sum("source_size")).first()[0] or 0
    left, weight = _settle(budget * total, MAX_REPEAT, measure)
    target = F.least(share(left, weight), most.cast("double")) if weight else most.cast("double")
    found = found.withColumn("target", target).withColumn("units", F.round(F.col("target") * UNITS).cast("long"))
    found = _before(found.select("src", "source", "source_size", "n", "target", "units", F.lit(0).alias("all_")), ["all_"], F.shiftright("src", 12), F.col("units"), ["src"])
    return materialize(found.withColumnRenamed("before", "low").withColumn("high", F.col("low") + F.col("units")).drop("all_", "units"), "targets")


def _schedule(sources: DataFrame, units: int, many: int, block: int) -> DataFrame:
    """``slot, src, k``: slot i takes the k-th block of source number src."""
    slots = -(-units // (UNITS * block))
    cells = 1 << max(4, min(30, many.bit_length() + 2))
    width = RING // cells
    ring = sources.where("high > low").select("src", (F.col("low") / units * RING).alias("low"), (F.col("high") / units * RING).alias("high"))
    cell = F.expr(f"sequence(cast(floor(low / {width}) as int), least(cast(floor(high / {width}) as int), {cells - 1}))")
    ring = ring.withColumn("cell", F.explode(cell))
    ids = sources.sparkSession.range(0, slots).withColumnRenamed("id", "slot")
    ids = ids.withColumn("point", F.expr(f"slot % {RING}L * {GOLDEN}L % {RING}L")).withColumn("cell", F.expr(f"cast(point div {width} as int)"))
    found = ids.join(ring, "cell").where("point >= low and point < high").select("slot", F.col("src"))
    return _before(found, ["src"], F.shiftright("slot", SLOT_BITS), F.lit(1), ["slot"]).withColumnRenamed("before", "k")


def mix(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Lines and schedule of ``doc_id, source, text``.

    Returns the documents with ``rid`` (a row's number), ``size``, ``source_size`` and
    ``target``, and the schedule as pieces ``slot, src, k, rid, epoch, start, stop`` (words
    start to stop of a document).
    """
    ship(docs.sparkSession)
    size = word_count() if size is None else size
    chance = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", size.alias("size"), chance.alias("chance"))
    rows = materialize(rows, "sizes")

    sources = _sources(rows, weights, budget)
    units, many, n = (x or 0 for x in sources.agg(F.max("high"), F.count(F.lit(1)), F.sum("n")).first())
    block = block_words(units / UNITS)
    rows = rows.join(sources.select(F.col("source").alias("s"), "src", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bits = max(4, min(40, (n // ROWS_PER_SHARE).bit_length()))
    line = _before(rows, ["src"], F.shiftrightunsigned("chance", 64 - bits), F.col("size"), ["chance", "doc_id", "rid"]).withColumnRenamed("before", "at")
    line = materialize(line.select("rid", "doc_id", "source", "size", "src", "source_size", "target", "at"), "line")

    placed = line.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEAT - 1))))
    placed = placed.withColumn("from", F.expr("at + epoch * source_size")).withColumn("to", F.expr("from + size"))
    placed = placed.withColumn("k", F.explode(F.expr(f"sequence(from div {block}, (to - 1) div {block})")))
    cut = {"start": f"greatest(from, k * {block}) - from", "stop": f"least(to, (k + 1) * {block}) - from"}
    pieces = placed.select("src", "k", "rid", "epoch", *(F.expr(v).alias(n) for n, v in cut.items()))
    return line, _schedule(sources, units, many, block).join(pieces, ["src", "k"])


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``size``, ``source_size``, its source's ``target`` and the words that the mix takes, repeats counted."""
    line, schedule = mix(docs, **options)
    words = schedule.groupBy("rid").agg(F.sum(F.expr("stop - start")).alias("taken"))
    return line.join(words, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
