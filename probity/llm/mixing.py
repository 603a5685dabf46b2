"""Operator 5: Pfair mixing of sources to target weights.

Each source is a stream of equal blocks. Block k of a source with weight w may not start before
slot floor(k / w) and is due by slot ceil((k + 1) / w); the earliest deadline goes first. On one
track with weights that sum to 1 every block meets its window, so at every slot each source is
less than one block off its target.

Windows follow from the exact weights, not from rounded shares, so that drift stays below one block
however long the input. The driver gives every block its slot, for one set of live sources after
the other (when a source runs out, the others share in proportion); documents meet their blocks in
parallel. Blocks grow with the input once there would be more than ``MAX_BLOCKS``, which bounds the
driver's work and the plan that is broadcast; so do the chunks in which sources are summed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.llm import text as T

BLOCK_BYTES = 64 * 1024
#: Bounds of the plan (blocks and one more a source), of the sums by chunk, and of the sources.
MAX_BLOCKS = 500_000
CHUNK_ROWS = 1_000
MAX_CHUNKS = 500_000
MAX_SOURCES = 100_000
PLAN_ROW = 4096  # blocks in a row of the plan, before it is exploded


def exact_weights(weights: Mapping) -> dict:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def edf_slots(shares: Mapping, blocks: Mapping) -> dict:
    """Slots of each source's blocks, earliest deadline first (ties by share, then name), up to the
    slot in which the first source has placed all its blocks."""
    period, done, slots = sum(shares.values()), dict.fromkeys(shares, 0), {s: [] for s in shares}
    waiting = [(0, str(s), s) for s in shares]
    heapq.heapify(waiting)
    ready: list = []
    for t in range(sum(blocks[s] for s in shares)):
        while waiting and waiting[0][0] <= t:
            _, _, s = heapq.heappop(waiting)
            due = -(-(done[s] + 1) * period // shares[s])
            heapq.heappush(ready, (due, -shares[s], str(s), s))
        _, _, _, s = heapq.heappop(ready)
        slots[s].append(t)
        done[s] += 1
        if done[s] == blocks[s]:
            break
        heapq.heappush(waiting, (done[s] * period // shares[s], str(s), s))
    return slots


def plan_phases(blocks: Mapping, weights: Mapping) -> list[tuple]:
    """(source, phase, first block, end block, blocks, start slot, slots in the phase, slots, share)
    for all sources. Sources of weight 0 come when the others have run out."""
    left, used, start, phase, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, 0, []
    while left:
        live = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1)
        shares = exact_weights(live)
        slots, size = edf_slots(shares, left), sum(shares.values())
        end = sum(map(len, slots.values()))
        for s, own in slots.items():
            n = len(own)
            out.append((s, phase, used[s], used[s] + n, n, start, end, own, shares[s] / size))
            used[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start, phase = start + end, phase + 1
    return out


def mix_sources(docs: DataFrame, order: list[Column], chunk_key: Column, source: str = "source", cost: Column | None = None, block_cost: int = 1, weights: Mapping | None = None, temperature: float = 0.5) -> DataFrame:
    """``docs`` with mix_block, mix_phase, mix_slot, mix_weight (the share in force) and mix_rank (the
    place within the source).

    A source's documents are laid end to end (by hash chunk, then ``order``) and cut in blocks of
    ``block_cost``, or more if that made over ``MAX_BLOCKS``; a document belongs to the block it
    starts in. ``weights`` default to each source's total cost to the power ``temperature``. A null
    source is a source of its own; null texts cost what ``cost`` says; sources that ``weights``
    doesn't name, or over ``MAX_SOURCES`` of them, are refused with an error. No document is dropped
    or repeated. An empty table stays empty. Where ``docs`` has a column of an added name, the added
    one gets an underscore in front.
    """
    spark = docs.sparkSession
    added = T.unused(docs, "mix_block", "mix_phase", "mix_slot", "mix_weight", "mix_rank")
    block, phase, slot, weight, rank = added
    chunk, price, run, before, key, chunks, last = T.unused(docs, "mix_chunk", "mix_cost", "mix_run", "mix_before", "mix_source", "mix_chunks", "mix_last")
    label = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    base = docs.withColumns({key: label, price: (F.lit(1) if cost is None else cost).cast("long")})
    totals = base.groupBy(key).agg(F.sum(price).alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them before mixing")
    sizes = {r[key]: r["n"] for r in totals}
    block_cost = max(block_cost, -(-sum(sizes.values()) // MAX_BLOCKS))
    chunk_rows = max(CHUNK_ROWS, sum(r["rows"] for r in totals) // MAX_CHUNKS)
    target = {s: float(n or 1) ** temperature for s, n in sizes.items()} if weights is None else {s: weights[None if s == "" else s[1:]] for s in sizes}
    blocks = {s: max(1, -(-n // block_cost)) for s, n in sizes.items()}
    rows = [(q, ph, first + k, start, slots[k : k + PLAN_ROW], share) for q, ph, first, _, _, start, _, slots, share in plan_phases(blocks, target) for k in range(0, len(slots), PLAN_ROW)]
    parts = spark.createDataFrame(rows, "source string, phase int, first long, start long, slots array<bigint>, weight double")
    plan = parts.select("source", "phase", "first", "start", "weight", F.posexplode("slots").alias("at", "slot"))
    plan = plan.select(F.col("source").alias(key), (F.col("first") + F.col("at")).alias(block), F.col("phase").alias(phase), (F.col("start") + F.col("slot")).alias(slot), F.col("weight").alias(weight))
    each = spark.createDataFrame([(r[key], -(-r["rows"] // chunk_rows), blocks[r[key]] - 1) for r in totals], f"`{key}` string, `{chunks}` int, `{last}` long")
    base = base.join(F.broadcast(each), key).withColumn(chunk, F.pmod(chunk_key, F.col(chunks)).cast("int"))
    sums = T.stored(base.groupBy(key, chunk).agg(F.sum(price).alias(run)))
    ahead = F.coalesce(F.sum(run).over(Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(key, chunk, ahead.alias(before))  # MAX_CHUNKS rows and one a source at most
    within = F.coalesce(F.sum(price).over(Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = base.withColumn(run, within).join(F.broadcast(offsets), [key, chunk])
    out = out.withColumn(rank, F.col(before) + F.col(run))
    out = out.withColumn(block, F.least(F.floor(F.col(rank) / F.lit(block_cost)).cast("long"), F.col(last))).join(F.broadcast(plan), [key, block])
    return out.select(*docs.columns, *added)


def mixed_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in mixed order: range-partitioned and sorted by slot, with their own columns.

    Written to files, part names and rows within them keep that order.
    """
    row = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col("source").alias("source"), T.utf8_bytes(F.col(text)).alias("bytes"), F.xxhash64(F.col(text)).alias("digest"))
    mixed = mix_sources(row, [F.col("key"), F.col("digest")], F.xxhash64("key"), cost=F.col("bytes") + 16, block_cost=BLOCK_BYTES)
    by = ["mix_slot", "mix_rank", "key", "digest"]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by).select("row.*")


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, blocks of 64 KiB, target weights by the square root of each source's bytes."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "source", T.utf8_bytes(F.col("text")).alias("bytes"))
    mixed = mix_sources(docs, [F.col("doc_id"), F.col("bytes")], F.xxhash64("doc_id"), cost=F.col("bytes") + 16, block_cost=BLOCK_BYTES)
    return mixed.select("doc_id", "source", "bytes", "mix_block", "mix_phase", "mix_slot", "mix_weight")
