"""Operator 4: rendezvous hashing of stable record keys over weighted shards.

Each record goes to the shard with the highest score for its key. A score depends on the key
and that one shard only, so a further shard takes records into itself and moves no others.
All of it is built-in expressions; the only shuffle carries the narrow slot keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.llm import text as T

MASK = 0xFFFFFFFF
MULTIPLIER = 0x45D9F3B
#: Slots are numbered within hash ranges of a shard, then shifted by the ranges' offsets. All shards
#: have about this many ranges together, which bounds the offsets that are broadcast.
RANGES = 1 << 16
SHARDS = 40


def shard_seed(shard: int) -> int:
    return int(hashlib.md5(f"shard:{shard}".encode()).hexdigest()[:8], 16)


def _draws(key: Column, shards: int) -> Column:
    """One 32-bit draw a shard: two multiply-xorshift rounds over the key's hash and the shard's seed."""
    x = F.transform(F.array(*[F.lit(shard_seed(i)).cast("long") for i in range(shards)]), lambda seed: key.bitwiseXOR(seed))
    for _ in range(2):
        x = F.transform(x, lambda v: (v.bitwiseXOR(F.shiftright(v, 16)) * F.lit(MULTIPLIER).cast("long")).bitwiseAND(F.lit(MASK)))
    return F.transform(x, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))


def key_hash(key: Column) -> Column:
    """32 bits of the key's text; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")), 1, 8), 16, 10).cast("long")


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """An array with each shard's score. Equal weights compare the raw 32-bit draws; otherwise
    the score is -w / ln(u), for which a shard wins a share of keys in proportion to w."""
    if any(w < 0 for w in weights) or not any(w > 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    draws = _draws(key, len(weights))
    if len(set(weights)) == 1:
        return draws
    shares = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(draws, lambda d, i: F.get(shares, i) / -F.log((d.cast("double") + 0.5) / float(1 << 32)))


def rendezvous_shard(frame: DataFrame, key: str, weights: Sequence[float], name: str = "shard", grown: str | None = None, grown_weight: float | None = None) -> DataFrame:
    """``frame`` with the shard of each row, from 0, and optionally the one with a shard added.

    A null key is a key of its own; rows of one key share a shard; ties of scores go to the lower
    number. An empty table stays empty. Clashing column names are avoided for helpers.
    """
    more = list(weights) + [weights[-1] if grown_weight is None else grown_weight]
    h, s = T.unused(frame, "key_hash", "scores")
    n = len(weights)
    out = frame.withColumn(h, key_hash(F.col(key))).withColumn(s, shard_scores(F.col(h), more if grown else weights))
    top = F.array_max(F.slice(s, 1, n))
    shard = (F.array_position(F.slice(s, 1, n), top) - 1).cast("int")
    out = out.withColumn(name, shard)
    if grown:
        out = out.withColumn(grown, F.when(F.element_at(s, n + 1) > top, F.lit(n)).otherwise(F.col(name)).cast("int"))
    return out.drop(h, s)


def chunks_for(groups: int) -> int:
    return max(1, RANGES // groups)


def number_slots(frame: DataFrame, group: str, groups: int, chunk_key: Column, order: Sequence[Column], name: str = "slot", counted: DataFrame | None = None) -> DataFrame:
    """Gapless numbers from 0 within each of ``groups`` groups, without one task per group.

    Rows are numbered within (group, chunk); offsets come from a count per (group, chunk), which
    has about ``RANGES`` rows (or one a group). ``counted`` may give a cheaper frame with the same
    groups and chunk key to count from. Order within a group: chunk, then ``order``.
    """
    c, n, off = T.unused(frame, "slot_chunk", "slot_count", "slot_offset")
    chunk = F.pmod(chunk_key, F.lit(chunks_for(groups))).cast("int")
    source = (frame if counted is None else counted).select(group, chunk.alias(c))
    counts = source.groupBy(group, c).agg(F.count("*").alias(n))
    before = Window.partitionBy(group).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias(f"_{off}_group"), F.col(c).alias(f"_{off}_chunk"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    within = F.row_number().over(Window.partitionBy(group, c).orderBy(*order))
    numbered = frame.withColumn(c, chunk).withColumn(n, within)
    joined = numbered.join(F.broadcast(offsets), (F.col(group) == F.col(f"_{off}_group")) & (F.col(c) == F.col(f"_{off}_chunk")))
    return joined.withColumn(name, (F.col(n) - 1 + F.col(off)).cast("long")).drop(c, n, off, f"_{off}_group", f"_{off}_chunk")


def _from_files(docs: DataFrame) -> bool:
    try:
        return bool(docs.select("_metadata.file_name", "_metadata.row_index").schema)
    except AnalysisException:
        return False


def shard_in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, source, size, shard and slot of each row; a shard's slots follow the rows' order.

    The order is that of file names and of rows within a file, for a frame read from files (any
    other frame is numbered by key); rows of a shard are numbered file by file, so that no task
    holds a whole shard.
    """
    if not _from_files(docs):
        rows = docs.select(F.col(key).alias("doc_id"), "source", (T.utf8_bytes(F.col(text)) + 16).alias("size"))
        placed = rendezvous_shard(rows, "doc_id", [1.0] * shards)
        return number_slots(placed, "shard", shards, key_hash(F.col("doc_id")), [F.col("doc_id"), F.col("size")]).select("doc_id", "source", "size", "shard", "slot")
    rows = docs.select(F.col(key).alias("doc_id"), "source", (T.utf8_bytes(F.col(text)) + 16).alias("size"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = rendezvous_shard(rows, "doc_id", [1.0] * shards)
    counts = placed.groupBy("shard", "file").agg(F.count("*").alias("n"))  # shards x files rows at most
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "file").orderBy("row")) - 1
    out = placed.withColumn("slot", within).join(offsets, ["shard", "file"])
    return out.select("doc_id", "source", "size", "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 equal shards by doc_id; law ``key``."""
    docs = T.read(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", (T.utf8_bytes(F.col("text")) + 16).alias("size"), T.crc32_text(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    weights = [1.0] * SHARDS
    placed = rendezvous_shard(keyed, "doc_id", weights, grown="grown_shard")
    counted = rendezvous_shard(docs.select("doc_id"), "doc_id", weights)
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    out = number_slots(placed, "shard", SHARDS, key_hash(F.col("doc_id")), order, counted=counted)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
