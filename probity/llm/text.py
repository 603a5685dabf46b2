"""Column expressions shared by the text operators; all of them stay in the JVM.

Null text has no words. "White" is the ASCII set [\\x20\\x09-\\x0D] everywhere.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other letters)."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column, separators: str = WHITE_RUN) -> Column:
    """Maximal runs of non-separator characters; null or blank text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def _fold(hashes: str, step: int, other: str | None = None) -> Column:
    """Folds into each element the one ``step`` further on (of ``other``, if given)."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(F.col(other or hashes), i + step)))


def with_window_hashes(frame: DataFrame, words: str, lengths: dict[int, str]) -> DataFrame:
    """Adds arrays of 64-bit fingerprints of all runs of so many words, in order.

    ``lengths`` maps run lengths to column names. An array is empty if the row has fewer words.
    Runs are built by doubling (1, 2, 4 ... words), each step a column of its own, so that
    nothing is computed twice.
    """
    top = max(lengths).bit_length()
    powers = unused(frame, *[f"run_{1 << k}" for k in range(top)])
    out = frame.withColumn(powers[0], F.transform(words, lambda w: F.xxhash64(w)))
    for k in range(1, top):
        out = out.withColumn(powers[k], _fold(powers[k - 1], 1 << (k - 1)))
    for length, name in lengths.items():
        bits = [k for k in reversed(range(top)) if length >> k & 1]
        acc, at = powers[bits[0]], 1 << bits[0]
        for k in bits[1:]:
            out = out.withColumn(nxt := f"{name}_{at}", _fold(acc, at, powers[k]))
            acc, at = nxt, at + (1 << k)
        out = out.withColumn(name, F.slice(acc, F.lit(1), F.greatest(F.size(words) - (length - 1), F.lit(0))))
    return out.select(*frame.columns, *lengths.values())


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_text(value: Column) -> Column:
    return F.crc32(F.encode(value, "utf-8"))


def unused(frames: DataFrame | list[DataFrame], *names: str) -> list[str]:
    """Column names that the frames don't have, derived from ``names`` by underscores."""
    taken, out = {c.lower() for f in (frames if isinstance(frames, list) else [frames]) for c in f.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def stored(frame: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to the folder all executors share and reads
    them back. Lost executors cost no recomputation of what came before."""
    path = f"{checkpoint_dir(frame.sparkSession)}/probity-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables that ``stored`` made, once nothing lazy reads them any more."""
    for path in (getattr(f, "_stored_at", None) for f in frames if f is not None):
        if path:
            remove_folder(next(f for f in frames if f is not None).sparkSession, path)


def remove_folder(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint_dir(spark) -> str:
    """The session's shared folder; where none is set, one in the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/probity-checkpoint-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of one key from which on it is spread over several tasks, and the most keys so treated:
#: the bound of what ``hot_keys`` broadcasts.
HOT_ROWS = 256
MAX_HOT = 20_000


def hot_keys(frame: DataFrame, key: str) -> DataFrame:
    """(key, splits) of the keys that hold many of ``frame``'s rows; at most ``MAX_HOT`` of them."""
    limit = max(HOT_ROWS, frame.count() // MAX_HOT)
    counts = frame.groupBy(key).agg(F.count("*").alias("splits")).filter((F.col("splits") > limit) & F.col(key).isNotNull())
    return F.broadcast(counts.select(key, F.ceil(F.col("splits") / F.lit(limit)).cast("int").alias("splits")))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Joins by ``key``, of which ``right`` holds a row at most, so that no key of ``left`` fills a task.

    Rows of a hot key are dealt by ``by``, and the row of ``right`` goes to each part.
    """
    hot = hot_keys(left, key) if hot is None else hot
    parts, part = unused([left, right], "hot_parts", "hot_part")
    hot = hot.select(key, F.col("splits").alias(parts))
    dealt = left.join(hot, key, "left").withColumn(part, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    copies = right.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return dealt.join(copies, [key, part], how).drop(part)


#: Bits of a membership filter, which is broadcast as a row for each 64 of them that hold any.
FILTER_BITS = 1 << 23


def likely_members(rows: DataFrame, value: Column, keys: DataFrame, key: Column) -> DataFrame:
    """All ``rows`` whose 64-bit hash ``value`` is a ``key`` of ``keys`` and, while these are few, few others.

    The keys become a bitmap of bounded size, put together by the executors and broadcast; rows that
    it drops need not be shuffled.
    """
    at, bit, bits = unused(rows, "filter_word", "filter_bit", "filter_bits")
    word, place = (lambda x: F.floor(F.pmod(x, F.lit(FILTER_BITS)) / 64).cast("int")), (lambda x: F.pmod(x, F.lit(64)).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place(key))
    words = keys.groupBy(word(key).alias(at)).agg(F.bit_or(one).alias(bits))  # FILTER_BITS / 64 rows at most
    met = rows.withColumns({at: word(value), bit: place(value)}).join(F.broadcast(words), at)
    return met.filter(F.call_function("shiftright", F.col(bits), F.col(bit)).bitwiseAND(F.lit(1).cast("long")) == 1).select(*rows.columns)
