"""Operator 7: exact line dedup over range-partitioned line hashes.

Line hashes are range-partitioned and sorted by (hash, document, position). Each partition is
streamed once; the first document of a run of equal hashes keeps its lines, the others lose them.
The sort key ends in document and position, so that one frequent line spreads over many
partitions; what a partition cannot know of the run it starts in is settled from the partitions'
border runs (two rows a partition). The result is a compressed bitmap per document, no text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import BinaryType, StringType

from probity.llm import text as T

MIN_CHARS = 10
WHITE = T.WHITE.encode()
LINE_ROWS = "doc long, digest long, h1 long, h2 long, pos int, n_lines int"


def _line_hashes(min_chars: int):
    kind = pa.schema([("doc", pa.int64()), ("digest", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, digests, hashes, places, counts = [], [], bytearray(), [], []
            for doc, digest, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = (text or "").encode().split(b"\n")
                for pos, line in enumerate(lines):
                    key = line.strip(WHITE)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        hashes += xxhash.xxh3_128_digest(key.lower())
                        docs.append(doc)
                        digests.append(digest)
                        places.append(pos)
                        counts.append(len(lines))
            pair = np.frombuffer(bytes(hashes), dtype=">u8").astype("u8").view("i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(digests, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(places, pa.int32()), pa.array(counts, pa.int32())], schema=kind)

    return run


def _stream_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Losing lines of sorted hashes; of the partition's first run all lines, marked open; and the
    first and last run as border rows. State between batches: one run."""
    run, keeper, opening, border = None, None, None, []
    for frame in frames:
        if frame.empty:
            continue
        h = frame[["h1", "h2"]].to_numpy()
        doc = frame["doc"].astype("Int64")
        doc = np.where(doc.isna(), np.iinfo("i8").max, doc.fillna(0)).astype("i8")
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]).any(axis=1)
        same = run is not None and tuple(h[0]) == run
        new[0] = not same
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first = np.where(start < 0, keeper if same else 0, doc[np.maximum(start, 0)])
        if run is None:
            opening = tuple(h[0])
            border.append((*opening, first[0]))
        open_ = (h == opening).all(axis=1)
        out = frame[open_ | (doc != first)].copy()
        out["open"], out["border"] = open_[open_ | (doc != first)], False
        run, keeper = tuple(h[-1]), first[-1]
        yield out[["doc", "digest", "h1", "h2", "pos", "n_lines", "open", "border"]]
    if run is not None:
        border.append((*run, keeper))
        rows = pd.DataFrame(border, columns=["h1", "h2", "doc"]).drop_duplicates()
        top = np.iinfo("i8").max
        yield pd.DataFrame({"doc": rows["doc"].where(rows["doc"] != top).astype("Int64"), "digest": 0, "h1": rows["h1"], "h2": rows["h2"], "pos": -1, "n_lines": 0, "open": True, "border": True})


def lost_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, digest, pos, n_lines) of every line that an earlier document (by ``key``) holds.

    ``key`` is an integer; null keys come last and count as one document, as do rows that share a
    key. Null text is one empty line, and lines under ``min_chars`` code points are left alone.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))
    lines = T.stored(rows.mapInArrow(_line_hashes(min_chars), LINE_ROWS))
    by = [F.col("h1"), F.col("h2"), F.col("doc").asc_nulls_last(), F.col("pos"), F.col("digest")]
    runs = T.stored(lines.repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(_stream_runs, LINE_ROWS + ", open boolean, border boolean"))
    borders = runs.filter("border").groupBy("h1", "h2").agg(F.min("doc").alias("keeper"))  # two rows a partition at most
    settled = runs.filter("open and not border").join(F.broadcast(borders), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    names = ["doc", "digest", "pos", "n_lines"]
    return runs.filter("not open").select(names).unionByName(settled.select(names))


@F.pandas_udf(BinaryType())
def _keep_bitmap(lost: pd.Series, n: pd.Series) -> pd.Series:
    def one(places, count: int) -> bytes:
        keep = np.ones(count, bool)
        keep[np.asarray(places, int)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(p, c) for p, c in zip(lost, n, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, digest, n_lines, n_dropped, keep_bitmap) of the documents that lose lines.

    ``digest`` is xxhash64 of the text, which tells rows with one key apart. The bitmap has a bit
    a line, most significant first, compressed with zlib. Documents not listed keep every line.
    """
    per_doc = lost_lines(docs, key, text, min_chars).groupBy("doc", "digest", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    return per_doc.select("doc", "digest", "n_lines", F.size("lost").cast("long").alias("n_dropped"), _keep_bitmap("lost", "n_lines").alias("keep_bitmap"))


@F.pandas_udf(StringType())
def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t: str | None, b: bytes | None) -> str | None:
        if b is None:
            return t
        lines = (t or "").split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), "u1"), count=len(lines))
        return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def bitmap_bits(bitmap: pd.Series, n: pd.Series) -> pd.Series:
    """A bitmap's bits as zeros and ones; all ones where there is no bitmap."""
    one = lambda b, count: "1" * count if b is None else "".join(map(str, np.unpackbits(np.frombuffer(zlib.decompress(b), "u1"), count=count)))
    return pd.Series([one(b, c) for b, c in zip(bitmap, n, strict=True)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with kept_text (the text that its bitmap keeps), n_dropped and keep_bitmap (null where
    every line stays).

    Null texts stay null; repeated rows are cut alike; an empty table stays empty. Where ``docs`` has
    a column of an added name, the added one gets an underscore in front.
    """
    kept, dropped, bitmap = T.unused(docs, "kept_text", "n_dropped", "keep_bitmap")
    d, g = T.unused(docs, "line_doc", "line_digest")
    side = bitmaps.select(F.col("doc").alias(d), F.col("digest").alias(g), F.col("n_dropped").alias(dropped), F.col("keep_bitmap").alias(bitmap))
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    out = docs.join(side, F.col(key).cast("long").eqNullSafe(F.col(d)) & (digest == F.col(g)), "left")
    cut = F.when(F.col(bitmap).isNull(), F.col(text)).otherwise(_kept_text(F.col(text), bitmap))
    return out.select(*docs.columns, cut.alias(kept), F.coalesce(dropped, F.lit(0)).alias(dropped), bitmap)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    out = apply_bitmaps(docs, keep_bitmaps(docs)).withColumn("n_lines", n_lines)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"), bitmap_bits("keep_bitmap", "n_lines").alias("keep_bits"))
