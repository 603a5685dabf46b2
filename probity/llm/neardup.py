"""Operator 9: near-duplicate documents by MinHash bands, odd sketches and full-set checks.

Each text becomes its set of five-word shingles. MinHash samples give band keys and, folded into
a parity bitmap, an odd sketch. Texts with equal sets are one node. Nodes that meet in a band
bucket are candidates; the XOR population count of two sketches estimates their similarity and
drops those below. Just under the threshold, where an estimate can't tell, a second parity bitmap
over the whole sets bounds it exactly; what is left is confirmed on the full sets.

A bucket isn't expanded into pairs. Its members are compared with a few pivots; new links merge
classes; a bucket is done when the members that haven't been pivots share one class. Otherwise
further, more numerous pivots follow, until every pair in every bucket is either in one class or
compared. Large buckets, frequent pivots and large classes are dealt over several tasks.

A node's id starts with the least key of its documents, in an order-preserving form, so that the
least id of a class names the class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import text as T
from probity.llm.ngrams import giving_back, pieces

SHINGLE = 5
SAMPLES = 256
#: Bands are as long as they can be while a pair at the threshold is missed less often than this.
MISSED = 1e-4
SKETCH_BITS = 1024
#: Standard deviations by which a pair at the threshold may differ from the estimate and still be
#: confirmed on the full sets: about 3 in 100,000 such pairs go beyond.
SKETCH_SLACK = 4.0
#: Bits of the parity bitmap over a whole set. Two such bitmaps never differ in more bits than their
#: sets in members.
SET_BITS = 1024
FIRST_PIVOTS = 4
#: Links that one task merges (some 100 MB); more are merged by distributed rounds.
TASK_LINKS = 1_000_000
M64 = (1 << 64) - 1


class _Words(dict):
    """Word to 64-bit hash; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of all runs of ``size`` words, A-Z lower-cased.

    A text of fewer words is one run; null or wordless text has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = _mixed(out + h[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(1, 1 << 32, n, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def min_hashes(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):  # whole sets, in pieces that fit the cache
        part = low[k : k + 2048]
        x = part[None, :] * mul[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x += add[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_shape(percent: int) -> tuple[int, int]:
    """Bands and samples in each."""
    j = percent / 100
    rows = max((r for r in range(1, 17) if (1 - j**r) ** (SAMPLES // r) <= MISSED), default=1)
    return SAMPLES // rows, rows


def parity(items: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((_mixed(items) % np.uint64(bits)).astype(int), minlength=bits) & 1).astype(np.uint8)).view("i8")


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (position, sample) pairs."""
    return parity(samples.astype(np.uint64) | (np.arange(len(samples), dtype=np.uint64) << np.uint64(32)), SKETCH_BITS)


def expected_difference(differing: float) -> float:
    """Odd bits that so many thrown items leave."""
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing)


def estimated_similarity(difference: float) -> float:
    """The share of equal samples from the XOR population count of two sketches."""
    rest = max(1 - 2 * difference / SKETCH_BITS, 1e-9)
    return 1 - math.log(rest) / math.log(1 - 2 / SKETCH_BITS) / (2 * SAMPLES)


def sketch_limit(percent: int) -> int:
    """The XOR population count up to which a pair can have ``percent`` similarity.

    Two items differ for each sample that does. Variances of sampling and of folding add up.
    """
    k, j = SAMPLES, percent / 100
    mean = expected_difference(2 * k * (1 - j))
    slope = (1 - 2 / SKETCH_BITS) ** (2 * k * (1 - j))
    folding = max(0.0, mean * (1 - mean / SKETCH_BITS) - 2 * k * (1 - j) * slope**2)
    return math.ceil(mean + SKETCH_SLACK * (4 * k * j * (1 - j) * slope**2 + folding) ** 0.5)


SKETCHES = "doc long, digest long, n int, node binary, sketch array<long>, whole array<long>, bands array<long>"


def _sketched(percent: int):
    n_bands, n_rows = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (mul, add) = _Words(), _seeds(SAMPLES)
        step = np.arange(n_bands, dtype=np.uint64)
        for batch in pieces(batches, 2):
            n, nodes, sketches, wholes, bands = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, known)
                n.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    m = min_hashes(s, mul, add)
                    sketches.append(odd_sketch(m))
                    wholes.append(parity(s, SET_BITS))
                    key = step
                    for r in range(n_rows):
                        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + m[r * n_bands : (r + 1) * n_bands].astype(np.uint64))
                    bands.append(key.view("i8"))
                else:
                    for x in (sketches, wholes, bands):
                        x.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(nodes, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (sketches, wholes, bands))],
                names=["doc", "digest", "n", "node", "sketch", "whole", "bands"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in pieces(batches, 1):
        sets = [shingle_set(t, known).view("i8") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _text_digest(text: str) -> Column:
    """Equal for equal texts; a null isn't an empty text."""
    return F.xxhash64(F.col(text).isNull(), F.coalesce(F.col(text), F.lit("")))


# --- classes


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the nodes that aren't the least of their class, from all links at once."""
    a, b = [], []
    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
    ids = sorted({*a, *b})
    place = {x: i for i, x in enumerate(ids)}
    x, y = (np.fromiter(map(place.__getitem__, v), np.int64, len(v)) for v in (a, b))
    root = np.arange(len(ids))
    while (apart := root[x] != root[y]).any():
        rx, ry = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while ((up := root[root]) != root).any():
            root = up
    moved = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in moved], pa.binary()), pa.array([ids[i] for i in root[moved]], pa.binary())], names=["node", "label"])


def spread_labels(edges: DataFrame, in_task: int = TASK_LINKS) -> DataFrame:
    """(node, label): the least node of its component, for the nodes of ``edges`` (a, b) that aren't it.

    Up to ``in_task`` links go to one task. Beyond that, alternating star contraction: every node
    links its larger, then its smaller neighbours to its least one, until each component is a
    star; the rounds grow with the logarithm of the graph.
    """
    if edges.count() <= in_task:
        return edges.select("a", "b").repartition(1).mapInArrow(_merged, "node binary, label binary")
    now = T.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while True:
        # large star: every neighbour above a node moves to the least of the node and its neighbours
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = T.stored(T.spread_join(ways, least, "a", F.col("b")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its neighbours below move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = T.spread_join(large, least, "a", F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        before, now = now, T.stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        T.discard(before, large)
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _attach(pairs: DataFrame, table: DataFrame, side: str, other: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``table`` for the node in column ``side``, named after it."""
    named = table.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in table.columns])
    return T.spread_join(pairs, named, side, F.col(other), hot=hot.select(F.col("node").alias(side), "splits"))


def may_link(percent: int) -> Column:
    """Whether a row (n, sketch, whole) and its pivot can reach ``percent``: by size, by the estimate
    of their odd sketches, and by the exact bound of their sets' bitmaps."""
    n, m = F.col("n"), F.col("pivot.n")
    apart = lambda c: F.aggregate(F.zip_with(c, f"pivot.{c}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (apart("sketch") <= sketch_limit(percent)) & ((100 + percent) * apart("whole") <= (100 - percent) * (n + m))


def confirmed_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets reach ``percent``."""
    hot = T.hot_keys(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    both = _attach(_attach(pairs, sets, "a", "b", hot), sets, "b", "a", hot)
    sizes = F.size("shingles_a") + F.size("shingles_b")
    return both.filter((100 + percent) * F.size(F.array_intersect("shingles_a", "shingles_b")) >= percent * sizes).select(*pairs.columns)


def _parts(splits: str = "splits") -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(splits) - 1)).alias("part")


def candidate_rows(nodes: DataFrame) -> DataFrame | None:
    """(band, node, part, splits) of the bands that nodes share; a large band's rows in several parts."""
    in_band = nodes.select("node", F.explode("bands").alias("band"))
    shared = T.stored(in_band.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"))
    total = shared.agg(F.sum("size")).first()[0]
    if not total:
        return None
    limit = max(T.HOT_ROWS, total // T.MAX_HOT)
    spread = shared.select("band", F.ceil(F.col("size") / F.lit(limit)).cast("int").alias("splits"))
    hot = F.broadcast(spread.filter("splits > 1"))  # MAX_HOT rows at most
    one = F.coalesce("splits", F.lit(1))
    dealt = in_band.join(hot, "band", "left").select("band", "node", one.alias("splits"), F.pmod(F.xxhash64("node"), one).cast("int").alias("part"))
    out = T.stored(dealt.join(spread.select("band", _parts()), ["band", "part"], "left_semi"))
    T.discard(shared)
    return out


def link_classes(nodes: DataFrame, sets_of, percent: int) -> DataFrame | None:
    """(node, label) for the nodes that aren't the least of their class; None if no node has links.

    ``nodes``: node, doc, digest, n, sketch, whole, bands; ``sets_of`` gives the shingles of the nodes it is
    handed.
    """
    left = candidate_rows(nodes)
    if left is None:
        return None
    some = T.stored(nodes.drop("bands").join(left.select("node").distinct(), "node", "left_semi"))  # the rounds carry these alone
    sets = T.stored(sets_of(some))
    sketches = some.select("node", "n", "sketch", "whole")
    classes, pivots, spent = None, FIRST_PIVOTS, [left]
    while True:
        labelled = left.withColumn("label", F.col("node"))
        if classes is not None:
            labelled = left.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
            ends = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("splits").alias("splits"))
            pending = ends.filter("lo != hi").select("band", _parts())
            labelled = T.stored(labelled.join(pending, ["band", "part"], "left_semi"))
            T.discard(*spent)
            spent = [labelled]
        turn = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots))
        chosen = labelled.groupBy("band", turn.alias("turn")).agg(F.min(F.struct("node", "label")).alias("p"), F.first("splits").alias("splits"))
        pivot = F.struct(F.col("p.node").alias("node"), F.col("p.label").alias("label"), "n", "sketch", "whole").alias("pivot")
        chosen = T.stored(chosen.join(sketches, F.col("p.node") == sketches["node"]).select("band", pivot, "splits"))
        met = labelled.drop("splits").join(sketches, "node").join(chosen.select("band", "pivot", _parts()), ["band", "part"])
        met = met.filter((F.col("label") != F.col("pivot.label")) & may_link(percent))  # within the join: what it drops is never a row
        either = lambda x: [F.when(F.col("node") < F.col("pivot.node"), p).otherwise(q) for p, q in ((F.col(x), F.col(f"pivot.{x}")), (F.col(f"pivot.{x}"), F.col(x)))]
        pairs = T.stored(met.select(*[c.alias(name) for c, name in zip([*either("node"), *either("label")], ["a", "b", "label_a", "label_b"], strict=True)]).distinct())
        if not pairs.isEmpty():
            links = T.stored(confirmed_links(pairs, sets, percent).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
            moved = None if links.isEmpty() else T.stored(spread_labels(links))
            if moved is None:
                pass
            elif classes is None:
                classes = moved
            else:
                to = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
                now = T.spread_join(classes, to, "label", F.col("node"), "left").select("node", F.coalesce("further", "label").alias("label"))
                before, classes = classes, T.stored(now.unionByName(moved))
                T.discard(before, moved)
            T.discard(links)
        T.discard(pairs)
        left = labelled.drop("label").join(chosen.select("band", F.col("pivot.node").alias("node")), ["band", "node"], "left_anti")
        spent.append(chosen)
        if left.isEmpty():
            break
        pivots *= 32
    T.discard(sets, some, *spent)
    return classes


#: The order-preserving bytes of a long; a null comes last.
def _ordered(key: Column) -> Column:
    bits = F.lpad(F.hex(key.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.when(key.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), bits)))


def _key_of(node: Column) -> Column:
    bits = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", bits.cast("long"))


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(doc, digest, n_shingles, component_id, kept), one row per row of ``docs``.

    Two documents are linked if 100 x shared shingles >= ``percent`` x all their shingles;
    ``component_id`` is the least key that links reach. ``key`` is an integer; equal texts are
    linked, wordless or null texts are linked with nothing, null keys never name a class unless
    they are alone. Of repeated rows with one key, all are kept or none. An empty table stays empty.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), _text_digest(text).alias("digest"), F.col(text).alias("text"))
    all_ = T.stored(rows.mapInArrow(giving_back(_sketched(percent)), SKETCHES))
    some = F.struct("doc", "digest")
    firsts = [F.first(c).alias(c) for c in ("n", "sketch", "whole", "bands")]
    nodes = all_.filter("node is not null").groupBy("node").agg(F.min("doc").alias("least"), F.min(some).alias("of"), F.count("*").alias("copies"), *firsts)
    node = F.concat(_ordered(F.col("least")), "node")
    nodes = T.stored(nodes.select(F.col("node").alias("set"), node.alias("node"), "of.doc", "of.digest", "copies", "n", "sketch", "whole", "bands"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select("node", F.struct("doc", "digest").alias("own"))
        some = T.likely_members(rows, F.xxhash64("doc", "digest"), wanted, F.xxhash64("own"))  # most texts have no candidate and stay where they are
        texts = T.spread_join(some.select(F.struct("doc", "digest").alias("own"), "text"), wanted, "own", F.spark_partition_id(), hot=T.hot_keys(all_.select(F.struct("doc", "digest").alias("own")), "own"))
        return texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(giving_back(_sets), "node binary, shingles array<long>")

    classes = link_classes(nodes.select("node", "doc", "digest", "n", "sketch", "whole", "bands"), sets_of, percent)
    ids = nodes.select("set", "node", "copies")
    ids = ids.withColumn("label", F.col("node")) if classes is None else ids.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = ids.select(F.col("set").alias("node"), _key_of(F.col("label")).alias("component_id"))
    here = all_.select("doc", "digest", "n", "node", F.col("_metadata.row_index").alias("row"))
    met = T.spread_join(here.filter("node is not null"), ids, "node", F.col("row")).select("doc", "digest", "n", "component_id")
    alone = here.filter("node is null").select("doc", "digest", "n", F.col("doc").alias("component_id"))
    return met.unionByName(alone).select("doc", "digest", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class, the one with the least key; its own columns.

    Of repeated rows with that key and text, one stays. A row with a null key stays unless its class
    has a key. An empty table stays empty.
    """
    own = lambda doc, digest: [doc.isNull().alias("own_null"), F.coalesce(doc, F.lit(0)).alias("own_doc"), digest.alias("own_digest")]
    keys = ["own_null", "own_doc", "own_digest"]
    kept = near_duplicate_classes(docs, key, text, percent).filter("kept").select(*own(F.col("doc"), F.col("digest"))).distinct()
    rows = docs.select(F.struct("*").alias("row"), *own(F.col(key).cast("long"), _text_digest(text)))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")  # in this order whole rows are sorted once


def op9_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicate_classes(docs, percent=85)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")
