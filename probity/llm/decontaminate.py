"""Operator 8: benchmark decontamination with built-in expressions only.

Normalised n-grams of the test items form a hash set; every training text is scanned with
rolling fingerprints, hits are verified word by word, and hit spans or documents are removed.

The hash set travels inside the plan as a literal while it has at most ``max_local`` windows,
which is checked by a count first; every row is then decided on its own, without a shuffle.
Beyond that bound the windows are joined by fingerprint instead. Both ways give equal results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import text as T

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Largest number of test windows, counted once an item, carried in the plan (about 100 bytes each).
MAX_LOCAL_WINDOWS = 200_000


def scan_words(text: Column) -> Column:
    """Words for the scan. ``lower`` folds more letters than A-Z and so finds all hits and perhaps
    others, which verification removes; word borders are the same. The final sigma, whose choice
    depends on what follows the word, becomes the plain one."""
    return T.split_words(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")), NOT_WORD)


def exact_words(text: Column) -> Column:
    return T.split_words(T.lower_ascii(text), NOT_WORD)


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(h, n, t, items): each distinct window, its fingerprint, length and item ids as strings.

    An item of fewer words than ``window`` is one window; null and wordless items have none.
    """
    words = benchmark.select(F.col(item).cast("string").alias("item"), scan_words(F.col(text)).alias("scan"), exact_words(F.col(text)).alias("exact"))
    words = words.filter(F.size("exact") > 0).withColumn("n", F.least(F.size("exact"), F.lit(window)))
    names = {k: f"h{k}" for k in range(1, window + 1)}
    hashed = T.with_window_hashes(words, "scan", names)
    pick = F.coalesce(*[F.when(F.col("n") == k, F.col(name)) for k, name in names.items()])
    rows = hashed.select("item", "exact", "n", F.posexplode(pick).alias("i", "h"))
    text_of = F.array_join(F.slice("exact", F.col("i") + 1, F.col("n")), " ")
    return rows.select("h", "n", text_of.alias("t"), "item").groupBy("h", "n", "t").agg(F.sort_array(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))


def _literal(rows: list, lengths: list[int]) -> tuple[dict[int, Column], Column, int]:
    """Hash buckets of the windows: fingerprints by length, full entries, and the bucket count."""
    n = 1 << max(4, (2 * len(rows)).bit_length())
    full: list[list] = [[] for _ in range(n)]
    only = {k: [[] for _ in range(n)] for k in lengths}
    for r in rows:
        full[r["h"] % n].append({"h": r["h"], "n": r["n"], "t": r["t"], "items": r["items"]})
        only[r["n"]][r["h"] % n].append(r["h"])
    parse = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  (folded into a literal)
    return {k: parse(v, "array<array<bigint>>") for k, v in only.items()}, parse(full, "array<array<struct<h:bigint,n:int,t:string,items:array<string>>>>"), n


def find_hits(docs: DataFrame, windows: DataFrame, text: str = "text", max_local: int = MAX_LOCAL_WINDOWS, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, hits (pos, len, items; by position), n_hit, items and contaminated.

    Null, empty and wordless texts have no words and no hits; repeated rows are decided alike.
    Without any window, nothing is hit; an empty table stays empty. Where ``docs`` has a column of
    an added name, the added one gets an underscore in front.
    """
    names = ["n_words", "hits", "n_hit", "items", "contaminated"]
    free = T.unused(docs, *names)
    if free != names:  # the names of the input step aside while the work is done
        (row,) = T.unused(docs, "input_row")
        inner = find_hits(docs.select(F.struct("*").alias(row), F.col(text).alias("text")), windows, "text", max_local, window)
        return inner.select(f"{row}.*", *[F.col(n).alias(f) for n, f in zip(names, free, strict=True)])
    by_length = {r["n"]: r["c"] for r in windows.groupBy("n").agg(F.sum(F.size("items")).alias("c")).collect()}
    lengths = sorted(by_length)
    scan, exact = T.unused(docs, "scan_words", "exact_words")
    out = docs.withColumn(scan, scan_words(F.col(text))).withColumn("n_words", F.size(scan).cast("long"))
    empty = F.array().cast("array<struct<pos:int,len:int,items:array<string>>>")
    if not lengths:
        out = out.withColumn("hits", empty).drop(scan)
    elif sum(by_length.values()) <= max_local:
        out = _hits_in_row(out, windows.collect(), lengths, text, scan, exact)
    else:
        out = _hits_by_join(out, windows, lengths, text, scan)
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["pos"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("n"))
    return out.withColumns(
        {
            "n_hit": F.aggregate("hits", zero, step, lambda a: a["n"]),
            "items": F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))),
            "contaminated": F.size("hits") > 0,
        }
    )


def _hits_in_row(docs: DataFrame, rows: list, lengths: list[int], text: str, scan: str, exact: str) -> DataFrame:
    only, full, n = _literal(rows, lengths)
    names = dict(zip(lengths, T.unused(docs, *[f"runs_{k}" for k in lengths]), strict=True))
    out = T.with_window_hashes(docs, scan, names)
    found = T.unused(out, *[f"found_{k}" for k in lengths])
    for (k, name), hit in zip(names.items(), found, strict=True):
        out = out.withColumn(hit, F.array_compact(F.transform(name, _probe(only[k], n)))).drop(name)
    some = F.lit(False)
    for hit in found:
        some = some | (F.size(hit) > 0)
    out = out.withColumn(exact, F.when(some, exact_words(F.col(text))))
    checked = [F.transform(hit, _verify(full, n, exact, k)) for k, hit in zip(lengths, found, strict=True)]
    hits = F.filter(F.flatten(F.array(*checked)), lambda x: x["items"].isNotNull())
    return out.withColumn("hits", F.sort_array(hits)).drop(scan, exact, *found)


def _probe(buckets: Column, n: int):
    """Position and fingerprint of a window that is in the set, else null."""
    return lambda h, i: F.when(F.array_contains(F.get(buckets, F.pmod(h, F.lit(n)).cast("int")), h), F.struct(i.alias("i"), h.alias("h")))


def _verify(full: Column, n: int, exact: str, length: int):
    def check(x: Column) -> Column:
        words = F.array_join(F.slice(F.col(exact), x["i"] + 1, F.lit(length)), " ")
        same = F.filter(F.get(full, F.pmod(x["h"], F.lit(n)).cast("int")), lambda e: (e["n"] == length) & (e["t"] == words))
        return F.struct(x["i"].alias("pos"), F.lit(length).alias("len"), F.get(same, 0)["items"].alias("items"))

    return check


def _hits_by_join(docs: DataFrame, windows: DataFrame, lengths: list[int], text: str, scan: str) -> DataFrame:
    """For test sets of any size: fingerprints of the windows of each distinct text meet those of the
    test set, frequent ones over several tasks; no words travel before that. What meets is verified
    word by word with its text, and hits come back by the text's digest."""
    (key,) = T.unused(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    texts = T.stored(keyed.select(F.col(key).alias("k"), F.col(text).alias("text")).dropDuplicates(["k"]))
    names = {k: f"h{k}" for k in lengths}
    hashed = T.with_window_hashes(texts.select("k", scan_words(F.col("text")).alias("scan")), "scan", names)
    runs = F.flatten(F.array(*[_tagged(name, k) for k, name in names.items()]))
    placed = T.stored(hashed.select("k", F.explode(runs).alias("r")).select("k", F.xxhash64("r.h", "r.n").alias("w"), "r.n", "r.pos"))
    known = windows.groupBy(F.xxhash64("h", "n").alias("w")).agg(F.collect_list(F.struct("n", "t", "items")).alias("same"))
    met = T.spread_join(placed, known, "w", F.xxhash64("k", "pos"))
    met = met.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "same"))).alias("met"))
    both = met.join(texts, "k").withColumn("exact", exact_words(F.col("text")))

    def check(x: Column) -> Column:
        words = F.array_join(F.slice(F.col("exact"), x["pos"] + 1, x["n"]), " ")
        same = F.filter(x["same"], lambda e: (e["n"] == x["n"]) & (e["t"] == words))
        return F.struct(x["pos"].alias("pos"), x["n"].alias("len"), F.get(same, 0)["items"].alias("items"))

    per_text = both.select(F.col("k").alias(key), F.filter(F.transform("met", check), lambda x: x["items"].isNotNull()).alias("hits"))
    empty = F.array().cast("array<struct<pos:int,len:int,items:array<string>>>")
    return keyed.join(per_text, key, "left").withColumn("hits", F.coalesce("hits", empty)).drop(key, scan)


def _tagged(name: str, length: int) -> Column:
    return F.transform(name, lambda h, i: F.struct(h.alias("h"), F.lit(length).alias("n"), i.alias("pos")))


def remove_hit_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by what is left without the hit words and the separators after them."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*)"), 1)
    lead = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]*", 0)
    free = lambda _, i: ~F.exists("hits", lambda h: (i >= h["pos"]) & (i < h["pos"] + h["len"]))
    return found.withColumn(text, F.when(F.size("hits") > 0, F.concat(lead, F.array_join(F.filter(pieces, free), ""))).otherwise(F.col(text)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents without any verified hit, with their own columns."""
    renamed = docs.select(F.struct("*").alias("row"), F.col(text).alias("scanned"))
    found = find_hits(renamed, benchmark_windows(benchmark), "scanned")
    # The partition number is never negative; being indeterminate, it keeps the optimizer from
    # pushing the filter below the scan's columns and evaluating them over and over.
    barred = found.withColumn("barrier", F.spark_partition_id())
    return barred.filter((F.col("barrier") >= 0) & ~F.col("contaminated")).select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, benchmark_windows(T.read(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
