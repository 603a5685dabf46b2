"""Operator 2: toxicity by a factorization machine over hashed terms.

Features are hashed words and word beginnings (several languages inflect the same stem). The
model is  b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j  over the terms a text holds: pairs of
terms, such as an insult and a mention of a group, weigh in beyond their own weights.
Labels never enter a score; of each row only its text does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import text as T
from probity.llm.ngrams import giving_back, pieces

#: Labelled rows used for fitting, at most; the first by hash of doc_id.
MAX_LABELLED = 20_000
HASH_BITS = 20
TERMS = 4096
FACTORS = 4
PREFIXES = (4, 5, 6)
WORD = re.compile(r"\w+")


def term_hashes(word: str) -> list[int]:
    """Buckets of a lower-cased word: itself and its beginnings."""
    terms = ["w" + word, *(f"p{word[:k]}" for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh3_64_intdigest(t) & ((1 << HASH_BITS) - 1) for t in terms]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class FactorizationMachine:
    """``terms``: selected buckets, sorted; ``linear``: a weight each; ``factors``: a vector each."""

    bias: float
    terms: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def score(self, columns: np.ndarray) -> float:
        v = self.factors[columns]
        z = self.bias + self.linear[columns].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


#: Texts whose terms are expanded at once while fitting.
STEP_TEXTS = 1000


def fit(at: list[np.ndarray], y: np.ndarray, terms: np.ndarray, steps: int = 200, factors: int = FACTORS, rate: float = 0.05, l2: float = 2e-4) -> FactorizationMachine:
    """Full-batch Adam on the logistic loss. ``at``: per text, the places in ``terms`` of those it
    holds. Without both labels the score is their rate (0 if there are none).

    Gradients are summed over ``STEP_TEXTS`` texts at a time, so memory beyond ``at`` doesn't grow.
    """
    y = np.asarray(y, float)
    none = np.empty(0, int), np.empty(0), np.empty((0, factors))
    if not len(y) or y.min() == y.max():
        return FactorizationMachine(40.0 if len(y) and y[0] else -40.0, *none)
    n, k = len(y), len(terms)
    weight = np.where(y > 0, np.sqrt((1 - y.mean()) / y.mean()), 1.0) / n  # the rarer label counts more
    sizes = np.array([len(a) for a in at])
    parts = [(slice(i, i + STEP_TEXTS), np.repeat(np.arange(len(sizes[i : i + STEP_TEXTS]), dtype=np.int32), sizes[i : i + STEP_TEXTS]), np.concatenate(at[i : i + STEP_TEXTS]).astype(np.int32)) for i in range(0, n, STEP_TEXTS)]
    rng = np.random.default_rng(5)
    p = {"b": np.array([np.log(y.mean() / (1 - y.mean()))]), "w": np.zeros(k), "v": rng.normal(0, 0.02, (k, factors))}
    m, s = {i: np.zeros_like(x) for i, x in p.items()}, {i: np.zeros_like(x) for i, x in p.items()}
    for t in range(1, steps + 1):
        g = {"b": np.zeros(1), "w": l2 * p["w"], "v": l2 * p["v"]}
        for rows, row, col in parts:
            some, v = len(y[rows]), p["v"][col]
            total = np.stack([np.bincount(row, v[:, f], some) for f in range(factors)], axis=1)
            square = np.bincount(row, (v * v).sum(axis=1), some)
            z = p["b"] + np.bincount(row, p["w"][col], some) + 0.5 * ((total**2).sum(axis=1) - square)
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * weight[rows]
            g_v = e[row, None] * (total[row] - v)
            g["b"] += e.sum()
            g["w"] += np.bincount(col, e[row], k)
            g["v"] += np.stack([np.bincount(col, g_v[:, f], k) for f in range(factors)], axis=1)
        for i in p:
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            s[i] = 0.999 * s[i] + 0.001 * g[i] ** 2
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-9)
    return FactorizationMachine(float(p["b"][0]), terms, p["w"], p["v"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold each bucket; bucket -1 counts the texts."""
    n = np.zeros((2, 1 << HASH_BITS), np.int64)
    size = [0, 0]
    for batch in pieces(batches, 2):
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            buckets = {h for w in distinct_words(text) for h in term_hashes(w)}
            n[int(label > 0)][np.fromiter(buckets, int, len(buckets))] += 1
            size[int(label > 0)] += 1
    some = np.flatnonzero(n.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[1, some], size[1])), pa.array(np.append(n[0, some], size[0]))], names=["term", "pos", "neg"])


def select_terms(counts: DataFrame, most: int = TERMS) -> np.ndarray:
    """The buckets that tell the labels apart best, by signed-root chi-square; rare ones are left out."""
    all_ = counts.filter("term = -1").first()
    if all_ is None or not all_["pos"] or not all_["neg"]:
        return np.empty(0, int)
    p, n = float(all_["pos"]), float(all_["neg"])
    share = (F.col("pos") + F.col("neg")) / (p + n)
    z = F.abs(F.col("pos") / p - F.col("neg") / n) / F.sqrt(share * (1 - share) * (1 / p + 1 / n) + 1e-12)
    best = counts.filter((F.col("term") >= 0) & (F.col("pos") + F.col("neg") >= 3)).withColumn("z", z).filter("z >= 2")
    return np.sort(np.array([r["term"] for r in best.orderBy(F.desc("z"), "term").limit(most).collect()], int))


PACKED = "keys binary, labels binary, sizes binary, at binary"


def _places(terms: np.ndarray):
    """The terms that each text holds, a batch of texts packed in a row."""
    place = {int(t): i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            at = [sorted({place[h] for w in distinct_words(t) for h in term_hashes(w) if h in place}) for t in batch.column(2).to_pylist()]
            keys, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = json.dumps(keys).encode(), np.array(labels, np.int8).tobytes(), np.array([len(a) for a in at], np.int32).tobytes(), np.array([x for a in at for x in a], np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["keys", "labels", "sizes", "at"])

    return run


def _fit_task(terms: np.ndarray):
    """Fits in one task, on the bounded sample; texts in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, at = [], [], []
        for row in (r for b in batches for r in b.to_pylist()):
            keys += json.loads(row["keys"])
            labels.append(np.frombuffer(row["labels"], np.int8))
            at += np.split(np.frombuffer(row["at"], np.int32), np.cumsum(np.frombuffer(row["sizes"], np.int32))[:-1]) if len(row["sizes"]) else []
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        y = np.concatenate([*labels, np.empty(0, np.int8)])
        model = fit([at[i] for i in order], y[order] > 0, terms)
        arrays = [pa.array([model.bias]), *(pa.array([a.tobytes()], pa.binary()) for a in (model.terms.astype(np.int64), model.linear, model.factors))]
        yield pa.RecordBatch.from_arrays(arrays, names=["bias", "terms", "linear", "factors"])

    return run


def fit_on_labels(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> FactorizationMachine:
    """Fits on at most ``most`` labelled keys that ``usable`` (over ``key``) admits.

    Null keys and labels are left out; a key labelled twice takes the larger label, a key with
    several texts one of them (the least by hash), so that ``most`` bounds the texts too. The fit
    runs in one task on that sample; only chosen terms and the model come to the driver.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), usable.alias("ok"))
    known = known.filter("ok").groupBy("key").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("key"), "key").limit(most)  # the bound of what is broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")
    one = rows.groupBy("key").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text"), "text")).alias("of"))
    rows = T.stored(one.select("key", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "of.text"))
    counts = T.stored(rows.mapInArrow(_term_counts, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    terms = select_terms(counts)
    fitted = rows.mapInArrow(_places(terms), PACKED).repartition(1).mapInArrow(_fit_task(terms), "bias double, terms binary, linear binary, factors binary").first()
    if fitted is None:
        return fit([], np.empty(0), terms)
    linear, factors = np.frombuffer(fitted["linear"]), np.frombuffer(fitted["factors"])
    return FactorizationMachine(fitted["bias"], np.frombuffer(fitted["terms"], np.int64), linear, factors.reshape(len(linear), FACTORS))


def _scored(model: FactorizationMachine, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches and the scores of their column ``text``."""
    place = {int(t): i for i, t in enumerate(model.terms)}
    known: dict[str, tuple] = {}
    for batch in pieces(batches, text):
        scores = []
        for said in batch.column(text).to_pylist():
            columns: set[int] = set()
            for w in distinct_words(said):
                if (c := known.get(w)) is None:
                    if len(known) > 60_000:
                        known.clear()
                    known[w] = c = tuple(place[h] for h in term_hashes(w) if h in place)
                if c:
                    columns.update(c)
            scores.append(model.score(np.fromiter(sorted(columns), int, len(columns))))
        yield batch, np.array(scores, float)


def _scorer(model: FactorizationMachine, text: int, name: str):
    """The batches with the scores in place of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(model, batches, text):
            yield batch.set_column(text, name, pa.array(scores))

    return giving_back(run)


def _under_half(model: FactorizationMachine, text: int):
    """The rows that score under 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(model, batches, text):
            yield batch.filter(pa.array(scores < 0.5))

    return giving_back(run)


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, carry: list[str], text: str = "text") -> DataFrame:
    """The ``carry`` columns and ``score`` (0 to 1) for every row; null and empty texts get the bias
    alone. If ``score`` is carried, the added column is called ``_score``. An empty table stays empty."""
    kept = docs.select(*carry)
    scored, score = T.unused(kept, "scored_text", "score")
    rows = docs.select(*carry, F.col(text).alias(scored))
    kind = "".join(f"{x}, " for x in [_ddl(kept)] if x)
    return rows.mapInArrow(_scorer(model, len(rows.columns) - 1, score), f"{kind}`{score}` double")


def held_out(key: Column, parts: int = 5, part: int = 0) -> Column:
    """True if crc32 of the key as text leaves ``part``; a null key counts as the empty text."""
    return F.pmod(T.crc32_text(F.coalesce(key.cast("string"), F.lit(""))), F.lit(parts)) == part


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that score under 0.5, with their own columns."""
    model = fit_on_labels(docs, labels, ~held_out(F.col(key)), key, text)
    at = [c.lower() for c in docs.columns].index(text.lower())
    return docs.mapInArrow(_under_half(model, at), _ddl(docs))  # a text goes to the worker and back once


def op2_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_labels(docs, T.read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
