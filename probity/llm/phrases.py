"""Operator 3: passages of 35 words that recur, found with Aho-Corasick automata.

1. Anchors. In every run of 28 eight-word phrases (one 35-word window) the phrase with the least
   hash is an anchor, so equal windows have equal anchors. Anchors that occur once are dropped.
2. Contexts. Around every recurring anchor, the words of the windows that it anchors go to the
   anchor's shard. Documents thus meet only the shards whose passages they can hold.
3. Shards. A task counts the windows of its contexts exactly, word for word, joins those that
   recur into passages, compiles the passages into an automaton over dictionary-coded words
   (pyahocorasick), and streams all contexts, equal ones once with their number, through it to
   locate every occurrence.
4. The covered places of a document come together and its words are cut.

An anchor in a large part of all documents would fill one shard. Of anchors over ``HOT`` occurrences
the windows are therefore counted by fingerprint (128 bits), in an aggregate that combines on the
map side and without their words; each context then goes to any shard, with its own recurring
windows. Frequent anchors, windows and copies are dealt over several tasks wherever they are joined.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from probity.llm import text as T
from probity.llm.neardup import _mixed

WINDOW = 35
PHRASE = 8
SPAN = WINDOW - PHRASE + 1
#: Occurrences from which on an anchor is spread by windows (about 100 MB of a task's memory below
#: it), and contexts a shard should hold.
HOT = 20_000
SHARD_CONTEXTS = 12_000
U64 = np.uint64
#: Bytes of text that are taken at once, so that their arrays stay small, and the bytes from which
#: on a word is hashed by itself.
PIECE = 1 << 20
LONG = 64


class Words:
    """The words of some texts: ``data`` joins them by one space, with a space behind the last.
    Word k is there from ``at[k]`` to ``at[k + 1] - 1``; text i has words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        white = (raw - np.uint8(9) < 5) | (raw == 32)
        ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        kept = ~white
        kept[ends] = True
        self.data = np.where(white, np.uint8(32), raw)[kept]
        self.at = np.concatenate([[0], np.flatnonzero(self.data == 32) + 1])
        borders = np.cumsum([len(t) + 1 for t in texts]) - 1
        self.first = np.concatenate([[0], np.searchsorted(ends, borders, "right")])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A hash of each word, made of eight bytes at a time."""
        start, length = self.at[:-1], np.diff(self.at) - 1
        eight = np.ndarray(len(self.data) + 1, "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        low = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
        out = _mixed(length.astype(U64))
        which, left = slice(None), length
        for done in range(0, LONG, 8):
            out[which] = _mixed(out[which] + (eight[start[which] + done] & low[np.minimum(left, 8)]))
            which = np.flatnonzero((length > done + 8) & (length <= LONG))
            if not len(which):
                break
            left = length[which] - (done + 8)
        for k in np.flatnonzero(length > LONG):
            out[k] = xxhash.xxh3_64_intdigest(self.data[start[k] : start[k] + length[k]].tobytes())
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with the same anchor: text, the anchor's hash, first window, number of windows."""
        if len(self.text) < WINDOW:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        p = phrase_hashes(self.hashes(), PHRASE)
        anchors = window_anchors(p)
        windows = np.flatnonzero(self.text[: len(anchors)] == self.text[WINDOW - 1 :])
        places = anchors[windows]
        head = np.flatnonzero(np.diff(places, prepend=-1))
        begin = windows[head]
        return self.text[begin], p[places[head]].view("i8"), begin, np.diff(head, append=len(windows))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The words of all texts (null: none), for ``PIECE`` bytes or one larger text at a time."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > PIECE:
            yield start, i - start, Words(texts[start:i])
            start, held = i, 0
        held += len(text) + 1
    if texts:
        yield start, len(texts) - start, Words(texts[start:])


def phrase_hashes(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(words) - size + 1, U64)
    for k in range(size):
        out = out * U64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return _mixed(out)


def window_anchors(phrases: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each window, the place of its least phrase (the last of equals)."""
    n = len(phrases) - span + 1
    order = phrases.copy()
    at = np.arange(len(phrases))
    width = 1
    while width < span:  # minima of runs of 1, 2, 4 ... then the run wanted, as in a sparse table
        step = min(width, span - width)
        left, right = order[: len(order) - step], order[step:]
        take = right <= left
        at = np.where(take, at[step:], at[: len(at) - step])
        order = np.where(take, right, left)
        width += step
    return at[:n]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: the anchors' hashes of its runs of windows."""
    for batch in batches:
        for start, n, words in pieces(batch.column(2)):
            text, anchor, *_ = words.runs()
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
            hashes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(anchor, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), hashes], names=["doc", "digest", "anchors"])


CONTEXTS = "doc long, digest long, anchor long, start int, context string, windows int, prints array<binary>"


def _contexts(hot_from: int):
    """Around each recurring anchor, the words its windows cover; of hot anchors also the windows' prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, words in pieces(batch.column(2)):
                text, anchor, begin, windows = words.runs()
                listed, counts = (x.to_numpy() for x in batch.column(3).slice(start, n).flatten().flatten())
                listed, one = np.unique(listed, return_index=True)
                found = np.minimum(np.searchsorted(listed, anchor), len(listed) - 1)
                recurring = np.flatnonzero(listed[found] == anchor)
                doc, digest = (batch.column(k).slice(start, n) for k in range(2))
                data, at, often = words.data.tobytes(), words.at, counts[one][found] >= hot_from
                for k in range(0, len(recurring), 4000):
                    r = recurring[k : k + 4000]
                    context = [data[a:b] for a, b in zip(at[begin[r]].tolist(), (at[begin[r] + windows[r] + WINDOW - 1] - 1).tolist(), strict=True)]
                    prints = [[xxhash.xxh3_128_digest(data[at[w] : at[w + WINDOW] - 1]) for w in range(begin[i], begin[i] + windows[i])] if often[i] else None for i in r] if often[r].any() else [None] * len(r)
                    columns = [doc.take(pa.array(text[r])), digest.take(pa.array(text[r])), pa.array(anchor[r]), pa.array(begin[r] - words.first[text[r]], pa.int32())]
                    columns += [pa.array(context, pa.binary()).cast(pa.string()), pa.array(windows[r], pa.int32()), pa.array(prints, pa.list_(pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "digest", "anchor", "start", "context", "windows", "prints"])

    return run


class _Codes(dict):
    """Word to character."""

    def __missing__(self, word: str) -> str:
        n = len(self) + 1
        self[word] = out = chr(n + (0x800 if n >= 0xD800 else 0))  # surrogates are not characters
        return out


class PhraseAutomaton:
    """Passages as strings with one character a word, after a dictionary of the words they use."""

    def __init__(self) -> None:
        self.codes = _Codes()

    def encode(self, words: list[str]) -> str:
        return "".join(map(self.codes.__getitem__, words))

    def compile(self, passages: set[str]) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in passages:
            automaton.add_word(p)
        automaton.make_automaton()
        return automaton


def covered(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int]]:
    """Places that occurrences of passages cover, merged."""
    out: list[list[int]] = []
    for end, length in automaton.iter(text):
        a, b = end - length + 1, end + 1
        while out and out[-1][1] >= a:
            a = min(a, out.pop()[0])
        out.append([a, b])
    return [(a, b) for a, b in out]


def locate(contexts: list[str], copies: list[int], known: list[list[int]] | None) -> list[list[tuple[int, int]]]:
    """Covered places (in words) of each of several different contexts, which occur so many times:
    windows that recur among the contexts, or are known to recur, become passages; an automaton finds
    every occurrence."""
    coder = PhraseAutomaton()
    coded = [coder.encode(c.split(" ")) for c in contexts]
    if known is None:
        count, copied = Counter(), set()
        for c, n in zip(coded, copies, strict=True):
            (copied if n > 1 else count).update([c[i : i + WINDOW] for i in range(len(c) - WINDOW + 1)])
        copied.update(w for w, n in count.items() if n > 1)
        known = [[i for i in range(len(c) - WINDOW + 1) if n > 1 or c[i : i + WINDOW] in copied] for c, n in zip(coded, copies, strict=True)]
    passages = set()
    for c, recurring in zip(coded, known, strict=True):
        start = None
        for i, following in itertools.zip_longest(recurring, recurring[1:]):
            start = i if start is None else start
            if following != i + 1:
                passages.add(c[start : i + WINDOW])
                start = None
    if not passages:
        return [[] for _ in coded]
    automaton = coder.compile(passages)
    return [covered(automaton, c) for c in coded]


def _shard(table: pa.Table) -> pa.Table:
    """All contexts of one shard, equal ones once; the places of each text come out together."""
    coded = table["context"].dictionary_encode()
    which = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    different, one = np.unique(which, return_index=True)
    known = None if table["known"].null_count else table["known"].take(pa.array(one)).to_pylist()
    found = locate(coded.chunk(0).dictionary.take(pa.array(different)).to_pylist(), np.bincount(which).tolist(), known)
    places = np.array([p for f in found for p in f], np.int64).reshape(-1, 2)
    n = np.array([len(f) for f in found])
    row = np.repeat(np.arange(len(which)), n[which])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n[which]) - n[which], n[which])
    spans = table["start"].to_numpy()[row, None] + places[(np.cumsum(n) - n)[which[row]] + nth]
    null, doc, digest = table["doc"].is_null().to_numpy(), table["doc"].fill_null(0).to_numpy(), table["digest"].to_numpy()
    keys = np.column_stack([null[row], doc[row], digest[row], spans])
    keys = keys[np.lexsort(keys.T[::-1])]
    keys = keys[np.diff(keys, axis=0, prepend=keys[:1] - 1).any(axis=1)]  # equal rows have equal places
    head = np.flatnonzero(np.diff(keys[:, :3], axis=0, prepend=keys[:1, :3] - 1).any(axis=1))
    listed = pa.ListArray.from_arrays(pa.array(np.append(head, len(keys)) * 2, pa.int32()), pa.array(keys[:, 3:].ravel(), pa.int32()))
    return pa.table({"doc": pa.array(keys[head, 1], mask=keys[head, 0] > 0), "digest": keys[head, 2], "spans": listed})


def recurring_places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest, spans) of the texts that hold windows occurring elsewhere too: first and following
    word of each range to remove, one after the other, per text (``digest``: xxhash64). Texts under 35 words, empty and null ones have none."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))
    held = T.stored(rows.mapInArrow(_anchors, "doc long, digest long, anchors array<long>"))
    each = held.select("doc", "digest", F.explode("anchors").alias("anchor"))
    counts = T.stored(each.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    volume = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") < HOT, F.col("n"))).alias("plain"), F.sum(F.when(F.col("n") >= HOT, F.col("n"))).alias("hot")).first()
    limit = max(T.HOT_ROWS, int(volume["all"] or 0) // T.MAX_HOT)
    often = F.broadcast(counts.filter(F.col("n") > limit).select("anchor", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("splits")))  # MAX_HOT rows at most
    met = T.spread_join(each, counts, "anchor", F.struct("doc", "digest"), hot=often).groupBy("doc", "digest").agg(F.collect_set(F.struct("anchor", "n")).alias("recurring"))
    d, g = met["doc"], met["digest"]
    with_text = rows.join(met, rows["doc"].eqNullSafe(d) & (rows["digest"] == g)).select(rows["doc"], rows["digest"], "text", "recurring")
    contexts = T.stored(with_text.mapInArrow(_contexts(HOT), CONTEXTS))
    T.discard(held, counts)
    shards = max(1, -(-int(volume["plain"] or 0) // SHARD_CONTEXTS))
    plain = contexts.filter("prints is null").withColumns({"known": F.lit(None).cast("array<int>"), "shard": F.pmod(F.xxhash64("anchor"), F.lit(shards))})
    names = ["shard", "doc", "digest", "start", "context", "known"]
    placed = plain.select(names)
    if volume["hot"]:
        hot_shards = -(-int(volume["hot"]) // SHARD_CONTEXTS)
        hot = contexts.filter("prints is not null").withColumn("own", F.struct("digest", "start"))  # equal texts have equal windows
        single = T.stored(hot.select("own", "doc", F.posexplode("prints").alias("i", "print")))
        again = single.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
        places = T.spread_join(single, again, "print", F.struct("own", "doc")).groupBy("own").agg(F.sort_array(F.collect_set("i")).alias("known"))
        hot = T.spread_join(hot, places, "own", F.struct("doc", "anchor")).withColumn("shard", F.lit(shards) + F.pmod(F.xxhash64("doc", "digest", "start"), F.lit(hot_shards)))
        placed = placed.unionByName(hot.select(names))
    found = placed.groupBy("shard").applyInArrow(_shard, "doc long, digest long, spans array<int>")
    return found.groupBy("doc", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


KEPT = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])


@F.arrow_udf(KEPT)
def cut_words(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Words outside the spans, joined by one space, with the counts."""
    out = []
    for start, n, words in pieces(text):
        first, listed = words.first, spans.slice(start, n)
        pairs = listed.value_lengths().fill_null(0).to_numpy() // 2
        cuts = listed.flatten().to_numpy().reshape(-1, 2) + np.repeat(first[:-1], pairs)[:, None]
        total = len(words.text)
        depth = np.cumsum(np.bincount(cuts[:, 0], minlength=total + 1) - np.bincount(cuts[:, 1], minlength=total + 1))
        keep = depth[:total] == 0
        of = words.text[kept := np.flatnonzero(keep)]
        stays = np.repeat(keep, np.diff(words.at))
        last = kept[np.flatnonzero(np.diff(of, append=n))]
        stays[words.at[last + 1] - 1] = False  # no space behind a text's last word
        sizes = np.concatenate([[0], np.cumsum(stays)])[words.at[first]]
        kept_text = pa.StringArray.from_buffers(n, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(words.data[stays]))
        n_words = np.diff(first)
        out.append(pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_words - np.bincount(of, minlength=n)), kept_text], names=KEPT.names))
    return pa.concat_arrays(out)


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text; every row counts as a text of its own, so
    repeated rows lose all their windows. Null and empty texts have no words; an empty table stays
    empty. Where ``docs`` has a column of an added name, the added one gets an underscore in front."""
    places = recurring_places(docs, key, text)
    d, g, s, cut = T.unused(docs, "place_doc", "place_digest", "place_spans", "place_cut")
    added = T.unused(docs, "n_words", "n_removed", "kept_text")
    side = places.select(F.col("doc").alias(d), F.col("digest").alias(g), F.col("spans").alias(s))
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    out = docs.join(side, F.col(key).cast("long").eqNullSafe(F.col(d)) & (digest == F.col(g)), "left")
    out = out.withColumn(cut, cut_words(F.col(text), F.col(s)))
    return out.select(*docs.columns, *[F.col(f"{cut}.{n}").alias(name) for n, name in zip(("n_words", "n_removed", "kept_text"), added, strict=True)])


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_passages(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
