"""Operator 10: language-model scoring with an Elias-Fano n-gram trie.

Level one holds the words' hashes and counts. Level two holds, for each word, the words that follow
it; level three, for each such pair, the words that follow the pair. A level is one Elias-Fano
sequence of successors and one of monotone pointers: pointers give a context's range, the value
before the range is the context's offset, and a word is looked up as the successor relative to
that offset within the range. Smoothed probabilities and back-off weights are 16-bit codes of
their logarithms (error under 0.0002 each). Shards are files in the folder all executors share;
workers map them into memory and search them in place.

Counting goes over all training texts, twice: words first, then pairs with what follows them. Tasks
count a run of tokens in bounded memory and send compressed sorted runs a shard; a shard is merged
by one task. Shards are ranges of pairs: a frequent first word is divided by the second word, so
that it fills no task; what one task has of one pair are distinct successors only. The number of
shards follows the input, and scores don't depend on it. Nothing of the model passes through the
driver but shard sizes, frequent words (eight a shard at most) and the numbers of n-grams seen
once and twice, from which a level's discount D comes.

P(w | h) = max(c(h w) - D, 0) / c(h) + D kinds(h) / c(h) P(w | shorter h), for h of two words and of
one; P(w) = (c(w) + 1) / (N + V + 1). It sums to 1 over the vocabulary and one unknown word. The
first token of a text follows the end alone.
"""

from __future__ import annotations

import ctypes
import itertools
import mmap
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import eliasfano as ef
from probity.llm import text as T

#: The end of a text; a word can't hold a blank.
END = xxhash.xxh3_64_intdigest(b" ")
#: Distinct words a task holds before it sends them on, bytes of text taken at once, tokens in a run.
HELD = 3_000_000
PIECE = 4 << 20
RUN = 2_000_000
#: Bytes of shards a worker holds where they can't be mapped.
HELD_BYTES = 256 << 20
U64 = np.uint64
RUNS = "shard int, keys binary, counts binary"
GRAM_RUNS = "shard int, pairs binary, sizes binary, next binary, counts binary"


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts as codes into ``words``, each text followed by the end (the last code)."""

    codes: np.ndarray
    words: list[bytes]
    ends: np.ndarray  # the ends' places

    @property
    def firsts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1] + 1])


def tokenised(texts: pa.Array) -> Tokens:
    """A-Z lower-cased, split at ASCII white space; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)  # white space at a border leaves an empty piece
    sizes = np.bincount(pc.list_parent_indices(lists).filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    coded = flat.filter(real).dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    ends = np.cumsum(sizes + 1) - 1
    codes = np.full(len(coded) + len(texts), len(words), np.int64)
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[inner] = coded.indices.to_numpy(zero_copy_only=False)
    return Tokens(codes, [*words, b" "], ends)


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``PIECE`` bytes of text, one row at least, so that Python holds
    few texts at once; an empty batch stays one."""
    for batch in batches:
        column %= batch.num_columns
        if not len(batch):
            yield batch
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PIECE, side="right")))
            yield batch.slice(start, end - start)
            start = end


def giving_back(run):
    """``run`` for mapInArrow; afterwards the worker, which waits for its next task, returns the memory
    that it no longer uses to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return whole


# --- shared files


def write_file(folder: str, name: str, data: bytes) -> None:
    """Whole or not at all, so that a repeated task does no harm."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
    fs.create_dir(root, recursive=True)
    spare = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(spare) as out:
        out.write(data)
    fs.move(spare, f"{root}/{name}")


def map_file(folder: str, name: str):
    """A read-only memory map; of a store that isn't a mounted file system, the bytes."""
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        with open(f"{where.path}/{name}", "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{name}") as source:
        return source.read()


def delete_file(folder: str, name: str) -> None:
    """Deletes it if it is there (a repeated task may find it gone)."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
    if fs.get_file_info(f"{root}/{name}").type == pyarrow.fs.FileType.File:
        fs.delete_file(f"{root}/{name}")


class Files(dict):
    """Opened files by name; all are let go when those that aren't mapped take too much memory."""

    def __init__(self, folder: str, opened) -> None:
        super().__init__()
        self.folder, self.opened, self.bytes = folder, opened, 0

    def __missing__(self, name: str):
        data = map_file(self.folder, name)
        self.bytes += 0 if isinstance(data, mmap.mmap) else len(data)
        if self.bytes > HELD_BYTES:
            self.clear()
            self.bytes = len(data)
        self[name] = out = self.opened(ef.unpack(data)[0])
        return out


# --- counting


class Counter:
    """Sorted distinct keys with counts; merges sorted runs of similar length."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._push(*merge_sorted(keys, counts))

    def _push(self, k: np.ndarray, c: np.ndarray) -> None:
        while self.runs and len(self.runs[-1][0]) < 2 * len(k):
            k, c = merge([self.runs.pop(), (k, c)])
        self.runs.append((k, c))

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.runs)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out, self.runs = merge(self.runs), []
        return out


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    runs = [r for r in runs if len(r[0])]
    if not runs:
        return np.empty(0, U64), np.empty(0, np.int64)
    if len(runs) == 1:
        return runs[0][0], runs[0][1].astype(np.int64)
    return merge_sorted(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]).astype(np.int64))


def merge_sorted(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[start], np.add.reduceat(c, start)


def squeeze(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Gaps of sorted keys in as few bytes as the largest needs, and compressed counts."""
    return int(keys[0]).to_bytes(8, "little") + (narrow(np.diff(keys)) if len(keys) > 1 else b""), numbers(counts)


def expand(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps = widen(keys[8:]) if len(keys) > 8 else np.empty(0, U64)
    return np.cumsum(np.concatenate([np.frombuffer(keys[:8], "<u8"), gaps]), dtype=U64), counted(counts)


def numbers(counts: np.ndarray) -> bytes:
    """Compressed whole numbers in their least type."""
    kind = np.min_scalar_type(int(counts.max()))
    return np.dtype(kind).str.encode() + b" " + zlib.compress(counts.astype(kind).tobytes(), 1)


def counted(data: bytes) -> np.ndarray:
    kind, _, packed = data.partition(b" ")
    return np.frombuffer(zlib.decompress(packed), np.dtype(kind.decode())).astype(np.int64)


def narrow(values: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return out.view("<u8").ravel()


def split_runs(keys: np.ndarray, counts: np.ndarray, borders: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard that has keys; ``borders``: the first key of every shard but the first."""
    cut = np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])
    rows = [(s, *squeeze(keys[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    for k in range(0, len(rows), 64):
        s, x, c = zip(*rows[k : k + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(x, pa.binary()), pa.array(c, pa.binary())], names=["shard", "keys", "counts"])


def shard_borders(bits: int) -> np.ndarray:
    return np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for piece in pieces(batches, 0):
            t = tokenised(piece.column(0))
            seen.add(word_hashes(t.words), np.bincount(t.codes, minlength=len(t.words)))
            if len(seen) > HELD:
                yield from split_runs(*seen.take(), shard_borders(bits))
        if len(seen):
            yield from split_runs(*seen.take(), shard_borders(bits))

    return run


def _merge_words(folder: str):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merge([expand(k, c) for k, c in zip(frame["keys"], frame["counts"], strict=True)])
        write_file(folder, f"words-{key[0]}", ef.pack(ef.encode(keys, 1 << 64) | {"counts": counts}))
        often = np.flatnonzero(8 * counts >= counts.sum())  # eight at most
        return pd.DataFrame({"shard": [key[0]], "n": [len(keys)], "tokens": [int(counts.sum())], "often": [often.tolist()], "counts": [counts[often].tolist()]})

    return run


# --- lookups


class Words:
    """Level one of all shards, mapped on first use; ids are ranks in hash order."""

    def __init__(self, folder: str, bits: int, bases: list[int]) -> None:
        self.bits, self.bases = bits, bases
        self.files = Files(folder, lambda a: (ef.EliasFano(a), a["counts"]))
        self.known: dict[bytes, int] = {}  # places in the two arrays
        self.ids = self.counts = np.empty(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        ranked = hashes[order]
        cut = np.concatenate([[0], np.searchsorted(ranked, shard_borders(self.bits)), [len(ranked)]])
        for s in np.flatnonzero(cut[1:] > cut[:-1]):
            if self.bases[s + 1] == self.bases[s]:
                continue
            level, held = self.files[f"words-{s}"]
            rows = order[cut[s] : cut[s + 1]]
            at = level.find(hashes[rows])
            hit = at >= 0
            ids[rows[hit]] = at[hit] + self.bases[s]
            counts[rows[hit]] = held[at[hit]]
        return ids, counts

    def encode(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of all tokens."""
        if len(self.known) > 500_000:
            self.known.clear()
            self.ids = self.counts = np.empty(0, np.int64)
        known = self.known
        if fresh := [w for w in t.words if w not in known]:
            ids, counts = self.find(word_hashes(fresh))
            known.update(zip(fresh, range(len(self.ids), len(self.ids) + len(fresh)), strict=True))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter(map(known.__getitem__, t.words), np.int64, len(t.words))[t.codes]
        return self.ids[at], self.counts[at]


def _contexts(ids: np.ndarray, t: Tokens) -> np.ndarray:
    """The id before each token; the first of a text follows the end."""
    out = np.concatenate([[0], ids[:-1]])
    out[t.firsts] = ids[t.ends]
    return out


def pair_borders(bases: list[int], tokens: list[int], often: dict[int, int]) -> np.ndarray:
    """The first pair (first word x V + second) of each shard: one shard a range of words, more for
    a frequent word, about as many as hold the tokens of such ranges.

    A frequent word is divided at second words that halve, third ... the running text as a whole.
    """
    v, total = bases[-1], sum(tokens)
    places, mass = [0], [0]  # tokens of all words before a place
    for s in range(len(tokens)):
        own = sorted(w for w in often if bases[s] <= w < bases[s + 1])
        rest = tokens[s] - sum(often[w] for w in own)
        for w in own:
            before = mass[-1] + rest * (w - max(places[-1], bases[s])) // max(1, bases[s + 1] - bases[s])
            places += [w, w + 1]
            mass += [before, before + often[w]]
        places.append(bases[s + 1])
        mass.append(sum(tokens[: s + 1]))
    borders = {b * v for b in bases[:-1]}
    for w, c in often.items():
        if (k := -(-c * len(tokens) // total)) > 1:
            borders |= {w * v, (w + 1) * v}
            borders |= {w * v + places[int(np.searchsorted(mass, total * j // k))] for j in range(1, k)}
    return np.array(sorted(b for b in borders if b < v * v), U64)


def _count_grams(folder: str, bits: int, bases: list[int], borders: np.ndarray):
    """Runs of pairs and what follows them; V stands for nothing, after the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, v, held = Words(folder, bits, bases), bases[-1], []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, following = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            kinds, at = np.unique(pairs, return_inverse=True)
            grams, counts = np.unique(at.astype(U64) * U64(v + 1) + following, return_counts=True)
            of = (grams // U64(v + 1)).astype(np.int64)
            sizes, following = np.bincount(of, minlength=len(kinds)), grams - of.astype(U64) * U64(v + 1)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            cut = np.concatenate([np.searchsorted(kinds, borders), [len(kinds)]])
            rows = []
            for s in np.flatnonzero(cut[1:] > cut[:-1]):
                a, b = cut[s], cut[s + 1]
                x, y = starts[a], starts[b]
                rows.append((s, *squeeze(kinds[a:b], sizes[a:b]), narrow(following[x:y]), numbers(counts[x:y])))
            for k in range(0, len(rows), 64):
                columns = zip(*rows[k : k + 64], strict=True)
                kinds_ = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_, strict=True)], names=["shard", "pairs", "sizes", "next", "counts"])

        size = 0
        for piece in pieces(batches, 0):
            t = tokenised(piece.column(0))
            ids, _ = words.encode(t)
            following = np.concatenate([ids[1:], [v]])
            following[t.ends] = v
            held.append((_contexts(ids, t).astype(U64) * U64(v) + ids.astype(U64), following.astype(U64)))
            size += len(ids)
            if size > RUN:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _relative(context: np.ndarray, ids: np.ndarray, contexts: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A level's arrays from (context, id), sorted; and the contexts' first places.

    A context's offset is the value before its range, plus one; values are ids plus the offset.
    """
    starts = np.searchsorted(context, np.arange(contexts + 1))
    some = np.flatnonzero(np.diff(starts))
    ends = np.cumsum(ids[starts[some + 1] - 1].astype(U64) + U64(1))
    offsets = np.zeros(contexts, U64)
    offsets[some] = np.concatenate([np.zeros(min(1, len(some)), U64), ends[:-1]])
    values = ids.astype(U64) + offsets[context]
    level = {f"next_{k}": a for k, a in ef.encode(values, int(ends[-1]) if len(some) else 1).items()}
    return level | {f"at_{k}": a for k, a in ef.encode(starts.astype(U64), len(ids) + 1).items()}, starts


def _range_of(shard: int, borders: np.ndarray, v: int) -> tuple[int, int]:
    """The first words of a shard's pairs, from and up to."""
    end = int(borders[shard + 1]) if shard + 1 < len(borders) else v * v
    return int(borders[shard]) // v, -(-end // v)


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _merge_grams(folder: str, borders: np.ndarray, v: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        s = int(key[0])
        runs = [(*expand(p, z), widen(x), counted(c)) for p, z, x, c in zip(frame["pairs"], frame["sizes"], frame["next"], frame["counts"], strict=True)]
        pairs = np.sort(np.concatenate([r[0] for r in runs]), kind="stable")  # sorted runs: a merge
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        grams = np.concatenate([np.repeat(np.searchsorted(pairs, p).astype(U64) * U64(v + 1), z) + x for p, z, x, _ in runs])
        grams, counts = merge_sorted(grams, np.concatenate([r[3] for r in runs]))
        del runs
        of = (grams // U64(v + 1)).astype(np.int64)
        following = grams - of.astype(U64) * U64(v + 1)
        pair_counts = np.bincount(of, counts, len(pairs)).astype(np.int64)
        real = following < U64(v)
        of, following, counts = of[real], following[real], counts[real]
        lo, hi = _range_of(s, borders, v)
        first = (pairs // U64(v)).astype(np.int64)
        two, at_two = _relative(first - lo, pairs - first.astype(U64) * U64(v), hi - lo)
        three, _ = _relative(of, following, len(pairs))
        write_file(folder, f"grams-{s}", ef.pack({f"two_{k}": a for k, a in two.items()} | {f"three_{k}": a for k, a in three.items()}))
        write_file(folder, f"counts-{s}", ef.pack({"two": _small(pair_counts), "three": _small(counts)}))
        kinds = np.diff(at_two)
        out = {"shard": s, "n2": len(pairs), "n3": len(counts), "first_kinds": int(kinds[0]), "last_kinds": int(kinds[-1])}
        return pd.DataFrame([out | {f"n{k}_{c}": int((x == c).sum()) for k, x in ((2, pair_counts), (3, counts)) for c in (1, 2)}])

    return run


SIZES = "shard int, n2 long, n3 long, first_kinds long, last_kinds long, n2_1 long, n2_2 long, n3_1 long, n3_2 long"
#: 16-bit codes of -log10, from 0 to this.
LOWEST = 16.0


def quantised(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-np.log10(p), 0, LOWEST) * (65535 / LOWEST)).astype(np.uint16)


#: The probability of each code.
DECODED = 10 ** (-np.arange(65536) * (LOWEST / 65535))


def _finish(folder: str, bits: int, bases: list[int], borders: np.ndarray, discounts: tuple[float, float]):
    """Probabilities and back-off weights of a shard, from its counts and the discounts of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, v = Files(folder, lambda a: a["counts"]), bases[-1]
        for row in (r for b in batches for r in b.to_pylist()):
            s, (d2, d3) = row["shard"], discounts
            lo, hi = _range_of(s, borders, v)
            w = int(np.searchsorted(bases, lo, side="right")) - 1
            of_words = words[f"words-{w}"][lo - bases[w] : hi - bases[w]]
            shard, counts = (ef.unpack(map_file(folder, f"{n}-{s}"))[0] for n in ("grams", "counts"))
            two, three = (counts[k].astype(np.int64) for k in ("two", "three"))
            at_two, at_three = (ef.EliasFano(shard, f"{x}_at_").get(np.arange(n + 1)).astype(np.int64) for x, n in (("two", hi - lo), ("three", len(two))))
            kinds_two, kinds_three = np.diff(at_two), np.diff(at_three)
            p_two = (two - d2) / np.repeat(of_words, kinds_two)
            p_three = (three - d3) / np.repeat(two, kinds_three)
            kinds_two = kinds_two.copy()
            kinds_two[0], kinds_two[-1] = row["first_kinds"], row["last_kinds"]
            back_two = np.where(kinds_two > 0, d2 * kinds_two / of_words, 1.0)
            back_three = np.where(kinds_three > 0, d3 * kinds_three / two, 1.0)
            write_file(folder, f"probs-{s}", ef.pack({"two": quantised(p_two), "three": quantised(p_three), "back_two": quantised(back_two), "back_three": quantised(back_three)}))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    return run


class Trie:
    """All levels, mapped in place; ``model`` as ``train`` returns it."""

    def __init__(self, model: dict) -> None:
        self.words = Words(model["folder"], model["bits"], model["bases"])
        self.tokens, self.size = model["tokens"], model["bases"][-1]
        self.borders, self.shards = np.array(model["borders"], U64), model["shards"]
        level = lambda a, x: (ef.EliasFano(a, f"{x}_next_"), ef.EliasFano(a, f"{x}_at_"))
        self.grams = Files(model["folder"], lambda a: (level(a, "two"), level(a, "three")))
        self.probs = Files(model["folder"], lambda a: a)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.tokens + self.size + 1)

    @staticmethod
    def search(level: tuple, contexts: np.ndarray, of: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places in a level (-1: none) of the successors ``ids``, each of context number ``of``.

        Pointers give the contexts' ranges, the value before a range its offset. Most contexts have
        one successor, which stands beside that value; others are searched for within the range.
        """
        following, at = level
        first, end = (x.astype(np.int64) for x in at.get_two(contexts))
        offset, least = np.zeros(len(contexts), U64), np.full(len(contexts), following.get(np.array([0]))[0] if following.n else 0, U64)
        some = end > first
        inner = np.flatnonzero(some & (first > 0))
        if len(inner):
            before, least[inner] = following.get_two(first[inner] - 1)
            offset[inner] = before + U64(1)
        out = np.where(some[of] & (ids + offset[of] == least[of]), first[of], -1)
        rest = np.flatnonzero((out < 0) & (end - first > 1)[of])
        if len(rest):
            out[rest] = following.find(ids[rest] + offset[of[rest]], first[of[rest]], end[of[rest]])
        return out

    def probabilities(self, context: np.ndarray, ids: np.ndarray, base: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(id | what comes before it): ``context`` holds the word before, and the pair of one token
        is the context of the next, but across the places in ``first``. Unknown ids are -1."""
        if not self.size:
            return base
        v = U64(self.size)
        known, seen = context >= 0, ids >= 0
        # each distinct pair once; an unknown second word asks for the first one's weight alone
        asked = np.where(known, context, 0).astype(U64) * (v + U64(1)) + np.where(seen, ids, self.size).astype(U64)
        pairs, at = np.unique(asked, return_inverse=True)
        one, two = pairs // (v + U64(1)), pairs % (v + U64(1))
        has = two < v
        keys = one * v + np.where(has, two, U64(0))
        p2, b1, b2 = np.zeros(len(pairs)), np.ones(len(pairs)), np.ones(len(pairs))
        # the pair before a token, and the word that follows it there
        follows = np.ones(len(ids), bool)
        follows[first] = False
        follows[1:] &= known[:-1] & seen[:-1]
        rows = np.flatnonzero(follows & seen)
        grams, gram_at = np.unique(at[rows - 1].astype(U64) * v + ids[rows].astype(U64), return_inverse=True)
        gram_pair = (grams // v).astype(np.int64)
        gram_next, p3 = grams - gram_pair.astype(U64) * v, np.zeros(len(grams))
        shard = np.searchsorted(self.borders, keys, side="right") - 1
        order = np.arange(len(pairs)) if (shard[1:] >= shard[:-1]).all() else np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(len(self.borders) + 1))
        place = np.full(len(pairs), -1, np.int64)
        gram_shard = shard[gram_pair]
        gram_order = np.argsort(gram_shard, kind="stable")
        gram_cut = np.searchsorted(gram_shard[gram_order], np.arange(len(self.borders) + 1))
        for s in map(int, np.flatnonzero(cut[1:] > cut[:-1])):
            (level_two, level_three), codes = self.grams[f"grams-{self.shards[s]}"], self.probs[f"probs-{self.shards[s]}"]
            mine = order[cut[s] : cut[s + 1]]
            words, of = np.unique(one[mine], return_inverse=True)
            local = words.astype(np.int64) - int(self.borders[s]) // self.size
            b1[mine] = DECODED[codes["back_two"][local]][of]
            found = np.where(has[mine], self.search(level_two, local, of, two[mine]), -1)
            hit = found >= 0
            p2[mine[hit]] = DECODED[codes["two"][found[hit]]]
            b2[mine[hit]] = DECODED[codes["back_three"][found[hit]]]
            place[mine] = found
            grams_here = gram_order[gram_cut[s] : gram_cut[s + 1]]
            grams_here = grams_here[place[gram_pair[grams_here]] >= 0]
            if not len(grams_here):
                continue
            used, of = np.unique(place[gram_pair[grams_here]], return_inverse=True)
            found = self.search(level_three, used, of, gram_next[grams_here])
            hit = found >= 0
            p3[grams_here[hit]] = DECODED[codes["three"][found[hit]]]
        p = np.where(known, p2[at] + b1[at] * base, base)
        before = np.concatenate([[0], at[:-1]])
        alpha = np.zeros(len(ids))
        alpha[rows] = p3[gram_at]
        return np.where(follows, alpha + b2[before] * p, p)


def _score(model: dict, kind: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for piece in pieces(batches, len(kind) - 4):
            t = tokenised(piece.column(len(kind) - 4))
            ids, counts = trie.words.encode(t)
            base, first = trie.unigram(counts), t.firsts
            p = trie.probabilities(_contexts(ids, t), ids, base, first)
            per = [t.ends + 1 - first, np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(np.log10(base), first), np.add.reduceat(np.log10(p), first)]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *map(pa.array, per)], schema=kind)

    return run


def train(docs: DataFrame, text: str = "text") -> dict:
    """Builds the trie from all rows of ``docs`` and returns what ``score`` needs to find it.

    Null and empty texts count as an end alone. No rows give an empty model. The files stay until
    ``remove`` deletes them.
    """
    spark = docs.sparkSession
    folder = f"{T.checkpoint_dir(spark)}/probity-trie-{uuid.uuid4().hex}"
    texts = docs.select(F.col(text).alias("text"))
    bits = min(16, max(4, (2 * texts.rdd.getNumPartitions() - 1).bit_length()))
    sizes = texts.mapInArrow(_count_words(bits), RUNS).groupBy("shard").applyInPandas(_merge_words(folder), "shard int, n long, tokens long, often array<long>, counts array<long>").collect()
    n, tokens = ({r["shard"]: r[k] for r in sizes} for k in ("n", "tokens"))
    bases = [0, *itertools.accumulate(n.get(s, 0) for s in range(1 << bits))]
    often = {bases[r["shard"]] + w: c for r in sizes for w, c in zip(r["often"], r["counts"], strict=True)}
    model = {"folder": folder, "bits": bits, "bases": bases, "tokens": sum(tokens.values()), "borders": [0], "shards": [], "discounts": (0.5, 0.5)}
    if not bases[-1]:
        return model
    borders = pair_borders(bases, [tokens.get(s, 0) for s in range(1 << bits)], often)
    grams = texts.mapInArrow(_count_grams(folder, bits, bases, borders), GRAM_RUNS).groupBy("shard").applyInPandas(_merge_grams(folder, borders, bases[-1]), SIZES).collect()
    discounts = tuple(_discount(sum(r[f"n{k}_1"] for r in grams), sum(r[f"n{k}_2"] for r in grams)) for k in (2, 3))
    rows = _shared_contexts(sorted(grams), borders, bases[-1])
    todo = spark.createDataFrame(rows, "shard int, first_kinds long, last_kinds long").repartition(max(1, min(len(rows), texts.rdd.getNumPartitions())), "shard")
    todo.mapInArrow(_finish(folder, bits, bases, borders, discounts), "shard int").count()
    for r in grams:
        delete_file(folder, f"counts-{r['shard']}")
    return model | {"discounts": discounts} | dict(zip(("borders", "shards"), _filled_ranges(sorted(r["shard"] for r in grams), borders.tolist(), bases[-1]), strict=True))


def _filled_ranges(filled: list[int], borders: list[int], v: int) -> tuple[list[int], list[int]]:
    """First pair and number of the filled shards. A part of a divided word that holds no pair goes
    to a neighbour that has the same first word, where that word's back-off weight is."""
    firsts = []
    for k, s in enumerate(filled):
        fresh = k == 0 or borders[s] // v != borders[filled[k - 1]] // v
        firsts.append(borders[s] // v * v if fresh else borders[s])
    return firsts, filled


def _shared_contexts(grams: list, borders: np.ndarray, v: int) -> list[tuple]:
    """(shard, kinds of the first context, kinds of the last): of a word that several shards divide,
    those of all of them."""
    kinds: dict[int, int] = {}
    ranges = {r["shard"]: _range_of(r["shard"], borders, v) for r in grams}
    for r in grams:
        lo, hi = ranges[r["shard"]]
        kinds[lo] = kinds.get(lo, 0) + r["first_kinds"]
        if hi - 1 > lo:
            kinds[hi - 1] = kinds.get(hi - 1, 0) + r["last_kinds"]
    return [(r["shard"], kinds[ranges[r["shard"]][0]], kinds[ranges[r["shard"]][1] - 1]) for r in grams]


def _discount(n1: int, n2: int) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def remove(spark: SparkSession, model: dict) -> None:
    """Deletes a model's files."""
    T.remove_folder(spark, model["folder"])


def score(docs: DataFrame, model: dict, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and n_tokens, n_known, base_score, score for every row; empty texts score their end.

    Where a carried column has one of these names, the added one gets an underscore in front. An
    empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.select(*carry)
    scored, *names = T.unused(kept, "scored_text", "n_tokens", "n_known", "base_score", "score")
    rows = docs.select(*carry, F.col(text).alias(scored))
    kinds = ["long", "long", "double", "double"]
    kind = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1]) + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    full = pa.schema([*to_arrow_schema(rows.schema)][:-1] + [pa.field(n, {"long": pa.int64(), "double": pa.float64()}[k]) for n, k in zip(names, kinds, strict=True)])
    return rows.mapInArrow(_score(model, full), kind)


def held_out(key: Column) -> Column:
    return F.pmod(T.crc32_text(F.coalesce(key.cast("string"), F.lit(""))), F.lit(7)) == 2


def op10_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
