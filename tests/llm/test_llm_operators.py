"""Training-data operators against brute force, round trips and held-out accuracy, on small inputs
with nulls, empty texts, ties, repeated rows and clashing column names."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probity.llm import blocks, decontaminate, eliasfano, lines, mixing, neardup, ngrams, phrases, quality, sharding, toxicity

DOCS = "doc_id long, text string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


def corpus(seed=3):
    """Texts of few words, so that shingles, windows and lines meet; with the awkward cases."""
    r = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "delta", "épsilon", "zeta", "eta", "theta", "Iota", "kappa", "l m", "mu", "nu", "xi", "omicron"]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = make(50)
    texts = [make(r.randint(1, 160)) for _ in range(24)]
    texts += [f"{make(20)} {passage}\n{make(9)}", f"{passage} {make(30)}", passage, passage[:-5], f"{make(3)}\n{passage.upper()}"]
    base = texts[3].split()
    for k in range(4):
        near = base.copy()
        if near:
            near[k % len(near)] = "changed"
        texts.append(" ".join(near))
    texts += [None, "", " \n\t ", "one", "one", "A shared line here\nother", "x\n a SHARED line here \ny", make(3000), "\n".join(["same line twice"] * 3)]
    rows = [(k, t, f"s{k % 3}" if k % 7 else None) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, texts[1], "s1"), (None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_sharding_law(spark, rows, docs):
    got = sharding.rendezvous_shard(docs, "doc_id", [1.0] * 5, grown="more").collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.shard < 5
        assert r.more in (r.shard, 5)
    assert len({r.shard for r in got if r.doc_id == 0}) == 1
    placed = sharding.rendezvous_shard(docs.select("doc_id"), "doc_id", [1.0] * 5)
    slots = sharding.number_slots(placed, "shard", 5, sharding.key_hash(F.col("doc_id")), [F.col("doc_id")]).collect()
    for s in range(5):
        own = sorted(r.slot for r in slots if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.rendezvous_shard(docs.limit(0), "doc_id", [1.0]).count() == 0


def test_sharding_weights(spark):
    n = spark.range(20_000).withColumnRenamed("id", "scores")  # a helper's name
    got = {r.shard: r["count"] for r in sharding.rendezvous_shard(n, "scores", [1.0, 3.0]).groupBy("shard").count().collect()}
    assert got[1] / 20_000 == pytest.approx(0.75, abs=0.02)


def test_pfair_windows():
    shares = mixing.exact_weights({"a": 0.6, "b": 0.3, "c": 0.1})
    slots, period = mixing.edf_slots(shares, {"a": 600, "b": 900, "c": 900}), sum(shares.values())
    n = sum(map(len, slots.values()))
    assert sorted(t for s in slots.values() for t in s) == list(range(n))
    for s, own in slots.items():
        for t in range(n + 1):
            assert abs(sum(x < t for x in own) - t * shares[s] / period) < 1


def test_mix_stays_within_a_block_of_irrational_weights(spark):
    """On the operator's output, over more than 100,000 slots."""
    weights = {"a": math.sqrt(2), "b": math.pi, "c": math.e}
    rows = spark.range(240_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    got = mixing.mix_sources(rows, [F.col("doc_id")], F.xxhash64("doc_id"), weights=weights).filter("mix_phase = 0").select("source", "mix_slot").toPandas()
    n = len(got)
    assert n > 100_000
    assert np.array_equal(np.sort(got["mix_slot"]), np.arange(n))
    for s, own in got.groupby("source")["mix_slot"]:
        done = np.cumsum(np.bincount(own, minlength=n))
        assert np.abs(done - np.arange(1, n + 1) * weights[s] / sum(weights.values())).max() < 1


def test_mixing_keeps_all(rows, docs, monkeypatch):
    cost = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    want = sorted(map(str, ((r[0], r[1]) for r in rows)))
    for bounds in ({}, {"CHUNK_ROWS": 3}, {"MAX_BLOCKS": 4, "CHUNK_ROWS": 1, "MAX_CHUNKS": 7}):
        for name, value in bounds.items():
            monkeypatch.setattr(mixing, name, value)
        got = mixing.mix_sources(docs, [F.col("doc_id")], F.xxhash64("doc_id"), cost=cost, block_cost=200).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == want
        by = {}
        for r in got:
            by.setdefault((r.source, r.mix_block), set()).add(r.mix_slot)
        assert all(len(s) == 1 for s in by.values())
        assert len({x for s in by.values() for x in s}) == len(by)  # a block in which no document starts has a slot too
        assert len(by) <= bounds.get("MAX_BLOCKS", 10**6) + 4
    assert mixing.mixed_order(docs).columns == docs.columns
    clash = docs.withColumnsRenamed({"text": "mix_plan"}).withColumn("mix_slot", F.lit(1)).withColumn("mix_cost", F.lit(2))
    out = mixing.mix_sources(clash, [F.col("doc_id")], F.xxhash64("doc_id"))
    assert out.columns == [*clash.columns, "mix_block", "mix_phase", "_mix_slot", "mix_weight", "mix_rank"]
    assert out.count() == len(rows)
    assert mixing.mix_sources(docs.limit(0), [F.col("doc_id")], F.xxhash64("doc_id")).count() == 0


def brute_quality(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    solid = [x for x in t.split("\n") if x.encode().strip()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(solid) - len(set(solid)), len(hit)


def test_quality_counts(spark, rows):
    more = [(500, "a b c d e f g h " * 4, None), (501, "x## | y** | z\n" * 9, None), (502, "It was fine, they said. All of it was good.\n" + "Home | About | Login | Help\n" + "We then went on to the next town by the river. Nobody there had heard of it, so we asked again and waited.", None)]
    got = quality.clean_lines(spark.createDataFrame(rows + more, DOCS)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text), r.text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert [x.rule for x in by[502].failed_lines] == ["navigation"]
    assert by[502].kept
    assert not by[501].kept


def test_line_dedup(rows, docs):
    got = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs)).collect()
    own = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda d: math.inf if d is None else d
    for d, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                own.setdefault(key(x), set()).add(order(d))
    for r in got:
        keep = [x for x in (r.text or "").split("\n") if len(key(x)) < 10 or min(own[key(x)]) == order(r.doc_id)]
        assert (r.kept_text or "") == "\n".join(keep)
        assert r.n_dropped == len((r.text or "").split("\n")) - len(keep)


def test_line_runs_over_partitions(spark):
    many = spark.createDataFrame([(k, "one very common line", "s") for k in range(300)], DOCS)
    lost = lines.lost_lines(many)
    assert sorted(r.doc for r in lost.collect()) == list(range(1, 300))


def brute_hits(rows, items):
    pat = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    norm = lambda t: pat.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = norm(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for _, t, _ in rows:
        w, hit, found = norm(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("most", [decontaminate.MAX_LOCAL_WINDOWS, 1])
def test_decontamination(spark, rows, docs, most):
    long = next(t for _, t, _ in rows if t and len(t.split()) > 100)
    items = [(1, " ".join(long.split()[5:30])), (2, "ALPHA beta gamma"), (11, "ÉPSILON zeta"), (3, None), (4, "..."), (5, "one"), (6, "kappa  mu-nu xi")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_hits(docs, decontaminate.benchmark_windows(bench), max_local=most)
    assert Counter((r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == Counter((n, h, tuple(i)) for n, h, i in brute_hits(rows, items))
    if most > 1:
        kept = decontaminate.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns
        assert kept.count() == sum(not h for _, h, _ in brute_hits(rows, items))
        left = decontaminate.find_hits(decontaminate.remove_hit_spans(got).select(*docs.columns), decontaminate.benchmark_windows(bench))
        assert left.agg(F.sum("n_words")).first()[0] == sum(n - h for n, h, _ in brute_hits(rows, items))
        assert decontaminate.find_hits(docs, decontaminate.benchmark_windows(bench.limit(0))).filter("contaminated").isEmpty()


def brute_classes(rows, percent):
    keys = [r for r in rows if r[0] is not None]
    sets = []
    for _, t, _ in keys:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(keys)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(keys):
        least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least[root(i)]) for i, (d, _, _) in enumerate(keys))


def test_near_duplicates(spark, rows):
    some = [r for r in rows if r[0] is not None]
    got = neardup.near_duplicate_classes(spark.createDataFrame(some, DOCS), percent=80).collect()
    assert Counter((r.doc, r.n_shingles, r.component_id) for r in got) == brute_classes(some, 80)
    assert all(r.kept == (r.doc == r.component_id) for r in got)


def test_near_duplicate_chain(spark):
    """A group whose links form a path: later pivots and the label rounds have to find it."""
    r = random.Random(1)
    w = [f"w{r.randrange(10**6)}" for _ in range(120)]
    chain = []
    for k in range(30):
        w = w.copy()
        w[(4 * k) % 120] = f"n{k}"
        chain.append((k, " ".join(w), "s"))
    got = neardup.near_duplicate_classes(spark.createDataFrame(chain, DOCS), percent=85).collect()
    assert Counter((x.doc, x.n_shingles, x.component_id) for x in got) == brute_classes(chain, 85)
    kept = neardup.drop_near_duplicates(spark.createDataFrame([*chain, chain[0], (99, None, None)], DOCS), percent=85)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, _, c in brute_classes(chain, 85)} | {99})


def shingled_pair(r, n, j):
    """Two sets of about n members with similarity j."""
    common = round(n * 2 * j / (1 + j))
    pool = np.unique(r.integers(0, 1 << 63, 3 * n, dtype=np.uint64))
    r.shuffle(pool)
    return pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])


@pytest.mark.parametrize("percent", [80, 85])
def test_odd_sketches_decide(percent):
    """Pairs at the threshold pass, pairs well below it are dropped by their sketches."""
    r, seeds = np.random.default_rng(2), neardup._seeds(neardup.SAMPLES)
    passed = {}
    for j in (percent / 100, percent / 100 - 0.2, percent / 100 - 0.3):
        differences = []
        for k in range(150):
            a, b = (neardup.odd_sketch(neardup.min_hashes(s, *seeds)).view(np.uint64) for s in shingled_pair(r, (80, 400, 2500)[k % 3], j))
            differences.append(int(np.bitwise_count(a ^ b).sum()))
        passed[j] = np.mean([d <= neardup.sketch_limit(percent) for d in differences])
        assert np.mean([neardup.estimated_similarity(d) for d in differences]) == pytest.approx(j, abs=0.02)
    at, below, far = passed.values()
    assert (at, far) == (1.0, 0.0)
    assert below <= 0.05


@pytest.mark.parametrize("percent", [80, 85])
def test_bands_recall(percent):
    bands, rows = neardup.band_shape(percent)
    assert bands * rows <= neardup.SAMPLES
    r, seeds, met = np.random.default_rng(4), neardup._seeds(neardup.SAMPLES), 0
    for k in range(300):
        a, b = (neardup.min_hashes(s, *seeds)[: bands * rows].reshape(rows, bands) for s in shingled_pair(r, (80, 400, 2500)[k % 3], percent / 100))
        met += (a == b).all(axis=0).any()
    assert met >= 299


@pytest.mark.parametrize("in_task", [0, neardup.TASK_LINKS])
def test_spread_labels(spark, in_task):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(500, 540)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    ids = spark.createDataFrame([(a.to_bytes(3), b.to_bytes(3)) for a, b in edges], "a binary, b binary")
    got = {(int.from_bytes(x.node), int.from_bytes(x.label)) for x in neardup.spread_labels(ids, in_task).collect()}
    assert got == {(x, find(x)) for x in label if find(x) != x}


@pytest.mark.parametrize("hot", [phrases.HOT, 3])
def test_passages(rows, docs, monkeypatch, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    got = phrases.remove_passages(docs).collect()
    seen = Counter(tuple(w[i : i + 35]) for _, t, _ in rows for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for _, t, _ in rows:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        want.append((len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()))
    assert Counter((r.n_words, r.n_removed, r.kept_text) for r in got) == Counter(want)


def test_anchors_cost():
    """Words that hardly repeat: anchors cost little more than to split the texts."""
    r = np.random.default_rng(5)
    texts = [" ".join(map(str, r.integers(0, 1 << 40, 4000).tolist())) for _ in range(200)]
    n = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, pa.array(texts)], names=["doc", "digest", "text"])

    def seconds(f) -> float:
        began = time.process_time()
        f()
        return time.process_time() - began

    split = min(seconds(lambda: [t.encode().split() for t in batch.column(2).to_pylist()]) for _ in range(3))
    assert min(seconds(lambda: list(phrases._anchors(iter([batch])))) for _ in range(3)) < 6 * split


def test_shard_takes_equal_contexts_once(monkeypatch):
    looked, covered = [], phrases.covered
    monkeypatch.setattr(phrases, "covered", lambda automaton, text: looked.append(text) or covered(automaton, text))
    copy, other, alone = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    context = [copy] * 3 + [f"{other} x", f"y {other}", alone, copy]
    doc, start = [1, 2, 2, 3, None, 5, 1], [0, 0, 40, 7, 0, 0, 0]  # the last row repeats the first
    table = pa.table({"doc": pa.array(doc, pa.int64()), "digest": pa.array([d or 0 for d in doc], pa.int64()), "start": pa.array(start, pa.int32()), "context": context, "known": pa.nulls(7, pa.list_(pa.int32()))})
    got = {r["doc"]: r["spans"] for r in phrases._shard(table).to_pylist()}
    assert got == {1: [0, 40], 2: [0, 40, 40, 80], 3: [7, 47], None: [1, 41]}
    assert len(looked) == 4


def test_words_in_arrays(monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 300)
    r = random.Random(6)
    vocabulary = ["a", "a\0", "\0", "é", "\u2003", "\x1c", "x" * 8, "x" * 9, "ž" * 32, "y" * 64, "y" * 65, "y" * 200 + "z"]
    texts = ["".join(r.choice(vocabulary) + r.choice([" ", "\t\n", "\v ", "\f", "\r\n"]) for _ in range(r.choice([0, 1, 34, 35, 36, 90]))) for _ in range(60)]
    texts += ["", None, " \n", "a", " a", None, "x " * 700, *texts[:3]]
    hashes, at = {}, 0
    for start, n, w in phrases.pieces(pa.array(texts)):
        assert start == at
        at += n
        data, h, runs = w.data.tobytes(), w.hashes().tolist(), {}
        for text, anchor, begin, windows in zip(*(x.tolist() for x in w.runs()), strict=True):
            runs.setdefault(text, []).append((begin - int(w.first[text]), windows))
        for i, text in enumerate(texts[start : start + n]):
            want = (text or "").encode().split()
            places = range(w.first[i], w.first[i + 1])
            assert [data[w.at[k] : w.at[k + 1] - 1] for k in places] == want
            for word, k in zip(want, places, strict=True):
                assert hashes.setdefault(word, h[k]) == h[k]
            assert [k for a, m in runs.get(i, []) for k in range(a, a + m)] == list(range(len(want) - 34))
    assert at == len(texts) and len(set(hashes.values())) == len(hashes) == len(vocabulary) + 1


def test_elias_fano_round_trip():
    r = np.random.default_rng(3)
    for n, top in ((0, 10), (1, 1), (500, 1 << 62), (500, 700), (400, 401)):
        v = np.unique(r.integers(0, top, n, dtype=np.uint64))
        arrays, head = eliasfano.unpack(eliasfano.pack(eliasfano.encode(v, top), a=1))
        e = eliasfano.EliasFano(arrays)
        asked = np.concatenate([v, r.integers(0, top, 300, dtype=np.uint64), np.array([top, 1 << 63], np.uint64)])
        place = {int(x): i for i, x in enumerate(v)}
        assert e.find(asked).tolist() == [place.get(int(x), -1) for x in asked]
        if len(v):
            assert (e.get(np.arange(len(v))) == v).all()
            here, after = e.get_two(np.arange(len(v) - 1))
            assert (here == v[:-1]).all()
            assert (after == v[1:]).all()
            first, end = r.integers(0, len(v), 300), r.integers(0, len(v) + 1, 300)
            asked = v[r.integers(0, len(v), 300)]
            assert e.find(asked, first, end).tolist() == [place[int(x)] if a <= place[int(x)] < b else -1 for x, a, b in zip(asked, first, end, strict=True)]
        assert head == {"a": 1}
    pointers = np.sort(r.integers(0, 50, 300)).astype(np.uint64)  # with repeats, as pointers have them
    assert (eliasfano.EliasFano(eliasfano.encode(pointers, 51)).get(np.arange(300)) == pointers).all()


def test_runs_round_trip():
    r = np.random.default_rng(4)
    k = np.unique(r.integers(0, 1 << 60, 1000, dtype=np.uint64))
    c = r.integers(1, 70_000, len(k))
    for a, b in ((k, c), (k[:1], c[:1])):
        x, y = ngrams.expand(*ngrams.squeeze(a, b))
        assert (x == a).all()
        assert (y == b).all()


def test_language_model(spark, rows, docs):
    model = ngrams.train(docs)
    got = ngrams.score(docs, model, ["doc_id", "text"]).collect()
    tokens = [[*(t or "").encode().lower().split(), b" "] for _, t, _ in rows]
    c = Counter(w for t in tokens for w in t)
    n, v = sum(c.values()), len(c)
    assert model["tokens"] == n
    for r in got:
        t = [*(r.text or "").encode().lower().split(), b" "]
        assert r.n_tokens == r.n_known == len(t)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    # the conditional distribution of a context sums to one, the unknown word included
    trie = ngrams.Trie(model)
    ids, counts = trie.words.find(np.array([ngrams.xxhash.xxh3_64_intdigest(w) for w in c], np.uint64))
    ids, base = np.append(ids, -1), trie.unigram(np.append(counts, 0))
    context = np.full(len(ids), ids[list(c).index(b"beta")])
    assert trie.probabilities(context, ids, base, np.arange(len(ids))).sum() == pytest.approx(1.0, abs=2e-3)
    stranger = ngrams.score(docs.limit(1).withColumn("text", F.lit("never seen")), model, []).first()
    assert (stranger.n_tokens, stranger.n_known) == (3, 1)
    clash = docs.withColumnsRenamed({"source": "score"})
    assert ngrams.score(clash, model, ["doc_id", "score"]).columns == ["doc_id", "score", "n_tokens", "n_known", "base_score", "_score"]
    empty = ngrams.train(docs.limit(0))
    assert {r.score for r in ngrams.score(docs, empty, []).collect()} == {0.0}
    assert ngrams.score(docs.limit(0), empty, []).count() == 0
    ngrams.remove(spark, model)


def test_toxicity_learns_pairs():
    """Neither term alone is toxic, both together are: linear weights can't tell."""
    r = np.random.default_rng(5)
    at, y = [], []
    for _ in range(600):
        a, b = r.random(2) < 0.5
        at.append(np.array([k for k, on in enumerate((a, b)) if on] + [2 + int(r.integers(5))]))
        y.append(a and b)
    model = toxicity.fit(at, np.array(y), np.arange(7), steps=400)
    assert model.score(np.array([0, 1, 3])) > 0.5
    assert max(model.score(np.array([0, 3])), model.score(np.array([1, 3])), model.score(np.array([3]))) < 0.5


def test_toxicity_held_out(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["ta", "ri", "mo", "len", "su"]) for _ in range(3))
    data = []
    for k in range(400):
        bad = k % 5 == 1
        w = [word() for _ in range(r.randint(5, 60))] + ([f"gruk{word()}", f"Gruk{word()}"] if bad else [])
        r.shuffle(w)
        data.append((k, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in data] + [(None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_on_labels(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()}
    out = [(k, x) for k, _, x in data if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((got[k] >= 0.5) == bool(x) for k, x in out)
    assert got[900] < 0.5
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    none = toxicity.fit_on_labels(docs, labels.limit(0), F.lit(True))
    assert none.score(np.empty(0, int)) == pytest.approx(0)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>
<div class="ad">Buy this.</div><article><h1>A &amp; B</h1><p><b>First   part of it,<br>going on.</b></p><p>Second part is here, and ends.</p></article>
<footer>&copy; Someone</footer></body></html>"""


def test_html_blocks(spark):
    assert [b.text for b in blocks.leaf_blocks(PAGE)] == ["Home", "More", "Buy this.", "A & B", "First part of it, going on.", "Second part is here, and ends.", "© Someone"]
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p"), (5, PAGE)], "page_id long, html string")
    got = {r.page_id: r.text for r in blocks.extract_text(pages, ["page_id"]).collect()}
    want = "A & B First part of it, going on. Second part is here, and ends."
    assert got == {1: want, 2: "", 3: "", 4: "", 5: want}
    labelled = blocks.label_blocks(pages, ["page_id"]).filter("page_id = 1").first().blocks
    assert len(labelled) == 7
    clash = pages.withColumn("text", F.lit("x")).withColumn("page_html", F.lit("y"))
    assert blocks.extract_text(clash, ["page_id", "text", "page_html"]).columns == ["page_id", "text", "page_html", "_text"]
    assert blocks.extract_text(pages.limit(0), ["page_id"]).count() == 0


@pytest.mark.parametrize("naming", ["telling", "neutral", "swapped", "absent"])
def test_block_labels_on_unseen_layouts(naming):
    """Pages that training didn't have; names of classes withheld or wrong on three quarters of them."""
    r, model = np.random.default_rng(991), blocks.trained()
    pages = [blocks.labelled_layout(r, naming) for _ in range(150)]
    got = np.concatenate(blocks.label_pages(model, [b for b, _ in pages])) >= 0.5
    y = np.concatenate([y for _, y in pages]) > 0
    f1 = 2 * (got & y).sum() / (got.sum() + y.sum())
    assert f1 >= {"telling": 0.97, "neutral": 0.93, "swapped": 0.9, "absent": 0.88}[naming], f1


ARTICLE = ["The river had risen in the night, and the people of the town were on the bridge before it was light.", "Nobody had slept. They said that the old mill was gone, that it had been carried away with all that was in it.", "By noon the water was falling again, and those who had come from the hills went back to their homes."]


@pytest.mark.parametrize("names", [("css-1x", "css-7b", "css-22c"), ("menu", "article", "content"), ("article", "menu", "content"), ("content", "content", "content")])
def test_names_do_not_decide(names):
    menu, body, notice = names
    links = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Contact", "Products"))
    page = f"<body><div class='{menu}'><ul>{links}</ul></div><div class='{notice}'>We use cookies. Accept our privacy policy.</div><div class='{body}'><h1>A flood in the valley</h1>{''.join(f'<p>{x}</p>' for x in ARTICLE)}</div></body>"
    model, cut = blocks.trained(), blocks.leaf_blocks(page)
    kept = [b.text for b, p in zip(cut, blocks.label_pages(model, [cut])[0], strict=True) if p >= 0.5]
    assert kept == ["A flood in the valley", *ARTICLE]


@pytest.mark.parametrize("piece", ["<a '", "<div>x", "<a b=\"c>", "<svg>", "</svg ", "<p><b><table>", "<option>", "<!x", "< <", "<li>y", "<a b='x>' "])
def test_cutting_takes_linear_time(piece):
    import time

    def seconds(n):
        began = time.perf_counter()
        blocks.leaf_blocks(piece * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.02)


def test_long_page_in_bounded_memory():
    import tracemalloc

    page = "<body><div class=x>" + "<p>It was a long day and the road was dry.</p>" * 100_000
    tracemalloc.start()
    cut = blocks.leaf_blocks(page)
    scores = blocks.label_pages(blocks.trained(), [cut])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores[0]) == 100_000
    assert peak < 400 << 20


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    full = [(d, t, "en", s, len(t or "")) for d, t, s in rows if d is not None]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing like the rest of it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted({c for _, _, c in brute_classes([r for r in rows if r[0] is not None], 80)})
    assert sorted(r.doc_id for r in got) == want
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
