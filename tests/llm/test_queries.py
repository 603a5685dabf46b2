"""The registered opN_ queries and the pipeline themselves, on small tables: against brute force, against
their SQL in DuckDB, on empty tables, and with columns whose names clash."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from probity.llm import blocks, decontaminate, lines, mixing, neardup, ngrams, phrases, quality, registry, sharding, toxicity
from tests.llm.test_llm_operators import PAGE, brute_classes, corpus

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {"documents": DOCUMENTS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string"}
QUERIES = registry.queries()


def crc(x):
    return zlib.crc32(str(x).encode())


def toxic_texts():
    """(doc_id, text, toxic): whether a text holds words of an insulting stem."""
    r = random.Random(6)
    word = lambda: "".join(r.choice(["ta", "ri", "mo", "len", "su"]) for _ in range(3))
    out = []
    for k in range(300):
        w = [word() for _ in range(r.randint(30, 60))] + ([f"gruk{word()}", f"Gruk{word()}"] if k % 5 == 1 else [])
        r.shuffle(w)
        out.append((1000 + k, " ".join(w), int(k % 5 == 1)))
    return out


@pytest.fixture(scope="module")
def tables():
    seen, documents = set(), []
    for d, t, s in corpus():
        if d is not None and d not in seen:
            seen.add(d)
            documents.append((d, t, "en", s, len(t or "")))
    toxic = toxic_texts()
    documents += [(d, t, "en", "s1", len(t)) for d, t, _ in toxic]
    long = next(t for _, t, *_ in documents if t and len(t.split()) > 100)
    documents.append((500, "Home | About | Login | Help\nAll rights reserved.\n" + "We then went on to the next town by the river. Nobody there had heard of it. " * 2, "en", None, 200))
    benchmark = [(1, " ".join(long.split()[5:30])), (2, "Iota Iota xi kappa"), (11, "épsilon zeta épsilon"), (3, None), (4, "...")]
    return {"documents": documents, "labels": [(d, 1, x) for d, _, x in toxic] + [(0, 1, None), (77_777, 0, 1)], "benchmark": benchmark, "pages": [(1, "u", PAGE), (2, None, None), (3, "v", "")]}


@pytest.fixture(scope="module")
def sf(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    for name, rows in tables.items():
        spark.createDataFrame(rows, TABLES[name]).coalesce(2).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_agrees(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, sf)
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(want.fetchall())


def test_op1(spark, sf):
    out = QUERIES["op1_html_blocks"](spark, sf)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    want = "A & B First part of it, going on. Second part is here, and ends."
    assert sorted(out.collect()) == [(1, "u", want, len(want)), (2, None, "", 0), (3, "v", "", 0)]


def test_op2(spark, sf, tables):
    got = {r.doc_id: r for r in QUERIES["op2_toxicity_fm"](spark, sf).collect()}
    assert set(got) == {r[0] for r in tables["documents"]}
    assert all(r.held_out == (crc(d) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    out = [(d, x) for d, _, x in toxic_texts() if crc(d) % 5 == 0]
    assert all(got[d].predicted == x for d, x in out)


@pytest.mark.parametrize("hot", [phrases.HOT, 3])
def test_op3(spark, sf, tables, monkeypatch, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    words = {d: (t or "").encode().split() for d, t, *_ in tables["documents"]}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = set()
    for d, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        want.add((d, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest()))
    assert {tuple(r) for r in QUERIES["op3_phrase_automata"](spark, sf).collect()} == want


def test_op4(spark, sf, tables):
    rows = QUERIES["op4_rendezvous_sharding"](spark, sf).collect()
    by = {d: t or "" for d, t, *_ in tables["documents"]}
    assert {(r.doc_id, r.size, r.text_crc32, r.law) for r in rows} == {(d, len(t.encode()) + 16, zlib.crc32(t.encode()), "key") for d, t in by.items()}
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_op5(spark, sf, tables):
    rows = QUERIES["op5_pfair_mix"](spark, sf).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((d, s) for d, _, _, s, _ in tables["documents"])


def test_op9(spark, sf, tables):
    got = QUERIES["op9_odd_sketch_neardup"](spark, sf).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes([(d, t, s) for d, t, _, s, _ in tables["documents"]], 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op10(spark, sf, tables):
    tokens = {d: [*(t or "").encode().lower().split(), b" "] for d, t, *_ in tables["documents"]}
    train = {d: t for d, t in tokens.items() if crc(d) % 7 != 2}
    c = Counter(w for t in train.values() for w in t)
    n, v = sum(c.values()), len(c)
    for r in QUERIES["op10_trie_lm"](spark, sf).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0


def hits(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = words(text)
    for _, t in items:
        i = words(t)
        n = min(10, len(i))
        if n and any(w[a : a + n] == i[b : b + n] for b in range(len(i) - n + 1) for a in range(len(w) - n + 1)):
            return True
    return False


def test_pipeline_stages_take_effect(spark, sf, tables):
    import corpus_pipeline

    docs = {d: (t, s) for d, t, _, s, _ in tables["documents"]}
    model = {r.doc_id: r.predicted for r in QUERIES["op2_toxicity_fm"](spark, sf).collect()}
    mild = [(d, t, s) for d, (t, s) in docs.items() if not model[d]]
    assert {d for d, _, x in toxic_texts() if x} <= set(docs) - {d for d, _, _ in mild}
    heads = {c for _, _, c in brute_classes(mild, 80)}
    want = {d for d in heads if not hits(docs[d][0], tables["benchmark"])}
    assert want != heads
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == want
    assert len(rows) == len(want)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_pipeline_order_is_the_mix(spark, sf):
    """Slots of a shard follow the rows of the mixing stage, which are in the order of its schedule."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix_sources(docs, [F.col("doc_id"), F.xxhash64("text")], F.xxhash64("doc_id"), cost=F.octet_length(F.coalesce("text", F.lit(""))) + 16, block_cost=mixing.BLOCK_BYTES)
    order = [r.doc_id for r in mixed.orderBy("mix_slot", "mix_rank", "doc_id").collect()]
    stages = dict(corpus_pipeline.STAGES)
    path = f"{sf}/mixed.parquet"
    stages["mixing"](spark, docs, sf).write.parquet(path)
    assert [r.doc_id for r in spark.read.parquet(path).select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()] == order
    rows = stages["sharding"](spark, spark.read.parquet(path), sf).collect()
    place = {d: k for k, d in enumerate(order)}
    for s in {r.shard for r in rows}:
        own = [place[r.doc_id] for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]
        assert own == sorted(own)


def odd_documents(spark):
    rows = [(None, None, "en", None, 0), (None, "one two three", "en", "a", 3), (7, None, "en", "a", 0), (7, "", "en", None, 0), (7, "", "en", None, 0), (8, " \n\t", "en", "a", 3), (9, "word " * 5000, "en", "a", 25000), (10, "word " * 5000, "en", "b", 25000)]
    return spark.createDataFrame(rows, DOCUMENTS).withColumns({"score": F.lit(1), "row": F.lit(2), "key": F.lit(3), "digest": F.lit(4), "doc": F.lit(5), "node": F.lit(6), "hits": F.lit(7), "n_words": F.lit(8), "mix_slot": F.lit(9), "barrier": F.lit(10)})


@pytest.mark.parametrize("stage", range(4))
@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, sf, stage, empty):
    """Nulls, empty and long texts, repeated rows, clashing names; and no rows at all: the columns stay."""
    import corpus_pipeline

    docs = odd_documents(spark).limit(0 if empty else 100)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, sf)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    everything = Counter((r.doc_id, r.text) for r in docs.collect())
    if name == "near_duplicates":  # null and wordless texts stay, rows that are repeated whole once; of 9 and 10 the first
        everything = Counter(set(everything) - {(10, "word " * 5000)})
    assert got == (Counter() if empty else everything)


def test_last_stage_on_odd_rows(spark, sf, tmp_path):
    import corpus_pipeline

    docs = odd_documents(spark)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    docs.write.parquet(str(tmp_path / "odd"))
    again = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(str(tmp_path / "odd")), sf).collect()
    assert len(rows) == len(again) == 8
    assert Counter((r.doc_id, r.shard) for r in rows) == Counter((r.doc_id, r.shard) for r in again)


def test_names_step_aside(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, "one two three")], TABLES["benchmark"])
    assert decontaminate.find_hits(docs, decontaminate.benchmark_windows(bench)).columns == [*docs.columns, "_n_words", "_hits", "n_hit", "items", "contaminated"]
    assert decontaminate.find_hits(docs, decontaminate.benchmark_windows(bench)).filter("contaminated").count() == 1
    assert quality.clean_lines(docs).columns[: len(docs.columns) + 1] == [*docs.columns, "_n_words"]
    cut = docs.withColumns({"n_dropped": F.lit(1), "keep_bitmap": F.lit(2), "kept_text": F.lit(3)})
    assert lines.apply_bitmaps(cut, lines.keep_bitmaps(cut)).columns == [*cut.columns, "_kept_text", "_n_dropped", "_keep_bitmap"]
    assert phrases.remove_passages(docs).columns == [*docs.columns, "_n_words", "n_removed", "kept_text"]
    model = toxicity.fit([], [], [])
    assert toxicity.score_toxicity(docs, model, docs.columns).columns == [*docs.columns, "_score"]
    assert sharding.rendezvous_shard(docs.withColumn("scores", F.lit(1)), "doc_id", [1.0]).columns == [*docs.columns, "scores", "shard"]
    assert neardup.drop_near_duplicates(docs.withColumn("own_doc", F.lit(1))).columns == [*docs.columns, "own_doc"]
    assert ngrams.score(docs, ngrams.train(docs), ["doc_id", "score"]).columns[-1] == "_score"
    assert blocks.extract_text(docs.withColumn("html", F.col("text")), ["doc_id", "row"]).columns == ["doc_id", "row", "text"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
