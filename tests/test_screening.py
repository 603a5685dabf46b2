"""Evidence, similarity, calibration, text, images, sources and streaming on small inputs."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import authors, evidence, images, relations, scoring, similarity, text
from probity.sources import readers, settings, sinks
from probity.streaming import incremental

FINDINGS = "paper_id long, seq long, figure_id string, method string, severity string, confidence double"


def risk(spark, rows):
    return evidence.paper_risk(spark.createDataFrame(rows, FINDINGS)).first()


def test_paper_risk_rules(spark):
    assert risk(spark, [(1, 1, "a", "ela", "high", 0.8)]).risk == "low"
    two = [(1, k, f, m, "high", 0.9) for k, (f, m) in enumerate((f, m) for f in "ab" for m in ("ela", "phash"))]
    assert risk(spark, two).risk == "critical"  # high, raised by two heavy methods
    assert risk(spark, [(1, k, f, "noise_analysis", "low", 0.9) for k, f in enumerate("ab")]).risk == "low"
    nulls = risk(spark, [(1, 1, None, None, None, None)])
    assert (nulls.risk, nulls.confidence) == ("clean", 0.0)


def test_papers_without_findings_are_clean(spark):
    f = spark.createDataFrame([], FINDINGS)
    got = evidence.paper_risk(f, papers=spark.createDataFrame([(7,)], "paper_id long")).collect()
    assert [(r.paper_id, r.risk) for r in got] == [(7, "clean")]


def test_similar_pairs_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 2, 64)
    codes = []
    for k in range(40):
        x = base.copy()
        x[r.choice(64, r.integers(0, 12), replace=False)] ^= 1
        codes.append((k, k % 7, np.packbits(x).tobytes().hex()))
    rows = spark.createDataFrame([*codes, (99, 1, None), (98, 1, "ab")], "figure_id long, paper_id long, phash string")
    got = {(x.figure_id_a, x.figure_id_b): x.distance for x in similarity.similar_pairs(rows, 16, 10, None).collect()}
    want = {(a, b): d for a, _, p in codes for b, _, q in codes if a < b and (d := (int(p, 16) ^ int(q, 16)).bit_count()) <= 10}
    assert got == want


def test_probe_prefixes():
    assert len(similarity.probe_prefixes("ab")) == 31


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long")
    got = {r.node: r.component for r in similarity.connected_components(e, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_louvain_splits_two_cliques():
    clique = lambda xs: [(a, b, 1) for a in xs for b in xs if a < b]
    part = authors.louvain(list(range(8)), [*clique(range(4)), *clique(range(4, 8)), (3, 4, 1)])
    assert len({part[k] for k in range(4)}) == 1
    assert part[0] != part[7]


def test_metrics_and_curve(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, True), (0.1, False), (0.2, False)], "confidence double, label boolean")
    m = scoring.metrics(scoring.confusion(s, [0.5])).first()
    assert (m.sensitivity, m.specificity, m.precision, m.f1) == (1, 1, 1, 1)
    assert scoring.roc(s, points=10).count() == 11
    # points of equal rate stay in the order of their thresholds, which costs the last step a half
    assert scoring.auc(scoring.roc(s)).first().auc == 0.75


def test_text_extraction(spark):
    d = spark.createDataFrame([(1, "M = 3.45 (SD = 1.20), N = 30; F(2, 50) = 4.56, p = 0.015 and t(30) = 2.0"), (2, None), (3, "")], "id long, text string")
    assert [(r.mean, r.sd, r.n) for r in text.extract_mean_sd(d).collect()] == [(3.45, 1.2, 30)]
    assert {(r.test_type, r.statistic, tuple(r.df), r.p) for r in text.extract_tests(d).collect()} == {("F", 4.56, (2, 50), 0.015), ("t", 2.0, (30,), None)}
    assert [r.value for r in text.extract_p_values(d).collect()] == [0.015]


@pytest.mark.parametrize(
    ("said", "reports"),
    [
        ("3.45 ± 1.20 (N = 30)", [(3.45, 1.2, 30)]),
        ("M = 3.45 [SD = 1.2]; n = 7", [(3.45, 1.2, 7)]),
        ("mean = -2 (s.d. = 0.5)", [(-2.0, 0.5, 0)]),
        ("mean ± SD: 4.1 ± 0.5, N = 12", [(4.1, 0.5, 0), (4.1, 0.5, 12)]),
        ("M = .5 (SD = 1.2)", []),
    ],
)
def test_forms_of_means(spark, said, reports):
    d = spark.createDataFrame([(1, said)], "id long, text string")
    assert sorted((r.mean, r.sd, r.n) for r in text.extract_mean_sd(d).collect()) == reports


def test_forms_that_are_no_reports(spark):
    d = spark.createDataFrame([(1, "M = .5, N = 3"), (2, "p = -0.5"), (3, "r(28) = 0.4"), (4, "χ²(2, N = 30) = 4"), (5, "χ²(2) = 4.5, p < .05; r = -.31")], "id long, text string")
    assert text.extract_means(d).count() == 0
    assert [(r.id, r.value) for r in text.extract_p_values(d).collect()] == [(5, 0.05)]
    assert {(r.id, r.test_type, r.statistic, r.p) for r in text.extract_tests(d).collect()} == {(5, "chi2", 4.5, 0.05), (5, "r", -0.31, None)}


def test_contexts(spark):
    long = "x" * 200 + " p = .01 " + " p<.2" * 60 + " " + "y" * 200
    rows = text.extract_p_values(spark.createDataFrame([(1, long), (2, "so p = .3")], "id long, text string")).collect()
    want = [long[max(0, m.start() - 80) : m.end() + 80].strip() for m in re.finditer(r"p\s*[<=]\s*\.\d+", long)]
    assert [r.context for r in rows if r.id == 1] == want
    assert [r.context for r in rows if r.id == 2] == ["so p = .3"]


def test_phrases(spark):
    d = spark.createDataFrame([(1, "Deep Learning, deep learning; undeep learning. Deep-learning"), (2, None), (3, "counterfeit consciousness (profound learning)")], "id long, text string")
    p = text.phrase_dictionary(spark.createDataFrame([("deep learning", "x"), ("Counterfeit Consciousness ", "artificial intelligence"), ("profound learning", None), ("bogus", "y"), (" ", "z")], "tortured string, correct string"))
    hits = text.phrase_hits(d, p, "id")
    assert {(r.id, r.phrase, r.hits) for r in hits.collect()} == {(1, "deep learning", 2), (3, "counterfeit consciousness", 1), (3, "profound learning", 1)}
    assert {(r.id, r.suspicious) for r in text.phrase_screening(hits, "id").collect()} == {(1, False), (3, True)}
    found = text.phrase_occurrences(d, p, "id").collect()
    low = "deep learning, deep learning; undeep learning. deep-learning"
    assert sorted(r.context for r in found if r.id == 1) == sorted(low[max(0, m.start() - 40) : m.end() + 40] for m in re.finditer(r"\bdeep learning\b", low))


def test_identifiers(spark):
    row = spark.range(1).select(text.valid_doi(F.lit(" https://doi.org/10.1234/ab.c ")).alias("a"), text.valid_doi(F.lit("10.1/x")).alias("b"), text.authors_line(F.array(*[F.lit(x) for x in "abcdefg"])).alias("c"), text.salvaged_json(F.lit('x ```json\n{"a": 1}\n```'), "a int")["a"].alias("d"), text.exif_date_gap(F.lit("2020:01:01 00:00:00"), F.lit("2020:01:02 00:00:00")).alias("e")).first()
    assert tuple(row) == ("10.1234/ab.c", None, "a, b, c, d, e et al. (7 total)", 1, 86400)


def test_payloads(spark):
    work = {"id": "w", "doi": "https://doi.org/10.5/x", "title": "t", "cited_by_count": 3, "abstract_inverted_index": {"the": [0, 3], "cat": [1], "sat": [2], "mat": [4]}}
    w = readers.works(spark.createDataFrame([(json.dumps(work),)], "payload string")).first()
    assert (w.doi, w.abstract) == ("10.5/x", "the cat sat the mat")
    n = readers.notices(spark.createDataFrame([(json.dumps({"DOI": "10.5/x", "update-to": [{"type": "Retraction"}]}),), ("{}",)], "payload string")).collect()
    assert [(r.is_retraction_notice, r.status) for r in n] == [(True, "retraction"), (False, None)]


def test_sample_and_report(spark):
    rows = spark.range(100).withColumn("class", F.col("id") % 2)
    assert sorted(r["count"] for r in readers.seeded_sample(rows, "id", "class", 5).groupBy("class").count().collect()) == [5, 5]
    f = spark.createDataFrame([(1, 1, None, "ela", "low", 0.5), (1, 2, None, "phash", "critical", 0.9)], FINDINGS)
    md = sinks.report_markdown(spark.createDataFrame([(1, "low")], "paper_id long, risk string"), f).first().report_markdown
    assert md.index("phash") < md.index("ela")


def test_image_checks():
    r = np.random.RandomState(44)
    img = r.randint(0, 255, (200, 200)).astype(np.uint8)
    assert images.ssim(img, img) == pytest.approx(1.0)
    forged = img.copy()
    forged[120:180, 120:180] = img[20:80, 20:80]
    votes, share, shift = images.block_clones(forged)
    assert images.copied_share(forged, shift) > images.copied_share(img, shift)
    assert votes >= 8
    assert share > 0.5
    assert shift == (100, 100)
    assert images.block_clones(img)[0] == 0
    assert len(images.perceptual_hash(img)) == 64
    assert images.error_level_finding(5, 1, 1) is None


def test_image_ladders():
    assert images.spectrum_finding(0, 0.5, 9) is None
    assert [images.spectrum_finding(1, 0.5, x) for x in (6.0, 4.0, 1.2)] == [("high", 0.6), ("medium", 0.5), ("low", pytest.approx(0.2))]
    assert images.ghost_finding(1, 10, 0.04) is None
    assert images.ghost_finding(1, 10, 0.06) == ("medium", 0.5)
    assert images.ghost_finding(3, 30, 0.01) == ("high", pytest.approx(0.8))
    assert [images.clone_finding(9, s, c) for s, c in ((0.8, 0.05), (0.8, 0.4), (0.6, 0.2), (0.6, 0.12))] == [None, ("high", pytest.approx(0.81)), ("medium", pytest.approx(0.63)), ("low", pytest.approx(0.48))]
    assert images.bands(np.array([0, 3, 1, 9, 2, 2.0])) == [1, 3]
    assert images.findings_of(np.zeros((8, 8)), {"bad": lambda img: 1 / 0, "good": lambda img: ("low", 0.1)}) == [("good", "low", 0.1)]


def test_blots():
    r = np.random.default_rng(2)
    lane = np.repeat(r.uniform(150, 250, (120, 1)), 30, axis=1)
    img = np.full((120, 200), 20.0)
    img[:, 20:50], img[:, 80:110], img[:, 140:170] = lane, lane, np.repeat(r.uniform(150, 250, (120, 1)), 30, axis=1)
    assert len(images.lanes(img)) == 3
    assert [x[:2] for x in images.blot_findings(img)][0] == ("western_blot", "high")
    assert images.blot_findings(np.full((50, 50), 9.0)) == []


def test_metadata(spark):
    icc = bytes(128) + b"desc" + bytes(4) + (18).to_bytes(4, "big") + b"sRGB IEC61966-2.1\0" + bytes(9)
    rows = [("a", {"Software": "Adobe Photoshop 25", "DateTime": "2020:01:03 00:00:00", "DateTimeOriginal": "2020:01:01 00:00:00"}, bytearray(icc), bytearray(b"..<x:xmpmeta"), 10), ("b", {"Software": "Fiji with gimp"}, None, bytearray(b"x"), 10), ("c", None, None, bytearray(b"x"), 200_000)]
    found = images.metadata_findings(spark.createDataFrame(rows, "figure_id string, exif map<string,string>, icc binary, content binary, bytes long")).collect()
    assert {(r.figure_id, r.kind) for r in found} == {("a", k) for k in ("editing_software", "date_mismatch", "icc_profile", "xmp_metadata")}


ARTICLE = """<PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><Journal><ISSN IssnType="Print">1-2</ISSN><JournalIssue><Volume>3</Volume><PubDate><Year>2019</Year></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>On x</ArticleTitle><ELocationID EIdType="doi">10.1/a</ELocationID><Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>Seen.</AbstractText></Abstract>
<AuthorList><Author><LastName>Li</LastName><ForeName>A</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/b</ArticleId><ArticleId IdType="pmc">PMC5</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


def test_more_payloads(spark):
    a = readers.pubmed_articles(spark.createDataFrame([(ARTICLE,), ("<PubmedArticle/>",)], "payload string")).collect()
    assert [(r.pmid, r.title, r.abstract, r.doi, r.pmcid, r.publication_year, r.journal, r.issn, [p.last_name for p in r.authors]) for r in a] == [("77", "On x", "AIM: To see. Seen.", "10.1/a", "PMC5", 2019, "J", "1-2", ["Li"])]
    x = spark.createDataFrame([('<OA><link format="tgz" href="a"/><link format="PDF" href="ftp://h/b.pdf"/></OA>',), ("<OA/>",)], "x string").select(readers.open_access_pdf_link(F.col("x")).alias("u")).collect()
    assert [r.u for r in x] == ["https://h/b.pdf", None]
    assert [r[0] for r in spark.createDataFrame([("10.1/x",), ("DOI:10.1/x",), ("abc",)], "i string").select(readers.paper_reference(F.col("i"))).collect()] == ["DOI:10.1/x", "DOI:10.1/x", "abc"]
    assert readers.cited_authors(spark.createDataFrame([('{"authorId": "1", "hIndex": 9}',)], "payload string")).first().asDict() == {"author_id": "1", "name": "Unknown", "h_index": 9, "citation_count": None, "paper_count": None}
    assert readers.cited_papers(spark.createDataFrame([('{"paperId": "p", "citationCount": 4}',)], "payload string")).first().citation_count == 4
    both = spark.createDataFrame([(json.dumps({"message": {"items": [{"DOI": "d"}, {"DOI": ""}]}}), json.dumps({"message": {"items": [{}, {}]}})), (None, "{}")], "retractions string, concerns string")
    assert [(r.retracted_dois, r.total_concerns) for r in readers.author_retractions(both).collect()] == [(["d"], 2), ([], 0)]
    pub = json.dumps({"data": [{"total_comments": 12, "comments": [{"content": "c" * 400}] * 12}]})
    got = readers.review_comments(spark.createDataFrame([(pub,), ("{}",)], "payload string")).collect()
    assert [(r.has_comments, r.total_comments, len(r.comments)) for r in got] == [(True, 12, 10), (False, 0, 0)]
    assert (got[0].comments[0].author, len(got[0].comments[0].snippet)) == ("Anonymous", 300)


def test_phrase_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"tortured": "x y", "correct": "z"}]')
    (tmp_path / "b.json").write_text('{"x y": "z"}')
    for name, n in (("a.json", 1), ("b.json", 1), ("absent.json", 0)):
        assert [tuple(r) for r in readers.phrase_records(spark, str(tmp_path / name)).collect()] == [("x y", "z")] * n


def test_settings():
    got = settings.settings({"llm": {"provider": "a", "retries": 2}}, {"llm": {"provider": "${P:-b}", "key": "${NONE}"}, "storage": {"pdf_dir": "in", "other": "x"}}, "/etc/p", {"spark.probity.llm.retries": "5", "spark.other": "1"})
    assert got == {"llm": {"provider": "b", "retries": "5", "key": None}, "storage": {"pdf_dir": "/etc/p/in", "other": "x"}}


def test_relations(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    cache = spark.createDataFrame([("k", "old", "2024-01-01"), ("k", "new", "2024-01-09"), ("j", "gone", "2023-12-01")], "key string, response string, at string").select("key", "response", F.col("at").cast("timestamp").alias("cached_at"))
    asked = spark.createDataFrame([("k",), ("j",), ("j",), ("m",)], "key string")
    assert sorted(r.key for r in relations.unanswered(asked, cache, now).collect()) == ["j", "m"]
    assert {(r.key, r.response) for r in relations.cached_answers(asked, cache, now).collect()} == {("k", "new"), ("j", None), ("m", None)}
    entry = relations.stage_entry(spark.createDataFrame([(1,)], "paper_id long"), "aggregate", "failed", now).first()
    assert (entry.started_at, entry.status, entry.completed_at is not None) == (None, "failed", True)
    with pytest.raises(ValueError, match="unknown"):
        relations.stage_entry(spark.range(1), "x", "odd")
    rows = spark.range(1200)
    first = relations.page(rows, "id")
    assert first.count() == 500
    assert [r.id for r in relations.page(rows, "id", 499, 3).collect()] == [500, 501, 502]


@pytest.mark.parametrize(("distance", "across"), [(20, None), (10, True), (3, False), (0, None)])
def test_wide_slices_lose_no_pair(spark, distance, across):
    r = np.random.default_rng(distance + 1)
    base = [int(x) for x in r.integers(0, 1 << 62, 12)]
    codes = [b ^ sum(1 << int(k) for k in r.choice(64, int(r.integers(0, 14)), replace=False)) for b in base for _ in range(5)] + base[:3]
    rows = [(k, k % 4, f"{c:016x}") for k, c in enumerate(codes)] + [(900, 1, None), (901, 1, "abc")]
    frame = spark.createDataFrame([*rows, rows[0]], "figure_id long, paper_id long, phash string")
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and (a ^ b).bit_count() <= distance and across in (None, i % 4 != j % 4)}
    assert {(x.figure_id_a, x.figure_id_b, x.distance) for x in similarity.similar_pairs(frame, 16, distance, across).collect()} == want
    if across is None:
        new = frame.filter("figure_id < 7")
        both = {(x.figure_id_a, x.figure_id_b) for x in similarity.similar_pairs(frame, 16, distance, None, new).collect()}
        assert both == {(i, j) for a, b, _ in want for i, j in ((a, b), (b, a)) if i < 7}


def test_stream_matches_batch(spark, tmp_path):
    rows = [(k, k % 3, f"{k % 5:016x}") for k in range(12)]
    schema = "figure_id long, paper_id long, phash string"
    spark.createDataFrame(rows[6:], schema).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame(rows[:6], schema)
    q = incremental.scan_arrivals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), known, str(tmp_path / "out"), str(tmp_path / "ck"), 16, 3)
    q.awaitTermination()
    got = {(r.figure_id_a, r.figure_id_b) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = spark.createDataFrame(rows, schema)
    assert got == {(r.figure_id_a, r.figure_id_b) for r in similarity.similar_pairs(every, 16, 3, True, every.filter("figure_id >= 6")).collect()}
