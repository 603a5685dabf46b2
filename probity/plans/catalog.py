"""All registered queries of the screening engine, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions import domain as D
from probity.operators import authors, campaign, evidence, images, relations, scoring, similarity, statistics, text
from probity.plans.views import oracle, view

DIGITS, DISTANCE = 16, 20


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.paper_risk(view(spark, sf_dir, "v_findings"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with a hash of the signs of their embedding: 64 bits as 16 hex digits."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0"))
    code = F.concat(*[F.lpad(F.lower(F.conv(F.array_join(F.slice(bits, k + 1, 32), ""), 2, 16)), 8, "0") for k in (0, 32)])
    return e.select(F.col("vec_id").alias("figure_id"), (F.col("vec_id") % 50).alias("paper_id"), code.alias("phash"))


V_BITS = "v_bits AS (SELECT vec_id AS figure_id, vec_id % 50 AS paper_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings)"
PAIRS = f"v_pairs AS (SELECT a.figure_id AS figure_id_a, a.paper_id AS paper_id_a, b.figure_id AS figure_id_b, b.paper_id AS paper_id_b, CAST(hamming(a.bits, b.bits) AS int) AS distance FROM v_bits a JOIN v_bits b ON a.figure_id < b.figure_id WHERE hamming(a.bits, b.bits) <= {DISTANCE})"
HASHES = f"WITH {V_BITS}, {PAIRS} "


def images_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey test images (128 by 128) tiled from the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for key, v in zip(f["vec_id"], f["embedding"], strict=True):
                x = np.resize(np.asarray(v, float), 128 * 128).reshape(128, 128)
                span = x.max() - x.min()
                out.append((str(key), 128, 128, ((x - x.min()) / (span or 1) * 255).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["figure_id", "height", "width", "content"])

    return e.select("vec_id", "embedding").mapInPandas(run, "figure_id string, height int, width int, content binary")


def v(name: str):
    return lambda s, d: view(s, d, name)


findings, links, people, timeline, scores, members, log, papers = map(v, ("v_findings", "v_links", "v_authors", "v_timeline", "v_scores", "v_campaign", "v_log", "v_priority"))


def prioritised(s: SparkSession, d: str) -> DataFrame:
    return papers(s, d).withColumn("priority_score", F.round(scoring.priority(), 4))


def edges(s: SparkSession, d: str) -> DataFrame:
    return authors.coauthor_edges(links(s, d))


def all_pairs(s: SparkSession, d: str, across: bool | None = None) -> DataFrame:
    return similarity.similar_pairs(hashes(s, d), DIGITS, DISTANCE, across)


def phrases(s: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return s.read.parquet(f"{d}/benchmark.parquet").select(F.array_join(F.slice(words, 1, 4), " ").alias("phrase")).distinct()


def triage(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    status = o.select(F.col("o_orderkey").alias("paper_id"), F.when(F.col("o_orderkey") % 97 == 0, "retraction").alias("retraction_status"), (F.col("o_custkey") % 50 == 0).cast("int").alias("pubpeer_comments"))
    return scoring.auto_risk(findings(s, d), status, status.filter("paper_id % 31 = 0"))


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def queries() -> dict:
    mean = v("v_means")
    return {
        "paper_risk": flagship,
        "figure_evidence": lambda s, d: evidence.figure_evidence(findings(s, d)).select("paper_id", "figure_id", "converging", "methods_flagged", "severity_rank", F.round(F.col("confidence") + 1e-9, 5).alias("confidence")),
        "paper_risk_unweighted": lambda s, d: evidence.paper_risk(findings(s, d), None),
        "passing_findings": lambda s, d: evidence.passing_findings(findings(s, d)).groupBy("method").agg(F.count("*").alias("findings")),
        "compression_discount": lambda s, d: six(evidence.compression_discount(findings(s, d).withColumn("pdf", F.col("figure_id").isNotNull()), "pdf").groupBy("method").agg(F.avg("confidence").alias("confidence")), "confidence"),
        "methods_summary": lambda s, d: evidence.severity_summary(findings(s, d)),
        "grim": lambda s, d: mean(s, d).select("id", statistics.grim_consistent(F.col("mean"), F.col("n")).alias("consistent")),
        "grimmer": lambda s, d: mean(s, d).select("id", statistics.grimmer_consistent("mean", "sd", "n").alias("consistent")),
        "grimmer_bounds": lambda s, d: mean(s, d).filter("n > 20").select("id", statistics.grimmer_bounds(F.col("mean"), F.col("sd"), F.col("n")).alias("consistent")),
        "sprite": lambda s, d: mean(s, d).select("id", statistics.sprite_feasible("mean", "sd", "n").alias("feasible")),
        "benford": lambda s, d: statistics.benford(v("v_values")(s, d), "group_id", "value"),
        "terminal_digit": lambda s, d: statistics.terminal_digits(v("v_values")(s, d), "group_id", "value"),
        "pvalue_check": lambda s, d: six(statistics.check_p_values(v("v_tests")(s, d)), "computed_p").select("id", "test_type", "computed_p", "significance_changed", "consistent"),
        "duplicate_values": lambda s, d: statistics.duplicate_cells(v("v_cells")(s, d), "table_id", "cell", "pos"),
        "variance_ratio": lambda s, d: statistics.variance_ratio(v("v_sd_n")(s, d), "table_id"),
        "distribution_fit": lambda s, d: statistics.distribution_fit(v("v_values")(s, d), "group_id", "value"),
        "exponential_fit": lambda s, d: statistics.distribution_fit(v("v_values")(s, d), "group_id", "value", "expon").select("group_id", "n", "ks", F.round("anderson", 3).alias("anderson"), (F.col("anderson") > F.col("critical")).alias("exceeds")),
        "priority": lambda s, d: prioritised(s, d).select("paper_id", "priority_score"),
        "pending_queue": lambda s, d: campaign.pending_queue(prioritised(s, d), 50).select("paper_id", "priority_score"),
        "auto_risk_score": triage,
        "author_network_risk": lambda s, d: authors.author_risk(people(s, d), edges(s, d)),
        "coauthor_edges": edges,
        "coauthor_clusters": lambda s, d: authors.cluster_risk(similarity.connected_components(edges(s, d), "author_a", "author_b").withColumnRenamed("node", "author_id"), people(s, d)),
        "coauthor_communities": lambda s, d: authors.communities(edges(s, d)),
        "temporal_patterns": lambda s, d: authors.temporal_patterns(timeline(s, d)),
        "latest_stage": lambda s, d: authors.latest_stage(log(s, d)),
        "remaining_stages": lambda s, d: authors.remaining_stages(authors.latest_stage(log(s, d)), D.STAGES),
        "similar_pairs": all_pairs,
        "cross_paper_duplicates": lambda s, d: all_pairs(s, d, True),
        "intra_paper_pairs": lambda s, d: all_pairs(s, d, False),
        "bucketed_pairs": lambda s, d: similarity.bucketed_pairs(hashes(s, d), DIGITS, DISTANCE),
        "incremental_scan": lambda s, d: similarity.similar_pairs(hashes(s, d), DIGITS, DISTANCE, None, hashes(s, d).filter("figure_id % 10 = 0")),
        "exact_hash_index": lambda s, d: similarity.exact_hash_index(hashes(s, d)),
        "hash_clusters": lambda s, d: similarity.hash_clusters(all_pairs(s, d)),
        "top_matches": lambda s, d: all_pairs(s, d).orderBy("distance", "figure_id_a", "figure_id_b").limit(50),
        "new_matches": lambda s, d: similarity.new_matches(all_pairs(s, d), all_pairs(s, d).filter("figure_id_a % 2 = 0")),
        "threshold_metrics": lambda s, d: six(scoring.metrics(scoring.confusion(scores(s, d), [0.3, 0.5, 0.6, 0.7, 0.8, 0.9], ["method"])), "sensitivity", "specificity", "precision", "f1"),
        "roc_curve": lambda s, d: six(scoring.roc(scores(s, d)), "fpr", "tpr"),
        "auc": lambda s, d: scoring.auc(scoring.roc(scores(s, d), ["method"]), ["method"]),
        "auto_tune": lambda s, d: scoring.auto_tune(scoring.metrics(scoring.confusion(scores(s, d), [k / 100 for k in range(101)], ["method"]))),
        "detection_rollup": lambda s, d: six(scoring.detection_rollup(scores(s, d)), "max_confidence"),
        "depth_filter": lambda s, d: campaign.at_depth(members(s, d), 1, 1, "pending").select("paper_id", "campaign_id", "depth"),
        "promotion_filter": lambda s, d: campaign.promotable(members(s, d)).select("paper_id", "auto_risk_score"),
        "flagged_seeds": lambda s, d: campaign.flagged_seeds(members(s, d), 2).select("paper_id", "depth", "final_risk"),
        "expansion_tree": lambda s, d: campaign.expansion_tree(members(s, d)),
        "risk_distribution": lambda s, d: campaign.breakdown(members(s, d), "final_risk"),
        "triage_breakdown": lambda s, d: campaign.breakdown(members(s, d), "triage_status"),
        "method_breakdown": lambda s, d: campaign.method_breakdown(findings(s, d), members(s, d)),
        "top_papers": lambda s, d: campaign.top_papers(members(s, d)).select("paper_id", "auto_risk_score", "final_risk"),
        "latest_report": lambda s, d: campaign.latest_per_paper(timeline(s, d), "author_id", "ts"),
        "campaign_export": lambda s, d: campaign.at_least(members(s, d), "medium").select("paper_id", "final_risk", "rank"),
        "expansion_caps": lambda s, d: campaign.capped_expansion(links(s, d), 2, 3),
        "matched_scores": lambda s, d: campaign.raise_matched_scores(members(s, d), members(s, d).filter("paper_id % 40 = 1").select(F.col("paper_id").alias("paper_id_a"), (F.col("paper_id") + 1).alias("paper_id_b"))).select("paper_id", "auto_risk_score"),
        "extract_means": lambda s, d: text.extract_means(v("v_sentences")(s, d).withColumn("text", F.regexp_replace("text", r" \(SD = [^)]*\)", ""))).drop("context"),
        "extract_mean_sd": lambda s, d: text.extract_mean_sd(v("v_sentences")(s, d)).drop("context"),
        "extract_tests": lambda s, d: text.extract_tests(v("v_sentences")(s, d)).withColumn("df", F.array_join(F.col("df").cast("array<string>"), ",")).drop("context"),
        "extract_p_values": lambda s, d: text.extract_p_values(v("v_sentences")(s, d)).drop("context"),
        "statistic_contexts": lambda s, d: text.extract_tests(v("v_sentences")(s, d)).filter("test_type in ('t', 'F')").select("id", "test_type", "context"),
        "extract_decimals": lambda s, d: text.extract_decimals(v("v_sentences")(s, d)).groupBy("id").agg(F.count("*").alias("k"), F.round(F.sum("value"), 4).alias("total")),
        "phrase_hits": lambda s, d: text.phrase_hits(s.read.parquet(f"{d}/documents.parquet"), phrases(s, d), "doc_id"),
        "phrase_screening": lambda s, d: text.phrase_screening(text.phrase_hits(s.read.parquet(f"{d}/documents.parquet"), phrases(s, d), "doc_id"), "doc_id"),
        "phrase_contexts": lambda s, d: text.phrase_occurrences(s.read.parquet(f"{d}/documents.parquet"), phrases(s, d), "doc_id"),
        "sd_ratio": lambda s, d: statistics.variance_ratio(v("v_sd_n")(s, d), "table_id").select("table_id", "k", "ratio"),
        "large_figures": lambda s, d: relations.large_figures(v("v_figures")(s, d)).select("figure_id", "width", "height"),
        "blot_figures": lambda s, d: relations.blot_figures(v("v_figures")(s, d)).select("figure_id", "image_type"),
        "coauthors": lambda s, d: relations.coauthors(links(s, d), people(s, d)).select("of_author", "author_id", F.col("flagged_papers").cast("long").alias("flagged_papers")),
        "described_matches": lambda s, d: relations.described_matches(all_pairs(s, d), v("v_papers")(s, d), v("v_figures")(s, d)),
        "labelled_findings": lambda s, d: relations.labelled_findings(findings(s, d), s.createDataFrame([("fig0", "Figure 1"), ("fig1", "Figure 2")], "figure_id string, figure_label string")).select("paper_id", "seq", "figure_id", "figure_label"),
        "new_members": lambda s, d: relations.new_members(links(s, d).select((F.col("author_id") % 5).alias("campaign_id"), "paper_id"), members(s, d)),
        "upserted_papers": lambda s, d: relations.upserted_papers(v("v_incoming")(s, d), v("v_papers")(s, d).select(F.col("paper_id").cast("string").alias("id"), "doi"), F.concat(F.lit("new-"), F.coalesce("doi", F.col("row_id").cast("string")))),
        "status_counts": lambda s, d: relations.status_counts(v("v_papers")(s, d)),
        "hash_page": lambda s, d: relations.page(hashes(s, d).select("figure_id", "paper_id"), "figure_id", 100),
        "statistics_summary": lambda s, d: relations.statistics_summary({"means": text.extract_means(v("v_sentences")(s, d)), "tests": text.extract_tests(v("v_sentences")(s, d)), "p_values": text.extract_p_values(v("v_sentences")(s, d)), "decimals": text.extract_decimals(v("v_sentences")(s, d))}, "id"),
        "grim_rollup": lambda s, d: relations.grim_rollup(mean(s, d).select((F.col("id") % 2000).alias("paper_id"), statistics.grim_consistent(F.col("mean"), F.col("n")).alias("consistent")), "paper_id"),
        "exported_reports": lambda s, d: campaign.exported_reports(members(s, d), v("v_timeline")(s, d).select((F.col("paper_id") % 9000).alias("paper_id"), F.col("author_id").alias("report_id"), F.col("ts").alias("created_at")), "medium").select("paper_id", "final_risk", "report_id"),
        "image_screening": lambda s, d: images.screen_images(images_from_embeddings(s, d)),
    }


PASS = "coalesce(confidence, CAST(0 AS double))"
W = D.case_sql("method", {k: float(x) for k, x in D.WEIGHTS.items()}, 0.5)
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def _evidence_sql(weighted: bool) -> str:
    w = W if weighted else "CAST(1 AS double)"
    heavy, some = ("w > CAST(0.6 AS double)", "w >= CAST(0.3 AS double)") if weighted else ("true", "true")
    return f"""f AS (SELECT paper_id, coalesce(figure_id, concat('_paper_finding_', CAST(seq AS varchar))) AS fk, method AS m, confidence AS c, {w} AS w, {RANK} AS sr FROM v_findings),
    g AS (SELECT paper_id, fk, max(sr) AS ms, count(DISTINCT CASE WHEN c >= CAST(0.5 AS double) AND {heavy} THEN m END) AS nb, count(DISTINCT CASE WHEN c >= CAST(0.6 AS double) AND {some} THEN m END) AS nf, count(DISTINCT m) AS nm, sum(c * w) AS cw, sum(w) AS sw FROM f GROUP BY ALL),
    h0 AS (SELECT *, nf >= 2 AS conv, CASE WHEN nb >= 2 AND ms < 4 THEN ms + 1 ELSE ms END AS boosted, least(cw / sw + CASE WHEN nm >= 2 THEN CAST(0.1 AS double) ELSE CAST(0 AS double) END, CAST(1 AS double)) AS conf0 FROM g),
    h AS (SELECT *, CASE WHEN nf = 1 THEN least(boosted, 2) ELSE boosted END AS sev, CASE WHEN nf = 1 THEN least(conf0, CAST(0.7 AS double)) ELSE conf0 END AS conf FROM h0)"""


def _risk_sql(weighted: bool) -> str:
    return oracle(
        "v_findings",
        f""", {_evidence_sql(weighted)},
    p AS (SELECT paper_id, count(*) FILTER (sev = 4 AND conv) AS ncc, count(*) FILTER (conv) AS nc, count(*) FILTER (nf > 0) AS fl, count(*) FILTER (sev = 4) AS cc FROM h GROUP BY paper_id),
    o AS (SELECT paper_id, count(*) AS total, least(sum(c * w) / sum(w) + CASE WHEN count(DISTINCT m) >= 2 THEN CAST(0.1 AS double) ELSE CAST(0 AS double) END, CAST(1 AS double)) AS conf FROM f GROUP BY paper_id)
    SELECT paper_id, CASE WHEN ncc > 0 THEN 'critical' WHEN nc > 0 AND fl >= 2 THEN 'high' WHEN fl >= 3 AND nc = 0 THEN 'medium' WHEN fl = 1 AND nc > 0 THEN 'medium' WHEN fl >= 1 THEN 'low' ELSE 'clean' END AS risk,
    nc > 0 AS converging, fl AS figures_flagged, cc AS critical_count, total AS total_findings, round(conf + CAST(1e-9 AS double), 5) AS confidence FROM p JOIN o USING (paper_id)""",
    )


GRIM_BOUNDS = """SELECT id, sqrt(greatest((ss - total * total / n) / (n - 1), CAST(0 AS double))) - CAST(0.005 AS double) <= sd AND sd <= sqrt(greatest((total * total - total * total / n) / (n - 1), CAST(0 AS double))) + CAST(0.005 AS double) AS consistent
    FROM (SELECT *, (n - rest) * item * item + rest * (item + 1) * (item + 1) AS ss FROM (SELECT *, total - item * n AS rest FROM (SELECT *, floor(total / n) AS item FROM (SELECT *, round_even(mean * n, 0) AS total FROM v_means WHERE n > 20))))"""
BY_DIGIT = """d AS (SELECT group_id, CAST(substr(printf('%.14e', value), 1, 1) AS int) AS digit FROM v_values WHERE value > 0),
    c AS (SELECT group_id, digit, count(*) AS o FROM d GROUP BY ALL), n AS (SELECT group_id, sum(o) AS n FROM c GROUP BY group_id)"""
LAST_DIGIT = "CASE WHEN value = 0 THEN 0 WHEN position('.' IN t) > 0 THEN CAST(right(t, 1) AS int) ELSE CAST(right(t, 1) AS int) END"
PRIORITY = """round((CAST(0.25 AS double) * (CASE WHEN citations > 0 THEN log10(CAST(least(citations, 10000) AS double)) ELSE CAST(0 AS double) END) / CAST(4 AS double) + CAST(0.2 AS double) * CASE quartile WHEN 1 THEN CAST(1 AS double) WHEN 2 THEN CAST(0.75 AS double) WHEN 3 THEN CAST(0.5 AS double) ELSE CAST(0.25 AS double) END
    + CAST(0.15 AS double) * (CASE WHEN influential > 0 THEN log10(CAST(least(influential, 1000) AS double)) ELSE CAST(0 AS double) END) / CAST(3 AS double) + CAST(0.1 AS double) * least(h_index, 80) / CAST(80 AS double) + CAST(0.1 AS double) * CASE WHEN open_data THEN CAST(1 AS double) ELSE CAST(0.3 AS double) END
    + CAST(0.1 AS double) * CASE WHEN retraction THEN CAST(1 AS double) ELSE CAST(0 AS double) END + CAST(0.05 AS double) * greatest(least(2026 - year, 20), 0) / CAST(20 AS double) + CAST(0.05 AS double) * CASE WHEN has_images THEN CAST(1 AS double) ELSE CAST(0.5 AS double) END) * 100, 4)"""
EDGES = "once AS (SELECT DISTINCT author_id, paper_id FROM v_links), e AS (SELECT a.author_id AS author_a, b.author_id AS author_b, count(*) AS weight FROM once a JOIN once b ON a.paper_id = b.paper_id AND a.author_id < b.author_id GROUP BY ALL)"


def _confusion_sql(thresholds: str, by: str) -> str:
    comma = f"{by}, " if by else ""
    return f"""t AS (SELECT CAST(unnest({thresholds}) AS double) AS threshold), c AS (SELECT {comma}threshold, CAST(count(*) FILTER (confidence >= threshold AND label) AS bigint) AS tp, CAST(count(*) FILTER (confidence < threshold AND NOT label) AS bigint) AS tn, CAST(count(*) FILTER (confidence >= threshold AND NOT label) AS bigint) AS fp, CAST(count(*) FILTER (confidence < threshold AND label) AS bigint) AS fn FROM v_scores, t GROUP BY ALL),
    m AS (SELECT *, tp / CAST(greatest(tp + fn, 1) AS double) AS se, tn / CAST(greatest(tn + fp, 1) AS double) AS sp, tp / CAST(greatest(tp + fp, 1) AS double) AS pr FROM c), k AS (SELECT *, 2 * pr * se / greatest(pr + se, CAST(1e-10 AS double)) AS f FROM m)"""


HUNDRED = "list_transform(range(0, 101), lambda x: x / CAST(100 AS double))"
FLAGGED = "final_risk IN ('critical', 'high', 'medium')"
MATCHED = "SELECT DISTINCT paper_id FROM (SELECT paper_id FROM v_campaign WHERE paper_id % 40 = 1 UNION ALL SELECT paper_id + 1 FROM v_campaign WHERE paper_id % 40 = 1)"
MEASURE, SHARE = r"(-?\d+(?:\.\d+)?)", r"(\.?\d+(?:\.\d+)?)"
SAID = rf"(?:\s*,\s*p\s*[<>=]\s*{SHARE})?"
MEANS = rf"(?i)(?:M|mean)\s*=\s*{MEASURE}[\s,;]*[(\[]?\s*N\s*=\s*(\d+)"
MEAN_SDS = [
    rf"(?i)(?:M|mean)\s*=\s*{MEASURE}\s*[(\[]\s*(?:SD|s\.d\.)\s*=\s*{MEASURE}\s*[)\]](?:\s*[,;]\s*N\s*=\s*(\d+))?",
    rf"{MEASURE}\s*±\s*{MEASURE}(?:\s*[(\[]\s*[Nn]\s*=\s*(\d+)\s*[)\]])?",
    rf"(?i)(?:M|mean)\s*±\s*(?:SD|SE|s\.d\.)\s*[:=]?\s*{MEASURE}\s*±\s*{MEASURE}(?:\s*[(\[,;]\s*N\s*=\s*(\d+))?",
]
T3 = rf"(?i)t\s*\(\s*(\d+)\s*\)\s*=\s*{MEASURE}{SAID}"
F4 = rf"(?i)F\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*=\s*{MEASURE}{SAID}"
C3 = rf"(?i)(?:chi2|chi-squared?|χ²|χ2)\s*\(\s*(\d+)\s*\)\s*=\s*{MEASURE}{SAID}"
R2 = rf"(?i)(?:^|[^a-zA-Z])r\s*=\s*(-?\d*\.?\d+){SAID}"
P2 = rf"(?i)(?:^|[^a-zA-Z])p\s*([<>=])\s*{SHARE}"
D1 = r"(?:^|[^a-zA-Z0-9.])(-?\d+\.\d+)"


STAGE_LIST = "[" + ", ".join(f"'{x}'" for x in D.STAGES) + "]"
NUMERIC = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
DUPLICATES = f""", c AS (SELECT table_id, trim(cell) AS cell, pos FROM v_cells WHERE trim(cell) <> ''), p AS (SELECT table_id, cell, count(*) AS k, min(pos) AS first, CASE WHEN regexp_matches(cell, {NUMERIC}) THEN CAST(cell AS double) END AS x FROM c GROUP BY table_id, cell),
    q AS (SELECT *, coalesce(x = round_even(x, 0) OR (abs(x * 10 - round_even(x * 10, 0)) < CAST(1e-9 AS double) AND CAST(round_even(x * 10, 0) AS bigint) % 5 = 0), false) AS rnd, row_number() OVER (PARTITION BY table_id ORDER BY k DESC, first, cell) AS r FROM p),
    g AS (SELECT table_id, CAST(sum(k) AS bigint) AS n, CAST(sum(k - 1) AS bigint) AS duplicates, CAST(coalesce(sum(k) FILTER (x IS NOT NULL), 0) AS bigint) AS n_numeric, CAST(coalesce(sum(k) FILTER (rnd), 0) AS bigint) AS n_round, string_agg(cell, ',' ORDER BY r) FILTER (r <= 3) AS most_common FROM q GROUP BY table_id)
    SELECT *, duplicates / CAST(n AS double) > CAST(0.3 AS double) OR (n_numeric >= 5 AND n_round / CAST(n_numeric AS double) > CAST(0.7 AS double)) AS suspicious FROM g"""
PHRASES = r"""words AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:4], ' ') AS phrase FROM benchmark), dict AS (SELECT phrase, len(regexp_extract_all(phrase, '[\p{L}\p{N}_]+')) AS n FROM words WHERE phrase <> ''),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+([^\p{L}\p{N}_]*)', 1) AS g FROM documents),
    runs AS (SELECT doc_id, n, array_to_string(list_transform(range(i, i + n - 1), lambda k: w[k] || g[k]), '') || w[i + n - 1] AS gram FROM (SELECT doc_id, w, g, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM dict))),
    met AS (SELECT doc_id, phrase FROM runs JOIN dict ON gram = phrase AND runs.n = dict.n)"""


def _contexts(pattern: str, kind: str) -> str:
    """Matches of a pattern with the 80 characters on either side."""
    pieces, found = f"regexp_split_to_array(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}')"
    return f"""(SELECT id, '{kind}' AS test_type, trim(right(l, 80) || found[i] || left(r, 80)) AS context FROM (SELECT id, i, found,
        array_to_string(list_transform(range(1, i), lambda k: pieces[k] || found[k]), '') || pieces[i] AS l, pieces[i + 1] || array_to_string(list_transform(range(i + 1, len(found) + 1), lambda k: found[k] || pieces[k + 1]), '') AS r
        FROM (SELECT id, pieces, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT id, {pieces} AS pieces, {found} AS found FROM v_sentences))))"""


def _each(pattern: str, groups: int, more: str = "") -> str:
    take = ", ".join(f"unnest(regexp_extract_all(text, '{pattern}', {k})) AS g{k}" for k in range(1, groups + 1))
    return f"(SELECT id, {take} FROM v_sentences{more})"


def oracle_sql() -> dict[str, str]:
    o = oracle
    num = lambda c: f"CAST(nullif({c}, '') AS double)"
    return {
        "paper_risk": _risk_sql(True),
        "paper_risk_unweighted": _risk_sql(False),
        "figure_evidence": o("v_findings", f", {_evidence_sql(True)} SELECT paper_id, fk AS figure_id, conv AS converging, nf AS methods_flagged, sev AS severity_rank, round(conf + CAST(1e-9 AS double), 5) AS confidence FROM h"),
        "passing_findings": o("v_findings", f"SELECT method, count(*) AS findings FROM v_findings WHERE confidence >= CAST(0.6 AS double) AND {W} >= CAST(0.3 AS double) GROUP BY method"),
        "compression_discount": o("v_findings", "SELECT method, round(avg(CASE WHEN figure_id IS NOT NULL AND method IN ('ela', 'noise_analysis', 'dct_analysis', 'jpeg_ghost', 'fft_analysis') THEN confidence * CAST(0.5 AS double) ELSE confidence END), 6) AS confidence FROM v_findings GROUP BY method"),
        "methods_summary": o("v_findings", "SELECT method, count(*) AS total, count(*) FILTER (severity IN ('critical', 'high', 'medium')) AS issues FROM v_findings GROUP BY method"),
        "grim": o("v_means", "SELECT id, n < 2 OR abs(mean * n - round_even(mean * n, 0)) <= CAST(0.5 AS double) / CAST(100 AS double) AS consistent FROM v_means"),
        "grimmer_bounds": o("v_means", GRIM_BOUNDS),
        "benford": o("v_values", f", {BY_DIGIT}, x AS (SELECT n.group_id, CAST(n.n AS bigint) AS n, n.n * log10(1 + CAST(1 AS double) / k) AS e, coalesce(c.o, 0) AS o FROM n CROSS JOIN (SELECT unnest(range(1, 10)) AS k) LEFT JOIN c ON c.group_id = n.group_id AND c.digit = k) SELECT group_id, n, round(sum((o - e) * (o - e) / e), 6) AS chi_square, sum((o - e) * (o - e) / e) <= CAST(26.12448155837614 AS double) AS conforms FROM x GROUP BY ALL"),
        "terminal_digit": o("v_values", f", d AS (SELECT group_id, {LAST_DIGIT} AS digit FROM (SELECT *, printf('%.15g', abs(value)) AS t FROM v_values)), c AS (SELECT group_id, digit, count(*) AS o FROM d GROUP BY ALL), s AS (SELECT group_id, CAST(sum(o) AS bigint) AS n, sum(o * o) * CAST(10 AS double) / sum(o) - sum(o) AS x FROM c GROUP BY ALL) SELECT group_id, n, round(x, 6) AS chi_square, n >= 10 AND x > CAST(21.665994333461924 AS double) AS suspicious FROM s"),
        "exponential_fit": o("v_values", ", s AS (SELECT group_id, count(*) AS n, avg(value) AS m, min(value) AS lo, stddev_pop(value) AS s FROM v_values GROUP BY group_id), f AS (SELECT group_id, n, row_number() OVER (PARTITION BY group_id ORDER BY value) AS i, 1 - exp(-(value - lo) / (m - lo)) AS f, 1 - exp(-value / m) AS g FROM v_values JOIN s USING (group_id) WHERE n >= 5 AND s > 0), a AS (SELECT group_id, max(n) AS n, max(greatest(i / CAST(n AS double) - f, f - (i - 1) / CAST(n AS double))) AS ks, -max(n) - sum((2 * i - 1) * ln(greatest(g, CAST(1e-300 AS double))) + (2 * n + 1 - 2 * i) * ln(greatest(1 - g, CAST(1e-300 AS double)))) / max(n) AS anderson FROM f GROUP BY group_id) SELECT group_id, n, round(ks, 6) AS ks, round(round(anderson, 6), 3) AS anderson, anderson > CAST(1.341 AS double) / (1 + CAST(0.6 AS double) / n) AS exceeds FROM a"),
        "priority": o("v_priority", f"SELECT paper_id, {PRIORITY} AS priority_score FROM v_priority"),
        "pending_queue": o("v_priority", f", q AS (SELECT paper_id, {PRIORITY} AS priority_score FROM v_priority WHERE status = 'pending' AND pdf_path IS NOT NULL) SELECT * FROM q ORDER BY priority_score DESC NULLS LAST, paper_id LIMIT 50"),
        "auto_risk_score": o("v_findings", f", kinds AS (SELECT DISTINCT paper_id, method FROM v_findings), p AS (SELECT paper_id, sum({D.case_sql('method', D.AUTO_RISK_WEIGHTS, 0)}) AS p FROM kinds GROUP BY paper_id) SELECT o_orderkey AS paper_id, CAST(least(coalesce(p, 0) + CASE WHEN o_orderkey % 31 = 0 THEN 30 ELSE 0 END + CASE WHEN o_orderkey % 97 = 0 THEN 20 ELSE 0 END + CASE WHEN o_custkey % 50 = 0 THEN 10 ELSE 0 END, 100) AS bigint) AS auto_risk_score FROM orders LEFT JOIN p ON paper_id = o_orderkey"),
        "coauthor_edges": o("v_links", f", {EDGES} SELECT * FROM e"),
        "author_network_risk": o("v_links", f""", {EDGES}, ways AS (SELECT author_a AS author_id, author_b AS other FROM e UNION ALL SELECT author_b, author_a FROM e), n AS (SELECT w.author_id, count(*) AS coauthors, count(*) FILTER (v.flagged_papers > 0) AS flagged_coauthors FROM ways w JOIN v_authors v ON v.author_id = w.other GROUP BY ALL),
            r AS (SELECT v.author_id, total_papers, flagged_papers, retraction_count, coalesce(coauthors, 0) AS coauthors, coalesce(flagged_coauthors, 0) AS flagged_coauthors FROM v_authors v LEFT JOIN n ON n.author_id = v.author_id)
            SELECT author_id, total_papers, CAST(flagged_papers AS bigint) AS flagged_papers, CAST(retraction_count AS bigint) AS retraction_count, coauthors, flagged_coauthors, risk_score FROM (SELECT *, round(least(least(CAST(flagged_papers AS double) / total_papers * 100, CAST(40 AS double)) + least(CAST(retraction_count AS double) * 10, CAST(30 AS double)) + CASE WHEN coauthors > 0 THEN least(CAST(flagged_coauthors AS double) / coauthors * 30, CAST(15 AS double)) ELSE CAST(0 AS double) END, CAST(100 AS double)), 6) AS risk_score FROM r) WHERE risk_score > 20""", "v_authors"),
        "temporal_patterns": o("v_timeline", """, t AS (SELECT author_id, CAST(floor(epoch(ts)) AS bigint) AS s FROM v_timeline), r AS (SELECT author_id, s, CAST(floor((s - lag(s) OVER w) / CAST(86400 AS double)) AS bigint) AS gap, count(*) OVER (PARTITION BY author_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 15724800 FOLLOWING) AS ahead FROM t WINDOW w AS (PARTITION BY author_id ORDER BY s)),
            g AS (SELECT author_id, count(*) AS n, min(gap) AS min_gap, count(*) FILTER (gap < 14) AS fast_intervals, max(ahead) AS most_in_half_year, floor((max(s) - min(s)) / CAST(86400 AS double)) AS days FROM r GROUP BY author_id), x AS (SELECT *, n / greatest(days / CAST(365.25 AS double), CAST(0.1 AS double)) AS r0 FROM g WHERE n >= 5)
            SELECT author_id, n, min_gap, fast_intervals, most_in_half_year, round(r0, 6) AS rate, most_in_half_year > 3 * r0 / 2 AS spike, (min_gap < 14 AND fast_intervals >= 3) OR most_in_half_year > 3 * r0 / 2 OR r0 > 20 AS suspicious FROM x"""),
        "latest_stage": o("v_log", "SELECT paper_id, max_by(stage, completed_at) AS stage, max(completed_at) AS completed_at FROM v_log WHERE status = 'completed' GROUP BY paper_id"),
        "similar_pairs": HASHES + "SELECT * FROM v_pairs",
        "cross_paper_duplicates": HASHES + "SELECT * FROM v_pairs WHERE paper_id_a <> paper_id_b",
        "intra_paper_pairs": HASHES + "SELECT * FROM v_pairs WHERE paper_id_a = paper_id_b",
        "incremental_scan": HASHES + f"SELECT a.figure_id AS figure_id_a, a.paper_id AS paper_id_a, b.figure_id AS figure_id_b, b.paper_id AS paper_id_b, CAST(hamming(a.bits, b.bits) AS int) AS distance FROM v_bits a JOIN v_bits b ON a.figure_id <> b.figure_id WHERE a.figure_id % 10 = 0 AND hamming(a.bits, b.bits) <= {DISTANCE}",
        "bucketed_pairs": HASHES + "SELECT p.* FROM v_pairs p JOIN v_bits a ON a.figure_id = figure_id_a JOIN v_bits b ON b.figure_id = figure_id_b WHERE paper_id_a <> paper_id_b AND (left(a.bits, 4) = left(b.bits, 4) OR substr(a.bits, 5, 4) = substr(b.bits, 5, 4))",
        "top_matches": HASHES + "SELECT * FROM v_pairs ORDER BY distance, figure_id_a, figure_id_b LIMIT 50",
        "new_matches": HASHES + "SELECT * FROM v_pairs WHERE figure_id_a % 2 <> 0",
        "threshold_metrics": o("v_scores", f", {_confusion_sql('[0.3, 0.5, 0.6, 0.7, 0.8, 0.9]', 'method')} SELECT method, threshold, tp, tn, fp, fn, round(se, 6) AS sensitivity, round(sp, 6) AS specificity, round(pr, 6) AS precision, round(f, 6) AS f1 FROM k"),
        "roc_curve": o("v_scores", f", {_confusion_sql(HUNDRED, '')} SELECT threshold, round(1 - sp, 6) AS fpr, round(se, 6) AS tpr FROM k"),
        "auc": o("v_scores", f", {_confusion_sql(HUNDRED, 'method')}, s AS (SELECT method, ((1 - sp) - lag(1 - sp) OVER w) * (se + lag(se) OVER w) / 2 AS a FROM k WINDOW w AS (PARTITION BY method ORDER BY 1 - sp, threshold)) SELECT method, round(sum(a), 6) AS auc FROM s GROUP BY method"),
        "auto_tune": o("v_scores", f", {_confusion_sql(HUNDRED, 'method')}, b AS (SELECT method, threshold, f, row_number() OVER (PARTITION BY method ORDER BY f DESC, threshold) AS r FROM k WHERE sp >= CAST(0.95 AS double) AND f > 0) SELECT x.method, coalesce(threshold, CAST(0.5 AS double)) AS threshold, round(coalesce(f, CAST(0 AS double)), 6) AS f1 FROM (SELECT DISTINCT method FROM k) x LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON b.method = x.method"),
        "detection_rollup": o("v_scores", "SELECT sample_id, round(max(confidence), 6) AS max_confidence, count(DISTINCT method) AS methods, bool_or(label) AS label FROM v_scores GROUP BY sample_id"),
        "depth_filter": o("v_campaign", "SELECT paper_id, campaign_id, depth FROM v_campaign WHERE campaign_id = 1 AND depth = 1 AND triage_status = 'pending'"),
        "promotion_filter": o("v_campaign", "SELECT paper_id, auto_risk_score FROM v_campaign WHERE triage_status = 'auto_done' AND auto_risk_score >= 30"),
        "flagged_seeds": o("v_campaign", f"SELECT paper_id, depth, final_risk FROM v_campaign WHERE depth = 1 AND {FLAGGED}"),
        "expansion_tree": o("v_campaign", f"SELECT campaign_id, depth, count(*) AS papers, count(*) FILTER ({FLAGGED}) AS flagged FROM v_campaign GROUP BY ALL"),
        "risk_distribution": o("v_campaign", "SELECT campaign_id, final_risk, count(*) AS papers FROM v_campaign WHERE final_risk IS NOT NULL GROUP BY ALL"),
        "triage_breakdown": o("v_campaign", "SELECT campaign_id, triage_status, count(*) AS papers FROM v_campaign WHERE triage_status IS NOT NULL GROUP BY ALL"),
        "method_breakdown": o("v_findings", "SELECT campaign_id, method, count(*) AS findings FROM v_findings JOIN v_campaign USING (paper_id) GROUP BY ALL", "v_campaign"),
        "top_papers": o("v_campaign", "SELECT paper_id, auto_risk_score, final_risk FROM v_campaign WHERE final_risk IS NOT NULL ORDER BY auto_risk_score DESC, paper_id LIMIT 20"),
        "latest_report": o("v_timeline", "SELECT author_id, ts, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY ts DESC, paper_id DESC) AS r FROM v_timeline) WHERE r = 1"),
        "campaign_export": o("v_campaign", "SELECT paper_id, final_risk, CASE final_risk WHEN 'critical' THEN 0 ELSE 1 END AS rank FROM v_campaign WHERE final_risk IN ('critical', 'high', 'medium')"),
        "expansion_caps": o("v_links", ", a AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY author_id) AS ra FROM (SELECT DISTINCT author_id, paper_id FROM v_links)), b AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY paper_id) AS rp FROM a WHERE ra <= 2) SELECT author_id, paper_id FROM b WHERE rp <= 3"),
        "matched_scores": o("v_campaign", f"SELECT paper_id, CASE WHEN paper_id IN ({MATCHED}) AND triage_status NOT IN ('llm_queued', 'llm_analyzing', 'complete') THEN least(auto_risk_score + 30, CAST(100 AS double)) ELSE auto_risk_score END AS auto_risk_score FROM v_campaign"),
        "extract_means": o("v_sentences", f"""SELECT id, CAST(g1 AS double) AS mean, CAST(g2 AS bigint) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '{MEANS}', 1)) AS g1, unnest(regexp_extract_all(t, '{MEANS}', 2)) AS g2 FROM (SELECT id, regexp_replace(text, ' \\(SD = [^)]*\\)', '') AS t FROM v_sentences))"""),
        "extract_mean_sd": o("v_sentences", " UNION ALL ".join(f"SELECT id, CAST(g1 AS double) AS mean, CAST(g2 AS double) AS sd, coalesce(CAST(nullif(g3, '') AS bigint), 0) AS n FROM {_each(p, 3)}" for p in MEAN_SDS)),
        "extract_tests": o("v_sentences", f"SELECT id, 't' AS test_type, {num('g2')} AS statistic, g1 AS df, {num('g3')} AS p FROM {_each(T3, 3)} UNION ALL SELECT id, 'F', {num('g3')}, concat(g1, ',', g2), {num('g4')} FROM {_each(F4, 4)} UNION ALL SELECT id, 'chi2', {num('g2')}, g1, {num('g3')} FROM {_each(C3, 3)} UNION ALL SELECT id, 'r', {num('g1')}, '', {num('g2')} FROM {_each(R2, 2)}"),
        "extract_p_values": o("v_sentences", f"SELECT id, g1 AS comparison, CAST(g2 AS double) AS value FROM {_each(P2, 2)}"),
        "statistic_contexts": o("v_sentences", f"SELECT * FROM {_contexts(T3, 't')} UNION ALL SELECT * FROM {_contexts(F4, 'F')}"),
        "extract_decimals": o("v_sentences", f"SELECT id, count(*) AS k, round(sum(CAST(g1 AS double)), 4) AS total FROM {_each(D1, 1)} GROUP BY id"),
        "duplicate_values": o("v_cells", DUPLICATES),
        "remaining_stages": o("v_log", f", l AS (SELECT paper_id, max_by(stage, completed_at) AS stage FROM v_log WHERE status = 'completed' GROUP BY paper_id), r AS (SELECT paper_id, {STAGE_LIST} AS names, coalesce(list_position({STAGE_LIST}, stage), 0) AS done FROM l) SELECT paper_id, names[done + 1] AS next_stage, CAST(len(names) - done AS int) AS remaining FROM r"),
        "exact_hash_index": HASHES + ", h AS (SELECT *, CONCAT(lower(lpad(to_hex(CAST(left(bits, 32) AS bit)::bigint), 8, '0')), lower(lpad(to_hex(CAST(right(bits, 32) AS bit)::bigint), 8, '0'))) AS phash FROM v_bits) SELECT phash, count(*) AS figures, count(DISTINCT paper_id) AS papers, min(figure_id) AS first_figure FROM h GROUP BY phash HAVING count(*) > 1",
        "hash_clusters": HASHES.replace("WITH ", "WITH RECURSIVE ", 1) + ", ways AS (SELECT figure_id_a AS x, figure_id_b AS y FROM v_pairs UNION SELECT figure_id_b, figure_id_a FROM v_pairs), reach(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON r.y = w.x), parts AS (SELECT x AS node, least(x, min(y)) AS component FROM reach GROUP BY x), sized AS (SELECT component, count(*) AS figures FROM parts GROUP BY component), near AS (SELECT component, min(distance) AS min_distance FROM v_pairs JOIN parts ON node = figure_id_a GROUP BY component) SELECT component, figures, min_distance, CASE WHEN min_distance <= 2 THEN 'critical' WHEN min_distance <= 5 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN min_distance <= 2 THEN CAST(0.95 AS double) WHEN min_distance <= 5 THEN CAST(0.8 AS double) ELSE CAST(0.6 AS double) END AS confidence FROM sized JOIN near USING (component)",
        "phrase_hits": f"WITH {PHRASES} SELECT doc_id, phrase, count(*) AS hits FROM met GROUP BY ALL",
        "phrase_screening": f"WITH {PHRASES} SELECT doc_id, count(DISTINCT phrase) AS unique_phrases, count(*) AS total_hits, count(DISTINCT phrase) >= 2 AS suspicious FROM met GROUP BY doc_id",
        "sd_ratio": o("v_sd_n", ", g AS (SELECT table_id, count(*) AS k, sum((n - 1) * sd * sd) AS ss, sum(n - 1) AS df, var_samp(sd) AS observed, sum(1 / (CAST(2 AS double) * n)) AS inv FROM v_sd_n GROUP BY table_id) SELECT table_id, k, CASE WHEN k < 3 THEN NULL ELSE round(observed / (ss / df * inv / k), 6) END AS ratio FROM g"),
        "large_figures": o("v_figures", "SELECT figure_id, width, height FROM v_figures WHERE coalesce(width, 999) >= 100 AND coalesce(height, 999) >= 100"),
        "blot_figures": o("v_figures", "SELECT figure_id, image_type FROM v_figures WHERE lower(image_type) IN ('western_blot', 'gel')"),
        "coauthors": o("v_links", ", once AS (SELECT DISTINCT author_id, paper_id FROM v_links), m AS (SELECT DISTINCT a.author_id AS of_author, b.author_id FROM once a JOIN once b ON a.paper_id = b.paper_id AND a.author_id <> b.author_id) SELECT of_author, m.author_id, CAST(flagged_papers AS bigint) AS flagged_papers FROM m JOIN v_authors v ON v.author_id = m.author_id", "v_authors"),
        "described_matches": HASHES + ", " + ", ".join(o(x, "")[5:].rstrip() for x in ("v_papers", "v_figures")) + " SELECT p.*, coalesce(x.title, 'Unknown') AS title_a, coalesce(f.figure_label, '') AS label_a, coalesce(y.title, 'Unknown') AS title_b, coalesce(g.figure_label, '') AS label_b FROM v_pairs p LEFT JOIN v_papers x ON x.paper_id = paper_id_a LEFT JOIN v_papers y ON y.paper_id = paper_id_b LEFT JOIN v_figures f ON f.figure_id = figure_id_a LEFT JOIN v_figures g ON g.figure_id = figure_id_b",
        "labelled_findings": o("v_findings", "SELECT paper_id, seq, figure_id, CASE figure_id WHEN 'fig0' THEN 'Figure 1' WHEN 'fig1' THEN 'Figure 2' END AS figure_label FROM v_findings"),
        "new_members": o("v_links", "SELECT DISTINCT author_id % 5 AS campaign_id, paper_id FROM v_links l WHERE NOT EXISTS (SELECT 1 FROM v_campaign c WHERE c.paper_id = l.paper_id AND c.campaign_id = l.author_id % 5)", "v_campaign"),
        "upserted_papers": o("v_incoming", ", k AS (SELECT doi, min(CAST(paper_id AS varchar)) AS known FROM v_papers WHERE doi IS NOT NULL GROUP BY doi) SELECT i.doi, row_id, coalesce(known, concat('new-', coalesce(i.doi, CAST(row_id AS varchar)))) AS id, known IS NULL AS is_new FROM v_incoming i LEFT JOIN k ON k.doi = i.doi", "v_papers"),
        "status_counts": o("v_papers", "SELECT status, count(*) AS papers, CAST((SELECT count(*) FROM v_papers) AS bigint) AS total FROM v_papers GROUP BY status"),
        "hash_page": HASHES + "SELECT figure_id, paper_id FROM v_bits WHERE figure_id > 100 ORDER BY figure_id LIMIT 500",
        "statistics_summary": o("v_sentences", f", k AS (SELECT id, 'm' AS k FROM {_each(MEANS, 2)} UNION ALL SELECT id, 't' FROM {_each(T3, 3)} UNION ALL SELECT id, 't' FROM {_each(F4, 4)} UNION ALL SELECT id, 't' FROM {_each(C3, 3)} UNION ALL SELECT id, 't' FROM {_each(R2, 2)} UNION ALL SELECT id, 'p' FROM {_each(P2, 2)} UNION ALL SELECT id, 'd' FROM {_each(D1, 1)}) SELECT id, count(*) FILTER (k = 'm') AS means, count(*) FILTER (k = 't') AS tests, count(*) FILTER (k = 'p') AS p_values, count(*) FILTER (k = 'd') AS decimals FROM k GROUP BY id"),
        "grim_rollup": o("v_means", ", f AS (SELECT id % 2000 AS paper_id, count(*) AS failures FROM v_means WHERE NOT (n < 2 OR abs(mean * n - round_even(mean * n, 0)) <= CAST(0.5 AS double) / CAST(100 AS double)) GROUP BY ALL) SELECT paper_id, failures, 'grim' AS method, CASE WHEN failures >= 3 THEN 'high' WHEN failures = 2 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN failures >= 3 THEN CAST(0.7 AS double) WHEN failures = 2 THEN CAST(0.6 AS double) ELSE CAST(0.45 AS double) END AS confidence FROM f"),
        "exported_reports": o("v_campaign", ", r AS (SELECT paper_id % 9000 AS paper_id, author_id AS report_id, ts AS created_at FROM v_timeline), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, report_id DESC) AS k FROM r) WHERE k = 1) SELECT c.paper_id, final_risk, report_id FROM v_campaign c LEFT JOIN l ON l.paper_id = c.paper_id WHERE final_risk IN ('critical', 'high', 'medium')", "v_timeline"),
    }
