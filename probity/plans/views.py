"""Views that give the driver's tables the shape of papers, findings, authors, hashes and so on.

The text is valid in Spark and in DuckDB; ``{table}`` stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

METHODS = ["ela", "clone_detection", "noise_analysis", "phash", "grim", "pvalue_check", "benford", "fft_analysis", "tortured_phrases", "variance_ratio", "unlisted_method", "dct_analysis"]
SEVERITIES = ["critical", "high", "medium", "low"]


def _case(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


VIEWS = {
    "v_findings": f"""SELECT l_orderkey AS paper_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
        CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat('fig', CAST(l_linenumber % 3 AS varchar(9))) END AS figure_id,
        {_case("l_partkey % 12", METHODS)} AS method, {_case("l_suppkey % 4", SEVERITIES)} AS severity,
        CAST(CAST(l_quantity AS int) % 50 AS double) / CAST(50 AS double) AS confidence FROM {{lineitem}}""",
    "v_links": "SELECT l_partkey AS author_id, l_orderkey AS paper_id FROM {lineitem}",
    "v_authors": "SELECT l_partkey AS author_id, count(*) AS total_papers, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS flagged_papers, sum(CASE WHEN l_discount >= CAST(0.09 AS double) THEN 1 ELSE 0 END) AS retraction_count FROM {lineitem} GROUP BY l_partkey",
    "v_timeline": "SELECT o_custkey AS author_id, o_orderkey AS paper_id, o_orderdate AS ts FROM {orders}",
    "v_values": "SELECT l_suppkey AS group_id, l_extendedprice AS value FROM {lineitem}",
    "v_cells": "SELECT l_orderkey AS table_id, l_linenumber * 10 + k AS pos, CASE k WHEN 0 THEN CAST(CAST(l_quantity AS int) AS varchar(20)) WHEN 1 THEN concat('0.', CAST(CAST(round(l_discount * 100) AS int) AS varchar(20))) ELSE concat('0.', CAST(CAST(round(l_tax * 100) AS int) AS varchar(20))) END AS cell FROM {lineitem} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) AS three",
    "v_means": "SELECT o_orderkey AS id, CAST(o_orderkey % 700 AS double) / CAST(100 AS double) AS mean, CAST(2 + o_custkey % 60 AS int) AS n, CAST(o_orderkey % 250 AS double) / CAST(100 AS double) AS sd FROM {orders}",
    "v_sd_n": "SELECT o_custkey AS table_id, CAST(1 + o_orderkey % 90 AS double) / CAST(30 AS double) AS sd, CAST(5 + o_orderkey % 40 AS int) AS n FROM {orders}",
    "v_tests": "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 't' WHEN 1 THEN 'F' WHEN 2 THEN 'chi2' ELSE 'r' END AS test_type, CASE WHEN o_orderkey % 4 = 3 THEN CAST(o_custkey % 95 AS double) / CAST(100 AS double) ELSE CAST(o_custkey % 600 AS double) / CAST(100 AS double) END AS statistic, CAST(1 + o_orderkey % 7 AS int) AS df1, CAST(5 + o_custkey % 50 AS int) AS df2, CAST(o_orderkey % 1000 AS double) / CAST(1000 AS double) AS reported_p FROM {orders}",
    "v_sentences": "SELECT o_orderkey AS id, concat('We saw M = ', CAST(o_orderkey % 9 AS varchar(9)), '.', CAST(10 + o_custkey % 90 AS varchar(9)), ' (SD = ', CAST(o_custkey % 4 AS varchar(9)), '.', CAST(10 + o_orderkey % 90 AS varchar(9)), '), N = ', CAST(5 + o_custkey % 80 AS varchar(9)), ' there; t(', CAST(3 + o_orderkey % 60 AS varchar(9)), ') = ', CAST(o_orderkey % 5 AS varchar(9)), '.', CAST(10 + o_orderkey % 80 AS varchar(9)), ', p = .0', CAST(1 + o_orderkey % 9 AS varchar(9)), ' and F(2, ', CAST(9 + o_custkey % 50 AS varchar(9)), ') = 4.', CAST(10 + o_custkey % 80 AS varchar(9)), '; (p < 0.05). ', CASE o_orderkey % 8 WHEN 0 THEN 'M = .5, N = 20' WHEN 1 THEN 'p = -0.5 or p < .05' WHEN 2 THEN 'r(28) = 0.40 and r = -.31, p = .04' WHEN 3 THEN 'chi2(2, N = 30) = 4.1; chi2(3) = 7.25, p < .01' WHEN 4 THEN 'mean = 2.5 [SD = 0.75]' WHEN 5 THEN '3.45 ± 1.20 (N = 30)' WHEN 6 THEN 'mean ± SD: 4.10 ± 0.55, N = 12' ELSE 'mean=3.1;n=7' END, '.') AS text FROM {orders}",
    "v_figures": "SELECT p_partkey AS figure_id, CAST(p_partkey % 50 AS bigint) AS paper_id, concat('Figure ', CAST(p_partkey % 9 AS varchar(9))) AS figure_label, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size * 8 AS int) END AS width, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size * 6 AS int) END AS height, CASE p_partkey % 5 WHEN 0 THEN 'Western_Blot' WHEN 1 THEN 'GEL' WHEN 2 THEN 'photo' WHEN 3 THEN 'plot' ELSE NULL END AS image_type FROM {part}",
    "v_papers": "SELECT o_orderkey AS paper_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Paper ', CAST(o_orderkey AS varchar(20))) END AS title, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE concat('10.1000/', CAST(o_custkey AS varchar(20))) END AS doi, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE NULL END AS status FROM {orders}",
    "v_incoming": "SELECT c_custkey AS row_id, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('10.1000/', CAST(c_custkey * 2 AS varchar(20))) END AS doi FROM {customer}",
    "v_scores": "SELECT d.doc_id AS sample_id, CASE d.doc_id % 3 WHEN 0 THEN 'ela' WHEN 1 THEN 'noise_analysis' ELSE 'grim' END AS method, least(CAST(1 AS double), CAST(d.n_chars AS double) / CAST(5000 AS double)) AS confidence, (l.quality = 0 OR l.toxic = 1) AS label FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
    "v_log": "SELECT event_id, user_id AS paper_id, ts AS completed_at, CASE event_type WHEN 'click' THEN 'download' WHEN 'view' THEN 'extract_text' WHEN 'purchase' THEN 'aggregate' WHEN 'signup' THEN 'discover' ELSE 'report' END AS stage, CASE WHEN value > 50 THEN 'completed' ELSE 'failed' END AS status FROM {events}",
    "v_campaign": "SELECT o_orderkey AS paper_id, o_custkey % 5 AS campaign_id, CAST(o_custkey % 3 AS int) AS depth, CASE o_orderpriority WHEN '1-URGENT' THEN 'auto_done' WHEN '2-HIGH' THEN 'complete' WHEN '3-MEDIUM' THEN 'pending' WHEN '5-LOW' THEN 'dismissed' ELSE 'llm_queued' END AS triage_status, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'clean' WHEN 'P' THEN 'critical' ELSE NULL END AS final_risk, CAST(o_orderkey * 7 % 101 AS double) AS auto_risk_score, o_orderdate AS created_at FROM {orders}",
    "v_priority": "SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 4 = 0 THEN 'downloaded' ELSE 'pending' END AS status, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('/p/', CAST(c_custkey AS varchar(20))) END AS pdf_path, CAST(c_custkey * 13 % 900 AS int) AS citations, CAST(c_nationkey % 4 + 1 AS int) AS quartile, CAST(c_custkey % 40 AS int) AS influential, CAST(c_custkey % 90 AS int) AS h_index, c_custkey % 2 = 0 AS open_data, c_custkey % 9 = 0 AS retraction, CAST(1995 + c_nationkey AS int) AS year, c_custkey % 3 = 0 AS has_images FROM {customer}",
}


def tables(name: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", VIEWS[name]))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(name)}
    return spark.sql(VIEWS[name], **frames)


def oracle(name: str, body: str, *more: str) -> str:
    """DuckDB text: the views' definitions, then ``body``."""
    ctes = ", ".join(f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in (name, *more))
    return f"WITH {ctes}{body}" if body.startswith(",") else f"WITH {ctes} {body}"
