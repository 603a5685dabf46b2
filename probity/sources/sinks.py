"""Sinks: findings, logs, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_findings(findings: DataFrame, path: str) -> None:
    """Appends findings; a struct of evidence is stored as JSON."""
    kinds = dict(findings.dtypes)
    if kinds.get("evidence", "").startswith(("struct", "map")):
        findings = findings.withColumn("evidence_json", F.to_json("evidence")).drop("evidence")
    findings.write.mode("append").parquet(path)


def metrics_csv(metrics: DataFrame, path: str) -> None:
    """Metrics with fixed digits, overall rows last."""
    four = {c: F.format_string("%.4f", c) for c in ("sensitivity", "specificity", "precision", "f1")}
    out = metrics.withColumn("last", (F.col("method") == "overall").cast("int")).orderBy("last", "method", "threshold").drop("last")
    out.withColumns(four).withColumn("threshold", F.format_string("%.2f", "threshold")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_markdown(papers: DataFrame, findings: DataFrame) -> DataFrame:
    """(paper_id, report_markdown): each paper's risk, and its findings by severity."""
    rank = F.expr("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END")
    line = F.format_string("- **%s** (%s, %d%%)", F.coalesce("method", F.lit("")), F.coalesce("severity", F.lit("low")), F.round(F.coalesce("confidence", F.lit(0.0)) * 100).cast("int"))
    per = findings.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.col("seq"), line.alias("line")))).alias("lines"))
    j = papers.join(per, "paper_id", "left")
    body = F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<rank:int,seq:int,line:string>>")), lambda x: x["line"]), "\n")
    return j.select("paper_id", F.concat(F.lit("# Paper "), F.col("paper_id").cast("string"), F.lit("\n\nRisk: "), F.col("risk"), F.lit("\n\n"), body).alias("report_markdown"))
