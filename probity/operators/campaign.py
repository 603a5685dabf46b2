"""Queues, campaign views and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import domain as D


def pending_queue(papers: DataFrame, limit: int, least: float = 0.0) -> DataFrame:
    """Pending papers with a file, most urgent first; null priorities come last."""
    q = papers.filter("status = 'pending' and pdf_path is not null")
    q = q.filter(F.col("priority_score") >= least) if least > 0 else q
    return q.orderBy(F.desc_nulls_last("priority_score"), "paper_id").limit(limit)


def at_depth(members: DataFrame, campaign: int, depth: int, status: str) -> DataFrame:
    return members.filter((F.col("campaign_id") == campaign) & (F.col("depth") == depth) & (F.col("triage_status") == status))


def promotable(members: DataFrame, threshold: float = 30.0) -> DataFrame:
    return members.filter((F.col("triage_status") == "auto_done") & (F.col("auto_risk_score") >= threshold))


def flagged_seeds(members: DataFrame, depth: int) -> DataFrame:
    """Papers one level up whose risk calls for expansion."""
    return members.filter((F.col("depth") == depth - 1) & F.col("final_risk").isin("critical", "high", "medium"))


def expansion_tree(members: DataFrame) -> DataFrame:
    return members.groupBy("campaign_id", "depth").agg(F.count("*").alias("papers"), F.count_if(F.col("final_risk").isin("critical", "high", "medium")).alias("flagged"))


def breakdown(members: DataFrame, column: str) -> DataFrame:
    return members.filter(F.col(column).isNotNull()).groupBy("campaign_id", column).agg(F.count("*").alias("papers"))


def method_breakdown(findings: DataFrame, members: DataFrame) -> DataFrame:
    """Findings by method over the papers of each campaign."""
    return findings.join(members.select("paper_id", "campaign_id").distinct(), "paper_id").groupBy("campaign_id", "method").agg(F.count("*").alias("findings"))


def top_papers(members: DataFrame, limit: int = 20) -> DataFrame:
    return members.filter("final_risk is not null").orderBy(F.desc("auto_risk_score"), "paper_id").limit(limit)


def latest_per_paper(reports: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest row of each key; of equal times the larger by the other columns."""
    rest = [c for c in reports.columns if c not in (key, ts)]
    return reports.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("r")).select(key, "r.*")


def at_least(members: DataFrame, risk: str) -> DataFrame:
    """Papers of at least a risk, worst first."""
    rank = D.lookup(F.col("final_risk"), {"critical": 0, "high": 1, "medium": 2, "low": 3}, 4)
    return members.withColumn("rank", rank).filter(F.col("rank") <= {"critical": 0, "high": 1, "medium": 2, "low": 3}.get(risk, 4))


def exported_reports(members: DataFrame, reports: DataFrame, risk: str) -> DataFrame:
    """Papers of at least a risk with their latest report, null where there is none."""
    return at_least(members, risk).join(latest_per_paper(reports.drop(*[c for c in members.columns if c not in ("paper_id", "created_at")]), "paper_id", "created_at").drop("created_at"), "paper_id", "left")


def capped_expansion(links: DataFrame, authors_per_paper: int = 20, papers_per_author: int = 50) -> DataFrame:
    """The first authors of a paper and the first papers of an author."""
    a = F.row_number().over(Window.partitionBy("paper_id").orderBy("author_id"))
    p = F.row_number().over(Window.partitionBy("author_id").orderBy("paper_id"))
    once = links.select("author_id", "paper_id").distinct()
    return once.withColumn("ra", a).filter(F.col("ra") <= authors_per_paper).withColumn("rp", p).filter(F.col("rp") <= papers_per_author).select("author_id", "paper_id")


def raise_matched_scores(members: DataFrame, matches: DataFrame, points: float = 30.0) -> DataFrame:
    """Adds the points of a hash match to papers that aren't with the language model yet; repeated
    scans add once, and 100 is the most."""
    hit = matches.select(F.explode(F.array("paper_id_a", "paper_id_b")).alias("paper_id")).distinct().withColumn("hit", F.lit(True))
    j = members.join(hit, "paper_id", "left")
    raised = F.when(F.coalesce("hit", F.lit(False)) & ~F.col("triage_status").isin("llm_queued", "llm_analyzing", "complete"), F.least(F.col("auto_risk_score") + points, F.lit(100.0)))
    return j.withColumn("auto_risk_score", F.coalesce(raised, F.col("auto_risk_score"))).drop("hit")
