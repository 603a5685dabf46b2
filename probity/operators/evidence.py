"""Evidence aggregation: findings to figures to papers (the flagship)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions import domain as D


def effective_method(method: Column, analysis_type: Column | None = None) -> Column:
    """The method, else the analysis type, else the empty text."""
    second = F.lit(None).cast("string") if analysis_type is None else F.nullif(analysis_type, F.lit(""))
    return F.coalesce(F.nullif(method, F.lit("")), second, F.lit(""))


def compression_discount(findings: DataFrame, from_pdf: str) -> DataFrame:
    """Halves the confidence of methods that re-compression misleads, on figures out of a PDF."""
    hit = F.col(from_pdf) & F.col("method").isin(D.COMPRESSION_METHODS)
    return findings.withColumn("confidence", F.when(hit, F.col("confidence") * 0.5).otherwise(F.col("confidence")))


def passing_findings(findings: DataFrame, threshold: float = 0.6, weights: dict | None = D.WEIGHTS) -> DataFrame:
    """Findings that can flag a method: confident, of weight, with a method."""
    keep = (F.coalesce("confidence", F.lit(0.0)) >= threshold) & (effective_method(F.col("method")) != "")
    if weights is not None:
        keep = keep & (D.method_weight(F.col("method"), weights) >= 0.3)
    return findings.filter(keep)


def _weighted(findings: DataFrame, weights: dict | None) -> DataFrame:
    m = effective_method(F.col("method"))
    w = F.lit(1.0) if weights is None else D.method_weight(m, weights)
    return findings.select(
        "paper_id",
        F.coalesce(F.nullif("figure_id", F.lit("")), F.concat(F.lit("_paper_finding_"), F.col("seq").cast("string"))).alias("fk"),
        F.nullif(m, F.lit("")).alias("m"),
        F.coalesce("confidence", F.lit(0.0)).alias("c"),
        w.alias("w"),
        D.severity_rank(F.col("severity")).alias("sr"),
    )


def _figures(findings: DataFrame, weights: dict | None, threshold: float) -> DataFrame:
    """One partial-aggregated pass: distinct methods first, so that counting them needs no expansion."""
    f = _weighted(findings, weights)
    heavy = F.lit(True) if weights is None else F.col("w") > 0.6
    some = F.lit(True) if weights is None else F.col("w") >= 0.3
    by_method = f.groupBy("paper_id", "fk", "m").agg(
        F.max("sr").alias("sr"), F.sum(F.col("c") * F.col("w")).alias("cw"), F.sum("w").alias("sw"), F.count("*").alias("k"),
        F.max((F.col("c") >= 0.5) & heavy & F.col("m").isNotNull()).cast("int").alias("boosts"),
        F.max((F.col("c") >= threshold) & some & F.col("m").isNotNull()).cast("int").alias("flags"),
    )
    code = F.when(F.col("m").isNotNull(), F.xxhash64("m"))  # numbers keep the aggregate in hash tables
    return by_method.groupBy("paper_id", "fk").agg(
        F.max("sr").alias("ms"), F.sum("cw").alias("cw"), F.sum("sw").alias("sw"), F.sum("k").alias("k"),
        F.sum("boosts").alias("nb"), F.sum("flags").alias("nf"), F.count("m").alias("nm"),
        F.min(code).alias("m_lo"), F.max(code).alias("m_hi"),
    )


def _confidence(cw: Column, sw: Column, methods: Column) -> Column:
    return F.least(F.when(sw == 0, 0.0).otherwise(cw / sw) + F.when(methods >= 2, 0.1).otherwise(0.0), F.lit(1.0))


def figure_evidence(findings: DataFrame, weights: dict | None = D.WEIGHTS, threshold: float = 0.6) -> DataFrame:
    """Per figure: severity and confidence, converging or capped for a single method."""
    g = _figures(findings, weights, threshold)
    boosted = F.when((F.col("nb") >= 2) & (F.col("ms") < 4), F.col("ms") + 1).otherwise(F.col("ms"))
    conf = _confidence(F.col("cw"), F.col("sw"), F.col("nm"))
    return g.select(
        "paper_id", F.col("fk").alias("figure_id"), (F.col("nf") >= 2).alias("converging"), F.col("nf").alias("methods_flagged"),
        F.when(F.col("nf") == 1, F.least(boosted, F.lit(2))).otherwise(boosted).alias("severity_rank"),
        F.when(F.col("nf") == 1, F.least(conf, F.lit(0.7))).otherwise(conf).alias("confidence"), "cw", "sw", "k", "m_lo", "m_hi",
    )


def paper_risk(findings: DataFrame, weights: dict | None = D.WEIGHTS, threshold: float = 0.6, papers: DataFrame | None = None) -> DataFrame:
    """Risk of each paper. A finding without a figure is a group of its own; papers without any
    finding (``papers``) are clean. Null confidence is 0, null severity low."""
    h = figure_evidence(findings, weights, threshold)
    p = h.groupBy("paper_id").agg(
        F.count_if((F.col("severity_rank") == 4) & F.col("converging")).alias("ncc"), F.count_if("converging").alias("nc"),
        F.count_if(F.col("methods_flagged") > 0).alias("figures_flagged"), F.count_if(F.col("severity_rank") == 4).alias("critical_count"),
        F.sum("cw").alias("cw"), F.sum("sw").alias("sw"), F.sum("k").alias("total_findings"),
        F.min("m_lo").alias("m_lo"), F.max("m_hi").alias("m_hi"),
    )
    out = p.withColumn("nm", F.when(F.col("m_lo") < F.col("m_hi"), 2).otherwise(1))  # only whether there are two methods counts
    risk = (
        F.when(F.col("ncc") > 0, "critical")
        .when((F.col("nc") > 0) & (F.col("figures_flagged") >= 2), "high")
        .when((F.col("figures_flagged") >= 3) & (F.col("nc") == 0), "medium")
        .when((F.col("figures_flagged") == 1) & (F.col("nc") > 0), "medium")
        .when(F.col("figures_flagged") >= 1, "low")
        .otherwise("clean")
    )
    out = out.select("paper_id", risk.alias("risk"), (F.col("nc") > 0).alias("converging"), "figures_flagged", "critical_count", "total_findings", F.round(_confidence(F.col("cw"), F.col("sw"), F.col("nm")) + 1e-9, 5).alias("confidence"))
    if papers is not None:
        out = papers.select("paper_id").join(out, "paper_id", "left").fillna({"risk": "clean", "converging": False, "figures_flagged": 0, "critical_count": 0, "total_findings": 0, "confidence": 0.0})
    return out


def severity_summary(findings: DataFrame) -> DataFrame:
    """Per method: findings and those that are issues (medium or worse), by name."""
    issue = F.col("severity").isin("critical", "high", "medium")
    return findings.groupBy("method").agg(F.count("*").alias("total"), F.count_if(issue).alias("issues")).orderBy("method")
