"""Priorities, triage scores and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import domain as D


def priority(year_now: int = 2026) -> Column:
    """0 to 100 from citations, journal quartile, influence, h-index and flags of a paper's columns."""
    log = lambda c, top: F.when(F.col(c) > 0, F.log10(F.least(F.col(c), F.lit(top)))).otherwise(0.0)
    quartile = D.lookup(F.col("quartile"), {1: 1.0, 2: 0.75, 3: 0.5, 4: 0.25}, 0.25)
    age = F.greatest(F.least(F.lit(year_now) - F.col("year"), F.lit(20)), F.lit(0)) / 20.0
    flag = lambda c, no: F.when(F.col(c), 1.0).otherwise(no)
    return (
        0.25 * log("citations", 10_000) / 4.0 + 0.20 * quartile + 0.15 * log("influential", 1000) / 3.0
        + 0.10 * F.least("h_index", F.lit(80)) / 80.0 + 0.10 * flag("open_data", 0.3) + 0.10 * flag("retraction", 0.0)
        + 0.05 * age + 0.05 * flag("has_images", 0.5)
    ) * 100


def auto_risk(findings: DataFrame, papers: DataFrame, matched: DataFrame) -> DataFrame:
    """Additive triage score: each distinct method once, a hash match, a retraction, comments; 100 at most."""
    kinds = findings.select("paper_id", "method").distinct()
    points = kinds.withColumn("p", D.lookup(F.col("method"), D.AUTO_RISK_WEIGHTS, 0)).groupBy("paper_id").agg(F.sum("p").alias("p"))
    hits = matched.select("paper_id").distinct().withColumn("hit", F.lit(True))
    j = papers.join(points, "paper_id", "left").join(hits, "paper_id", "left")
    score = F.coalesce("p", F.lit(0)) + F.when(F.col("hit"), 30).otherwise(0) + F.when(F.col("retraction_status").isin("retraction", "expression_of_concern"), 20).otherwise(0) + F.when(F.col("pubpeer_comments") > 0, 10).otherwise(0)
    return j.select("paper_id", F.least(score, F.lit(100)).cast("long").alias("auto_risk_score"))


def confusion(samples: DataFrame, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """tp, tn, fp, fn at every threshold in one pass: a score counts at all thresholds up to it."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    hit = F.col("confidence") >= F.col("threshold")
    # one row a distinct (group, score, label) goes through the thresholds, not one a sample
    few = samples.groupBy(*by, "confidence", "label").agg(F.count("*").alias("k")).withColumn("threshold", t)
    s = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    return few.groupBy(*by, "threshold").agg(s(hit & F.col("label")).alias("tp"), s(~hit & ~F.col("label")).alias("tn"), s(hit & ~F.col("label")).alias("fp"), s(~hit & F.col("label")).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    over = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    m = counts.withColumns({"sensitivity": over("tp", "fn"), "specificity": over("tn", "fp"), "precision": over("tp", "fp")})
    p, r = F.col("precision"), F.col("sensitivity")
    return m.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-10)))


def roc(samples: DataFrame, by: list[str] = (), points: int = 100) -> DataFrame:
    m = metrics(confusion(samples, [k / points for k in range(points + 1)], by))
    return m.select(*by, "threshold", (1 - F.col("specificity")).alias("fpr"), F.col("sensitivity").alias("tpr"))


def auc(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """Trapezoids over the curve by false-positive rate, equal rates by threshold."""
    w = Window.partitionBy(*[F.col(b) for b in by], F.lit(1)).orderBy("fpr", "threshold")
    step = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return curve.withColumn("step", step).groupBy(*by).agg(F.round(F.sum("step"), 6).alias("auc"))


def auto_tune(m: DataFrame, by: str = "method", least_specificity: float = 0.95) -> DataFrame:
    """The threshold of the best F1 with enough specificity; the lowest of equals; .5 if there is none."""
    good = F.when((F.col("specificity") >= least_specificity) & (F.col("f1") > 0), F.struct("f1", (-F.col("threshold")).alias("t")))
    return m.groupBy(by).agg(F.max(good).alias("best")).select(by, F.coalesce(-F.col("best.t"), F.lit(0.5)).alias("threshold"), F.round(F.coalesce("best.f1", F.lit(0.0)), 6).alias("f1"))


def detection_rollup(samples: DataFrame) -> DataFrame:
    """Per sample: strongest confidence, methods, whether anything was detected."""
    return samples.groupBy("sample_id").agg(F.max("confidence").alias("max_confidence"), F.count_distinct("method").alias("methods"), F.max("label").alias("label"))


def expectation_met(expected: Column, n_findings: Column, risk: Column) -> Column:
    """Whether a labelled sample passes: findings with a risk that counts, or clean without alarm."""
    return F.when(expected == "findings", (n_findings > 0) & risk.isin("medium", "high", "critical")).when(expected == "clean", (n_findings == 0) | ~risk.isin("critical", "high")).otherwise(True)
