"""Look-ups, upserts, queues and paging over the tables of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOTS = ("western_blot", "gel")
LEAST_SIDE, UNKNOWN_SIDE = 100, 999


def large_figures(figures: DataFrame) -> DataFrame:
    """Figures of at least 100 pixels on either side; an unknown side passes."""
    side = lambda c: F.coalesce(F.col(c), F.lit(UNKNOWN_SIDE)) >= LEAST_SIDE
    return figures.filter(side("width") & side("height"))


def blot_figures(figures: DataFrame) -> DataFrame:
    """Figures whose type calls for blot checks."""
    return figures.filter(F.lower("image_type").isin(*BLOTS))


def coauthors(links: DataFrame, authors: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(of_author, and the columns of each distinct author with whom they share a paper).

    For the authors of ``wanted`` (author_id), or for all in one go.
    """
    once = links.select("author_id", "paper_id").distinct()
    of = once if wanted is None else once.join(wanted.select("author_id").distinct(), "author_id", "left_semi")
    met = of.select(F.col("author_id").alias("of_author"), "paper_id").join(once, "paper_id").filter("author_id != of_author")
    return met.select("of_author", "author_id").distinct().join(authors, "author_id")


def described_matches(matches: DataFrame, papers: DataFrame, figures: DataFrame) -> DataFrame:
    """Hash matches with titles of both papers ("Unknown" if missing) and labels of both figures (empty
    if missing). The dimensions are joined by key; small ones are broadcast by the optimizer."""
    out = matches
    for s in ("a", "b"):
        p = papers.select(F.col("paper_id").alias(f"paper_id_{s}"), F.col("title").alias(f"title_{s}"))
        f = figures.select(F.col("figure_id").alias(f"figure_id_{s}"), F.col("figure_label").alias(f"label_{s}"))
        out = out.join(p, f"paper_id_{s}", "left").join(f, f"figure_id_{s}", "left")
        out = out.withColumns({f"title_{s}": F.coalesce(f"title_{s}", F.lit("Unknown")), f"label_{s}": F.coalesce(f"label_{s}", F.lit(""))})
    return out


def labelled_findings(findings: DataFrame, figures: DataFrame) -> DataFrame:
    """Findings with the label of their figure, null where there is none."""
    return findings.join(figures.select("figure_id", "figure_label"), "figure_id", "left")


def new_members(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates (campaign_id, paper_id) that aren't in their campaign yet, each once."""
    return candidates.dropDuplicates(["campaign_id", "paper_id"]).join(members.select("campaign_id", "paper_id"), ["campaign_id", "paper_id"], "left_anti")


def upserted_papers(incoming: DataFrame, papers: DataFrame, new_id: Column) -> DataFrame:
    """``incoming`` with the id of the paper that has its DOI, else ``new_id``; ``is_new`` tells which.

    Of several incoming rows with one DOI all get one id if ``new_id`` depends on the DOI alone; of
    several known papers with one DOI the least id counts. A null DOI is always new.
    """
    known = papers.filter("doi is not null").groupBy("doi").agg(F.min("id").alias("known_id"))
    met = incoming.join(known, "doi", "left")
    return met.withColumn("id", F.coalesce("known_id", new_id)).withColumn("is_new", F.col("known_id").isNull()).drop("known_id")


def status_counts(papers: DataFrame) -> DataFrame:
    """(status, papers, total): how many papers have each status, null included, and all in all."""
    each = papers.groupBy("status").agg(F.count("*").alias("papers"))
    return each.join(F.broadcast(each.agg(F.sum("papers").alias("total"))))


def page(rows: DataFrame, key: str, after=None, size: int = 500) -> DataFrame:
    """The rows after a key, in its order: a page that stays the same while rows are added behind it,
    and that doesn't scan those before it."""
    rest = rows if after is None else rows.filter(F.col(key) > after)
    return rest.orderBy(key).limit(size)


def stage_entry(rows: DataFrame, stage: str, status: str, at: Column | None = None) -> DataFrame:
    """Log rows for papers whose stage has begun, completed or failed; append them to the log."""
    if status not in ("started", "completed", "failed"):
        raise ValueError(f"unknown status {status}")
    at = F.current_timestamp() if at is None else at
    none = F.lit(None).cast("timestamp")
    return rows.select("paper_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), (at if status == "started" else none).alias("started_at"), (none if status == "started" else at).alias("completed_at"))


def statistics_summary(counts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a paper with a counter for each kind of extracted or found rows (0 if none)."""
    tagged = [f.select(key, F.lit(name).alias("kind")) for name, f in counts.items()]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(key).agg(*[F.count_if(F.col("kind") == name).alias(name) for name in counts])


def grim_rollup(checks: DataFrame, key: str) -> DataFrame:
    """One finding a paper from its GRIM checks (``consistent``): 3 failures high, 2 medium, 1 low."""
    n = checks.filter(~F.col("consistent")).groupBy(key).agg(F.count("*").alias("failures"))
    severity = F.when(F.col("failures") >= 3, "high").when(F.col("failures") == 2, "medium").otherwise("low")
    confidence = F.when(F.col("failures") >= 3, 0.7).when(F.col("failures") == 2, 0.6).otherwise(0.45)
    return n.select(key, "failures", F.lit("grim").alias("method"), severity.alias("severity"), confidence.alias("confidence"))


# --- responses of a language model, kept as a table

KEPT_DAYS = 7


def response_key(image_sha256: Column, prompt: Column, model: Column) -> Column:
    return F.concat_ws("_", image_sha256, F.substring(F.sha2(prompt, 256), 1, 16), model)


def fresh_responses(cache: DataFrame, now: Column | None = None, days: int = KEPT_DAYS) -> DataFrame:
    """Entries (key, response, cached_at) not older than so many days, the newest of each key.

    What this leaves out is what an eviction deletes: overwrite the table with it.
    """
    now = F.current_timestamp() if now is None else now
    fresh = cache.filter(F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= days * 86400)
    return fresh.groupBy("key").agg(F.max(F.struct("cached_at", "response")).alias("e")).select("key", "e.response", "e.cached_at")


def unanswered(requests: DataFrame, cache: DataFrame, now: Column | None = None, days: int = KEPT_DAYS) -> DataFrame:
    """Requests (with ``key``) that have no fresh entry and so have to be asked, each key once."""
    return requests.dropDuplicates(["key"]).join(fresh_responses(cache, now, days).select("key"), "key", "left_anti")


def cached_answers(requests: DataFrame, cache: DataFrame, now: Column | None = None, days: int = KEPT_DAYS) -> DataFrame:
    """Requests with their fresh response, null where there is none."""
    return requests.join(fresh_responses(cache, now, days).select("key", "response"), "key", "left")
