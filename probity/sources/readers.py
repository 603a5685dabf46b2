"""Sources: typed tables, files and the payloads of scholarly services.

Fetching over HTTP is left to the caller (or a Python data source of one's own): these functions
start from files and from JSON text columns, so that a fetch can be retried and audited apart.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.operators import text as X

SCHEMAS = {
    "papers": "id string, doi string, title string, abstract string, authors_json string, journal string, journal_issn string, publication_year int, citation_count long, influential_citation_count long, priority_score double, pdf_path string, pdf_sha256 string, full_text string, source string, status string, risk_level string, overall_confidence double, converging_evidence boolean, error_message string, retraction_status string, retraction_date timestamp, retraction_reason string, pubpeer_comments int, created_at timestamp, updated_at timestamp",
    "figures": "id string, paper_id string, page_number int, figure_label string, caption string, image_path string, image_sha256 string, image_type string, width int, height int, phash string, ahash string, created_at timestamp",
    "findings": "id string, paper_id string, figure_id string, analysis_type string, severity string, confidence double, title string, description string, evidence_json string, model_used string, raw_response string, created_at timestamp",
    "reports": "id string, paper_id string, overall_risk string, overall_confidence double, summary string, report_markdown string, report_html string, num_findings int, num_critical int, converging_evidence boolean, created_at timestamp",
    "processing_log": "id long, paper_id string, stage string, status string, details string, started_at timestamp, completed_at timestamp, created_at timestamp",
    "authors": "id string, name string, orcid string, institution string, h_index int, total_papers int, flagged_papers int, retraction_count int, risk_score double, created_at timestamp, updated_at timestamp",
    "author_paper_links": "id long, author_id string, paper_id string, position int",
    "campaigns": "id string, name string, mode string, status string, config_json string, seed_dois string, max_depth int, max_papers int, llm_budget int, created_at timestamp, updated_at timestamp",
    "campaign_papers": "id long, campaign_id string, paper_id string, source string, source_paper_id string, source_author_id string, depth int, triage_status string, auto_findings_count int, auto_risk_score double, llm_promoted boolean, final_risk string",
    "image_hash_matches": "id long, campaign_id string, figure_id_a string, figure_id_b string, paper_id_a string, paper_id_b string, hash_type string, hash_distance int, verified boolean",
}
WORK = "id string, doi string, title string, cited_by_count long, publication_year int, abstract_inverted_index map<string,array<int>>, open_access struct<oa_url:string>, primary_location struct<source:struct<display_name:string,issn_l:string>>, authorships array<struct<author:struct<display_name:string,orcid:string>,institutions:array<struct<display_name:string>>>>"
NOTICE = "DOI string, type string, `update-to` array<struct<type:string,DOI:string>>, relation struct<`is-retraction-of`:array<struct<id:string>>>"
#: What is read of an article in PubMed's XML; attributes begin with an underscore.
PUBMED = (
    "MedlineCitation struct<PMID:struct<_VALUE:string,_Version:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,AffiliationInfo:array<struct<Affiliation:string>>>>>,"
    "Journal:struct<Title:string,ISSN:struct<_VALUE:string,_IssnType:string>,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string>>>,Pagination:struct<MedlinePgn:string>,"
    "ELocationID:array<struct<_EIdType:string,_VALUE:string>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)
OPEN_ACCESS = "doi string, best_oa_location struct<url_for_pdf:string>, oa_locations array<struct<url_for_pdf:string>>"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the model with its declared schema; absent columns read as null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def pdf_files(spark: SparkSession, path: str, most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Files with size, digest and whether they are PDF at all and not over the limit."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    magic = F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (magic & (F.col("length") <= most_bytes)).alias("valid"))


def page_table(documents: DataFrame, key: str, pages: str) -> DataFrame:
    """(key, page_number, text, word_count) of an array of page texts; numbers start at 1."""
    p = documents.select(key, F.posexplode(pages).alias("i", "text"))
    return p.select(key, (F.col("i") + 1).alias("page_number"), "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_count"))


def table_cells(tables: DataFrame, key: str, rows: str) -> DataFrame:
    """(key, row, column, header, cell) of arrays of rows whose first is the header; null cells are empty."""
    r = tables.withColumn("head", F.get(rows, 0)).select(key, "head", F.posexplode(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).alias("row", "cells"))
    c = r.select(key, "row", "head", F.posexplode("cells").alias("column", "cell"))
    return c.select(key, "row", "column", F.get("head", F.col("column")).alias("header"), F.trim(F.coalesce("cell", F.lit(""))).alias("cell"))


def works(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Papers out of works in JSON: bare DOI, abstract from its inverted index, authors."""
    w = payloads.select(F.from_json(column, WORK).alias("w")).select("w.*")
    people = F.transform("authorships", lambda a: F.struct(a["author"]["display_name"].alias("name"), a["author"]["orcid"].alias("orcid"), F.get(a["institutions"], 0)["display_name"].alias("institution")))
    return w.select(
        "id", X.normalised_doi(F.col("doi")).alias("doi"), "title", F.col("cited_by_count").alias("citation_count"), "publication_year",
        F.when(F.col("abstract_inverted_index").isNotNull(), X.abstract_from_index(F.col("abstract_inverted_index"))).alias("abstract"),
        F.col("primary_location.source.display_name").alias("journal"), F.col("primary_location.source.issn_l").alias("journal_issn"), F.col("open_access.oa_url").alias("oa_url"), people.alias("authors"),
    )


def notices(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Retraction notices and status out of registry items in JSON."""
    n = payloads.select(F.from_json(column, NOTICE).alias("n")).select("n.*")
    kinds = F.transform(F.coalesce("update-to", F.array().cast("array<struct<type:string,DOI:string>>")), lambda u: u["type"])
    is_notice = F.exists(kinds, lambda k: F.lower(k) == "retraction") | (F.size("relation.is-retraction-of") > 0)
    return n.select(F.col("DOI").alias("doi"), F.coalesce(is_notice, F.lit(False)).alias("is_retraction_notice"), X.retraction_status(kinds, F.col("type")).alias("status"))


def open_access_pdf(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The best open copy's address, else the first that has a PDF."""
    o = payloads.select(F.from_json(column, OPEN_ACCESS).alias("o")).select("o.*")
    first = F.get(F.filter("oa_locations", lambda x: x["url_for_pdf"].isNotNull()), 0)["url_for_pdf"]
    return o.select("doi", F.coalesce("best_oa_location.url_for_pdf", first).alias("pdf_url"))


def pubmed_articles(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Articles out of PubMed's XML, one ``PubmedArticle`` a row (the XML source's ``rowTag``).

    Labelled parts of an abstract are joined by a space; authors without a last name are skipped;
    the DOI is that of the electronic location, else that of the article's ids. Rows without a
    PMID or that aren't XML are left out.
    """
    x = payloads.select(F.from_xml(column, PUBMED, {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}).alias("x")).select("x.*")
    a, ids = "MedlineCitation.Article", F.col("PubmedData.ArticleIdList.ArticleId")
    parts = F.transform(F.col(f"{a}.Abstract.AbstractText"), lambda t: F.concat(F.when(F.coalesce(t["_Label"], F.lit("")) != "", F.concat(t["_Label"], F.lit(": "))).otherwise(""), F.coalesce(t["_VALUE"], F.lit(""))))
    people = F.transform(F.filter(F.col(f"{a}.AuthorList.Author"), lambda p: p["LastName"].isNotNull()), lambda p: F.struct(p["LastName"].alias("last_name"), F.coalesce(p["ForeName"], F.lit("")).alias("first_name"), F.get(p["AffiliationInfo"], 0)["Affiliation"].alias("affiliation")))
    kind = lambda name: F.filter(ids, lambda i: i["_IdType"] == name)
    places = F.filter(F.col(f"{a}.ELocationID"), lambda e: e["_EIdType"] == "doi")
    journal = F.col(f"{a}.Journal")
    return x.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), F.when(F.size(parts) > 0, F.array_join(parts, " ")).alias("abstract"), F.coalesce(people, F.array()).alias("authors"),
        journal["Title"].alias("journal"), journal["ISSN"]["_VALUE"].alias("issn"), F.coalesce(F.get(places, F.size(places) - 1)["_VALUE"], F.get(kind("doi"), 0)["_VALUE"]).alias("doi"),
        F.get(kind("pmc"), F.size(kind("pmc")) - 1)["_VALUE"].alias("pmcid"), journal["JournalIssue"]["PubDate"]["Year"].try_cast("int").alias("publication_year"),
        journal["JournalIssue"]["Volume"].alias("volume"), journal["JournalIssue"]["Issue"].alias("issue"), F.col(f"{a}.Pagination.MedlinePgn").alias("pages"),
    ).filter("pmid is not null")


def open_access_pdf_link(xml: Column) -> Column:
    """The address of the first PDF in an open-access response in XML, by HTTPS; null if there is none."""
    address = F.get(F.filter(F.xpath(xml, F.lit("//link[translate(@format,'PDF','pdf')='pdf']/@href")), lambda x: x != ""), 0)
    return F.regexp_replace(address, "^ftp://", "https://")


def paper_reference(identifier: Column) -> Column:
    """How a paper is asked for: DOIs take a prefix."""
    return F.when(F.contains(identifier, F.lit("/")) & ~F.startswith(identifier, F.lit("DOI:")), F.concat(F.lit("DOI:"), identifier)).otherwise(identifier)


def cited_papers(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Citation counts of papers out of JSON."""
    p = payloads.select(F.from_json(column, "paperId string, title string, year int, citationCount long, influentialCitationCount long, authors array<struct<authorId:string,name:string>>").alias("p")).select("p.*")
    return p.select(F.col("paperId").alias("paper_id"), "title", "year", F.col("citationCount").alias("citation_count"), F.col("influentialCitationCount").alias("influential_citation_count"), F.transform("authors", lambda a: a["authorId"]).alias("author_ids"))


def cited_authors(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Authors with their h-index out of JSON."""
    p = payloads.select(F.from_json(column, "authorId string, name string, hIndex int, citationCount long, paperCount long").alias("p")).select("p.*")
    return p.select(F.col("authorId").alias("author_id"), F.coalesce("name", F.lit("Unknown")).alias("name"), F.col("hIndex").alias("h_index"), F.col("citationCount").alias("citation_count"), F.col("paperCount").alias("paper_count"))


def author_retractions(payloads: DataFrame, retractions: str = "retractions", concerns: str = "concerns") -> DataFrame:
    """Each row's counts of retraction notices with a DOI and of expressions of concern, out of two
    registry responses in JSON. The first 50 items count, which is what a response holds."""
    items = lambda c: F.slice(F.coalesce(F.from_json(c, "message struct<items:array<struct<DOI:string>>>")["message"]["items"], F.array().cast("array<struct<DOI:string>>")), 1, 50)
    dois = F.transform(F.filter(items(retractions), lambda i: F.coalesce(i["DOI"], F.lit("")) != ""), lambda i: i["DOI"])
    return payloads.withColumns({"retracted_dois": dois, "total_retractions": F.size(dois), "total_concerns": F.size(items(concerns))})


def review_comments(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The first publication's comments out of JSON: their total, and ten of them at most with the first
    300 characters each (an empty response has none)."""
    one = "struct<total_comments:int,url:string,comments:array<struct<author:string,content:string,created_at:string,url:string>>>"
    p = payloads.withColumn("p", F.get(F.from_json(column, f"data array<{one}>")["data"], 0))
    total = F.coalesce("p.total_comments", F.lit(0))
    shown = F.transform(F.slice(F.coalesce("p.comments", F.array().cast("array<struct<author:string,content:string,created_at:string,url:string>>")), 1, 10), lambda c: F.struct(F.coalesce(c["author"], F.lit("Anonymous")).alias("author"), F.left(F.coalesce(c["content"], F.lit("")), F.lit(300)).alias("snippet"), F.coalesce(c["created_at"], F.lit("")).alias("created_at"), F.coalesce(c["url"], F.lit("")).alias("url")))
    return p.withColumns({"has_comments": total > 0, "total_comments": total, "page_url": F.col("p.url"), "comments": shown}).drop("p")


def grey_images(spark: SparkSession, path: str) -> DataFrame:
    """(figure_id, height, width, content) of image files: decoded once by Spark's image source, grey by
    the usual weights of green, red and blue. Files that can't be decoded are dropped by the source."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def grey(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for r in f.itertuples():
                x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                g = x[..., 0] if r.nChannels == 1 else 0.114 * x[..., 0] + 0.587 * x[..., 1] + 0.299 * x[..., 2]
                out.append((r.origin, r.height, r.width, np.rint(g).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["figure_id", "height", "width", "content"])

    return i.mapInPandas(grey, "figure_id string, height int, width int, content binary")


def phrase_records(spark: SparkSession, path: str) -> DataFrame:
    """(tortured, correct) out of a JSON file that holds a list of such records or one map; an absent
    file gives no phrases."""
    kind = "tortured string, correct string"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], kind)
    listed = text.select(F.explode(F.from_json("value", f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")).alias("r")).select("r.*").filter("tortured is not null")
    mapped = text.filter(F.startswith(F.trim("value"), F.lit("{"))).select(F.explode(F.from_json("value", "map<string,string>")).alias("tortured", "correct"))
    return listed.unionByName(mapped)


def labelled_samples(files: DataFrame, path: str = "path") -> DataFrame:
    """Labels by directory: synthetic ones are forged, clean ones not, archive ones by their name."""
    p = F.lower(F.col(path))
    stem = F.regexp_extract(p, r"([^/]+)\.[^./]+$", 1)
    label = F.when(F.contains(p, F.lit("/synthetic/")), True).when(F.contains(p, F.lit("/rsiil/")), ~F.rlike(stem, F.lit("pristine|authentic|original|clean"))).when(F.contains(p, F.lit("/clean/")), False)
    return files.withColumn("label", label).filter(F.col("label").isNotNull())


def seeded_sample(rows: DataFrame, key: str, stratum: str, k: int, seed: int = 42) -> DataFrame:
    """Exactly ``k`` rows of each stratum (or all, if fewer), the same for every run of a seed."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")
