"""Reported statistics, phrases and identifiers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms in which papers report statistics, as they have to be read.
MEASURE = r"(-?\d+(?:\.\d+)?)"  # 3, 3.45, -3.45
SHARE = r"(\.?\d+(?:\.\d+)?)"  # 0.05, .05; never negative
COEFFICIENT = r"(-?\d*\.?\d+)"  # 0.31, .31, -.31
SAID_P = rf"(?:\s*,\s*p\s*[<>=]\s*{SHARE})?"
IN_ANY_CASE, NOT_IN_WORD = "(?iuU)", "(?<![a-zA-Z])"
MEAN_N = rf"{IN_ANY_CASE}(?:M|mean)\s*=\s*{MEASURE}[\s,;]*[(\[]?\s*N\s*=\s*(\d+)\s*[)\]]?"
T_TEST = rf"{IN_ANY_CASE}t\s*\(\s*(\d+)\s*\)\s*=\s*{MEASURE}{SAID_P}"
F_TEST = rf"{IN_ANY_CASE}F\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*=\s*{MEASURE}{SAID_P}"
CHI_TEST = rf"{IN_ANY_CASE}(?:chi2|chi-squared?|χ²|χ2)\s*\(\s*(\d+)\s*\)\s*=\s*{MEASURE}{SAID_P}"
R_TEST = rf"{IN_ANY_CASE}{NOT_IN_WORD}r\s*=\s*{COEFFICIENT}{SAID_P}"
P_VALUE = rf"{IN_ANY_CASE}{NOT_IN_WORD}p\s*([<>=])\s*{SHARE}"
DECIMAL = r"(?<![a-zA-Z])(-?\d+\.\d+)(?![a-zA-Z])"
MEAN_SD = rf"{IN_ANY_CASE}(?:M|mean)\s*=\s*{MEASURE}\s*[(\[]\s*(?:SD|s\.d\.)\s*=\s*{MEASURE}\s*[)\]](?:\s*[,;]\s*N\s*=\s*(\d+))?"
PLUS_MINUS = rf"(?U){MEASURE}\s*±\s*{MEASURE}(?:\s*[(\[]\s*[Nn]\s*=\s*(\d+)\s*[)\]])?"
LABELLED = rf"{IN_ANY_CASE}(?:M|mean)\s*±\s*(?:SD|SE|s\.d\.)\s*[:=]?\s*{MEASURE}\s*±\s*{MEASURE}(?:\s*[(\[,;]\s*N\s*=\s*(\d+))?"
AROUND_STATISTIC, AROUND_PHRASE = 80, 40  # characters of context on either side


#: Matches before and after one that can lie within its context: each takes three characters or more.
NEIGHBOURS = 27


def groups(text: Column, pattern: Column | str, n: int, around: int = AROUND_STATISTIC) -> Column:
    """All matches as an array of structs g1 ... gn and context; an absent group is empty.

    The context is the match with so many characters on either side, stripped. It is put together
    from the pieces between the matches, so nothing leaves the JVM and long texts take linear time.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole, *arrays = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in range(n + 1))
    pieces = F.split(text, pattern)
    pairs = F.zip_with(pieces, whole, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))

    def context(x: Column, i: Column) -> Column:
        before = F.concat(F.array_join(F.slice(pairs, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.least(i, F.lit(NEIGHBOURS))), ""), F.get(pieces, i))
        after = F.array_join(F.slice(pairs, i + 2, F.lit(NEIGHBOURS + 1)), "")
        return F.regexp_replace(F.concat(F.right(before, F.lit(around)), x, F.left(after, F.lit(around))), r"(?U)^\s+|\s+$", "")

    return F.transform(whole, lambda x, i: F.struct(*[F.get(a, i).alias(f"g{k}") for k, a in enumerate(arrays, 1)], context(x, i).alias("context")))


def number(text: Column) -> Column:
    """A captured number; an absent one is null."""
    return F.nullif(text, F.lit("")).try_cast("double")


def _exploded(docs: DataFrame, key: str, text: str, pattern: str, n: int) -> DataFrame:
    return docs.select(key, F.explode(groups(F.col(text), pattern, n)).alias("m")).select(key, "m", "m.context")


def extract_means(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, mean, n, context) of reported means with their sample sizes, over whole texts."""
    m = _exploded(docs, key, text, MEAN_N, 2)
    return m.select(key, number(F.col("m.g1")).alias("mean"), F.col("m.g2").try_cast("long").alias("n"), "context")


def extract_mean_sd(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, mean, sd, n, context) in any of three forms: M = x (SD = y), N = z; x ± y (N = z); mean ± SD:
    x ± y, N = z. A missing N is 0, a standard error counts as the deviation; a labelled report is
    found in its plain form as well, so it gives two rows."""
    of = lambda pattern: _exploded(docs, key, text, pattern, 3).select(key, number(F.col("m.g1")).alias("mean"), number(F.col("m.g2")).alias("sd"), F.coalesce(F.nullif("m.g3", F.lit("")).try_cast("long"), F.lit(0)).alias("n"), "context")
    return of(MEAN_SD).unionByName(of(PLUS_MINUS)).unionByName(of(LABELLED))


def extract_tests(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """t, F, chi-square and r reports with degrees of freedom, p (where given) and context. A report
    whose p isn't a number is left out."""

    def of(kind: str, pattern: str, degrees: int) -> DataFrame:
        m = _exploded(docs, key, text, pattern, degrees + 2).withColumn("said", F.nullif(F.col(f"m.g{degrees + 2}"), F.lit("")))
        df = F.array(*[F.col(f"m.g{k}").try_cast("int") for k in range(1, degrees + 1)]).cast("array<int>")
        m = m.filter(F.col("said").isNull() | number(F.col("said")).isNotNull())
        return m.select(key, F.lit(kind).alias("test_type"), number(F.col(f"m.g{degrees + 1}")).alias("statistic"), df.alias("df"), number(F.col("said")).alias("p"), "context")

    return of("t", T_TEST, 1).unionByName(of("F", F_TEST, 2)).unionByName(of("chi2", CHI_TEST, 1)).unionByName(of("r", R_TEST, 0))


def extract_p_values(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    m = _exploded(docs, key, text, P_VALUE, 2)
    return m.select(key, F.col("m.g1").alias("comparison"), number(F.col("m.g2")).alias("value"), "context").filter("value is not null")


def extract_decimals(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(DECIMAL), F.lit(1))).alias("v")).select(key, F.col("v").cast("double").alias("value"))


#: A dictionary up to so many phrases is broadcast (some 100 bytes each); a larger one is joined by shuffle.
BROADCAST_PHRASES = 200_000
WORD, GAP = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def phrase_dictionary(phrases: DataFrame, phrase: str = "tortured", correct: str = "correct") -> DataFrame:
    """(phrase, correct) with lower-case phrases, from records or from a map's entries; blank ones are
    left out, of several entries for one phrase the least by its correction stays."""
    rows = phrases.select(F.lower(F.trim(phrase)).alias("phrase"), F.col(correct).alias("correct"))
    return rows.filter("phrase != ''").groupBy("phrase").agg(F.min("correct").alias("correct"))


def _phrases_met(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """(key, digest, phrase), a row each time a phrase stands at word borders of a text, case aside.

    Runs of as many words as phrases have, with what stands between them, meet the dictionary in
    an equi-join, so that the work doesn't grow with texts times phrases. Phrases that don't begin
    and end with a word character can't stand at word borders and are left out.
    """
    lower = F.lower(F.col(phrase))
    known = phrases.select(F.col(phrase).alias("phrase"), lower.alias("gram"), F.size(_words(lower)).alias("n"))
    known = known.filter(F.rlike("gram", F.lit(rf"^{WORD}(?s:.*{WORD})?$"))).distinct()
    counts = {r["n"]: r["c"] for r in known.groupBy("n").agg(F.count("*").alias("c")).collect()}
    if sum(counts.values()) <= BROADCAST_PHRASES:
        known = F.broadcast(known)
    parts = docs.select(key, F.xxhash64(text).alias("digest"), F.lower(F.col(text)).alias("t"))
    # words, and words with what follows them; each is used more than once, so the optimizer keeps it a column
    parts = parts.withColumn("w", _words(F.col("t"))).withColumn("b", F.regexp_extract_all("t", F.lit(rf"({WORD}+{GAP}*)"), F.lit(1)))
    runs = F.flatten(F.array(*[_runs(n) for n in sorted(counts)])) if counts else F.array().cast("array<string>")
    return parts.select(key, "digest", F.explode(runs).alias("gram")).join(known.drop("n"), "gram").select(key, "digest", "phrase")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"({WORD}+)"), F.lit(1))


def _runs(n: int) -> Column:
    """Every run of n words as it stands in the text."""
    places = F.when(F.size("b") >= n, F.sequence(F.lit(1), F.size("b") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.array_join(F.slice("b", i, F.lit(n - 1)), ""), F.get("w", i + n - 2)))


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(key, phrase, hits): how often each phrase stands in each text."""
    return _phrases_met(docs, phrases, key, text, phrase).groupBy(key, "phrase").agg(F.count("*").alias("hits"))


def phrase_occurrences(docs: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(key, phrase, context), a row for each place where a phrase stands; only texts that hold one are
    read again."""
    met = _phrases_met(docs, phrases, key, text, phrase).distinct()
    lower = docs.select(key, F.xxhash64(text).alias("digest"), F.lower(F.col(text)).alias("t"))
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.lower("phrase"), F.lit(r"\E\b"))
    both = lower.join(met, [key, "digest"])
    return both.select(key, "phrase", F.explode(groups(F.col("t"), pattern, 0, AROUND_PHRASE)).alias("m")).select(key, "phrase", "m.context")


def phrase_screening(hits: DataFrame, key: str, min_matches: int = 2) -> DataFrame:
    """(key, unique_phrases, total_hits, suspicious) from (key, phrase, hits)."""
    each = hits.groupBy(key).agg(F.count_distinct("phrase").alias("unique_phrases"), F.sum("hits").alias("total_hits"))
    return each.withColumn("suspicious", F.col("unique_phrases") >= min_matches)


def valid_doi(doi: Column) -> Column:
    """The bare DOI if it is well-formed, else null."""
    bare = F.trim(doi)
    for prefix in ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:"):
        bare = F.when(F.startswith(bare, F.lit(prefix)), F.substring(bare, F.lit(len(prefix) + 1), F.length(bare))).otherwise(bare)
    bare = F.trim(bare)
    return F.when((F.length(bare) <= 256) & F.rlike(bare, F.lit(r"^10\.\d{4,9}/[a-zA-Z0-9./_\-();:]+$")), bare)


def normalised_doi(doi: Column) -> Column:
    return F.regexp_replace(F.trim(doi), r"^https?://(dx\.)?doi\.org/", "")


def institution_matches(name: Column, known: list[str]) -> Column:
    """Whether a name is, holds or is part of a known one; blank names match nothing."""
    bare = F.lower(F.trim(name))
    hit = F.lit(False)
    for k in known:
        hit = hit | F.contains(bare, F.lit(k.lower())) | F.contains(F.lit(k.lower()), bare)
    return (bare != "") & hit


def abstract_from_index(index: Column) -> Column:
    """A map of words to places as the text it stands for."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["w"]), " ")


def authors_line(names: Column, most: int = 5) -> Column:
    """The first names, and how many there are."""
    n = F.size(names)
    return F.when(n > most, F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" et al. ("), n.cast("string"), F.lit(" total)"))).otherwise(F.array_join(names, ", "))


def salvaged_json(text: Column, schema: str) -> Column:
    """JSON as such, in a fence, or as the first bracketed span; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    span = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    fits = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return F.coalesce(fits(text), fits(fenced), fits(span))


def exif_date_gap(first: Column, second: Column) -> Column:
    """Seconds between two EXIF dates; null if either isn't one."""
    when = lambda c: F.unix_timestamp(F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")))
    return F.abs(when(first) - when(second))


def retraction_status(updates: Column, item_type: Column) -> Column:
    """The first deciding entry of a work's update notices; else the item's own type."""
    kinds = F.filter(F.transform(updates, lambda u: F.lower(u)), lambda u: u.isin("retraction", "expression_of_concern", "correction"))
    return F.coalesce(F.get(kinds, 0), F.when(F.lower(item_type) == "retraction", F.lit("retraction")))
