"""Operator 6: line-first cleaning with built-in expressions only.

Every line is judged by itself (navigation, boilerplate, symbols, shouting, punctuation), failing
lines are removed, and a document that loses too much of its text is rejected. A document-level
base of counts comes first. One pass, no shuffle: everything is computed within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import text as T

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected if more than this percentage of its word characters goes with the lines.
MAX_LOST_PERCENT = 50
STOP_MARK = r"[.,;:!?…。、！？]"
SYMBOL = r"[#*$%&|<>]"
DIVIDER = r"[|»›•]"
#: A line is boilerplate if it has one of these phrases for every so many words, however long it is.
WORDS_A_PHRASE = 30
#: Phrases of menus and notices in the corpus' languages, from a word's beginning; a dot stands for a
#: letter with an accent.
BOILERPLATE = (
    r"(?i)(\{|\}|\b(?:cookie|privacy policy|terms of (use|service)|all rights reserved|javascript|lorem ipsum|"
    r"sign (in|up)|log ?in\b|subscribe|click here|read more|share (this|on)|newsletter|powered by|"
    r"politique de confidentialit|tous droits r.serv|lire la suite|cliquez ici|abonnez-vous|mentions l.gales|"
    r"datenschutzerkl|alle rechte vorbehalten|weiterlesen|hier klicken|impressum|jetzt anmelden|"
    r"pol.tica de privacidad|derechos reservados|leer m.s\b|haga clic|suscr.b|aviso legal))"
)


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(T.WHITE)) != ""


def count_matches(text: Column, pattern: str) -> Column:
    """Occurrences of a one-character pattern."""
    return F.size(F.split(text, pattern)) - 1


def line_failures(line: Column, marked: Column) -> Column:
    """The name of the first rule a line breaks, or null. Lines without a word break none.

    ``marked`` is true if the document has any divider, symbol or double exclamation mark at all.
    Cheap tests stand first: each costlier one is evaluated only where they hold.
    """
    size = F.length(line)
    dividers, words = count_matches(line, DIVIDER), F.size(T.split_words(line))
    upper, lower = count_matches(line, r"\p{Lu}"), count_matches(line, r"\p{Ll}")
    return (
        F.when(~has_word(line), F.lit(None).cast("string"))
        .when(marked & F.rlike(line, F.lit(DIVIDER)) & (dividers >= 2) & (dividers * 6 >= words), "navigation")
        .when(F.rlike(line, F.lit(BOILERPLATE)) & (F.regexp_count(line, F.lit(BOILERPLATE)) * WORDS_A_PHRASE >= words), "boilerplate")
        .when(marked & F.rlike(line, F.lit(SYMBOL)) & (count_matches(line, SYMBOL) * 10 > size), "symbols")
        .when(marked & F.contains(line, F.lit("!!")) & (upper > 4 * lower), "shouting")
        .when((size >= 60) & ~F.contains(line, F.lit(".")) & ~F.rlike(line, F.lit(STOP_MARK)), "punctuation")
    )


def with_repeats(frame: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words in 8-word windows that occur at least twice in the row's text.

    Windows are compared by 64-bit fingerprints. Rows whose fingerprints are all distinct skip
    the sort. Each intermediate is a column of its own so that it is computed once a row.
    """
    p, s = T.unused(frame, "rep_window", "rep_sorted")
    out = T.with_window_hashes(frame, words, {WINDOW: p})
    sort = F.sort_array(F.transform(p, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(p)) < F.size(p), sort)).drop(p)
    at = lambda i, x: F.get(F.col(s), i)["h"].eqNullSafe(x["h"])
    same = lambda x, i: at(i - 1, x) | at(i + 1, x)
    starts = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"))
    covered = F.aggregate(starts, zero, step, lambda a: a["n"])
    return out.withColumn(name, F.coalesce(covered, F.lit(0)).cast("long")).drop(s)


def clean_lines(frame: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, ``cleaned_text``, ``failed_lines`` (rule and line) and ``kept``.

    Null and blank texts have no words and fail the base. Repeated rows are judged alike, each
    by itself; an empty table stays empty. Where the input has a column of an added name, the added
    one gets an underscore in front.
    """
    body, words, lines, judged, marked = T.unused(frame, "q_body", "q_words", "q_lines", "q_judged", "q_marked")
    added = T.unused(frame, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_lines", "cleaned_text", "base_failed", "kept")
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_lines, cleaned_text, base_failed, kept = added
    out = frame.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(words, T.split_words(F.col(body)))
    out = with_repeats(out, words, n_repeat_words)
    chars = lambda w: F.length(F.array_join(w, ""))
    out = out.withColumn(lines, F.split(body, "\n"))
    out = out.withColumn(marked, F.rlike(body, F.lit(r"[#*$%&|<>»›•]|!!")))
    out = out.withColumn(judged, F.transform(lines, lambda x: F.struct(x.alias("line"), line_failures(x, F.col(marked)).alias("rule"))))
    worded = F.filter(lines, lambda x: has_word(x))
    out = out.withColumns(
        {
            n_words: F.size(words).cast("long"),
            word_chars: chars(F.col(words)).cast("long"),
            n_symbols: F.when(F.col(marked), count_matches(F.col(body), SYMBOL)).otherwise(0).cast("long"),
            lines: worded,
            failed_lines: F.filter(judged, lambda x: x["rule"].isNotNull()),
            cleaned_text: F.array_join(F.transform(F.filter(judged, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n"),
        }
    )
    out = out.withColumn(n_dup_lines, (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")).drop(words, lines, judged, marked)
    out = out.withColumn(base_failed, (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > MAX_REPEAT_PERCENT * F.col(n_words)))
    lost = F.aggregate(failed_lines, F.lit(0).cast("long"), lambda a, x: a + chars(T.split_words(x["line"])))
    out = out.withColumn(kept, ~F.col(base_failed) & (100 * lost <= MAX_LOST_PERCENT * F.col(word_chars)))
    return out.select(*frame.columns, *added)


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
