"""Quality rules, line first.

Every line is judged alone (punctuation, navigation, boilerplate); failing
lines go; a document that loses too much of its text goes as a whole. Only
built-in functions run here, within one scan and without a shuffle.

Defined cases: a null text counts as empty and has no word, so its base rule
fails and it is not kept; its cleaned text is empty. Lines without a word are
neither judged nor counted as lost. Repeated rows get equal results each. Extra
columns pass through ``clean`` untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailforge.llm.common import words

#: Phrases of legal and site boilerplate, matched in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
)
#: Phrases of navigation, matched in lower case in short lines.
NAVIGATION = ("read more", "sign in", "sign up", "log in", "skip to content", "back to top", "next page", "previous page", "click here")
#: Signs that part the entries of menus and breadcrumbs.
SEPARATORS = r"[|»›•·→]"
SIGNS = r"[#*$%&<>~^=\\\\{}]"
#: A short line has so many words at most.
SHORT = 8
#: A document is kept if its failing lines hold at most this share of its characters.
MOST_LOST = 0.5


def failed_rule(line: Column) -> Column:
    """The name of the first rule that a line fails, or null.

    Each rule begins with a cheap test that its lines must meet and prose does
    not, so that a line of prose costs a few searches. Where 40 letters or more
    are capitals but for a tenth, seven capitals follow each other with no other
    letter between.
    """
    n = F.size(words(line))
    low = F.array(F.lower(line))
    signs = F.regexp_count(line, F.lit(SIGNS))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    # The lambda makes the lower case once for all phrases.
    has = lambda phrases: F.exists(low, lambda x: reduce(Column.__or__, [x.contains(p) for p in phrases]))
    return (
        F.when(has(BOILERPLATE), "boilerplate")
        .when(line.rlike(SEPARATORS) & (separators >= 2) & (separators * 5 >= n), "navigation")
        .when(has(NAVIGATION) & (n <= SHORT), "navigation")
        .when(line.rlike(SIGNS) & (signs * 5 > F.length(line)), "punctuation")
        .when(line.contains("!") & (F.regexp_count(line, F.lit("!")) >= 3) & (F.regexp_count(line, F.lit("!")) * 2 >= n), "punctuation")
        .when(line.rlike(r"\p{Lu}(?:\P{L}*+\p{Lu}){6}") & (letters >= 40) & (capitals * 10 >= letters * 9), "punctuation")
        .when(~line.rlike(r"\p{P}") & (n > SHORT), "punctuation")
    )


def _judged(text: Column) -> tuple[Column, Column]:
    """The lines of a text, and those of them that stay."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return lines, F.filter(lines, lambda x: failed_rule(x).isNull())


def _with_repeats(df: DataFrame, tokens: str, to: str) -> DataFrame:
    """Add the number of words that lie in a window of five words found twice or more in the text.

    Windows are compared by their 64-bit hashes. Texts without a repeated
    window, the most, are done after one distinct. Each step is a column of its
    own, so that no lambda computes it anew for every element.
    """
    n = F.size(tokens)
    df = df.withColumn("__w", F.transform(tokens, lambda x: F.xxhash64(x)))
    df = df.withColumn("__h", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(5)]))))
    ranked = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__r", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), ranked))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    near = lambda x, k: same(x, F.get(F.col("__r"), k - 1)) | same(x, F.get(F.col("__r"), k + 1))
    df = df.withColumn("__i", F.array_sort(F.transform(F.filter("__r", near), lambda x: x["i"])))
    steps = F.zip_with(F.col("__i"), F.slice("__i", 2, F.greatest(F.size("__i"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(5)), F.lit(5)))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x), F.lit(0))
    return df.withColumn(to, covered.cast("long")).drop("__w", "__h", "__r", "__i")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base counts, the base verdict, the method's verdict and what it removes.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, lines_removed, lost_share.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = one.select("doc_id", text.alias("text"), words(F.col("text")).alias("tokens"))
    lines, good = _judged(F.col("text"))
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = one.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        worded.alias("worded"),
        F.aggregate(good, F.lit(0), lambda t, x: t + F.length(x)).alias("left"),
        F.aggregate(lines, F.lit(0), lambda t, x: t + F.length(x)).alias("all"),
        F.size(good).alias("n_good"),
        F.size(lines).alias("n_lines"),
        F.col("tokens"),
    )
    one = _with_repeats(one, "tokens", "n_repeat_words")
    lost = F.when(F.col("all") > 0, 1 - F.col("left") / F.col("all")).otherwise(0.0)
    one = one.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.col("n_good")).cast("long").alias("lines_removed"),
        lost.alias("lost_share"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return one.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("lost_share") <= MOST_LOST)).alias("kept"), "n_lines", "lines_removed", "lost_share")


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The kept documents without their failing lines, all columns as they came.

    A length column, where there is one, is set to the code points of the new
    text.
    """
    # The caller's columns travel in one struct, so that none meets a column of this function.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("whole"))
    lines, good = _judged(F.col("whole"))
    own = _with_repeats(own.withColumns({"tokens": words(F.col("whole")), "lines": lines, "good": good}), "tokens", "repeated")
    chars = lambda x: F.aggregate(F.col(x), F.lit(0), lambda t, y: t + F.length(y))
    n = F.size("tokens")
    stays = (n >= 10) & (100 * F.col("repeated") <= 20 * n) & (chars("lines") - chars("good") <= MOST_LOST * chars("lines"))
    # The row number keeps the optimizer from pushing the filter below, where it would compute its columns inside the lambdas.
    own = own.withColumns({"stays": stays, "left": F.array_join("good", "\n"), "nth": F.monotonically_increasing_id()})
    kept = own.filter(F.col("stays") & (F.col("nth") >= 0))
    made = {text_col: F.col("left")}
    if length_col and length_col in docs.columns:
        made[length_col] = F.length("left").cast(docs.schema[length_col].dataType)
    return kept.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _any(phrases) -> str:
    return "(" + " OR ".join(f"contains(low, '{p}')" for p in phrases) + ")"


#: measure() over documents as DuckDB's SQL. The rules' cheap first tests follow from the others, so they are left out.
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs
), counted AS (
  SELECT r, line, lower(line) AS low, length(line) AS chars,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    len(regexp_extract_all(line, '{SEPARATORS}')) AS separators,
    len(regexp_extract_all(line, '{SIGNS}')) AS signs,
    len(regexp_extract_all(line, '!')) AS shouts,
    len(regexp_extract_all(line, '\p{{L}}')) AS letters,
    len(regexp_extract_all(line, '\p{{Lu}}')) AS capitals,
    regexp_matches(line, '\p{{P}}') AS stops
  FROM lines
), judged AS (
  SELECT r, line, chars, n,
    {_any(BOILERPLATE)}
    OR (separators >= 2 AND separators * 5 >= n)
    OR ({_any(NAVIGATION)} AND n <= {SHORT})
    OR signs * 5 > chars
    OR (shouts >= 3 AND shouts * 2 >= n)
    OR (letters >= 40 AND capitals * 10 >= letters * 9)
    OR (NOT stops AND n > {SHORT}) AS bad
  FROM counted
), by_line AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS lines_removed,
    coalesce(sum(chars) FILTER (NOT bad), 0) AS kept_chars, sum(chars) AS all_chars,
    count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines
  FROM judged GROUP BY r
), tokens AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), placed AS (
  SELECT r, unnest(range(len(w))) AS i, unnest(w) AS x FROM tokens
), starts AS (
  SELECT r, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS five, lead(x, 4) OVER o AS fifth
  FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, five) AS times FROM starts WHERE fifth IS NOT NULL
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, unnest([0, 1, 2, 3, 4]) AS t(k) WHERE times > 1 GROUP BY r
), measured AS (
  SELECT t.doc_id, len(t.w) AS n_words, length(array_to_string(t.w, '')) AS word_chars,
    len(regexp_extract_all(t.text, '[#*$%&|<>]')) AS n_symbols, b.n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words, b.n_lines, b.lines_removed,
    CASE WHEN b.all_chars > 0 THEN 1 - b.kept_chars::DOUBLE / b.all_chars::DOUBLE ELSE 0.0::DOUBLE END AS lost_share
  FROM tokens t JOIN by_line b USING (r) LEFT JOIN repeated p USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_share <= {MOST_LOST} AS kept,
  n_lines, lines_removed, lost_share
FROM measured
"""
