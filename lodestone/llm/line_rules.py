"""Line-first quality rules, in SQL functions only.

Every line with a word is judged by a punctuation, a navigation and a boilerplate rule. Failing
lines are removed, and a document that loses more than `max_lost` of its word characters is
rejected, as is one that fails the base rules (too few words, too many repeated five-word windows).

Defined cases: a null or empty text has no words and fails the base rules; null ids and repeated
rows are judged row by row; an empty table gives an empty result; other columns are ignored.
Texts are never cut: windows of a text are found by one sort of its window hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Separators that stand alone between the entries of menus and tables.
MENU = r"(?:^|\x20)(?:\||>|»|•|·)(?=\x20|$)"
BOILERPLATE = r"(?i)lorem ipsum|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|subscribe to our newsletter|skip to (?:main )?content|datenschutzerklärung|alle rechte vorbehalten|cookie-einstellungen|newsletter abonnieren|politique de confidentialité|tous droits réservés|mentions légales|política de (?:privacidad|cookies)|todos los derechos reservados|aviso legal"
WINDOW = 5


def _chars(text: Column, pattern: str) -> Column:
    """Code points that are part of matches of `pattern`."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Punctuation: over 10 % symbols, over 5 % exclamation marks, or mostly capitals in a line of 20 or
    more characters. Navigation: three or more free-standing separators. Boilerplate: a stock phrase of
    English, German, French or Spanish pages."""
    word_chars = F.length(F.regexp_replace(line, SPACE, ""))
    punctuation = (10 * _chars(line, SYMBOLS) > word_chars) | (20 * _chars(line, "!+") > word_chars) | ((word_chars >= 20) & (2 * _chars(line, r"\p{Lu}+") > word_chars))
    navigation = F.regexp_count(line, F.lit(MENU)) >= 3
    return punctuation | navigation | F.regexp_like(line, F.lit(BOILERPLATE))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_pct: int = 20, max_lost_pct: int = 50) -> DataFrame:
    """One row per row of `df`: counts, verdicts, and `clean_text`, the text without its failing lines."""
    text = F.col("text")
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "text",
        F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        _chars(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.split(text, "\n", -1).alias("lines"))
    rows = rows.select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.filter("lines", lambda x: F.regexp_like(x, F.lit(WORD))).alias("full"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("good"))
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "good",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted"))
    same = lambda x, other: F.coalesce(x["h"] == F.get(F.col("sorted"), other)["h"], F.lit(False))
    rows = rows.withColumn("starts", F.array_sort(F.transform(F.filter("sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # Each start covers its window, up to where the next repeated window begins.
    covered = F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), k + 1) - s, F.lit(WINDOW))).cast("long"))
    rows = rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("clean_text", F.array_join("good", "\n"))
    rows = rows.withColumn("kept_chars", F.length(F.regexp_replace("clean_text", SPACE, "")).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * (F.col("word_chars") - F.col("kept_chars")) <= max_lost_pct * F.col("word_chars"))).alias("kept"),
        "kept_chars", "clean_text")


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
y AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM x),
z AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM y),
s AS (SELECT r, i, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM z WHERE c > 1),
rep AS (SELECT r, sum(n)::BIGINT AS n_repeat_words FROM s GROUP BY r),
l AS (SELECT r, unnest(l) AS s FROM w),
m AS (SELECT r, s, length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g')) AS c,
             length(s) - length(regexp_replace(s, '[#*$%&|<>]+', '', 'g')) AS sym, length(s) - length(replace(s, '!', '')) AS bang,
             length(s) - length(regexp_replace(s, '\p{Lu}+', '', 'g')) AS up,
             len(regexp_extract_all(replace(s, ' ', '  '), '(?:^| )(?:\||>|»|•|·)(?: |$)')) AS menu FROM l),
k AS (SELECT r, sum(CASE WHEN 10 * sym > c OR 20 * bang > c OR (c >= 20 AND 2 * up > c) OR menu >= 3 OR
             regexp_matches(s, '(?i)lorem ipsum|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|subscribe to our newsletter|skip to (?:main )?content|datenschutzerklärung|alle rechte vorbehalten|cookie-einstellungen|newsletter abonnieren|politique de confidentialité|tous droits réservés|mentions légales|política de (?:privacidad|cookies)|todos los derechos reservados|aviso legal')
             THEN 0 ELSE c END)::BIGINT AS kept_chars FROM m GROUP BY r),
b AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
             (len(list_filter(l, lambda q: regexp_matches(q, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda q: regexp_matches(q, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, kept_chars FROM w LEFT JOIN rep USING (r) JOIN k USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * (word_chars - kept_chars) <= 50 * word_chars AS kept, kept_chars FROM f
"""
