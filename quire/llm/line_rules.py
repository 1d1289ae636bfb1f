"""Operator 6 - quality rules, line first.

Every line is judged alone: it fails without a mark that closes a sentence, as navigation (separators
between short items, or a menu word at its start), as boilerplate (stock phrases, code braces), as symbol
noise or shouting, or when few of its words differ.  Failing lines go; a document that keeps less than
``keep_share`` of the characters of its non-blank lines is rejected.

Cases: a null or blank text loses nothing and is kept with an empty text; a null id is kept like any
other; repeated rows are each judged; a very long text is judged line by line, whole; an empty table gives an empty result.  No Python runs here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import shield

CLOSED = "[.!?:;…][\"')»”’]*( |$)"
MENU = "^(home|menu|next|previous|back|login|log in|sign in|sign up|share|skip to|read more|search)( |$)"
STOCK = "cookie|privacy policy|terms of (use|service)|all rights reserved|click here|subscribe|newsletter|javascript|lorem ipsum|copyright ©"
KEEP_SHARE = 0.5


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line (trimmed, with its words) fails; the rules per word run only where a line has their marks."""
    n, low = F.size(words), F.lower(line)
    dividers = F.size(F.filter(words, lambda w: w.isin("|", ">", "»", "•", "·", "/")))
    noisy = F.size(F.filter(words, lambda w: w.rlike("[#$%&*@^~=]{2,}")))
    loud = F.size(F.filter(words, lambda w: w.rlike("[!?]{2,}$")))
    return (
        ~line.rlike(CLOSED)
        | (line.rlike("[|>»•·/]") & (dividers * 4 >= n))
        | low.rlike(MENU)
        | low.rlike(STOCK)
        | line.rlike("[{}]")
        | (line.rlike("[#$%&*@^~=]{2,}") & (noisy * 5 >= n))
        | (line.rlike("[!?]{2,}") & (loud * 3 >= n))
        | ((n >= 10) & (F.size(F.array_distinct(words)) * 4 < n))
    )


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """value as a column that later filters and projections read rather than compute again."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _judged(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.transform(lines, lambda x: F.struct(x.alias("x"), F.filter(F.split(x, " "), lambda w: w != "").alias("w")))
    rows = _once(rows, "q_lines", lines)
    rows = _once(rows, "q_kept", F.filter("q_lines", lambda s: ~line_fails(s["x"], s["w"]))["x"])
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x))
    return _once(rows, "q_size", F.struct(size(F.col("q_lines.x")).alias("all"), size("q_kept").alias("left")))


def clean(docs: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Kept documents: doc_id, clean_text, lines, kept_lines, chars, kept_chars."""
    rows = _judged(shield(docs).picked()).where(F.col("q_size.left") >= F.col("q_size.all") * keep_share)
    return rows.select("doc_id", F.array_join("q_kept", "\n").alias("clean_text"), F.size("q_lines").alias("lines"), F.size("q_kept").alias("kept_lines"), F.col("q_size.all").alias("chars"), F.col("q_size.left").alias("kept_chars"))


def clean_sql(keep_share: float = KEEP_SHARE) -> str:
    q = lambda s: s.replace("'", "''")
    words = "list_filter(string_split(x, ' '), lambda w: w <> '')"
    fails = f"""NOT regexp_matches(x, '{q(CLOSED)}')
      OR len(list_filter({words}, lambda w: w IN ('|', '>', '»', '•', '·', '/'))) * 4 >= len({words})
      OR regexp_matches(lower(x), '{MENU}') OR regexp_matches(lower(x), '{STOCK}') OR regexp_matches(x, '[{{}}]')
      OR len(list_filter({words}, lambda w: regexp_matches(w, '[#$%&*@^~=]{{2,}}'))) * 5 >= len({words})
      OR len(list_filter({words}, lambda w: regexp_matches(w, '[!?]{{2,}}$'))) * 3 >= len({words})
      OR (len({words}) >= 10 AND len(list_distinct({words})) * 4 < len({words}))"""
    return f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
    b AS (SELECT doc_id, ls, list_filter(ls, lambda x: NOT ({fails})) AS ks FROM a),
    c AS (SELECT *, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS n, coalesce(list_sum(list_transform(ks, lambda x: length(x))), 0) AS k FROM b)
    SELECT doc_id, coalesce(array_to_string(ks, chr(10)), '') AS clean_text, len(ls)::INT AS lines, len(ks)::INT AS kept_lines, n::INT AS chars, k::INT AS kept_chars
    FROM c WHERE k >= n * {keep_share}"""
