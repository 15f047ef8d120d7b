"""Quality rules, line by line first; SQL expressions only.

A line that holds a word fails when it is
- symbols or shouting: more than 3 marks (runs of two or more of ``#*$%&<>``, or ``!!``) per 10 words,
- navigation: at least 3 separators (``|``, ``»``, ``›``, ``•``) and more than 2 per 10 words,
- unfinished: under 5 words and no closing punctuation,
- boilerplate: under 40 words and one of the phrases of BOILERPLATE.
Failing lines are removed; a document that loses more than 30 % of its words that way is rejected, and so is one that
fails the base rules (fewer than 50 words, or over half of its words in repeated three-word windows).

Everything is computed within the row: no shuffle, and no group to gather. Repeated windows are found by sorting a
document's own windows, so a long document costs n log n.

Defined results: a null or empty text has no words and fails the base rules; whole texts are read at any length;
repeated rows are judged alike; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MARKS = r"[#*$%&<>]{2,}|!!"
SEPARATOR = r"[|»›•]"
CLOSED = r"[.!?…:;,\"”»)\x5D][\x20\x09-\x0D]*$"
#: Phrases of notices and menus in English, German, French and Spanish, in lower case.
BOILERPLATE = (
    r"all rights reserved|copyright|cookie|privacy policy|terms of (use|service)|licensed under|released under|general public license|click here|sign (in|up)|log ?in|subscribe|enable javascript|skip to content|read more"
    r"|alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|impressum|hier klicken|newsletter abonnieren|weiterlesen"
    r"|tous droits r[eé]serv|politique de confidentialit|conditions d.utilisation|mentions l[eé]gales|cliquez ici|se connecter|lire la suite"
    r"|todos los derechos reservados|pol[ií]tica de privacidad|condiciones de uso|aviso legal|haga clic|iniciar sesi[oó]n|leer m[aá]s"
)
MOST_LOST = 30


def _q(pattern: str) -> str:
    """pattern as a literal of Spark SQL."""
    return "r'" + pattern.replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body, with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def line_fails(line: str) -> str:
    """Whether a line that holds a word fails; its words and separators are counted once. The dear test comes last."""
    fails = (
        f"(10 * regexp_count({line}, {_q(MARKS)}) > 3 * n OR (n < 5 AND NOT {line} RLIKE {_q(CLOSED)})"
        f" OR {_let(f'regexp_count({line}, {_q(SEPARATOR)})', 'c', 'c >= 3 AND 10 * c > 2 * n')} OR (n < 40 AND lower({line}) RLIKE {_q(BOILERPLATE)}))"
    )
    return _let(f"regexp_count({line}, {_q(WORD)})", "n", fails)


REPEATED = _let(
    "sort_array(CASE WHEN size(_words) < 4 THEN NULL ELSE transform(sequence(0, size(_words) - 3), i -> struct(concat_ws(' ', get(_words, i), get(_words, i + 1), get(_words, i + 2)) AS g, i AS i)) END)",
    "s",
    "CASE WHEN s IS NULL THEN 0 ELSE size(array_distinct(flatten(transform(filter(s, (x, j) -> get(s, j - 1).g <=> x.g OR get(s, j + 1).g <=> x.g), x -> array(x.i, x.i + 1, x.i + 2))))) END",
)


def judge(docs: DataFrame, text: str = "text", keep=("doc_id",), with_text: bool = False) -> DataFrame:
    """A row per row of docs: the columns of keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines_removed, n_words_removed; with_text also clean_text, the text without its failing lines."""
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.selectExpr(*keep, "_text", f"filter(split(_text, {_q(SPACE)}), w -> w <> '') AS _words", f"filter(split(_text, '\\n'), l -> l RLIKE {_q(WORD)}) AS _lines")
    d = d.selectExpr(*keep, "_text", "_words", "_lines", f"filter(_lines, l -> {line_fails('l')}) AS _failing")
    d = d.selectExpr(
        *keep,
        "_text",
        "cast(size(_words) AS bigint) AS n_words",
        "cast(length(array_join(_words, '')) AS bigint) AS word_chars",
        f"cast(regexp_count(_text, {_q(SYMBOL)}) AS bigint) AS n_symbols",
        "cast(size(_lines) - size(array_distinct(_lines)) AS bigint) AS n_dup_lines",
        f"cast({REPEATED} AS bigint) AS n_repeat_words",
        "cast(size(_failing) AS bigint) AS n_lines_removed",
        f"aggregate(_failing, 0L, (a, l) -> a + regexp_count(l, {_q(WORD)})) AS n_words_removed",
    )
    d = d.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    d = d.withColumn("kept", F.expr(f"NOT base_failed AND 100 * n_words_removed <= {MOST_LOST} * n_words"))
    if with_text:
        d = d.withColumn("clean_text", F.expr(f"array_join(filter(split(_text, '\\n'), l -> NOT (l RLIKE {_q(WORD)}) OR NOT {line_fails('l')}), '\\n')"))
    return d.drop("_text")


def op5_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_D = {k: "'" + v.replace("'", "''") + "'" for k, v in {"space": SPACE, "word": WORD, "symbol": SYMBOL, "marks": MARKS, "sep": SEPARATOR, "closed": CLOSED, "boiler": BOILERPLATE}.items()}

QUERIES = {"op5_line_first_quality": op5_line_first_quality}

ORACLE = {
    "op5_line_first_quality": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, [x FOR x IN regexp_split_to_array(text, {_D["space"]}) IF x <> ''] AS ws FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
q AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
c AS (SELECT r, l, len(regexp_extract_all(l, {_D["word"]})) AS n, len(regexp_extract_all(l, {_D["marks"]})) AS m,
             len(regexp_extract_all(l, {_D["sep"]})) AS s FROM l WHERE regexp_matches(l, {_D["word"]})),
f AS (SELECT r, l, n, 10 * m > 3 * n OR (s >= 3 AND 10 * s > 2 * n) OR (n < 5 AND NOT regexp_matches(l, {_D["closed"]}))
             OR (n < 40 AND regexp_matches(lower(l), {_D["boiler"]})) AS bad FROM c),
a AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed,
             coalesce(sum(n) FILTER (bad), 0) AS n_words_removed FROM f GROUP BY r),
o AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, {_D["symbol"]}))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed,
         coalesce(n_words_removed, 0)::BIGINT AS n_words_removed
  FROM w LEFT JOIN q USING (r) LEFT JOIN a USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND 100 * n_words_removed <= {MOST_LOST} * n_words AS kept FROM b""",
}
