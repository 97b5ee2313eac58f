"""Quality rules, line first, in DataFrame functions only.

Each line of a text is held against four rules: it must end a sentence somewhere (punctuation), it
must not be a row of separators (navigation), must not be a short line with a stock phrase as words of
its own (boilerplate), and must not be full of symbols. Failing lines are removed; a document that loses
too large a share of its characters is rejected. Document-level base figures are kept beside it.

Everything happens inside a row: no shuffle, no Python. Repeated windows of words are found by
sorting window hashes within the text, n log n in its length.

Defined results: a null text has no words and one empty line, so its figures are zero and it is
rejected (fewer than 20 words); blank lines pass every rule; repeated rows each give a row; an empty table
gives no rows; input columns are kept, but for one named as the verdict, which is replaced by that struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE_CLASS, unused

WINDOW = 8
#: Stock phrases of page furniture in English, German, French and Spanish (fixed values).
PHRASES = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "accept cookies", "enable javascript", "sign up", "log in",
    "subscribe to our newsletter", "click here", "read more", "share this", "back to top", "skip to content", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "jetzt anmelden", "newsletter abonnieren", "hier klicken",
    "weiterlesen", "nach oben", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "accepter les cookies", "se connecter", "s'inscrire",
    "abonnez-vous à notre newsletter", "cliquez ici", "lire la suite", "haut de page", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "aceptar cookies", "iniciar sesión", "suscríbete a nuestro boletín",
    "haz clic aquí", "leer más", "volver arriba", "saltar al contenido",
]
#: A phrase in lower case, with neither a letter nor a digit on either side.
BOILERPLATE = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(PHRASES) + r")(?:$|[^\p{L}\p{N}])"
SENTENCE_END = r"""[.!?…。！？]["')\]»”’]*(?:[ \t-\r]|$)"""
SEPARATORS = "[|»›•·]"
SYMBOLS = "[#*$%&|<>{}\\\\^~=]"


def _let(value: Column, body) -> Column:
    """Bind `value` once inside an expression that is evaluated only where it is needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    """Number of characters that match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _covered(hashes: Column, width: int) -> Column:
    """Words inside windows whose hash comes twice or more."""

    def of_sorted(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
        return _let(F.array_sort(F.transform(again, lambda x: x["i"])), of_positions)

    def of_positions(p: Column) -> Column:
        spans = F.transform(p, lambda at, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - at, F.lit(width))))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    return _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that come twice or more in the text, the first included."""
    single = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(single, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width))))
    count = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w, width)).otherwise(0))
    return F.when(F.size(words) >= width + 1, count).otherwise(0)


def line_fails(line: Column) -> Column:
    """Whether a line breaks one of the rules; blank lines pass."""
    full = F.length(line)
    separators = _count(line, SEPARATORS)
    navigation = (separators >= 3) & (separators * 4 >= _count(line, " ") + 1)
    boilerplate = (full < 200) & F.lower(line).rlike(BOILERPLATE)
    symbols = _count(line, SYMBOLS) * 10 > full
    return line.rlike(r"[^ \t-\r]") & (~line.rlike(SENTENCE_END) | navigation | boilerplate | symbols)


def assess(df: DataFrame, text_col: str = "text", least_words: int = 20, most_repeated: int = 30, most_lost: int = 50, out_col: str = "rules") -> DataFrame:
    """`df` with a struct of figures and verdicts.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, lines_removed,
    chars_removed, kept, clean_text. `most_repeated` and `most_lost` are percentages; a document is kept
    unless a base rule fails or more than `most_lost` per cent of its characters are in removed lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = unused(df, out_col)
    staged = df.select("*", F.struct(
        text.alias("text"),
        F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "").alias("words"),
        F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), line_fails(line).alias("fails"))).alias("lines"),
    ).alias(own))
    at = F.col(own)
    words, lines = at["words"], at["lines"]
    worded = F.filter(lines, lambda x: x["line"].rlike(r"[^ \t-\r]"))
    removed = F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(x["fails"], F.length(x["line"])).otherwise(0))
    figures = staged.withColumn(own, F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count(at["text"], "[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(F.transform(worded, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x["fails"])).cast("long").alias("lines_removed"),
        removed.cast("long").alias("chars_removed"),
        F.length(at["text"]).cast("long").alias("n_chars"),
        F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
    ))
    failed = (at["n_words"] < least_words) | (at["n_repeat_words"] * 100 > at["n_words"] * most_repeated)
    kept = ~failed & (at["chars_removed"] * 100 <= at["n_chars"] * most_lost)
    judged = figures.withColumn(own, at.withField("base_failed", failed).withField("kept", kept))
    return judged.drop(out_col).withColumnRenamed(own, out_col) if own != out_col else judged


#: DuckDB SQL of the query, with the same rules.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[ \x09-\x0d]+'), lambda x: x <> '') AS ws,
         string_split(t, chr(10)) AS ls FROM d
), win AS (
  SELECT rid, pos, array_to_string(ws[pos:pos + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS u(pos) WHERE len(ws) >= 8
), dup AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS n FROM win
), span AS (
  SELECT rid, least(8, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos, 8)) AS s FROM dup WHERE n > 1
), rep AS (
  SELECT rid, sum(s)::BIGINT AS n_repeat_words FROM span GROUP BY rid
), line AS (
  SELECT rid, l, length(l) AS len, regexp_matches(l, '[^ \x09-\x0d]') AS worded,
         length(l) - length(regexp_replace(l, '{SEPARATORS}', '', 'g')) AS seps,
         length(l) - length(replace(l, ' ', '')) AS blanks,
         length(l) - length(regexp_replace(l, '[#*$%&|<>{{}}\\^~=]', '', 'g')) AS syms
  FROM w, unnest(ls) AS u(l)
), judged AS (
  SELECT rid, l, len, worded, worded AND (
           NOT regexp_matches(l, '{SENTENCE_END.replace("'", "''").replace("t-", "x09-").replace(chr(92) + "r", chr(92) + "x0d")}')
           OR (seps >= 3 AND seps * 4 >= blanks + 1)
           OR (len < 200 AND regexp_matches(lower(l), '{BOILERPLATE.replace("'", "''")}'))
           OR syms * 10 > len) AS fails
  FROM line
), lines AS (
  SELECT rid, (count(*) FILTER (worded) - count(DISTINCT l) FILTER (worded))::BIGINT AS n_dup_lines,
         sum(CASE WHEN fails THEN len ELSE 0 END) AS lost FROM judged GROUP BY rid
), fig AS (
  SELECT w.rid, doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost
  FROM w JOIN lines USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost * 100 <= length(t) * 50 AS kept
FROM fig
"""
