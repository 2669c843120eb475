"""Line-first quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from currikit.llm.common import WORD, let, words_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
#: Line rules. Separators of menus, phrases of notices that sites repeat (in the languages of the corpus), and marks that end a sentence.
SEPARATORS = "|»›•·"
BOILERPLATE = (
    # English
    "accept all cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "use of cookies",
    # German
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "cookie-richtlinie",
    "datenschutzerklärung",
    "diese website verwendet cookies",
    "hier klicken",
    "javascript aktivieren",
    "nutzungsbedingungen",
    "zum inhalt springen",
    "zum newsletter anmelden",
    # Spanish
    "aceptar todas las cookies",
    "activar javascript",
    "este sitio utiliza cookies",
    "haga clic aquí",
    "ir al contenido",
    "política de cookies",
    "política de privacidad",
    "suscríbase a nuestro boletín",
    "términos de uso",
    "todos los derechos reservados",
    # French
    "abonnez-vous à notre newsletter",
    "accepter tous les cookies",
    "activer javascript",
    "aller au contenu",
    "ce site utilise des cookies",
    "cliquez ici",
    "conditions d'utilisation",
    "politique de confidentialité",
    "politique relative aux cookies",
    "tous droits réservés",
)
SENTENCE_END = r"[.!?…。！？]"
#: A line of menu separators: one for so many words at most.
WORDS_PER_SEPARATOR = 4
#: A boilerplate phrase fails a line of so many words at most.
BOILERPLATE_WORDS = 40
#: A line of this many words needs a sentence mark.
UNPUNCTUATED_WORDS = 8
#: A document may lose this share of its word characters, in percent.
MAX_LOST_PERCENT = 50


def _count_of(text: Column, chars: str) -> Column:
    """How many of the text's characters are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def _signs(text: Column) -> Column:
    """What a whole text has at all: symbols, separators, and boilerplate phrases. Cheap searches that spare nearly all lines a count."""
    notices = let(F.lower(text), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in BOILERPLATE)))
    return F.struct(F.rlike(text, F.lit(f"[{SYMBOLS}]")).alias("symbols"), F.rlike(text, F.lit(f"[{SEPARATORS}]")).alias("separators"), notices.alias("notices"))


def line_failure(line: Column, signs: Column) -> Column:
    """The first rule that a line with a word fails: punctuation, navigation or boilerplate; null if none. ``signs`` are its text's."""
    zero = F.lit(0)
    counts = F.struct(
        F.regexp_count(line, F.lit(WORD)).alias("n"),
        F.when(signs["symbols"], _count_of(line, SYMBOLS)).otherwise(zero).alias("symbols"),
        F.when(signs["separators"], _count_of(line, SEPARATORS)).otherwise(zero).alias("separators"),
        F.when(F.contains(line, F.lit("!!")), F.regexp_count(line, F.lit("!!"))).otherwise(zero).alias("marks"),
    )

    def judged(x: Column) -> Column:
        unended = (x["n"] >= UNPUNCTUATED_WORDS) & ~F.rlike(line, F.lit(SENTENCE_END))
        return (
            F.when((x["separators"] >= 1) & (x["separators"] * WORDS_PER_SEPARATOR >= x["n"]), "navigation")
            .when((x["symbols"] * 2 >= x["n"]) & (x["symbols"] >= 2) | (x["marks"] * 3 >= x["n"]) & (x["marks"] >= 2) | unended, "punctuation")
            .when(signs["notices"] & (x["n"] <= BOILERPLATE_WORDS) & F.rlike(F.lower(line), F.lit("|".join(BOILERPLATE))), "boilerplate")
        )

    return let(counts, judged)


def _repeat_words(words: Column) -> Column:
    """Words in windows of REPEAT_WINDOW words that the text has twice or more, all occurrences included.

    Windows are put in order, so that equal ones are neighbours; the starts of
    those with an equal neighbour are put in order again, and each covers up to
    the next start.
    """
    k = REPEAT_WINDOW

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, j: F.coalesce(F.least(F.lit(k), F.get(starts, j + 1) - p), F.lit(k))), F.lit(0).cast("long"), lambda a, b: a + b)

    def repeated(windows: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(windows, j)["w"] == x["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(windows, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def ordered(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + d) for d in range(k))).alias("w"), i.alias("i"))))

    def of(w: Column) -> Column:
        return F.when(F.size(w) >= k, let(let(ordered(w), repeated), covered)).otherwise(F.lit(0).cast("long"))

    return let(words, of)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT, whole_rows: bool = False) -> DataFrame:
    """Base counts, the cleaned text and the verdict for each row of docs.

    Lines (at \\n) with a word are judged first, one by one: menu lines, lines
    of symbols or without a sentence mark, and notices are removed. The base
    rules then judge the whole text, and a document that lost more than
    ``max_lost_percent`` of its word characters with its lines is rejected.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept, lost_chars (long), clean_text, and,
    with ``whole_rows``, doc, a struct of all columns of docs. A null text counts as empty: all counts 0, base_failed true, kept false. A
    null id stays null; equal rows give equal rows; other columns are ignored;
    an empty table gives an empty result. No shuffle; each text is one row's work.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.struct("*").alias("doc")] if whole_rows else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *carried)
    doc = ["doc"] if whole_rows else []
    wordy = lambda x: F.rlike(x, F.lit(WORD))
    good_lines = let(_signs(F.col("text")), lambda signs: F.filter(F.split("text", "\n"), lambda x: ~wordy(x) | line_failure(x, signs).isNull()))
    measured = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    found = F.struct(
        "doc_id",
        measured.alias("w"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(F.filter(F.split("text", "\n"), wordy), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.array_join(good_lines, "\n"), lambda c: F.struct(c.alias("text"), F.when(F.length(c) == F.length("text"), 0).otherwise(_word_chars(F.col("text")) - _word_chars(c)).cast("long").alias("lost"))).alias("clean"),
        *doc,
    )
    # a row of a generator: a filter on the result can't be pushed below and have it all computed twice
    counted = rows.select(F.explode(F.array(found)).alias("f")).select(
        "f.doc_id",
        "f.w.n_words",
        "f.w.word_chars",
        "f.n_symbols",
        "f.n_dup_lines",
        "f.w.n_repeat_words",
        F.col("f.clean.lost").alias("lost_chars"),
        F.col("f.clean.text").alias("clean_text"),
        *(F.col(f"f.{d}") for d in doc),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    judged = counted.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost_percent))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "clean_text", *doc)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same in DuckDB."""
    word, white = _sql_text(WORD), "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    chars_of = lambda x, chars: f"(length({x}) - length(translate({x}, {chars}, '')))"
    count = lambda x: f"len(regexp_extract_all({x}, {word}))"
    n, symbols, seps, marks = count("l"), chars_of("l", _sql_text(SYMBOLS)), chars_of("l", _sql_text(SEPARATORS)), "len(regexp_extract_all(l, '!!'))"
    bad = f"""(({seps} >= 1 AND {seps} * {WORDS_PER_SEPARATOR} >= {n})
      OR ({symbols} * 2 >= {n} AND {symbols} >= 2) OR ({marks} * 3 >= {n} AND {marks} >= 2)
      OR ({n} >= {UNPUNCTUATED_WORDS} AND NOT regexp_matches(l, {_sql_text(SENTENCE_END)}))
      OR (regexp_matches(lower(l), {_sql_text("|".join(BOILERPLATE))}) AND {n} <= {BOILERPLATE_WORDS}))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {word}) AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {word})) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(0, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= {REPEAT_WINDOW}),
key AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS k FROM win),
rep AS (SELECT doc_id, i FROM key QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, range(0, {REPEAT_WINDOW}) t(o) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST({chars_of("text", white)} AS BIGINT) AS white, length(text) AS n, {chars_of("text", _sql_text(SYMBOLS))} AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n_repeat_words, 0) AS n_repeat_words,
             array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, {word}) OR NOT {bad}), chr(10)) AS clean_text
      FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT doc_id, n_words, n - white AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
             CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
             n - white - (length(clean_text) - {chars_of("clean_text", white)}) AS lost_chars,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(lost_chars AS BIGINT) AS lost_chars, base_failed,
       NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM f"""

