"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is data: (name, measure, lower bound, upper bound). ``compile_rules``
turns any such table into Boolean columns over the measures; the measures are
built-in Spark expressions, so no user function runs.

Measures of a text (NULL counts as the empty text):

- ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``[#*$%&|<>]``),
- ``n_dup_lines`` (lines with a word that equal an earlier line of the text),
- ``n_repeat_words`` (words covered by five-word windows found twice or more),
- the ratios of the table: symbols, capitals, exclamation marks, stop words and the share of the text in repeated lines
  (of its characters, so that a short header that comes twice beside a long body is no fault).

An empty text has no words and fails the base rules. Rows are judged one by
one: ties, repeated rows and extra columns have no influence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_CHARS, text_of, words_of

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "de la le et les des en un du une que pour est par dans qui avec pas sur au "
    "der die und den von zu das mit sich auf für ist im nicht dem ein eine als "
    "el y los se las del por con no su para es al lo"
).split()

#: The threshold table. A verdict holds when every measure lies within its bounds (None: no bound). Stop words
#: are asked for from 50 words on: a shorter text may have none by chance.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "mean_word_length", 2.0, 12.0),
    ("symbols_per_word", "symbols_per_word", None, 0.10),
    ("capital_share", "capital_share", None, 0.40),
    ("exclamations_per_word", "exclamations_per_word", None, 0.25),
    ("stop_words_if_long", "stop_words_if_long", 0.02, None),
    ("dup_char_share", "dup_char_share", None, 0.30),
)

_WINDOW = 5


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The measures that need no window of words, by name."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "line_chars": F.length(F.array_join(lines, "")).cast("long"),
        "dup_chars": (F.length(F.array_join(lines, "")) - F.length(F.array_join(F.array_distinct(lines), ""))).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "n_exclamations": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long"),
    }


def repeated_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words in five-word windows that the row's word list holds twice or more.

    One hash a window tells most texts to have no such window. For the others the hashes are sorted with their places,
    so the cost is n log n in the words of one text, whatever is repeated.
    """
    w, h, s, d = F.col(words), "__hashes", "__windows", "__starts"
    n = F.size(w) - _WINDOW + 1
    window = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(_WINDOW)])
    docs = docs.withColumn(h, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), window)))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    docs = docs.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), placed)).drop(h)
    place = lambda x, i: F.when(
        (x["h"] == F.get(F.col(s), i - 1)["h"]) | (x["h"] == F.get(F.col(s), i + 1)["h"]), x["i"]
    )
    starts = F.sort_array(F.filter(F.transform(F.col(s), place), lambda i: i.isNotNull()))
    docs = docs.withColumn(d, starts).drop(s)
    gaps = F.transform(
        F.col(d),
        lambda x, i: F.least(F.lit(_WINDOW), F.coalesce(F.get(F.col(d), i + 1) - x, F.lit(_WINDOW))),
    )
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))).drop(d)


def ratios(m: dict[str, Column]) -> dict[str, Column]:
    """The measures of the threshold table."""
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "mean_word_length": per(m["word_chars"], m["n_words"]),
        "symbols_per_word": per(m["n_symbols"], m["n_words"]),
        "capital_share": per(m["n_capitals"], m["word_chars"]),
        "exclamations_per_word": per(m["n_exclamations"], m["n_words"]),
        "stop_words_if_long": F.when(m["n_words"] < 50, F.lit(1.0)).otherwise(per(m["n_stop_words"], m["n_words"])),
        "dup_char_share": per(m["dup_chars"], m["line_chars"]),
    }


def compile_rules(rules=RULES, columns: dict[str, Column] | None = None) -> Column:
    """One Boolean expression: every measure of the table lies within its bounds."""
    ok = F.lit(True)
    for _, measure, low, high in rules:
        value = (columns or {}).get(measure, F.col(measure))
        if low is not None:
            ok = ok & (value >= F.lit(low))
        if high is not None:
            ok = ok & (value <= F.lit(high))
    return ok


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """Every row with struct columns ``__m`` (the measures) and ``__kept`` (the verdict)."""
    docs = docs.withColumn("__text", text_of(text_col)).withColumn("__words", words_of(F.col("__text")))
    docs = repeated_words(docs, "__words", "__repeat")
    m = measures(F.col("__text"), F.col("__words")) | {"n_repeat_words": F.col("__repeat")}
    docs = docs.withColumn("__m", F.struct(*[v.alias(k) for k, v in m.items()]))
    docs = docs.drop("__text", "__words", "__repeat")
    got = {k: F.col("__m")[k] for k in m}
    failed = (got["n_words"] < 10) | (100 * got["n_repeat_words"] > 20 * got["n_words"])
    return docs.withColumn("__failed", failed).withColumn(
        "__kept", ~F.col("__failed") & compile_rules(rules, ratios(got))
    )


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The measures and verdict of every row."""
    judged = judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rules)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id", *[F.col("__m")[c].alias(c) for c in base], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with their columns unchanged."""
    # A filter would be pushed below the projections, with a copy of the measures for every use of one; a row number
    # that the filter needs keeps it above them.
    judged = judge(docs, text_col, rules).withColumn("__row", F.monotonically_increasing_id())
    return judged.filter(F.col("__kept") & (F.col("__row") >= 0)).select(docs.columns)
