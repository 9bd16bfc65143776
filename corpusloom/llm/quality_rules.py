"""Quality rules: a threshold table compiled into one Spark projection; no user function takes part."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import pick

STOP_WORDS = ("the of and to in is that for it as was with be by on are this from an at not or which le la de et les des en un une du est que pour dans par sur au aux avec ne se der die das und den von zu mit sich dem ein eine ist auf für im nicht el los las del y por con para al lo su como más").split()
SYMBOLS = "#$%&*@^~+=<>{}[]|\\"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A text breaks the rule if it has at least min_words words and the metric lies outside [low, high]."""

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")
    min_words: int = 0


RULES = (
    Rule("too_short", "n_words", low=1),
    Rule("too_long", "n_words", high=200_000),
    Rule("word_length", "mean_word_length", low=2, high=15, min_words=10),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("bars", "bar_ratio", high=0.3, min_words=10),
    Rule("bangs", "bang_ratio", high=0.2, min_words=10),
    Rule("shouting", "upper_ratio", high=0.4, min_words=10),
    Rule("stop_words", "stop_word_ratio", low=0.04, min_words=20),
    Rule("line_length", "mean_line_words", low=1.2, min_words=50),
    Rule("copied_lines", "copied_line_ratio", high=0.4, min_words=10),
)
METRICS = ("n_chars", "n_words", "mean_word_length", "symbol_ratio", "bar_ratio", "bang_ratio", "upper_ratio", "stop_word_ratio", "mean_line_words", "copied_line_ratio")


def _count(text: Column, chars: str) -> Column:
    """How many of the characters a text has; one scan by a character class is far cheaper than a translation table."""
    return F.regexp_count(text, F.lit("[" + re.sub(r"([\\\[\]^&-])", r"\\\1", chars) + "]"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, the METRICS, broken, keep) for each row of docs, over the whole text.

    broken lists the names of the broken rules in table order, joined by commas; keep says that there are none. Words are
    cut at blanks, tabs and line ends, lines at line ends; blank lines don't count. Ratios of an empty text are 0. A null
    text has null metrics and breaks only the rule "null_text". Rows with a null doc_id and repeated rows are judged row
    by row. Only doc_id and text are read.
    """
    text = F.col("text")
    base = pick(docs, doc_id="doc_id", text="text").select(
        "doc_id", "text", F.length(text).cast("long").alias("n_chars"),
        F.filter(F.split(F.lower(text), "[ \t\r\n]+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0).alias("x"),
    )
    stop_count = F.size(F.filter("w", lambda w: w.isin(STOP_WORDS)))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(text.isNotNull(), F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0)))

    n_words, n_lines = F.size("w"), F.size("x")
    metrics = {
        "n_words": F.when(text.isNotNull(), n_words.cast("long")),
        "mean_word_length": ratio(F.col("n_chars") - _count(text, " \t\r\n"), n_words),
        "symbol_ratio": ratio(_count(text, SYMBOLS), F.col("n_chars")),
        "bar_ratio": ratio(_count(text, "|"), n_words),
        "bang_ratio": ratio(_count(text, "!"), n_words),
        "upper_ratio": ratio(_count(text, UPPER), F.col("n_chars")),
        "stop_word_ratio": ratio(stop_count, n_words),
        "mean_line_words": ratio(n_words, n_lines),
        "copied_line_ratio": ratio(n_lines - F.size(F.array_distinct("x")), n_lines),
    }
    measured = base.select("doc_id", F.col("n_chars"), *[c.alias(n) for n, c in metrics.items()])
    return measured.select("doc_id", *METRICS, broken_rules(rules).alias("broken")).withColumn("keep", F.col("broken") == "")


def broken_rules(rules: tuple[Rule, ...]) -> Column:
    """The table as one expression: the names of the broken rules."""
    named = []
    for r in rules:
        outside = [F.col(r.metric) < r.low] * (r.low > float("-inf")) + [F.col(r.metric) > r.high] * (r.high < float("inf"))
        if outside:
            test = outside[0] if len(outside) == 1 else outside[0] | outside[1]
            named.append(F.when((F.col("n_words") >= r.min_words) & test, F.lit(r.name)))
    return F.when(F.col("n_words").isNull(), F.lit("null_text")).otherwise(F.concat_ws(",", *named))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows in DuckDB SQL."""
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    symbols = SYMBOLS.replace("'", "''")
    tests = ", ".join(
        f"CASE WHEN n_words >= {r.min_words} AND (" + " OR ".join([f"{r.metric} < {r.low}"] * (r.low > float("-inf")) + [f"{r.metric} > {r.high}"] * (r.high < float("inf"))) + f") THEN '{r.name}' END" for r in rules
    )
    return f"""
WITH base AS (SELECT doc_id, text, length(text)::BIGINT AS n_chars,
    list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: x <> '') AS x FROM documents),
n AS (SELECT *, len(w)::DOUBLE AS nw, len(x)::DOUBLE AS nx FROM base),
m AS (SELECT doc_id, n_chars, len(w)::BIGINT AS n_words,
    CASE WHEN nw > 0 THEN length(translate(text, ' ' || chr(9) || chr(13) || chr(10), ''))::DOUBLE / nw ELSE 0 END AS mean_word_length,
    CASE WHEN n_chars > 0 THEN (n_chars - length(translate(text, '{symbols}', '')))::DOUBLE / n_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN nw > 0 THEN (n_chars - length(replace(text, '|', '')))::DOUBLE / nw ELSE 0 END AS bar_ratio,
    CASE WHEN nw > 0 THEN (n_chars - length(replace(text, '!', '')))::DOUBLE / nw ELSE 0 END AS bang_ratio,
    CASE WHEN n_chars > 0 THEN (n_chars - length(translate(text, '{UPPER}', '')))::DOUBLE / n_chars ELSE 0 END AS upper_ratio,
    CASE WHEN nw > 0 THEN len(list_filter(w, lambda t: lower(t) IN ({words})))::DOUBLE / nw ELSE 0 END AS stop_word_ratio,
    CASE WHEN nx > 0 THEN nw / nx ELSE 0 END AS mean_line_words,
    CASE WHEN nx > 0 THEN (nx - len(list_distinct(x))) / nx ELSE 0 END AS copied_line_ratio FROM n WHERE text IS NOT NULL)
SELECT *, broken = '' AS keep FROM (SELECT *, concat_ws(',', {tests}) AS broken FROM m)
UNION ALL BY NAME SELECT doc_id, 'null_text' AS broken, FALSE AS keep FROM documents WHERE text IS NULL"""
