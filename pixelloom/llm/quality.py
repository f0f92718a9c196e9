"""Quality rules: a table of thresholds compiled into one projection.

Each measure is an expression of built-in functions, each rule a comparison of
a measure with a threshold, applied from a least word count on. All of them
are evaluated in one pass over a document, without user functions; filters and
measures are plain columns to Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, spread

SYMBOLS = "#$%&*|<>{}[]~^_=+\\@/"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it as on be was with are at by or this from an not "
    "de la le et les des un une que en el los y se del au du est dans par pas sur pour "
    "con para no al las lo por su der die und das den von zu mit ist ein auf dem im für nicht sich"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a document of at least ``from_words`` words whose measure is
    below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 1


#: The production table.
RULES = (
    Rule("empty", "words", least=1, from_words=0),
    Rule("long_words", "word_length", most=14.0, from_words=5),
    Rule("symbols", "symbol_ratio", most=0.05),
    Rule("marks", "mark_ratio", most=0.04),
    Rule("capitals", "capital_ratio", most=0.35, from_words=5),
    Rule("few_stop_words", "stop_ratio", least=0.03, from_words=20),
    Rule("only_stop_words", "stop_ratio", most=0.75, from_words=20),
    Rule("few_distinct_words", "distinct_words", least=1.6, from_words=20),
    Rule("repeated_lines", "line_ratio", least=0.1, from_words=20),
)


def any_of(words: list[str]) -> str:
    """A regular expression for just these words, that shares their beginnings:
    it takes a step for each letter instead of one for each word."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        parts = [c + written(sub) for c, sub in sorted(at.items()) if c]
        if not parts:
            return ""
        return ("(?:" + "|".join(parts) + ")" if len(parts) > 1 or "" in at else parts[0]) + "?" * ("" in at)

    return written(tree)


def _count(text: Column, chars: str) -> Column:
    """Characters of a class of regular expressions. (translate() would make a
    string of each character.)"""
    return F.length(text) - F.length(F.regexp_replace(text, chars + "+", ""))


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body has it.
    Spark would write it out at each place when it moves filters down. (That keeps
    it out of generated code, where it was slower: regular expressions take the time.)"""
    return F.transform(F.array(value), body)[0]


def measures(text: Column) -> Column:
    """The struct of a text's measures. Ratios are to its characters (symbols,
    marks, capitals), words (stop words), lines (distinct lines), or the square
    root of its words (distinct words), so that they suit any length."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    apart = r" \n\t\r\f.,;:!?"
    base = F.struct(
        t.alias("t"),
        F.split(t, "\n").alias("lines"),
        # a mark for each word, and the blanks: what both are counted from
        F.regexp_replace(t, r"[^ \t\n\r\f]+", "x").alias("marks"),
        F.regexp_count(low, F.lit(f"(?<![^{apart}]){any_of(STOP_WORDS)}(?![^{apart}])")).alias("stops"),
        F.size(F.array_distinct(F.split(low, " "))).alias("distinct"),
    )

    def counted(b: Column) -> Column:
        blanks = F.length(F.replace(b["marks"], F.lit("x"), F.lit("")))
        own = [b[c].alias(c) for c in ("t", "lines", "stops", "distinct")]
        return let(F.struct(*own, blanks.alias("blanks"), (F.length(b["marks"]) - blanks).cast("double").alias("words")), ratios)

    def ratios(b: Column) -> Column:
        chars = F.greatest(F.length(b["t"]), F.lit(1)).cast("double")
        per_word = F.greatest(b["words"], F.lit(1.0))
        return F.struct(
            b["words"].alias("words"),
            ((F.length(b["t"]) - b["blanks"]) / per_word).alias("word_length"),
            (_count(b["t"], "[" + re.sub(r"(\W)", r"\\\1", SYMBOLS) + "]") / chars).alias("symbol_ratio"),
            ((F.length(b["t"]) - F.length(F.replace(b["t"], F.lit("!"), F.lit("")))) / chars).alias("mark_ratio"),
            (_count(b["t"], "[A-Z]") / chars).alias("capital_ratio"),
            (b["stops"] / per_word).alias("stop_ratio"),
            (b["distinct"] / F.sqrt(per_word)).alias("distinct_words"),
            (F.size(F.array_distinct(b["lines"])) / F.size(b["lines"]).cast("double")).alias("line_ratio"),
        )

    return let(base, counted)


def compile_rules(rules: tuple[Rule, ...], measure: Column) -> Column:
    """The name of the first rule that rejects, else null."""
    out = None
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (measure[r.measure] < F.lit(float(r.least)))
        if r.most is not None:
            bad = bad | (measure[r.measure] > F.lit(float(r.most)))
        bad = bad & (measure["words"] >= F.lit(float(r.from_words)))
        out = F.when(bad, F.lit(r.name)) if out is None else out.when(bad, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents with their measures in the struct ``quality`` and the name
    of the first rule that rejects them, or null, in ``rejected_by`` (both with
    underscores before them if the table has such columns).

    Null texts count as empty: rule "empty" rejects them, as it does texts of
    blanks only. Texts are read whole. Rows are judged one by one: repeated rows
    and ties get the same. An empty table gives an empty table."""
    q, by = free_name(docs, "quality"), free_name(docs, "rejected_by")
    both = let(measures(col(text)), lambda m: F.struct(m.alias("q"), compile_rules(rules, m).alias("by")))
    one = free_name(docs, "judged", q, by)
    return docs.withColumn(one, both).withColumn(q, F.col(one)["q"]).withColumn(by, F.col(one)["by"]).drop(one)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    return spread(docs).where(let(measures(col(text)), lambda m: compile_rules(rules, m)).isNull())


def quality_sql(rules: tuple[Rule, ...] = RULES, table: str = "documents", kept: str = "doc_id") -> str:
    """DuckDB's SQL for the kept documents' columns ``kept``."""
    sym = SYMBOLS.replace("'", "''")
    tests = []
    for r in rules:
        bad = [f"{r.measure} {sign} {float(x)}" for sign, x in (("<", r.least), (">", r.most)) if x is not None]
        tests.append(f"(words >= {float(r.from_words)} AND ({' OR '.join(bad)}))")
    return f"""
WITH t AS (SELECT *, coalesce(text, '') AS t_, greatest(length(coalesce(text, '')), 1)::DOUBLE AS chars,
  len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))::DOUBLE AS words FROM {table}),
u AS (SELECT *, greatest(words, 1.0) AS per_word,
  ' ' || replace(translate(lower(t_), chr(10) || chr(9) || chr(13) || chr(12) || '.,;:!?', '          '), ' ', '  ') || ' ' AS spaced FROM t),
m AS (SELECT *, length(translate(t_, ' ' || chr(9) || chr(10) || chr(13) || chr(12), ''))::DOUBLE / per_word AS word_length,
  (length(t_) - length(translate(t_, '{sym}', '')))::DOUBLE / chars AS symbol_ratio,
  (length(t_) - length(translate(t_, '!', '')))::DOUBLE / chars AS mark_ratio,
  (length(t_) - length(translate(t_, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::DOUBLE / chars AS capital_ratio,
  len(regexp_extract_all(spaced, ' (?:{"|".join(STOP_WORDS)}) '))::DOUBLE / per_word AS stop_ratio,
  len(list_distinct(string_split(lower(t_), ' ')))::DOUBLE / sqrt(per_word) AS distinct_words,
  len(list_distinct(string_split(t_, chr(10))))::DOUBLE / len(string_split(t_, chr(10)))::DOUBLE AS line_ratio FROM u)
SELECT {kept} FROM m WHERE NOT ({" OR ".join(tests)})"""
