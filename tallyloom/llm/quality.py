"""Quality rules: a table of thresholds compiled into one projection over whole texts.

A measure is a count that one text gives: words, code points, symbols, stop words, lines.
A rule bounds one measure, or the share in percent that one measure has of another, from
below, from above, or both.  ``judged`` turns any table of rules into columns; a row never
meets another one, so there is no shuffle, and all of it is built-in expressions.

Repeated words are those in some window of three words that the text holds twice or more.
Windows are sorted within their text as numbers, half hash and half position; only those that
share their hash with another one are then compared by their words, so hashes decide nothing.

Defined results: null and empty texts, and those of white space, have no words and no lines;
a rule on a share passes where the whole is 0; repeated rows are judged one by one; an empty
table gives an empty table; other columns of the input may have any name, and are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: What may stand around a word without making it another one.
AROUND = ".,;:!?()[]{}\"'"
#: Two capitals at least and no small letter.
SHOUTED = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"

#: Frequent function words of English, German, French and Spanish, as given in common lists.
STOP_WORDS = (
    "the be to of and that have with in is it as for was on are by this from an or at not "
    "der die das und ist von mit den dem des zu im ein eine auf nicht sich als auch "
    "le la les de du et en un une que qui dans pour par sur au est il elle "
    "el los las y del se con para su al es lo como más"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(items: Column) -> Column:
    return F.size(items).cast("long")


def _twins(found: Column, key: Callable[[Column], Column]) -> Column:
    """The places in a sorted array, not empty, whose ``key`` is that of a neighbour."""

    def again(j: Column) -> Column:
        own = key(F.get(found, j))
        return F.coalesce(own == key(F.get(found, j - 1)), F.lit(False)) | F.coalesce(own == key(F.get(found, j + 1)), F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(found) - 1), again)


#: Bits of a packed window for its position.
PLACE = 31


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many of ``words`` lie in a window of ``width`` words that is there twice or more."""

    def own(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(width)]

    def packed(i: Column) -> Column:
        short = F.xxhash64(*own(i)).bitwiseAND(F.lit((1 << 32) - 1))
        return F.shiftleft(short, PLACE).bitwiseOR(i.cast("long"))

    def suspects(found: Column) -> Column:
        at = _twins(found, lambda x: F.shiftright(x, PLACE))
        return F.transform(at, lambda j: F.get(found, j).bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))

    def covered(found: Column) -> Column:
        at = F.transform(_twins(found, lambda x: x["w"]), lambda j: F.get(found, j)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + (width - 1))))))

    def exact(at: Column) -> Column:
        named = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *own(i)).alias("w"), i.alias("i"))))
        return F.when(F.size(at) > 0, let(named, covered)).otherwise(F.lit(0))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), packed)
    found = let(let(F.sort_array(windows), suspects), exact)
    return F.when(F.size(words) > width, found).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """A struct of all measures of a text that isn't null.

    Words and lines are bound once, inside the expression: a filter on a measure that Spark
    moves below this projection then computes it again, but never once for each word.
    """

    def counted(parts: Column) -> Column:
        words, lines = parts["words"], parts["lines"]
        found = {
            "n_words": _count(words),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
            "n_lines": _count(lines),
            "n_dup_lines": _count(lines) - _count(F.array_distinct(lines)),
            "n_repeat_words": let(words, lambda w: repeated_words(w)),
            "n_stop_words": _count(F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(AROUND))).isin(STOP_WORDS))),
            "n_letter_words": _count(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
            "n_shouted_words": _count(F.filter(words, lambda w: w.rlike(SHOUTED))),
        }
        return F.struct(*(c.alias(n) for n, c in found.items()))

    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(F.struct(words.alias("words"), lines.alias("lines")), counted)


@dataclass(frozen=True)
class Rule:
    """``measure``, or its share in percent of ``of``, lies within ``least`` and ``most``."""

    name: str
    measure: str
    of: str | None = None
    least: int | None = None
    most: int | None = None

    def broken(self) -> Column:
        value, unit = F.col(self.measure), F.lit(1)
        if self.of:
            value, unit = 100 * value, F.col(self.of)
        out = F.lit(False)
        if self.least is not None:
            out = out | (value < self.least * unit)
        if self.most is not None:
            out = out | (value > self.most * unit)
        return out


#: What no table may leave out.
BASE = (
    Rule("few_words", "n_words", least=50),
    Rule("repeats", "n_repeat_words", of="n_words", most=50),
)
#: Lengths, symbols, stop words and lines: thresholds of public filters for web text, in percent.
RULES = (
    Rule("word_length", "word_chars", of="n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", of="n_words", most=10),
    Rule("letters", "n_letter_words", of="n_words", least=80),
    Rule("stop_words", "n_stop_words", of="n_words", least=5),
    Rule("shouted", "n_shouted_words", of="n_words", most=30),
    Rule("dup_lines", "n_dup_lines", of="n_lines", most=40),
)


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """``doc_id``, all measures, ``base_failed``, ``kept`` and ``broken`` (names of broken rules, by commas) of each row."""
    measured = df.select("doc_id", measures(F.coalesce(F.col("text"), F.lit(""))).alias("_qr")).select("doc_id", "_qr.*")
    names = F.array_compact(F.array(*(F.when(r.broken(), F.lit(r.name)) for r in (*base, *rules))))
    failed = F.lit(False)
    for r in base:
        failed = failed | r.broken()
    told = measured.withColumns({"base_failed": failed, "broken": F.array_join(names, ",")})
    return told.withColumn("kept", F.col("broken") == "")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document and whether the table keeps it."""
    told = judged(table(spark, sf_dir, "documents"))
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", "n_letter_words", "n_shouted_words", "broken",
    )


def _listed(words: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _broken_sql(rule: Rule) -> str:
    value, unit = (f"100 * {rule.measure}", rule.of) if rule.of else (rule.measure, "1")
    sides = [f"{value} < {rule.least} * {unit}"] * (rule.least is not None) + [f"{value} > {rule.most} * {unit}"] * (rule.most is not None)
    return " OR ".join(sides)


_AROUND_SQL = AROUND.replace("'", "''")
ORACLE_SQL = f"""
WITH parts AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
split_up AS (
  SELECT *, [w FOR w IN regexp_split_to_array(text, '{BLANK}') IF w <> ''] AS words,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{WORD}')] AS lines FROM parts),
windows AS (
  SELECT row_no, unnest(range(1, len(words) - 1)) AS i, words FROM split_up WHERE len(words) > 2),
named AS (SELECT row_no, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM windows),
often AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w) AS n FROM named),
repeated AS (
  SELECT row_no, count(DISTINCT i + k) AS n_repeat_words
  FROM often, (VALUES (0), (1), (2)) AS steps(k) WHERE n > 1 GROUP BY row_no),
measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '{SYMBOL}')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len([w FOR w IN words IF list_contains([{_listed(STOP_WORDS)}], lower(trim(w, '{_AROUND_SQL}')))]) AS n_stop_words,
         len([w FOR w IN words IF regexp_matches(w, '\\p{{L}}')]) AS n_letter_words,
         len([w FOR w IN words IF regexp_matches(w, '{SHOUTED}')]) AS n_shouted_words
  FROM split_up LEFT JOIN repeated USING (row_no)),
told AS (
  SELECT *, {" OR ".join(f"({_broken_sql(r)})" for r in BASE)} AS base_failed,
         concat_ws(',', {", ".join(f"CASE WHEN {_broken_sql(r)} THEN '{r.name}' END" for r in (*BASE, *RULES))}) AS broken
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken = '' AS kept,
       n_lines, n_stop_words, n_letter_words, n_shouted_words, broken FROM told
"""
