"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule is a row ``(name, measure, comparison, numerator, denominator, per)``: the document fails when
``measure * denominator  <comparison>  numerator * per``, in whole numbers, so no verdict hangs on rounding.

Defined results: a null or empty text has no words and fails the length rule; ties on a threshold pass; repeated rows are
judged alone, each the same; an empty table gives an empty table. Other columns never matter, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, hidden, let, once, shown, table, words


class Rule(NamedTuple):
    name: str
    measure: str
    fails_if: str  # "<" or ">"
    numerator: int
    denominator: int
    per: str
    from_words: int = 0  # texts with fewer words pass


#: The base rules of the query's contract.
BASE_RULES = (
    Rule("too_short", "n_words", "<", 10, 1, "one"),
    Rule("repeated_windows", "n_repeat_words", ">", 20, 100, "n_words"),
)
#: The further rules: symbol, line, shouting and stop-word ratios, and word length.
RULES = (
    Rule("symbols", "n_symbols", ">", 3, 10, "n_words"),
    Rule("bangs", "n_bangs", ">", 5, 10, "n_words"),
    Rule("dup_lines", "n_dup_lines", ">", 5, 10, "n_lines"),
    Rule("long_words", "word_chars", ">", 30, 1, "n_words"),
    Rule("stop_words", "n_stop_words", "<", 1, 100, "n_words", 60),
)
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for with was this on it as by be are from at or an a "
    "der die das und den von mit ist des im zu ein eine nicht auf sich dem für als auch "
    "le la les de des et un une du en que qui dans pour par sur au est pas "
    "el los las del que y por con su para una se lo como más no"
).split()


def measures(text: Column) -> dict[str, Column]:
    """The counts that the rules use, by name; whole texts, null as empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    return {
        "word_chars": F.length(F.translate(whole, SEPARATORS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "n_bangs": (F.length(whole) - F.length(F.translate(whole, "!", ""))).cast("long"),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
        "words": let(
            words(whole),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"),
                repeat_words(w, 5).alias("repeat"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("stop"),
            ),
        ),
    }


def repeat_words(w: Column, k: int) -> Column:
    """Words inside ``k``-word windows that occur twice or more in the array ``w``, the first occurrence included.

    Windows are compared by 64-bit hash. Texts without an equal pair (a distinct-count over primitive longs) stop there;
    the others sort (hash, position) pairs, so the cost is n log n whatever the text.
    """
    n = F.size(w)
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])), F.lit(1), F.greatest(n - (k - 1), F.lit(0)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        spots = let(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda e: e["i"])))
        return let(spots, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, b: a + b))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def _fails(rule: Rule) -> Column:
    left, right = F.col(rule.measure) * rule.denominator, (F.lit(1) if rule.per == "one" else F.col(rule.per)) * rule.numerator
    bad = left < right if rule.fails_if == "<" else left > right
    return bad & (F.col("n_words") >= rule.from_words) if rule.from_words else bad


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_lines", "n_stop_words", "base_failed", "failed_rules", "kept")


def _judged(docs: DataFrame, text: str, base, rules) -> tuple[DataFrame, dict[str, str]]:
    """The hidden columns of ``docs`` and ``OWN``."""
    rows, names = hidden(docs)
    counted = once(rows, "m", F.struct(*[v.alias(k) for k, v in measures(F.col(names[text]).cast("string")).items()]))
    part = {"n_words": "words.n", "n_dup_lines": "lines.dup", "n_repeat_words": "words.repeat", "n_lines": "lines.n", "n_stop_words": "words.stop"}
    measured = counted.select(*names.values(), *[F.col(f"m.{part.get(c, c)}").alias(c) for c in OWN[:8]])
    failed = lambda some: F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in some]))
    verdicts = {"base_failed": F.size(failed(base)) > 0, "failed_rules": F.concat(failed(base), failed(rules))}
    return measured.withColumns(verdicts).withColumn("kept", F.size("failed_rules") == 0), names


def quality_rules(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """Every column of ``docs`` that ``OWN`` doesn't replace, then ``OWN``: the measures, the rules' names and the verdicts."""
    judged, names = _judged(docs, text, base, rules)
    return judged.select(*shown(names, *OWN), *OWN)


def passing(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with all columns as they are."""
    judged, names = _judged(docs, text, base, rules)
    return judged.where("kept").select(*shown(names))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rule(rule: Rule) -> str:
    out = f"{rule.measure} * {rule.denominator} {rule.fails_if} {rule.per} * {rule.numerator}".replace("one * ", "")
    return f"({out}" + (f" AND n_words >= {rule.from_words})" if rule.from_words else ")")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ws),
v AS (SELECT doc_id, i, CASE WHEN lead(x, 4) OVER o IS NOT NULL THEN x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o END AS g
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS twice FROM v),
r AS (SELECT doc_id, i, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM c),
n AS (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT ws.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
      CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      CAST(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS BIGINT) AS n_stop_words
      FROM ws LEFT JOIN n USING (doc_id)),
b AS (SELECT *, ({" OR ".join(map(_sql_rule, BASE_RULES))}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(map(_sql_rule, RULES))}) AS kept FROM b
"""
