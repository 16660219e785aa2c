"""Quality rules: a table of thresholds compiled into one Spark projection.

Defined results: a null text counts as empty; an empty text has no words and
fails; repeated rows each get their own (equal) row; extra columns don't matter
to `judge` beyond `id_columns`, and `measures` never reads them; an empty table
gives an empty result. `measures` replaces columns that have the names of its own results,
and drops `_w`, `_l` and `_t`; `judge` and `passing` don't touch other columns, whatever their names.
Very long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, table, text_of, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was with as on be at by this from or an are not but have he she they "
    "der die das und ist von zu den mit ein eine im für auf nicht des sich als auch es dem "
    "le la les et de des un une est que en pour dans qui sur pas au du il elle "
    "el los las y que en un una es por con para del se no lo al como su más"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the measure must lie in [low, high]; a null measure passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds, wide on purpose: a document fails on what prose doesn't show.
RULES = (
    Rule("length", "n_words", 50, 1_000_000),
    Rule("mean_word_chars", "mean_word_chars", 1.5, 30),
    Rule("symbols", "symbol_ratio", None, 0.35),
    Rule("stop_words", "stop_ratio", 0.005, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.7),
    Rule("repeated_words", "repeat_ratio", None, 0.5),
)


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and names it in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _once(c: Column) -> Column:
    """c, marked as not deterministic: else a filter on a measure is pushed down and evaluates the words again for each word."""
    return F.when(F.monotonically_increasing_id() < 0, F.lit(None)).otherwise(c)


def measures(docs: DataFrame) -> DataFrame:
    """docs with counts and ratios of each whole text; no shuffle and no user function."""
    text = text_of()
    words = docs.withColumns({"_w": _once(words_of(text)), "_l": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))})
    hashed = words.withColumn(
        "_t",
        _once(F.expr("CASE WHEN size(_w) >= 4 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE cast(array() AS array<bigint>) END")),
    )
    twice = "filter(s, (x, j) -> get(s, j - 1).h = x.h OR get(s, j + 1).h = x.h)"
    covered = _let("sort_array(transform(_t, (h, i) -> named_struct('h', h, 'i', i)))", "s", f"size(array_distinct(flatten(transform({twice}, x -> array(x.i, x.i + 1, x.i + 2)))))")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    counted = hashed.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_stop": F.expr(f"size(filter(_w, w -> lower(w) IN ({stop})))").cast("long"),
            "n_repeat_words": F.expr(f"CASE WHEN size(_t) > size(array_distinct(_t)) THEN {covered} ELSE 0 END").cast("long"),
        }
    ).drop("_w", "_l", "_t")
    per = lambda n, d: F.try_divide(F.col(n).cast("double"), F.col(d).cast("double"))
    return counted.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "stop_ratio": per("n_stop", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
        }
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The first rule that a row of measures breaks, else null."""

    def broken(r: Rule) -> Column:
        outside = [F.col(r.measure) < r.low] * (r.low is not None) + [F.col(r.measure) > r.high] * (r.high is not None)
        return F.when(F.coalesce(reduce(Column.__or__, outside), F.lit(False)), F.lit(r.name))

    return F.coalesce(*(broken(r) for r in rules), F.lit(None).cast("string"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document: its measures, `broken_rule`, `base_failed` and `kept`."""
    out = measures(docs.select(*dict.fromkeys((*id_columns, "text")))).withColumns({"broken_rule": compiled(rules), "base_failed": base_failed()})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("broken_rule").isNull())


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    verdict = (~base_failed() & compiled(rules).isNull()).alias("_kept")
    # A column that isn't deterministic keeps the optimizer from pushing the filter below the measures, which would evaluate them again for each mention.
    judged = measures(packed).select("_row", verdict, F.monotonically_increasing_id().alias("_fence"))
    return judged.where("_kept AND _fence >= 0").select("_row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(w.w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 1.5 * n_words AND word_chars <= 30 * n_words AND n_words <= 1000000
       AND n_symbols <= 0.35 * n_words AND n_stop >= 0.005 * n_words AND n_dup_lines <= 0.7 * n_lines AS kept
FROM b
"""
