"""Quality rules: a table of thresholds compiled into Spark expressions, without user functions.

The metrics of a text and the verdict of all rules are columns of projections over the text; nothing is shuffled.

Words are `[^ \\t-\\r]+`. A text's repeated three-word windows are found by sorting (hash, position) of its windows, so that
equal windows are neighbours; windows are equal if their 64-bit hashes are, whose chance for different windows of a text of
n words is n^2 / 2^65. Arrays that a lambda looks into are bound to a lambda variable first, or they would be made anew for
each element.

Defined cases: null and empty texts have no words, zero in every count, and fail the base rules; repeated rows each get their
verdict; an empty table gives no rows; texts of any length are read whole; columns of the input other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import docs_of, read_table

STOP_WORDS = tuple("the of and to in a is that it on der die das und zu den von mit ist ein le la les de et en un une que du el los y por con del".split())


@dataclass(frozen=True)
class Threshold:
    """A text passes if low <= value <= high; value is SQL over the metrics."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: Applied after the base rules.
RULES = (
    Threshold("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    Threshold("symbol_to_word_ratio", "n_symbols / n_words", high=0.3),
    Threshold("stop_word_ratio", "n_stop_words / n_words", low=0.02),
    Threshold("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", high=0.4),
    Threshold("words_per_line", "n_words / greatest(n_lines, 1)", low=2.0),
    Threshold("exclamation_ratio", "n_exclamations / n_words", high=0.3),
)

_BLANK = r"' \t\n\u000b\u000c\r'"


def _bound(value: str, name: str, body: str) -> str:
    """body, in which name stands for value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated_words() -> str:
    """Words in three-word windows that the text has twice or more."""
    windows = "sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)))"
    twice = "sort_array(filter(transform(s, (x, k) -> if(get(s, k + 1).h = x.h OR (k > 0 AND get(s, k - 1).h = x.h), x.i, -1)), v -> v >= 0))"
    covered = "aggregate(p, struct(0L AS n, -1 AS upto), (a, x) -> struct(a.n + 3 - greatest(0, a.upto - x) AS n, x + 3 AS upto), a -> a.n)"
    return _bound("words", "w", f"CASE WHEN size(w) < 4 THEN 0L ELSE {_bound(windows, 's', _bound(twice, 'p', covered))} END")


#: Metrics over text, words and lines, in SQL.
METRICS = {
    "n_words": "CAST(size(words) AS BIGINT)",
    "word_chars": f"CAST(length(translate(text, {_BLANK}, '')) AS BIGINT)",
    "n_symbols": "CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT)",
    "n_dup_lines": "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)",
    "n_repeat_words": _repeated_words(),
    "n_lines": "CAST(size(lines) AS BIGINT)",
    "n_stop_words": f"CAST(size(filter(words, v -> lower(v) IN ({', '.join(repr(w) for w in STOP_WORDS)}))) AS BIGINT)",
    "n_exclamations": "CAST(length(text) - length(translate(text, '!', '')) AS BIGINT)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def verdict(rules: tuple[Threshold, ...] = RULES) -> str:
    """The table of thresholds as one SQL condition."""
    parts = []
    for r in rules:
        parts += [f"({r.value}) >= {r.low}D"] * (r.low is not None) + [f"({r.value}) <= {r.high}D"] * (r.high is not None)
    return " AND ".join(parts) or "true"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the metrics of every row."""
    d = docs_of(docs).withColumn("bare", F.expr(f"btrim(text, {_BLANK})"))
    d = d.select(
        "doc_id",
        "text",
        F.expr(r"CASE WHEN bare = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(bare, '[\\x20\\x09-\\x0D]+') END").alias("words"),
        F.expr(rf"filter(split(text, '\n'), v -> btrim(v, {_BLANK}) <> '')").alias("lines"),
    )
    return d.select("doc_id", *(F.expr(sql).alias(name) for name, sql in METRICS.items()))


def judged(docs: DataFrame, rules: tuple[Threshold, ...] = RULES) -> DataFrame:
    """doc_id, the metrics, base_failed and kept of every row."""
    m = measured(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    return m.withColumn("kept", F.expr(f"CASE WHEN base_failed THEN false ELSE {verdict(rules)} END"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of every document."""
    return judged(read_table(spark, sf_dir, "documents"))


#: The same in DuckDB.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM t WHERE len(words) > 3),
g AS (SELECT doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
       CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(list_filter(words, lambda v: lower(v) IN ({", ".join(repr(w) for w in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
       CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations
      FROM t LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, CASE WHEN base_failed THEN false ELSE word_chars / n_words BETWEEN 2.0 AND 20.0 AND n_symbols / n_words <= 0.3
  AND n_stop_words / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.4 AND n_words / greatest(n_lines, 1) >= 2.0
  AND n_exclamations / n_words <= 0.3 END AS kept FROM b
"""
