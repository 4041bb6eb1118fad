"""Quality rules with host verdicts, in DataFrame functions only.

Each text gets word, symbol and repetition counts and a pass or fail of the
base rule.  Failures are summed by host; the hosts' failure rates are shrunk
towards a beta prior fitted to all hosts by moments.  Hosts whose shrunk rate
stands out from the prior (above its mean by ``DEVIATIONS`` of its standard
deviations, and above ``TIMES`` its mean) or is above ``MOST_RATE`` are
rejected as a whole.

A very long text is one array of words and window hashes in one row, some 30
bytes for each word.

A null or empty text has zero counts and fails the base rule (fewer than 20
words).  Rows with a null host form one host of their own.  Every input row
gives one row, repeated rows and null ids included; an empty table gives none.
Columns besides ``doc_id``, ``text`` and the host are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.spark import settle

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MOST_RATE, DEVIATIONS, TIMES = 0.5, 3, 2
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def repeated_words(word: Column, n: int = WINDOW) -> Column:
    """Words inside runs of ``n`` words that occur twice or more in the array."""
    size = F.size(word)

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1))

            def spans(at: Column) -> Column:
                gap = F.transform(at, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(at, i + 1) - p, F.lit(n))))
                return F.aggregate(gap, F.lit(0), lambda a, g: a + g)

            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), spans)

        sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(sorted_, of_sorted))

    hashes = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.xxhash64(F.slice(word, i, n)))
    return F.when(size <= n, 0).otherwise(let(hashes, covered))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host``, the counts and ``base_failed`` of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    counted = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        of_words.alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
    )
    n, repeated = F.col("w.n").cast("long"), F.col("w.repeated").cast("long")
    failed = (n < 20) | (100 * repeated > 30 * n)
    return counted.select("doc_id", "host", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), failed.alias("base_failed"))


def host_verdicts(measured: DataFrame, most: float = MOST_RATE) -> DataFrame:
    """``host, n_docs, n_failed, rate, rejected`` with rates shrunk by an empirical beta prior."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m, v = moments.m or 0.0, moments.v or 0.0
    strength = m * (1 - m) / v - 1 if 0 < m < 1 and 0 < v < m * (1 - m) else 2.0
    alpha, beta = (m * strength, (1 - m) * strength) if 0 < m < 1 else (1.0, 1.0)
    shrunk = (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta)
    mean, size = alpha / (alpha + beta), alpha + beta
    limit = min(most, max(TIMES * mean, mean + DEVIATIONS * (mean * (1 - mean) / (size + 1)) ** 0.5))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk > limit).alias("rejected"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures of each row and ``kept``: the base rule and the host's verdict.

    The join back leaves the choice of a broadcast to Spark's size threshold;
    beyond it a hot host's partition is split by the skew join.
    """
    measured = settle(measure(docs, host))
    verdicts = host_verdicts(measured).select(F.col("host").alias("of_host"), "rejected")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("rejected"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


SQL = r"""
WITH base AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS run
  FROM base, range(1, greatest(len(w) - 6, 1)) r(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
spans AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT b.doc_id, host, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN lines l ON b.doc_id = l.doc_id LEFT JOIN spans s ON b.doc_id = s.doc_id),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
hosts AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f FROM failed GROUP BY host),
moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
prior AS (SELECT CASE WHEN m > 0 AND m < 1 THEN m * s ELSE 1 END AS a, CASE WHEN m > 0 AND m < 1 THEN (1 - m) * s ELSE 1 END AS b
  FROM (SELECT m, CASE WHEN m > 0 AND m < 1 AND v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 2 END AS s FROM moments)),
verdicts AS (SELECT host, (f + a) / (n + a + b) > least(0.5, greatest(2 * a / (a + b), a / (a + b) + 3 * sqrt(a * b / (a + b) ** 2 / (a + b + 1)))) AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, FALSE) AS kept
FROM failed LEFT JOIN verdicts ON failed.host IS NOT DISTINCT FROM verdicts.host
"""
