"""Quality rules per document and per host.

The document rules are counts over the whole text. The host rule
aggregates the documents' failures by domain, shrinks each domain's failure
rate with a beta prior fitted to all domains (method of moments), and joins the
verdict back to the documents: a document stays if it passes its own rules and
its host's shrunken rate is not above the limit.

Everything is DataFrame code: the text is split once, a window of three words
becomes a 64-bit hash, and only where a text repeats many different windows are
their positions sorted. What is shuffled is one partial row per task
and domain; texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.session import materialize, small_side, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A domain whose shrunken failure rate is above this is rejected.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength in documents.
PRIOR_STRENGTH = (2.0, 1000.0)
#: Up to so many different repeated windows, positions are looked up; beyond, they are sorted.
LOOKUP = 24


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside ``[\\x20\\x09-\\x0D]``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _covered(starts: Column) -> Column:
    """Words under windows of three at these ascending starts."""
    return F.aggregate(
        F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )


def with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of three that occur twice or more in the text; needs ``words``."""
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_s",
        F.slice(F.transform("_h", lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2))), F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))),
    )
    df = df.withColumn("_o", F.sort_array("_s"))
    df = df.withColumn("_d", F.array_distinct(F.filter("_o", lambda x, i: (i > 0) & (x == F.get("_o", i - 1)))))
    index = lambda a: F.transform(a, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    looked_up = F.transform(F.filter(index(F.col("_s")), lambda x: F.array_contains("_d", x["h"])), lambda x: x["i"])
    df = df.withColumn("_p", F.when(F.size("_d") > LOOKUP, F.sort_array(index(F.col("_s")))))
    by_sort = F.sort_array(
        F.transform(
            F.filter("_p", lambda x, i: (x["h"] == F.get("_p", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("_p", i - 1)["h"]))), lambda x: x["i"]
        )
    )
    df = df.withColumn("_at", F.when(F.size("_d") == 0, F.expr("array()").cast("array<int>")).when(F.size("_d") <= LOOKUP, looked_up).otherwise(by_sort))
    df = df.withColumn("n_repeat_words", _covered(F.col("_at")).cast("long"))
    return df.drop("_h", "_s", "_o", "_d", "_p", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def document_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "source") -> DataFrame:
    """(doc_id, domain, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(domain).cast("string"), F.lit("")).alias("domain"), whole.alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    df = with_repeat_words(df)
    joined = F.array_join("words", "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    df = df.withColumn("_joined", joined).withColumn("_lines", lines)
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("base_failed", base_failed())
    return df.select(
        "doc_id",
        "domain",
        "n_words",
        F.char_length("_joined").cast("long").alias("word_chars"),
        F.regexp_count("_joined", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
    )


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(domain, host_docs, host_rate, host_rejected) from rows with (domain, base_failed).

    Prior: mean m of all documents, strength m(1 - m) / v - 1 with v the
    variance of the domains' rates, held within PRIOR_STRENGTH (the upper
    bound if v is 0 or there is one domain). host_rate = (failed + m s) / (docs + s).
    """
    hosts = materialize(rules.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("bad")))
    low, high = PRIOR_STRENGTH
    fit = hosts.agg(
        F.try_divide(F.sum("bad").cast("double"), F.sum("n").cast("double")).alias("m"),
        F.coalesce(F.var_pop(F.col("bad") / F.col("n")), F.lit(0.0)).alias("v"),
    )
    spread = F.col("m") * (1 - F.col("m"))
    fit = fit.select("m", F.when(F.col("v") < 1e-12, F.lit(high)).otherwise(F.least(F.greatest(F.try_divide(spread, "v") - 1, F.lit(low)), F.lit(high))).alias("s"))
    rate = (F.col("bad") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    # one row of two numbers, so this is a broadcast of a fixed size
    out = hosts.join(F.broadcast(fit)).select("domain", F.col("n").alias("host_docs"), F.round(rate, 6).alias("host_rate"))
    return out.withColumn("host_rejected", F.col("host_rate") > max_rate)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs`` with its counts, base_failed, its host's rate and ``kept``.

    A null text has no words and so fails; a null domain is the domain of the
    empty name. Repeated rows are counted as often as they occur. An empty table
    gives an empty result. Columns other than the three named are not read.
    """
    rules = materialize(document_rules(docs, doc_id, text, domain))
    hosts = small_side(materialize(host_verdicts(rules, max_rate)))
    out = rules.join(hosts, "domain", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns, whatever these are named.

    The document rules are worked out once, beside the rows. Rows that fail are written without their
    columns, the others whole; the host rates come from what is written, and then decide on the others.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(domain).cast("string"), F.lit("")).alias("domain"))
    rows = with_repeat_words(rows.withColumn("words", words_of(F.col("text")))).withColumn("n_words", F.size("words"))
    rows = rows.withColumn("base_failed", F.coalesce(base_failed(), F.lit(True)))
    rows = materialize(rows.select("domain", "base_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row")))
    hosts = small_side(materialize(host_verdicts(rows, max_rate).where("not host_rejected").select("domain")))
    return rows.where("not base_failed").join(hosts, "domain", "left_semi").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE_OP5 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS domain, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), f AS (
  SELECT doc_id, domain, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, words
  FROM w
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM f
), k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM s
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) o(j) WHERE c > 1 GROUP BY 1
), d AS (
  SELECT f.doc_id, domain, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM f LEFT JOIN r USING (doc_id)
), h AS (
  SELECT domain, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM d GROUP BY 1
), p AS (
  SELECT CAST(sum(bad) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS m, var_pop(CAST(bad AS DOUBLE) / n) AS v FROM h
), q AS (
  SELECT m, CASE WHEN v < 1e-12 THEN {PRIOR_STRENGTH[1]}
              ELSE least(greatest(m * (1 - m) / v - 1, {PRIOR_STRENGTH[0]}), {PRIOR_STRENGTH[1]}) END AS s FROM p
), g AS (
  SELECT domain, CAST(n AS BIGINT) AS host_docs, round((bad + m * s) / (n + s), 6) AS host_rate FROM h, q
)
SELECT domain, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_rate,
       host_rate > {MAX_HOST_RATE} AS host_rejected, NOT base_failed AND NOT host_rate > {MAX_HOST_RATE} AS kept
FROM d JOIN g USING (domain)
"""
