"""Quality rules, aggregated by host: rule failures of each document are summed by domain, the rates are shrunk with an
empirical beta prior, and the host's verdict decides how much a document may fail.

Base rules: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. Further rules: symbols exceed a
tenth of the words, capitals exceed half of the characters in words, the mean word length leaves 2 to 14, over 60 % of the
lines with words are repeats. A document that breaks none of these may still be marginal: half of a limit is passed (for word
lengths: 3 to 10). A host (the column `source`) has the rate (failed + a) / (documents + a + b), where a and b fit the hosts'
rates by their moments; with it goes the posterior's deviation. A host whose rate lies more than DEVIATIONS of these below the
rate of all documents is trusted: a document of it may break one further rule. A host that lies as far above is poor: its
marginal documents go, too. Documents of the other hosts are kept if they break no rule.

Everything is a DataFrame expression. Windows of words are compared by 64-bit hashes within one text.

Edge cases: a null or empty text has no words and fails. A null host is a host of its own. Repeated rows count each time.
With a single host, or hosts of equal rates, the prior is as strong as MAX_STRENGTH documents. An empty table gives an
empty result. Only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import cut, free_names, table, text_of

#: How many posterior deviations a host's rate must lie from that of all documents for a verdict of its own.
DEVIATIONS = 1.0
#: Bounds of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5


def _repeated() -> Column:
    """From `sorted` (hash and place of each window, sorted): words in windows that occur twice or more."""
    same = lambda x, j: F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    add = lambda acc, x: F.struct(x.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("total"))
    return F.aggregate(places, start, add, lambda acc: acc["total"]).cast("long")


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """`keep` with the counts of each text: n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words."""
    t = text_of(text)
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(*keep, t.alias("t"), words.alias("w"), lines.alias("l"))
    n = F.size("w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW)))))
    two = one.select(
        *keep, n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), hashes.alias("h"),
    )
    ties = F.size("h") > F.size(F.array_distinct("h"))  # only texts with a repeat are sorted
    sorted_ = F.when(F.coalesce(ties, F.lit(False)), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    three = two.withColumn("sorted", sorted_).drop("h")
    return three.withColumn("n_repeat_words", F.coalesce(_repeated(), F.lit(0).cast("long"))).drop("sorted")


def judge(measured: DataFrame, host: str = "source") -> DataFrame:
    """`measured` with base_failed, n_failed (further rules), n_marginal (rules of which half a limit is passed), host_rate,
    host_verdict and kept. It is written once and read twice."""
    c = F.col
    count = lambda rules: sum((r.cast("long") for r in rules), F.lit(0).cast("long"))
    base = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    rules = [10 * c("n_symbols") > c("n_words"), 2 * c("n_upper") > c("word_chars"), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")), 10 * c("n_dup_lines") > 6 * c("n_lines")]
    near = [20 * c("n_symbols") > c("n_words"), 4 * c("n_upper") > c("word_chars"), (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")), 10 * c("n_dup_lines") > 3 * c("n_lines"), 10 * c("n_repeat_words") > c("n_words")]
    judged = cut(measured.withColumn("base_failed", base).withColumn("n_failed", count(rules)).withColumn("n_marginal", count(near)))
    failed = (c("base_failed") | (c("n_failed") > 0)).cast("long")
    hosts = judged.groupBy(host).agg(F.count("*").alias("n"), F.sum(failed).alias("f"))
    p = c("f") / c("n")
    s = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(p).alias("p"), F.sum(p * p).alias("pp")).first()
    a, b = prior(s["hosts"], s["n"] or 0, s["f"] or 0, s["p"] or 0.0, s["pp"] or 0.0)
    mean = (s["f"] or 0) / (s["n"] or 1)
    rated = hosts.select(c(host).alias("of_host"), ((c("f") + F.lit(a)) / (c("n") + F.lit(a + b))).alias("host_rate"), "n")
    far = F.lit(DEVIATIONS) * F.sqrt(c("host_rate") * (1 - c("host_rate")) / (c("n") + F.lit(a + b + 1)))
    verdict = F.when(c("host_rate") + far < mean, "trusted").when(c("host_rate") - far > mean, "poor").otherwise("plain")
    rated = rated.select("of_host", "host_rate", verdict.alias("host_verdict"))
    allowed = F.when(c("host_verdict") == "trusted", c("n_failed") <= 1).when(c("host_verdict") == "poor", (c("n_failed") == 0) & (c("n_marginal") == 0)).otherwise(c("n_failed") == 0)
    return judged.join(rated, judged[host].eqNullSafe(rated["of_host"]), "left").drop("of_host").withColumn("kept", ~c("base_failed") & allowed)


def prior(hosts: int, n: int, f: int, p: float, pp: float) -> tuple[float, float]:
    """The beta prior (a, b) whose mean is the pooled rate and whose variance is that of the hosts' rates.

    hosts, n, f, p, pp: hosts, documents, failed documents, sum of the hosts' rates and of their squares."""
    mean = f / n if n else 0.0
    var = pp / hosts - (p / hosts) ** 2 if hosts else 0.0
    strength = mean * (1 - mean) / var - 1 if var > 1e-12 else MAX_STRENGTH
    strength = min(MAX_STRENGTH, max(MIN_STRENGTH, strength))
    return mean * strength, (1 - mean) * strength


def filtered(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `docs` that are kept. Rows alike in key, text and host share a verdict."""
    tie = F.xxhash64(text_of(text))
    names = free_names(docs, "the_key", "the_host", "the_text", "the_tie")  # so that the join is not ambiguous
    k, h, t, x = names
    seen = docs.select(F.col(key).alias(k), F.col(host).alias(h), F.col(text).alias(t), tie.alias(x))
    kept = judge(measures(seen, t, (k, h, x)), h).where("kept").select(k, h, x).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col(k)) & F.col(host).eqNullSafe(F.col(h)) & (tie == F.col(x)), "left_semi")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its counts, the base verdict and the host-level verdict."""
    out = judge(measures(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed", "n_marginal", F.round("host_rate", 6).alias("host_rate"), "host_verdict")


OP7_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         row_number() OVER () AS r
  FROM documents),
m AS (
  SELECT r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM w),
g AS (SELECT r, unnest(range(len(w) - 4)) AS i, w FROM w WHERE len(w) >= 5),
k AS (SELECT r, i, array_to_string(w[i + 1:i + 5], ' ') AS k FROM g),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k) WHERE c > 1),
u AS (SELECT r, sum(least(5, i - coalesce(p, -5)))::BIGINT AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM d) GROUP BY r),
j AS (
  SELECT m.*, coalesce(u.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(u.n, 0) > 20 * n_words AS base_failed,
         (10 * n_symbols > n_words)::BIGINT + (2 * n_upper > word_chars)::BIGINT + (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT
           + (10 * n_dup_lines > 6 * n_lines)::BIGINT AS n_failed,
         (20 * n_symbols > n_words)::BIGINT + (4 * n_upper > word_chars)::BIGINT + (word_chars < 3 * n_words OR word_chars > 10 * n_words)::BIGINT
           + (10 * n_dup_lines > 3 * n_lines)::BIGINT + (10 * coalesce(u.n, 0) > n_words)::BIGINT AS n_marginal
  FROM m LEFT JOIN u USING (r)),
h AS (SELECT source, count(*) AS n, sum((base_failed OR n_failed > 0)::INT) AS f FROM j GROUP BY source),
s AS (SELECT sum(f) / sum(n)::DOUBLE AS mean, greatest(avg((f / n::DOUBLE) * (f / n::DOUBLE)) - avg(f / n::DOUBLE) ** 2, 0) AS var FROM h),
b AS (SELECT mean, CASE WHEN var > 1e-12 THEN least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, mean * (1 - mean) / var - 1)) ELSE {MAX_STRENGTH} END AS k FROM s),
r AS (SELECT source, mean, (f + mean * k) / (n + k) AS host_rate, n + k + 1 AS weight FROM h, b),
v AS (SELECT *, {DEVIATIONS} * sqrt(host_rate * (1 - host_rate) / weight) AS far FROM r),
q AS (SELECT *, CASE WHEN host_rate + far < mean THEN 'trusted' WHEN host_rate - far > mean THEN 'poor' ELSE 'plain' END AS host_verdict FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE host_verdict WHEN 'trusted' THEN n_failed <= 1 WHEN 'poor' THEN n_failed + n_marginal = 0 ELSE n_failed = 0 END AS kept,
       n_failed, n_marginal, round(host_rate, 6) AS host_rate, host_verdict
FROM j JOIN q ON j.source IS NOT DISTINCT FROM q.source
"""
