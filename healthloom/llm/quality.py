"""Host-level quality rules [native].

Each document gets a few counts of its whole text and a verdict of its own (the base rules). The failures are then summed by
host, each host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (method of moments), and hosts
whose shrunk rate is above a threshold lose all their documents.

Defined results: null text counts as empty (0 words, so it fails); a null host has no host verdict, its documents stand by
their own; repeated rows count as often as they occur; an empty table gives an empty result; input columns named like an
output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, keyed_join, without, written

#: Smallest number of words, and largest share of words in repeated windows (per cent).
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A host whose shrunk failure rate is above this is rejected.
HOST_THRESHOLD = 0.5
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACES = r"[\\x20\\x09-\\x0D]"
#: ``transform(array(x), v -> f(v))[0]`` binds v once, so x isn't computed again wherever f uses it.
_REPEATED = """
CASE WHEN size(w) < 9 THEN 0 ELSE
  transform(array(transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8)))), h ->
    CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE
      transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
        transform(array(sort_array(transform(filter(s, (e, j) -> get(s, j - 1).x = e.x OR get(s, j + 1).x = e.x), e -> e.i))), p ->
          aggregate(transform(p, (q, j) -> least(8, coalesce(get(p, j + 1) - q, 8))), 0, (a, b) -> a + b))[0])[0]
    END)[0]
END"""


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS (long) of the whole text.

    A window of 8 words is known by its 64-bit hash within its own text; positions of hashes found twice are sorted and
    their 8-word reaches added up, so cost is n log n in the text's length.
    """
    docs = without(docs, *COUNTS)
    t = f"coalesce(`{text}`, '')"
    taken = {c.lower() for c in docs.columns}
    c, l = free("__c", taken), free("__l", taken)  # noqa: E741
    found = docs.withColumn(
        c,
        F.expr(f"transform(array(array_remove(split({t}, '{_SPACES}+'), '')), w -> named_struct('n', size(w), 'r', {_REPEATED}))[0]"),
    ).withColumn(l, F.expr(f"transform(array(filter(split({t}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')), x -> size(x) - size(array_distinct(x)))[0]"))
    return found.select(
        *[F.col(f"`{x}`") for x in docs.columns],
        F.col(f"{c}.n").cast("long").alias("n_words"),
        F.expr(f"char_length(regexp_replace({t}, '{_SPACES}+', ''))").cast("long").alias("word_chars"),
        F.expr(f"char_length({t}) - char_length(regexp_replace({t}, '[#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        F.col(l).cast("long").alias("n_dup_lines"),
        F.col(f"{c}.r").cast("long").alias("n_repeat_words"),
    )


def base_verdict(docs: DataFrame) -> DataFrame:
    """docs, which have COUNTS, with base_failed."""
    return docs.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(docs: DataFrame, host: str, threshold: float = HOST_THRESHOLD) -> DataFrame:
    """One row a host of docs (which have base_failed): __host, host_docs, host_failed, host_rate (shrunk), host_rejected."""
    by_host = docs.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    hosts = written(by_host, "hosts")
    n, f = F.col("host_docs"), F.col("host_failed")
    whole = hosts.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff")).first()
    alpha, weight = beta_prior(whole["k"], whole["n"] or 0, whole["f"] or 0, whole["ff"] or 0.0)
    rate = (f + F.lit(alpha)) / (n + F.lit(weight))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > threshold)


def beta_prior(k: int, n: int, f: int, ff: float) -> tuple[float, float]:
    """alpha and alpha + beta by moments, from the number of hosts, their documents, failures, and the sum of f*f/n."""
    if not n:
        return 0.0, LEAST_WEIGHT
    mean = f / n
    spread = ff / n - mean * mean
    noise = mean * (1 - mean) * k / n
    between = (spread - noise) / (1 - k / n) if k < n else 0.0
    weight = mean * (1 - mean) / between - 1 if between > 0 else MOST_WEIGHT
    weight = min(max(weight, LEAST_WEIGHT), MOST_WEIGHT)
    return mean * weight, weight


def judge(docs: DataFrame, host: str = "source", text: str = "text", threshold: float = HOST_THRESHOLD, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or just its columns ``keep``) with COUNTS, base_failed, host_rate and kept.

    The texts are counted once; that table is written to the shared folder, then summed by host and joined with the verdicts.
    """
    docs = without(docs, *COUNTS, "base_failed", "host_rate", "kept")
    columns = [c for c in docs.columns if keep is None or c in keep]
    narrow = docs.select(*{*columns, host, text})
    taken = {c.lower() for c in columns}
    own, rejected = free("__host", taken), free("__rejected", taken)
    plain = [F.col(f"`{c}`") for c in columns]
    counted = base_verdict(text_counts(narrow, text)).select(*plain, F.col(f"`{host}`").alias(own), *COUNTS, "base_failed")
    counted = written(counted, "counted")
    hosts = host_verdicts(counted, own, threshold).select(F.col("__host").alias(own), "host_rate", F.col("host_rejected").alias(rejected))
    spread = "doc_id" if "doc_id" in columns else columns[0] if columns else "n_words"
    joined = keyed_join(counted, hosts, own, spread, "left")
    return joined.select(*plain, *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))).alias("kept"))


def stage(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules and their host's verdict keep, with their own columns."""
    return judge(docs, host, text).where("kept").select(*docs.columns)
