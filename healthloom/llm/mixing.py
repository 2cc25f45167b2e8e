"""Mixing sources to target weights [native]: Poisson replication.

Each source has a target share of the output. Its repetition rate is that share of the target size over its size, and each of
its documents is repeated as often as a Poisson variable with that mean says, drawn by inverting the distribution at a number
in (0, 1) hashed from the seed and the document's id. Copies are then dealt out and sorted by a hash of seed, id and copy.

Defined results: rows of one id get the same count; a null id is hashed as the word null; a null source is a source of its own;
null and empty texts are repeated like others; sources without a weight, or with a weight of 0, have no copies; an empty table
gives an empty result. Input columns named like an output (copy, shuffle_key) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, keyed_join, without, written

#: Hex digits of a hash that make a number: 52 bits, exact in a double.
DIGITS = 13


def unit(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) hashed from seed and parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))


def source_key(source: str) -> Column:
    """Null is a key of its own."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("null"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the tail is below any hashed number's distance to 1.

    Terms are made in logarithms, so large rates don't underflow.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / k)
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["steps"])).otherwise(F.array(F.lit(1.0)))


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.7) -> DataFrame:
    """source_key, weight: each source's document count to a power below 1, which lifts small sources."""
    return docs.groupBy(source_key(source).alias("source_key")).agg(F.pow(F.count("*"), F.lit(power)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, source: str = "source", size_ratio: float = 1.0) -> DataFrame:
    """source_key, rate: target repetitions of each source; the output has size_ratio times the documents on average."""
    sizes = docs.groupBy(source_key(source).alias("source_key")).agg(F.count("*").alias("n"))
    joined = written(sizes.join(weights, "source_key", "left").select("source_key", "n", F.coalesce("weight", F.lit(0.0)).alias("weight")), "sizes")
    total = joined.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    if not total["n"] or not total["w"]:
        return joined.select("source_key", F.lit(0.0).alias("rate"))
    return joined.select("source_key", (F.col("weight") / F.lit(float(total["w"])) * F.lit(float(total["n"])) * F.lit(float(size_ratio)) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", doc_id: str = "doc_id", seed: int = 42, size_ratio: float = 1.0) -> DataFrame:
    """docs repeated to the weights (source_key, weight; by default tempered_weights), with copy (from 1) and shuffle_key.

    The per-source steps are a small written table: broadcast when counted to be small, else joined by salted keys. The texts
    move once, in a shuffle by shuffle_key and a row's place in its input partition, so that neither a source nor
    an id that many rows share (a null one, say) is a hot key; within a partition rows are sorted by shuffle_key.
    """
    docs = without(docs, "copy", "shuffle_key")
    names = docs.columns
    taken = {c.lower() for c in names}
    own_key, own_steps, own_unit, own_n, own_place = (free(n, taken) for n in ("__key", "__steps", "__u", "__n", "__place"))
    weights = tempered_weights(docs, source) if weights is None else weights
    steps = written(rates(docs, weights, source, size_ratio).select(F.col("source_key").alias(own_key), poisson_steps(F.col("rate")).alias(own_steps)), "steps")
    place = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    drawn = docs.select(*[F.col(f"`{c}`") for c in names], source_key(source).alias(own_key), unit(seed, F.col(doc_id)).alias(own_unit), place.alias(own_place))
    counted = keyed_join(drawn, steps, own_key, own_place).withColumn(own_n, F.size(F.filter(own_steps, lambda c: c < F.col(own_unit))))
    copies = counted.where(F.col(own_n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(own_n))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("copy"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    dealt = copies.withColumn("shuffle_key", key).repartition("shuffle_key", F.xxhash64(own_place))
    return dealt.sortWithinPartitions("shuffle_key").select(*[F.col(f"`{c}`") for c in names], "copy", "shuffle_key")


def stage(docs: DataFrame) -> DataFrame:
    return mix(docs).select(*docs.columns)
