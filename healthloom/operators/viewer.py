"""Relational logic of the case viewer and of saved queries."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_list(cases: DataFrame, conditions: DataFrame, rules: DataFrame, key: str = "eICR_ID") -> DataFrame:
    """Cases with their conditions and rule summaries, left-joined."""
    return cases.join(conditions, key, "left").join(rules, "ecr_rr_conditions_id", "left")


def page(rows: DataFrame, newest_first: str, tie: str, offset: int, limit: int) -> DataFrame:
    """One page by a date, newest first and nulls before all, ties by a unique column."""
    return rows.orderBy(F.desc_nulls_first(newest_first), tie).offset(offset).limit(limit)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def filled(rows: DataFrame, dates: tuple[str, ...] = ()) -> DataFrame:
    """Texts with nulls as empty, dates formatted."""
    from ..functions.text import date_text

    return rows.select(*[F.coalesce(date_text(F.col(c)), F.lit("")).alias(c) if c in dates else (F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c)) for c, t in rows.dtypes])


def saved_query(queries: DataFrame, to_value_set: DataFrame, included: DataFrame, concepts: DataFrame, value_sets: DataFrame, name: str | None = None) -> DataFrame:
    """A saved query with its value sets and concepts: four left joins from the query."""
    rows = queries.select(F.col("id").alias("query_id"), "query_name")
    if name is not None:
        rows = rows.where(F.col("query_name") == name)
    rows = rows.join(to_value_set.select(F.col("id").alias("query_by_valueset_id"), "query_id", "valueset_id"), "query_id", "left")
    rows = rows.join(value_sets.select(F.col("id").alias("valueset_id"), F.col("name").alias("valueset_name"), "type"), "valueset_id", "left")
    return rows.join(included.select("query_by_valueset_id", "concept_id", "include"), "query_by_valueset_id", "left").join(concepts.select(F.col("id").alias("concept_id"), "code", "code_system", "display"), "concept_id", "left")


def default_queries(conditions: DataFrame, junction: DataFrame, valuesets: DataFrame, author: str = "system") -> tuple[DataFrame, DataFrame]:
    """One saved query a condition, and its value sets; ids are hashes of what they stand for."""
    queries = conditions.select(F.sha2(F.concat_ws("|", F.lit("query"), "id"), 256).alias("id"), F.col("name").alias("query_name"), F.lit(author).alias("author"), F.lit(1).alias("time_window_number"), F.lit("day").alias("time_window_unit"), F.col("id").alias("condition_id"))
    rows = queries.join(junction.select("condition_id", "valueset_id"), "condition_id").join(valuesets.select(F.col("id").alias("valueset_id"), F.col("oid").alias("valueset_oid")), "valueset_id")
    return queries.drop("condition_id"), rows.select(F.sha2(F.concat_ws("|", "id", "valueset_id"), 256).alias("id"), F.col("id").alias("query_id"), "valueset_id", "valueset_oid")


def filter_value_sets(rows: DataFrame, wanted: list[str], column: str = "code") -> DataFrame:
    return rows.where(F.col(column).isin(wanted))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """by, n, percent of all. The total is summed from the counts, not by a window over one partition."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole")).withColumn("__one", F.lit(1))
    return counts.withColumn("__one", F.lit(1)).join(F.broadcast(whole), "__one").select(by, "n", (F.col("n") * 100.0 / F.col("whole")).alias("percent"))


def reportable_rules(rows: DataFrame) -> DataFrame:
    """condition, rules: (rule, jurisdictions), all sorted and distinct."""
    per = rows.groupBy("condition", "rule").agg(F.array_sort(F.collect_set("jurisdiction")).alias("jurisdictions"))
    return per.groupBy("condition").agg(F.array_sort(F.collect_list(F.struct("rule", "jurisdictions"))).alias("rules"))


def condition_summaries(rows: DataFrame, selected: str | None = None) -> DataFrame:
    """code, name, rules; the selected code first."""
    grouped = rows.groupBy("code").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("rule")).alias("rules"))
    return grouped.orderBy(F.col("code") != F.lit(selected), "code") if selected else grouped.orderBy("code")


def stamped_with(resources: DataFrame, condition: str) -> DataFrame:
    return resources.where(F.array_contains("conditions", condition))


def relevant_labs(reports: DataFrame, observations: DataFrame, condition: str) -> DataFrame:
    """Reports that are stamped, and those with any stamped observation: each once. reports: id, conditions, results (array of ids)."""
    stamped = stamped_with(reports, condition)
    hits = stamped_with(observations, condition).select(F.col("id").alias("r"))
    through = reports.select("id", F.explode("results").alias("r")).join(hits, "r", "left_semi").select("id").distinct()
    others = reports.join(through, "id", "left_semi").join(stamped.select("id"), "id", "left_anti")
    return stamped.unionByName(others.select(*stamped.columns))


def report_observations(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """report_id, place and the observation's columns; references that lead nowhere are left out."""
    refs = reports.select(F.col("id").alias("report_id"), F.posexplode("results").alias("place", "ref")).withColumn("id", F.substring_index("ref", "/", -1)).drop("ref")
    return refs.join(observations, "id")


def by_organization(reports: DataFrame) -> DataFrame:
    return reports.groupBy("organization").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("reports"))


def same_organization(organizations: DataFrame) -> DataFrame:
    """id, telecom of another organization at the same address (missing parts equal missing parts); the last one counts.

    Two organizations an address are enough, as only the last one itself needs the one before; so an address with very many
    makes no pairs.
    """
    parts = ["line", "city", "state", "postal_code", "country"]
    own = organizations.groupBy("id", *parts).agg(F.max(F.struct("pos", "telecom")).alias("last"))
    order = Window.partitionBy(*parts).orderBy(F.desc("last"), "id")
    top = own.withColumn("n", F.row_number().over(order)).where("n <= 2")
    best = top.groupBy(*parts).agg(F.max_by("id", -F.col("n")).alias("first_id"), F.max_by("last", -F.col("n")).alias("first"), F.max_by("last", F.when(F.col("n") == 2, 1)).alias("second"))
    a, b = own.alias("a"), best.alias("b")
    joined = a.join(b, reduce(and_, [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in parts]))
    other = F.when(F.col("a.id") == F.col("b.first_id"), F.col("b.second")).otherwise(F.col("b.first"))
    found = joined.select(F.col("a.id").alias("id"), other.alias("other")).where("other IS NOT NULL")
    return found.groupBy("id").agg(F.max("other").alias("other")).select("id", F.col("other.telecom").alias("telecom"))


def chunks(rows: DataFrame, order: str, size: int = 500, ranges: int = 64) -> DataFrame:
    """rows with place (from 0, in order; nulls first) and chunk.

    Rows are numbered within ranges of the order, each by itself, and the ranges' counts are added up. A bounded sample of
    values says where ranges begin; that evens out the work and changes no place.
    """
    some = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(100 * ranges).collect())
    bounds = sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []
    reached = reduce(add, [F.coalesce((F.col(order) >= F.lit(x)).cast("int"), F.lit(0)) for x in bounds], F.lit(0))
    ranged = rows.withColumn("__range", reached)
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1 + F.col("__start")
    numbered = ranged.join(F.broadcast(starts), "__range").withColumn("place", place.cast("long")).drop("__range", "__start")
    return numbered.withColumn("chunk", F.floor(F.col("place") / size))


def has_key(table: Column, wanted: Column) -> Column:
    """The first value under a key anywhere in JSON text of one level of nesting or more."""
    return F.regexp_extract(table, F.concat(F.lit('"'), wanted, F.lit('"\\s*:\\s*"([^"]*)"')), F.lit(1))
