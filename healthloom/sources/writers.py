"""Sinks: tables as CSV, Parquet or SQL, bundles to a FHIR server, rows to the index. Nulls stay nulls everywhere."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tabulation import flat, tables
from ..plans.tables import TableSpec

BATCH = 500


def write_table(rows: DataFrame, path: str, kind: str, table: str | None = None, mode: str = "append") -> None:
    """Appends. CSV has a header in each file; sql saves as a table of the catalog, or by JDBC for a jdbc: path."""
    if kind == "csv":
        flat(rows).write.mode(mode).option("header", True).csv(path)
    elif kind == "parquet":
        rows.write.mode(mode).parquet(path)
    elif kind == "sql" and path.startswith("jdbc:"):
        flat(rows).write.mode(mode).jdbc(path, table or "data")
    elif kind == "sql":
        flat(rows).write.mode(mode).saveAsTable(table or path)
    else:
        raise ValueError(f"a table is written as csv, parquet or sql, not {kind}")


def typed(rows: DataFrame, table: TableSpec) -> DataFrame:
    """rows in the schema's types; columns that it doesn't know are text."""
    kinds = {c.name: {"number": "float", "boolean": "boolean"}.get(c.data_type, "string") for c in table.columns}
    return flat(rows).select(*[F.col(f"`{c}`").try_cast(kinds.get(c, "string")).alias(c) for c in rows.columns])


def batches(resources: DataFrame, size: int = BATCH) -> DataFrame:
    """bundle_id, batch, bundle: each bundle's resources in batches of at most size, none of them empty."""
    entry = F.struct(F.struct(F.lit("PUT").alias("method"), F.concat_ws("/", "resource_type", "id").alias("url")).alias("request"), F.to_json("resource").alias("resource"))
    grouped = resources.withColumn("batch", F.floor(F.col("pos") / size)).groupBy("bundle_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("x"))
    text = F.concat(F.lit('{"resourceType":"Bundle","type":"batch","entry":['), F.array_join(F.transform("x", lambda i: F.concat(F.lit('{"request":'), F.to_json(i["e"]["request"]), F.lit(',"resource":'), i["e"]["resource"], F.lit("}"))), ","), F.lit("]}"))
    return grouped.select("bundle_id", "batch", text.alias("bundle"))


def upload(bundles: DataFrame, server: str, post: Callable[[str, bytes], tuple[int, bytes]]) -> DataFrame:
    """bundle_id, batch, status, failed (entries that the server didn't take)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            out = []
            for i, n, text in zip(b["bundle_id"], b["batch"], b["bundle"], strict=True):
                status, body = post(server, text.encode())
                entries = (json.loads(body).get("entry") or []) if status == 200 else []
                out.append((i, n, status, sum(not str(e.get("response", {}).get("status", "")).startswith("20") for e in entries)))
            yield pd.DataFrame(out, columns=["bundle_id", "batch", "status", "failed"])

    return bundles.mapInPandas(run, "bundle_id string, batch long, status int, failed int")


def append_index(rows: dict[str, DataFrame], folder: str, known: dict[str, DataFrame] | None = None) -> None:
    """Rows to the index's tables, in the order of their foreign keys. With known, those whose id a table has already stay out."""
    from ..operators.mpi import TABLES

    for t in TABLES:
        if t in rows:
            key = rows[t].columns[0]
            fresh = rows[t].join(known[t].select(key), key, "left_anti").select(*rows[t].columns) if known else rows[t]
            fresh.write.mode("append").parquet(f"{folder}/{t}")


def generate_tables(resources: DataFrame, schema: dict[str, TableSpec], outputs: dict[str, dict[str, str]], **options) -> dict[str, list[str]]:
    """Tabulates resources by every table of a schema and writes each one; returns the tables' columns.

    outputs names for each table where it goes: path and kind (csv, parquet or sql), as write_table takes them. Its columns are
    cast to the schema's types.
    """
    if missing := [t for t in schema if t not in outputs]:
        raise ValueError(f"no output is named for {', '.join(missing)}")
    columns = {}
    for name, rows in tables(resources, schema, **options).items():
        made = typed(rows, schema[name])
        write_table(made, **{"table": name, **outputs[name]})
        columns[name] = made.columns
    return columns


def case_tables(cases: DataFrame) -> dict[str, DataFrame]:
    """ecr_data, ecr_rr_conditions and ecr_rr_rule_summaries of cases (metadata columns; conditions array<struct<condition, rules>>)."""
    condition_id = F.sha2(F.concat_ws("|", "eICR_ID", "c.condition"), 256)
    exploded = cases.select("eICR_ID", F.explode("conditions").alias("c"))
    return {
        "ecr_data": cases.drop("conditions"),
        "ecr_rr_conditions": exploded.select(condition_id.alias("uuid"), "eICR_ID", F.col("c.condition").alias("condition")),
        "ecr_rr_rule_summaries": exploded.select(condition_id.alias("ecr_rr_conditions_id"), F.explode("c.rules").alias("rule_summary")).withColumn("uuid", F.sha2(F.concat_ws("|", "ecr_rr_conditions_id", "rule_summary"), 256)).select("uuid", "ecr_rr_conditions_id", "rule_summary"),
    }
