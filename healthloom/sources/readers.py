"""Sources: FHIR search (a Python data source), NDJSON exports, message batches, zipped case reports, the index's tables."""

from __future__ import annotations

import io
import json
import urllib.request
import warnings
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import hl7

RETRIED = (429, 500, 502, 503, 504)


def fetch(url: str, headers: dict[str, str] | None = None, tries: int = 3, opened: Callable = urllib.request.urlopen, reauthorize: Callable[[], dict] | None = None, data: bytes | None = None) -> bytes:
    """The body of a URL. Busy servers are asked again; a refused token is renewed once."""
    from urllib.error import HTTPError

    renewed = False
    for n in range(tries):
        try:
            with opened(urllib.request.Request(url, data=data, headers=headers or {})) as r:
                return r.read()
        except HTTPError as e:
            if e.code == 401 and reauthorize and not renewed:
                headers, renewed = {**(headers or {}), **reauthorize()}, True
            elif e.code not in RETRIED or n == tries - 1:
                raise
    raise RuntimeError(f"no answer from {url}")


def search_pages(url: str, get: Callable[[str], bytes]) -> Iterator[list[dict]]:
    """The entries of each page of a search; an empty page warns."""
    while url:
        page = json.loads(get(url))
        entries = page.get("entry") or []
        if not entries:
            warnings.warn(f"no resources at {url}", stacklevel=2)
        yield entries
        url = next((x["url"] for x in page.get("link") or [] if x.get("relation") == "next"), None)


class _Search(InputPartition):
    def __init__(self, url: str):
        self.url = url


class FhirSearchReader(DataSourceReader):
    """One partition a search; pages of a search follow each other, searches run side by side."""

    def __init__(self, options: dict):
        self.base = options.get("server", "").rstrip("/")
        self.searches = json.loads(options.get("searches", "[]"))
        self.token = options.get("token")

    def partitions(self) -> list[InputPartition]:
        return [_Search(s) for s in self.searches]

    def read(self, partition: _Search) -> Iterator[tuple]:
        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        pos = 0
        for entries in search_pages(f"{self.base}/{partition.url}", lambda u: fetch(u, headers)):
            for e in entries:
                r = e.get("resource") or {}
                yield partition.url, pos, r.get("resourceType"), r.get("id"), (e.get("search") or {}).get("mode"), json.dumps(r)
                pos += 1


class FhirSearch(DataSource):
    """spark.read.format("fhir_search") with options server, searches (JSON list), token."""

    @classmethod
    def name(cls) -> str:
        return "fhir_search"

    def schema(self) -> str:
        return "bundle_id string, pos int, resource_type string, id string, mode string, resource string"

    def reader(self, schema) -> DataSourceReader:
        return FhirSearchReader(self.options)


def fhir_search(spark: SparkSession, server: str, searches: list[str], token: str | None = None) -> DataFrame:
    spark.dataSource.register(FhirSearch)
    found = spark.read.format("fhir_search").options(server=server, searches=json.dumps(searches), **({"token": token} if token else {})).load()
    return found.withColumn("resource", F.try_parse_json("resource"))


def ndjson(spark: SparkSession, path: str, mode: str = "match") -> DataFrame:
    """Resources of a bulk export: one JSON text a line."""
    v = F.try_parse_json("value")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("bundle_id"), v.alias("resource")).where("resource IS NOT NULL")
    get = lambda p: F.try_variant_get("resource", p, "string")
    return rows.select("bundle_id", F.lit(0).alias("pos"), get("$.resourceType").alias("resource_type"), get("$.id").alias("id"), F.lit(mode).alias("mode"), "resource")


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """bundle_id (the file), bundle: one bundle a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("bundle_id"), F.try_parse_json("value").alias("bundle"))


def export_url(server: str, scope: str = "", since: str = "", types: str = "", container: str = "") -> str:
    """Where a bulk export starts: all, Patient or Group/id."""
    from urllib.parse import urlencode

    if scope and scope != "Patient" and not scope.startswith("Group/"):
        raise ValueError("a scope is empty, Patient or Group/id")
    params = {k: v for k, v in (("_since", since), ("_type", types), ("_container", container)) if v}
    return f"{server.rstrip('/')}/{scope + '/' if scope else ''}$export" + (f"?{urlencode(params)}" if params else "")


def export(server: str, get: Callable[[str], tuple[int, dict, bytes]], wait: Callable[[float], None], every: float = 30, until: float = 300, **options) -> list[tuple[str, str]] | None:
    """(type, url) of a bulk export's files. get returns status, headers and body; null if the server doesn't take the order."""
    status, headers, _ = get(export_url(server, **options))
    if status != 202:
        return None
    waited = 0.0
    while waited <= until:
        status, _, body = get(headers["Content-Location"])
        if status == 200:
            return [(o["type"], o["url"]) for o in json.loads(body).get("output", [])]
        wait(every)
        waited += every
    raise TimeoutError(f"the export took more than {until} s")


def hl7_batches(spark: SparkSession, path: str) -> DataFrame:
    """bundle_id, position, message of batch files."""
    return hl7.explode_batches(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("bundle_id"), "value"))


def case_zips(spark: SparkSession, path: str) -> DataFrame:
    """path, ecr, rr of zip files that hold a case report and, mostly, its response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    take = lambda name, z=z: next((z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.rpartition("/")[2] == name), None)
                    rows.append((p, take("CDA_eICR.xml"), take("CDA_RR.xml")))
            yield pd.DataFrame(rows, columns=["path", "ecr", "rr"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ecr string, rr string")


def index_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from ..operators.mpi import TABLES

    return {t: spark.read.schema(s).parquet(f"{folder}/{t}") for t, s in TABLES.items()}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [str(s.getPath()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
