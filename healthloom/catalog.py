"""The queries of this engine by name, and the SQL that gives the same rows.

The driver's tables stand in for health data: documents, customers and parts are records to link, orders (with customers and
line items) are resources with references, regions and nations are conditions and value sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fhirpath, hl7, phone, phonetic, similarity, text
from .operators import linkage as link
from .operators import geocode, mpi, parsing, patients, searching, tabulation, valuesets, viewer, xml
from .plans.linkage import BlockKey, Pass, deterministic
from .plans.tables import ColumnSpec, Reference, TableSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# Linkage. Parts of one brand, size and first word of the name are records of a block.
PART_BLOCK = (BlockKey("p_brand"), BlockKey("p_size"))
EXACT, FOUR, FUZZY = "feature_match_exact", "feature_match_four_char", "feature_match_fuzzy_string"
WEIGHTED, WEIGHTED_FUZZY = "feature_match_log_odds_exact", "feature_match_log_odds_fuzzy_compare"
WEIGHTS = {"p_name": 6.0, "p_brand": 2.0, "p_size": 1.5}
_PART_PAIRS = "FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_fuzzy_jw(spark, sf_dir)


@query("SELECT a.doc_id AS id_i, b.doc_id AS id_j FROM documents a JOIN documents b ON a.lang = b.lang AND a.source = b.source AND a.text = b.text AND a.doc_id < b.doc_id")
def link_exact_pairs(spark, sf_dir):
    p = Pass({"text": EXACT}, (BlockKey("lang"), BlockKey("source"), BlockKey("text")), "eval_perfect_match")
    return link.match_pairs(table(spark, sf_dir, "documents"), p, "doc_id")


@query(f"SELECT a.p_partkey AS id_i, b.p_partkey AS id_j {_PART_PAIRS} WHERE left(a.p_name, 4) = left(b.p_name, 4)")
def link_first4_pairs(spark, sf_dir):
    return link.match_pairs(table(spark, sf_dir, "part"), Pass({"p_name": FOUR}, PART_BLOCK, "eval_perfect_match"), "p_partkey")


@query("""SELECT a.c_custkey AS id_i, b.c_custkey AS id_j FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey
WHERE jaro_winkler_similarity(a.c_name, b.c_name) >= 0.96""")
def link_fuzzy_jw(spark, sf_dir):
    p = Pass({"c_name": FUZZY}, (BlockKey("c_nationkey"), BlockKey("c_mktsegment")), "eval_perfect_match", threshold=0.96)
    return link.match_pairs(table(spark, sf_dir, "customer"), p, "c_custkey")


@query(f"SELECT a.p_partkey AS id_i, b.p_partkey AS id_j {_PART_PAIRS} WHERE 1.0::DOUBLE - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) >= 0.55")
def link_fuzzy_lev(spark, sf_dir):
    return link.match_pairs(table(spark, sf_dir, "part"), Pass({"p_name": FUZZY}, PART_BLOCK, "eval_perfect_match", threshold=0.55, similarity_measure="Levenshtein"), "p_partkey")


@query(f"SELECT a.p_partkey AS id_i, b.p_partkey AS id_j {_PART_PAIRS} WHERE 1.0::DOUBLE - damerau_levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) >= 0.55")
def link_fuzzy_dl(spark, sf_dir):
    return link.match_pairs(table(spark, sf_dir, "part"), Pass({"p_name": FUZZY}, PART_BLOCK, "eval_perfect_match", threshold=0.55, similarity_measure="DamerauLevenshtein"), "p_partkey")


@query("""SELECT a.p_partkey AS id_i, b.p_partkey AS id_j FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE CASE WHEN a.p_name = b.p_name THEN 6.0 ELSE 0 END + CASE WHEN a.p_size = b.p_size THEN 1.5 ELSE 0 END >= 7.0""")
def link_logodds(spark, sf_dir):
    p = Pass({"p_name": WEIGHTED, "p_size": WEIGHTED}, (BlockKey("p_brand"),), "eval_log_odds_cutoff", true_match_threshold=7.0, log_odds=WEIGHTS)
    return link.match_pairs(table(spark, sf_dir, "part"), p, "p_partkey")


@query(f"""SELECT a.p_partkey AS id_i, b.p_partkey AS id_j {_PART_PAIRS}
WHERE CASE WHEN jaro_winkler_similarity(a.p_name, b.p_name) >= 0.7 THEN 6.0 * jaro_winkler_similarity(a.p_name, b.p_name) ELSE 0 END >= 4.8""")
def link_logodds_fuzzy(spark, sf_dir):
    p = Pass({"p_name": WEIGHTED_FUZZY}, PART_BLOCK, "eval_log_odds_cutoff", true_match_threshold=4.8, log_odds=WEIGHTS)
    return link.match_pairs(table(spark, sf_dir, "part"), p, "p_partkey")


def _part_matches(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    passes = [Pass({"p_name": FOUR}, PART_BLOCK, "eval_perfect_match"), Pass({"p_name": EXACT}, (BlockKey("p_brand"), BlockKey("p_name")), "eval_perfect_match")]
    return link.link(parts, passes, "p_partkey")


_COMPILED = f"""m AS (SELECT a.p_partkey AS root, b.p_partkey AS member {_PART_PAIRS} WHERE left(a.p_name, 4) = left(b.p_name, 4)
UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey)"""
_TRUTH = "t AS (SELECT a.p_partkey AS root, b.p_partkey AS member FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey)"


@query(f"WITH {_COMPILED} SELECT root, member FROM m")
def link_compile(spark, sf_dir):
    return _part_matches(spark, sf_dir)


@query()
def link_clusters(spark, sf_dir):
    p = Pass({"p_name": FUZZY}, PART_BLOCK, "eval_perfect_match", 0.9, threshold=0.75)
    return link.match_clusters(table(spark, sf_dir, "part"), p, "p_partkey")


@query("SELECT p_brand AS b0, p_size AS b1, count(*) AS records FROM part GROUP BY ALL HAVING count(*) > 1")
def link_block_sizes(spark, sf_dir):
    return link.block_sizes(table(spark, sf_dir, "part"), PART_BLOCK, 1).select(F.col("__b0").alias("b0"), F.col("__b1").alias("b1"), "records")


def _known(parts: DataFrame) -> DataFrame:
    """Parts with the identity that makes true pairs."""
    return parts.withColumn("k", F.concat_ws("|", "p_brand", "p_name"))


def _truth(parts: DataFrame) -> DataFrame:
    return link.true_pairs(_known(parts), "k", "p_partkey")


_M = "SELECT 'p_size' AS \"column\", (1 + count(*) FILTER (a.p_size = b.p_size)) / (1 + count(*))::DOUBLE AS probability FROM t JOIN part a ON a.p_partkey = t.root JOIN part b ON b.p_partkey = t.member"
_U = """SELECT 'p_size' AS "column", (1 + (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM part GROUP BY p_size)) - (SELECT count(*) FROM t JOIN part a ON a.p_partkey = t.root JOIN part b ON b.p_partkey = t.member WHERE a.p_size = b.p_size))
/ (1 + (SELECT count(*) * (count(*) - 1) // 2 FROM part) - (SELECT count(*) FROM t))::DOUBLE AS probability"""


@query(f"WITH {_TRUTH} {_M}")
def link_m_probs(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return link.m_probabilities(_truth(parts), parts, ["p_size"], "p_partkey")


@query(f"WITH {_TRUTH} {_U}")
def link_u_probs(spark, sf_dir):
    found = link.probabilities_by_key(_known(table(spark, sf_dir, "part")), "k", ["p_size"])
    return found.select("column", F.col("u").alias("probability"))


@query(f'WITH {_TRUTH}, m AS ({_M}), u AS ({_U}) SELECT "column", round(ln(m.probability) - ln(u.probability), 9) AS log_odds FROM m JOIN u USING ("column")')
def link_log_odds(spark, sf_dir):
    known = link.probabilities_by_key(_known(table(spark, sf_dir, "part")), "k", ["p_size"])
    found = link.log_odds(*[known.select("column", F.col(c).alias("probability")) for c in ("m", "u")])
    return found.select("column", F.round("log_odds", 9).alias("log_odds"))


@query(f"""WITH {_COMPILED}, {_TRUTH}, c AS (SELECT (SELECT count(*) FROM m JOIN t USING (root, member)) AS tp, (SELECT count(*) FROM m ANTI JOIN t USING (root, member)) AS fp, (SELECT count(*) FROM t ANTI JOIN m USING (root, member)) AS fn, (SELECT count(*) * (count(*) - 1) // 2 FROM part) AS n)
SELECT round(tp / (tp + fn)::DOUBLE, 3) AS sensitivity, round((n - tp - fp - fn) / (n - tp - fn)::DOUBLE, 3) AS specificity, round(tp / (tp + fp)::DOUBLE, 3) AS ppv, round(2 * tp / (2 * tp + fn + fp)::DOUBLE, 3) AS f1 FROM c""")
def link_score(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return link.score(_part_matches(spark, sf_dir), _truth(parts), parts.count())


@query(f"WITH {_COMPILED}, {_TRUTH} SELECT DISTINCT unnest([root, member]) AS id FROM (SELECT root, member FROM m ANTI JOIN t USING (root, member))")
def link_affected(spark, sf_dir):
    return link.affected(link.missed(_truth(table(spark, sf_dir, "part")), _part_matches(spark, sf_dir)))


@query("""WITH s AS (SELECT l_orderkey::VARCHAR AS patient_id, l_suppkey::VARCHAR AS person_id, l_quantity >= 25 AS hit FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT patient_id, person_id, count(*) FILTER (hit) / count(*)::DOUBLE AS ratio FROM s GROUP BY ALL)
SELECT patient_id, person_id, ratio FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ratio DESC, person_id) AS n FROM r WHERE ratio >= 0.5) WHERE n = 1""")
def link_best_person(spark, sf_dir):
    """Orders are records, their line items the index rows of their block; those of 25 or more agree."""
    none = F.lit(None).cast("string")
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("patient_id"), F.lit("many").alias("first_name"), F.col("o_orderkey").cast("string").alias("mrn"))
    flat = table(spark, sf_dir, "lineitem").select(none.alias("patient_id"), F.col("l_suppkey").cast("string").alias("person_id"), F.col("l_orderkey").cast("string").alias("mrn"), F.when(F.col("l_quantity") >= 25, "many").otherwise("few").alias("first_name"))
    return mpi.best_persons(records, flat, [Pass({"first_name": EXACT}, (BlockKey("mrn"),), "eval_perfect_match", 0.5)])


def _index(spark, sf_dir) -> dict[str, DataFrame]:
    """Customers as an index of patients, one person each."""
    c = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey").cast("string"))
    n = lambda kind: F.lit(None).cast(kind)
    index = mpi.empty(spark)
    index["person"] = c.select(F.concat(F.lit("p"), "id").alias("person_id"))
    index["patient"] = c.select(F.col("id").alias("patient_id"), F.concat(F.lit("p"), "id").alias("person_id"), n("date").alias("dob"), F.col("c_mktsegment").alias("sex"), n("string").alias("race"), n("string").alias("ethnicity"))
    index["name"] = c.select(F.col("id").alias("name_id"), F.col("id").alias("patient_id"), F.col("c_name").alias("last_name"), n("string").alias("type"))
    index["given_name"] = c.select(F.col("id").alias("given_name_id"), F.col("id").alias("name_id"), F.right("c_name", F.lit(4)).alias("given_name"), F.lit(0).alias("given_name_index"))
    index["identifier"] = c.select(F.col("id").alias("identifier_id"), F.col("id").alias("patient_id"), F.right("c_name", F.lit(3)).alias("patient_identifier"), F.lit("MR").alias("type_code"), n("string").alias("type_display"), n("string").alias("type_system"))
    index["address"] = c.select(F.col("id").alias("address_id"), F.col("id").alias("patient_id"), n("string").alias("type"), F.col("c_mktsegment").alias("line_1"), n("string").alias("line_2"), F.col("c_nationkey").cast("string").alias("city"), n("string").alias("zip_code"), n("string").alias("state"), n("string").alias("country"), n("decimal(9,6)").alias("latitude"), n("decimal(9,6)").alias("longitude"), n("timestamp").alias("start_date"), n("timestamp").alias("end_date"))
    return index


_CUSTOMER_BLOCK = "FROM customer a JOIN customer b ON right(a.c_name, 3) = right(b.c_name, 3) AND left(a.c_mktsegment, 4) = left(b.c_mktsegment, 4)"


@query(f"""WITH r AS (SELECT a.c_custkey::VARCHAR AS patient_id, 'p' || b.c_custkey AS person_id, jaro_winkler_similarity(a.c_name, b.c_name) >= 0.9 AND a.c_nationkey = b.c_nationkey AS hit {_CUSTOMER_BLOCK}),
g AS (SELECT patient_id, person_id, count(*) FILTER (hit) / count(*)::DOUBLE AS ratio FROM r GROUP BY ALL),
m AS (SELECT patient_id, min(person_id) AS person_id FROM g WHERE ratio >= 0.9 GROUP BY patient_id)
SELECT c.c_custkey::VARCHAR AS patient_id, m.person_id IS NOT NULL AS matched, coalesce(m.person_id, 'new-' || sha256(c.c_custkey::VARCHAR)) AS person_id FROM customer c LEFT JOIN m ON m.patient_id = c.c_custkey::VARCHAR""")
def link_incremental(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    records = c.select(F.col("c_custkey").cast("string").alias("patient_id"), none.alias("first_name"), F.col("c_name").alias("last_name"), none.alias("birthdate"), F.col("c_mktsegment").alias("sex"), F.right("c_name", F.lit(3)).alias("mrn"), F.array("c_mktsegment").alias("address"), F.array(F.col("c_nationkey").cast("string")).alias("city"), F.array(none).alias("state"), F.array(none).alias("zip"))
    p = Pass({"last_name": FUZZY, "city": EXACT}, (BlockKey("mrn", "last4"), BlockKey("address", "first4")), "eval_perfect_match", 0.9, threshold=0.9)
    return mpi.link(records, _index(spark, sf_dir), [p]).select("patient_id", "matched", "person_id")


@query("SELECT c_custkey::VARCHAR AS patient_id FROM customer WHERE left(c_name, 4) = 'Cust' AND left(c_mktsegment, 4) = 'BUIL'")
def blocking_semi_join(spark, sf_dir):
    return mpi.block_patients(_index(spark, sf_dir), {"last_name": ("Cust", "first4"), "address": ("BUIL", "first4"), "unknown": ("x", None)})


@query("SELECT c_custkey::VARCHAR AS patient_id, 'p' || c_custkey AS person_id, right(c_name, 4) AS first_name, c_name AS last_name, right(c_name, 3) AS mrn, c_mktsegment AS address, c_nationkey::VARCHAR AS city FROM customer")
def mpi_flat_view(spark, sf_dir):
    return mpi.flat_view(_index(spark, sf_dir)).select("patient_id", "person_id", "first_name", "last_name", "mrn", "address", "city")


# Harmonisation.
@query("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} ]', '', 'g'), '\\p{N}', '', 'g'), ' ')) AS name FROM documents")
def std_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.standardize_name(F.col("text"), case="lower").alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS born FROM orders")
def std_dob(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.standardize_birth_date(F.date_format("o_orderdate", "MM/dd/yyyy"), "%m/%d/%Y").alias("born"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '.1234-0500' AS at FROM events")
def hl7_datetime(spark, sf_dir):
    long = F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("99.123456-05007x"))
    return table(spark, sf_dir, "events").select("event_id", hl7.normalize_datetime(long).alias("at"))


@query("SELECT o_orderkey, 'MSH|^~\\&|A|B|||' || strftime(o_orderdate, '%Y%m%d%H%M%S') || chr(10) || 'PID|1||' || o_custkey || '||||' || strftime(o_orderdate, '%Y%m%d') || chr(10) || 'ZZZ|x' AS message FROM orders")
def hl7_message(spark, sf_dir):
    at = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    message = F.concat(F.lit("MSH|^~\\&|A|B|||"), at, F.lit("777\rPID|1||||||"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("\rZZZ|x"))
    whole = hl7.default_value(message, "PID", 3, "unknown")
    own = F.regexp_replace(hl7.standardize_datetimes(whole), F.lit("\\|unknown\\|"), F.concat(F.lit("|"), F.col("o_custkey").cast("string"), F.lit("|")))
    return table(spark, sf_dir, "orders").select("o_orderkey", own.alias("message"))


@query("SELECT o_custkey, i AS position, 'MSH|' || o_orderkey || chr(13) || 'PID|' || o_custkey || chr(13) AS message FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)")
def hl7_batch(spark, sf_dir):
    one = F.concat(F.lit("MSH|"), F.col("o_orderkey").cast("string"), F.lit("\r\nPID|"), F.col("o_custkey").cast("string"), F.lit("\r\n"))
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("m")))), lambda x: x["m"]), "").alias("body"))
    return hl7.explode_batches(files.select("o_custkey", F.concat(F.lit("FHS|x\nBHS|y\n"), "body", F.lit("BTS|1\nFTS|1")).alias("value")))


@query("SELECT c_custkey, sha256(c_name || 'salt') AS hashed FROM customer")
def hash_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.hash_identifier(F.col("c_name"), "salt").alias("hashed"))


@query("SELECT c_custkey, c_name || ' ' || c_mktsegment || ', ' || c_nationkey || ' ' || c_custkey AS line FROM customer")
def one_line_address(spark, sf_dir):
    line = text.one_line_address(F.array("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))


@query("SELECT c_custkey, '+1' || lpad((2000000000 + c_custkey)::VARCHAR, 10, '0') AS phone FROM customer")
def std_phone(spark, sf_dir):
    raw = F.regexp_replace((F.lit(2_000_000_000) + F.col("c_custkey")).cast("string"), "^(...)(...)(....)$", "($1) $2-$3")
    return table(spark, sf_dir, "customer").select("c_custkey", phone.standardize_phone(raw, ("US",)).alias("phone"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'FR' END AS country FROM nation")
def std_country(spark, sf_dir):
    raw = F.element_at(F.array(F.lit(" usa "), F.lit("826"), F.lit("France"), F.lit("zzz")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return phone.standardize_country(table(spark, sf_dir, "nation").withColumn("raw", raw), "raw").select("n_nationkey", "country")


@query()
def double_metaphone(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(phonetic.double_metaphone_codes("p_name"), "|").alias("codes"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j, round(jaro_winkler_similarity(a.n_name, b.n_name), 9) AS jw, round(1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)), 9) AS lev, round(1 - damerau_levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)), 9) AS dl FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def similarities(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    pairs = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"))
    a, b = F.col("a.n_name"), F.col("b.n_name")
    return pairs.select(F.col("a.n_nationkey").alias("i"), F.col("b.n_nationkey").alias("j"), F.round(similarity.compare_strings(a, b, "JaroWinkler"), 9).alias("jw"), F.round(similarity.compare_strings(a, b, "Levenshtein"), 9).alias("lev"), F.round(similarity.compare_strings(a, b, "DamerauLevenshtein"), 9).alias("dl"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') || ' 12:00 AM UTC' AS at, strftime(o_orderdate, '%m/%d/%Y') AS day, date_diff('year', DATE '1970-01-01', o_orderdate::DATE) AS age FROM orders")
def display_forms(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.display_datetime(iso).alias("at"), text.display_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), text.age_years(F.lit("1970-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("age"))


# Tabulation: orders refer to customers, line items refer to orders.
def _resources(spark, sf_dir) -> DataFrame:
    ref = lambda kind, c: F.struct(F.concat(F.lit(f"{kind}/"), F.col(c).cast("string")).alias("reference"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", ref("Patient", "o_custkey").alias("subject"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", ref("Encounter", "l_orderkey").alias("encounter"))
    return tabulation.resources_of(c, "Patient", F.col("c_custkey"), "include").unionByName(tabulation.resources_of(o, "Encounter", F.col("o_orderkey"))).unionByName(tabulation.resources_of(items, "Observation", F.concat_ws("-", "l_orderkey", "l_linenumber"), "include"))


_FORWARD, _REVERSE = Reference("forward", "Patient", "subject"), Reference("reverse", "Observation", "encounter")
_KEY = ColumnSpec("o_orderkey", "o_orderkey")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus AS status FROM orders")
def tab_anchor(spark, sf_dir):
    return tabulation.tabulate(_resources(spark, sf_dir), TableSpec("orders", "Encounter", (_KEY, ColumnSpec("status", "Encounter.o_orderstatus"))))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, c_name AS name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def tab_forward(spark, sf_dir):
    return tabulation.tabulate(_resources(spark, sf_dir), TableSpec("orders", "Encounter", (_KEY, ColumnSpec("name", "c_name", reference=_FORWARD), ColumnSpec("segment", "Patient.c_mktsegment", reference=_FORWARD))))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, string_agg(l_returnflag, ',' ORDER BY l_orderkey || '-' || l_linenumber, l_returnflag) AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def tab_reverse(spark, sf_dir):
    return tabulation.flat(tabulation.tabulate(_resources(spark, sf_dir), TableSpec("orders", "Encounter", (_KEY, ColumnSpec("flags", "l_returnflag", reference=_REVERSE)))))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus AS status, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def tab_drop_invalid(spark, sf_dir):
    spec = TableSpec("orders", "Encounter", (_KEY, ColumnSpec("status", "o_orderstatus", invalid_values=("F", None)), ColumnSpec("segment", "c_mktsegment", reference=_FORWARD, invalid_values=("BUILDING", "MACHINERY", None))))
    return tabulation.drop_invalid(tabulation.tabulate(_resources(spark, sf_dir), spec), spec)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def tab_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fhirpath.first_text(F.parse_json("props"), "k").alias("k"))


@query("""SELECT conv_id, count(*) AS turns, max(length(text)) FILTER (role = 'user') AS longest, string_agg(role, '|' ORDER BY turn) AS roles, count(*) FILTER (role = 'assistant') > 0 AS answered FROM conversations GROUP BY conv_id""")
def fhirpath_functions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.char_length("text").alias("n")))).alias("item"))
    r = F.to_variant_object(F.struct("item"))
    longest = F.array_max(F.transform(fhirpath.texts(r, "item.where(role = 'user').n"), lambda x: x.cast("int")))
    return c.select("conv_id", fhirpath.first_text(r, "item.count()").cast("long").alias("turns"), longest.alias("longest"), fhirpath.first_text(r, "item.role.join('|')").alias("roles"), (fhirpath.first_text(r, "item.where(role = 'assistant').exists()") == "true").alias("answered"))


@query("SELECT conv_id, arg_min(role, turn) AS first, arg_max(role, turn) AS last, string_agg(role, ',' ORDER BY turn) AS everything FROM conversations GROUP BY conv_id")
def select_first_last_all(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return c.select("conv_id", *[text.select_value(F.col("roles"), k).alias(k) for k in ("first", "last")], text.list_text(text.select_value(F.col("roles"), "all")).alias("everything"))


# Value sets: regions are conditions, nations value sets, suppliers concepts.
def _valuesets(spark, sf_dir) -> dict[str, DataFrame]:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    t = lambda c: F.col(c).cast("string")
    return {
        "conditions": r.select(t("r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "junction": n.select(t("n_regionkey").alias("condition_id"), t("n_nationkey").alias("valueset_id")),
        "valuesets": n.select(t("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "dxtc").otherwise("lotc").alias("type"), F.col("n_name").alias("name"), t("n_nationkey").alias("oid")),
        "to_concept": s.select(t("s_nationkey").alias("valueset_id"), t("s_suppkey").alias("concept_id")),
        "concepts": s.select(t("s_suppkey").alias("id"), F.col("s_name").alias("code"), F.lit("local").alias("code_system"), valuesets.stripped(F.col("s_name")).alias("gem_formatted_code")),
    }


_CONCEPTS = "FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey"


@query(f"SELECT r_regionkey::VARCHAR AS condition_id, CASE WHEN n_nationkey % 2 = 0 THEN 'dxtc' WHEN n_nationkey IS NOT NULL THEN 'lotc' END AS type, CASE WHEN s_suppkey IS NOT NULL THEN 'local' END AS system, coalesce(string_agg(DISTINCT s_name, '|' ORDER BY s_name), '') AS codes {_CONCEPTS} GROUP BY ALL")
def valueset_concat(spark, sf_dir):
    v = _valuesets(spark, sf_dir)
    return valuesets.concepts_for(v["conditions"], v["junction"], v["valuesets"], v["to_concept"], v["concepts"]).select("condition_id", F.when(F.col("type").isNotNull(), F.col("type")).alias("type"), "system", "codes")


@query("SELECT n_nationkey::VARCHAR AS condition_id, 'dxtc' AS type, n_name AS codes, 'local' AS system FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'dxtc', r_name, 'http://hl7.org/fhir/sid/icd-9-cm' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def crosswalk_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_nationkey").cast("string").alias("condition_id"), F.lit("dxtc").alias("type"), F.col("n_name").alias("codes"), F.lit("local").alias("system"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).alias("icd9"))
    return valuesets.with_crosswalk_rows(rows)


@query("""WITH f AS (SELECT p_partkey, unnest(list_distinct([p_brand, regexp_replace(p_brand, '[^\\p{L}\\p{N}]', '', 'g')])) AS code FROM part),
l AS (SELECT DISTINCT p_type AS condition_id, replace(p_brand, '#', '') AS code FROM part) SELECT DISTINCT p_partkey, condition_id FROM f JOIN l USING (code)""")
def stamp_codes(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    listed = parts.select(F.col("p_type").alias("condition_id"), F.regexp_replace("p_brand", "#", "").alias("code"))
    return valuesets.stamps(parts.select("p_partkey", F.col("p_brand").alias("code")), listed, ["p_partkey"])


# Viewer and services.
@query("SELECT o_orderkey AS query_id, o_orderstatus AS query_name, l_linenumber AS valueset_id, p_name AS display FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'")
def saved_query_join(spark, sf_dir):
    queries_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("query_name"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("valueset_id"), "l_partkey")
    sets = spark.range(1, 8).select(F.col("id").cast("int").alias("id"), F.lit("set").alias("name"), F.lit("dxtc").alias("type"))
    included = lines.select(F.col("id").alias("query_by_valueset_id"), F.col("l_partkey").alias("concept_id"), F.lit(True).alias("include"))
    concepts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("code"), F.lit("local").alias("code_system"), F.col("p_name").alias("display"))
    return viewer.saved_query(queries_, lines, included, concepts, sets, "F").select("query_id", "query_name", "valueset_id", "display")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey OFFSET 50 LIMIT 25")
def list_page(spark, sf_dir):
    return viewer.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50, 25)


@query("SELECT count(*) AS n FROM orders")
def list_count(spark, sf_dir):
    return viewer.total(table(spark, sf_dir, "orders"))


@query("SELECT c_mktsegment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percent FROM customer GROUP BY c_mktsegment")
def share_of_total(spark, sf_dir):
    return viewer.shares(table(spark, sf_dir, "customer"), "c_mktsegment").withColumn("percent", F.round("percent", 9))


# Clinical XML: an order is a case report, its customer's segment the response's organization.
_RULES = [
    {"fieldName": "Report id", "cdaPath": "//hl7:ClinicalDocument/hl7:id", "errorType": "fatal", "attributes": [{"attributeName": "root"}]},
    {"fieldName": "Set number", "cdaPath": "//hl7:ClinicalDocument/hl7:setId", "errorType": "errors", "attributes": [{"attributeName": "extension", "regEx": "^[0-9]*[02468]$"}]},
    {"fieldName": "Status", "cdaPath": "//hl7:ClinicalDocument/hl7:title", "errorType": "warnings", "textRequired": "True", "regEx": "[FO]"},
]


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows in several parts a core, by key: for work that is large beside its input, which is split by its bytes only."""
    session = rows.sparkSession
    return rows.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), key)


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def _reports(spark, sf_dir) -> DataFrame:
    return _reported(_orders(spark, sf_dir)).select("o_orderkey", "o_custkey", "report")


def _reported(orders: DataFrame) -> DataFrame:
    """orders with a report each."""
    key = F.col("o_orderkey").cast("string")
    section = lambda code: F.concat(F.lit(f'<component><section><code code="{code}"/><text>t</text><entry><observation><templateId root="t1"/><code code="a'), F.col("o_custkey").cast("string"), F.lit('"/></observation></entry><entry><observation><code code="b"/></observation></entry></section></component>'))
    head = F.concat(F.lit('<ClinicalDocument xmlns="urn:hl7-org:v3"><id root="r'), key, F.lit('" extension="e"/><setId extension="'), key, F.lit('"/><title>'), F.col("o_orderstatus"), F.lit("</title>"))
    # Every fifth report lacks its last end tags.
    tail = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("</structuredBody></component></ClinicalDocument>")
    report = F.concat(head, F.lit("<component><structuredBody>"), section("30954-2"), section("11450-4"), tail)
    # A few MB of orders make many reports, so their short rows are dealt to all cores first.
    return _dealt(orders, "o_orderkey").withColumn("report", report)


@query("SELECT o_orderkey, true AS valid, CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END AS errors, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS warnings, 'r' || o_orderkey AS root FROM orders")
def report_validation(spark, sf_dir):
    found = _reports(spark, sf_dir).select("o_orderkey", xml.validate(F.col("report"), _RULES).alias("v"))
    return found.select("o_orderkey", F.col("v.message_valid").alias("valid"), F.size("v.errors").alias("errors"), F.size("v.warnings").alias("warnings"), F.col("v.message_ids.eicr.root").alias("root"))


@query("""SELECT 'errors' AS severity, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 HAVING count(*) > 0 UNION ALL SELECT 'warnings', count(*) FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
UNION ALL SELECT 'information', count(*) FROM orders HAVING count(*) > 0""")
def error_rollup(spark, sf_dir):
    return xml.roll_up(_reports(spark, sf_dir).select(xml.validate(F.col("report"), _RULES).alias("result")))


@query("SELECT o_orderkey, o_orderkey % 5 > 0 AS refined, CASE WHEN o_orderkey % 5 > 0 THEN 1 ELSE 0 END AS kept, 0 AS other, CASE WHEN o_orderkey % 5 > 0 THEN 1 ELSE 0 END AS emptied FROM orders")
def report_refinement(spark, sf_dir):
    """One section keeps the observations of its trigger, the other is emptied. A broken report isn't refined."""
    refined = _reports(spark, sf_dir).withColumn("refined", xml.refine(F.col("report"), {"30954-2": {"t1"}, "11450-4": {"t9"}}))
    times = lambda c: F.coalesce(F.regexp_count("refined", c), F.lit(0))
    observed = F.concat(F.lit("<(?:\\w+:)?observation>[^§]*?code=\"a"), F.col("o_custkey").cast("string"), F.lit('"'))
    return refined.select("o_orderkey", F.col("refined").isNotNull().alias("refined"), times(observed).alias("kept"), times(F.lit('<(?:\\w+:)?code code="b"')).alias("other"), times(F.lit("nullFlavor")).alias("emptied"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 AND c_custkey IS NOT NULL THEN 'x' || c_custkey END AS response, CASE WHEN o_orderkey % 5 > 0 AND c_custkey IS NOT NULL THEN 1 ELSE 0 END AS statuses,
CASE WHEN o_orderkey % 5 > 0 AND c_custkey IS NOT NULL THEN 1 ELSE 0 END AS decided FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def report_merge(spark, sf_dir):
    own = F.col("c_custkey").cast("string")
    response = F.concat(
        F.lit('<ClinicalDocument xmlns="urn:hl7-org:v3"><templateId root="t"/><id root="x'), own, F.lit('"/><code code="88085-6"/><title>Response</title><effectiveTime value="2020"/><confidentialityCode code="N"/><component><structuredBody><component><section>'),
        F.lit(f'<templateId root="{xml.STATUS_SECTION}"/><id root="no"/><entry><act><templateId root="{xml.STATUS_ACT}"/><code code="status"/></act></entry>'),
        F.lit('<entry typeCode="DRIV"><organizer classCode="CLUSTER" moodCode="EVN"><code code="decided"/></organizer></entry></section></component></structuredBody></component></ClinicalDocument>'),
    )
    # Keys are joined, and both texts made afterwards: no document is shuffled or sorted.
    orders = _orders(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    merged = _reported(orders).withColumn("response", response).select("o_orderkey", xml.merge_response("response", "report").alias("merged"))
    told = F.nullif(F.regexp_extract("merged", '<section><templateId root="t" ?/><id root="(x[0-9]+)" ?/><code code="88085-6" ?/><title>Response</title><effectiveTime value="2020" ?/><confidentialityCode code="N" ?/><entry>', 1), F.lit(""))
    return merged.select("o_orderkey", told.alias("response"), F.regexp_count("merged", F.lit('code="status"')).alias("statuses"), F.regexp_count("merged", F.lit('code="decided"')).alias("decided"))


# Bundles: an order with its customer and line items.
def _bundles(spark, sf_dir) -> DataFrame:
    kind = lambda name: F.lit(name).alias("resourceType")
    text_of = lambda c: F.col(c).cast("string")
    entry = lambda r: F.to_json(F.struct(r.alias("resource")))
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    item = F.struct(kind("Observation"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.struct(F.array(F.struct(F.col("l_returnflag").alias("code"))).alias("coding")).alias("valueCodeableConcept"))
    items = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry(item))).alias("items"), F.sort_array(F.collect_set(F.concat(F.lit("Observation/"), F.concat_ws("-", "l_orderkey", "l_linenumber")))).alias("refs"))
    patient = F.struct(kind("Patient"), F.concat(F.lit("p"), text_of("c_custkey")).alias("id"), F.array(F.struct(F.col("c_name").alias("family"), F.array(F.lit("A"), F.col("c_mktsegment")).alias("given"))).alias("name"))
    section = F.struct(F.struct(F.array(F.struct(F.lit("88085-6").alias("code"))).alias("coding")).alias("code"), F.transform("refs", lambda r: F.struct(r.alias("reference"))).alias("entry"))
    composition = F.struct(kind("Composition"), F.concat(F.lit("c"), text_of("o_orderkey")).alias("id"), F.struct(F.concat(F.lit("Patient/p"), text_of("o_custkey")).alias("reference")).alias("subject"), F.array(section).alias("section"))
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    whole = F.concat(F.lit('{"resourceType":"Bundle","entry":['), F.concat_ws(",", F.array(entry(composition), entry(patient)), "items"), F.lit("]}"))
    return rows.select(text_of("o_orderkey").alias("bundle_id"), F.parse_json(whole).alias("bundle"))


@query("SELECT DISTINCT l_orderkey::VARCHAR AS bundle_id, l_returnflag AS code FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def find_conditions(spark, sf_dir):
    return valuesets.reportable_conditions(tabulation.explode_bundles(_bundles(spark, sf_dir)))


@query("""SELECT o_orderkey::VARCHAR AS bundle_id, c_name AS family, 'A,' || c_mktsegment AS given, 'p' || c_custkey AS patient, n AS items FROM orders JOIN customer ON c_custkey = o_custkey
JOIN (SELECT l_orderkey, string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY l_linenumber) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def parsed_messages(spark, sf_dir):
    people = "Bundle.entry.resource.where(resourceType = 'Patient')"
    spec = {
        "family": {"fhir_path": f"{people}.name.family"},
        "given": {"fhir_path": f"{people}.name.given"},
        "patient": {"fhir_path": f"{people}.id"},
        "items": {"fhir_path": "Bundle.entry.resource.where(resourceType = 'Observation')", "secondary_schema": {"item": {"fhir_path": "Observation.id"}}},
    }
    found = parsing.parse(_bundles(spark, sf_dir), parsing.schema_of(spec), keep=("bundle_id",))
    return found.withColumn("items", F.array_join(F.array_sort(F.transform("items", lambda x: x["item"])), ","))


@query("SELECT o_orderkey, 'p' || o_custkey AS id, 'Fam' || o_custkey AS family, 'Ann Bea' AS given, strftime(o_orderdate, '%Y-%m-%d') AS born, CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'other' ELSE 'unknown' END AS gender, '1 Main St' AS line, 'City' || o_custkey AS city, '555' AS phone FROM orders")
def hl7_patient(spark, sf_dir):
    own = F.col("o_custkey").cast("string")
    pid = F.concat(F.lit("PID|1||p"), own, F.lit("^^^A~q||Fam"), own, F.lit("^Ann^Bea||"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000|"), F.col("o_orderstatus"), F.lit("|||1 Main St^^City"), own, F.lit("^ST^123||555"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", hl7.patient(F.concat(F.lit("MSH|^~\\&|A\r"), pid, F.lit("\rZZZ|x"))).alias("p"))
    return found.select("o_orderkey", "p.id", "p.family", F.array_join("p.given", " ").alias("given"), F.col("p.birthDate").alias("born"), "p.gender", F.array_join("p.address.line", " ").alias("line"), "p.address.city", "p.phone")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'https://geocoding.geo.census.gov/geocoder/geographies/address?street=' || replace(replace(c_mktsegment || ' St,', ' ', '+'), ',', '%2C') || '&city=' || c_nationkey || '&zip=' || c_custkey || '&benchmark=Public_AR_Census2020&vintage=Census2020_Census2020&layers=[10]&format=json' END AS asked,
CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ' ST' END AS line, CASE WHEN c_custkey % 3 > 0 THEN '0' || c_nationkey || '7' END AS county, CASE WHEN c_custkey % 3 > 0 THEN c_custkey / 4.0 END AS lat, CASE WHEN c_custkey % 3 > 0 THEN 2 ELSE 0 END AS extensions FROM customer""")
def geocoded(spark, sf_dir):
    """What is asked, and what becomes of the answers; every third customer has no street and no match."""
    c, text_of = table(spark, sf_dir, "customer"), lambda x: F.col(x).cast("string")
    street = F.when(F.col("c_custkey") % 3 > 0, F.concat("c_mktsegment", F.lit(" St,"))).otherwise("")
    block = F.concat(F.lit('"geographies":{"Census Blocks":[{"STATE":"0'), text_of("c_nationkey"), F.lit('","COUNTY":"7","GEOID":"g","BASENAME":"b"}],"Census Tracts":[{"BASENAME":"t"}],"Counties":[{"BASENAME":"k"}]}'))
    match = F.concat(F.lit('{"matchedAddress":"'), "c_mktsegment", F.lit(' ST, X","coordinates":{"x":1.5,"y":'), (F.col("c_custkey") / 4).cast("string"), F.lit('},"addressComponents":{"city":"X","state":"S","zip":"Z"},'), block, F.lit("}"))
    answer = F.concat(F.lit('{"result":{"addressMatches":['), F.when(F.col("c_custkey") % 3 > 0, match).otherwise(""), F.lit("]}}"))
    found = c.select("c_custkey", geocode.census_url(street, text_of("c_nationkey"), F.lit(None).cast("string"), text_of("c_custkey")).alias("asked"), geocode.census_place(answer).alias("place"))
    none = F.lit(None).cast("string")
    placed = found.withColumn("a", geocode.placed(F.struct(F.array().cast("array<string>").alias("line"), none.alias("city"), none.alias("state"), none.alias("postalCode")), F.col("place")))
    return placed.select("c_custkey", "asked", F.nullif(F.array_join("a.line", ""), F.lit("")).alias("line"), F.col("place.county_fips").alias("county"), F.col("place.lat").alias("lat"), (F.size("a.extension") + F.coalesce(F.size("a._line"), F.lit(0))).alias("extensions"))


@query("""WITH n AS (SELECT c_nationkey AS request_id, min('p' || c_custkey) AS patient_id FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL HAVING count(*) = 1)
SELECT request_id, '/Encounter?subject=' || patient_id || '&reason-reference=' || (SELECT arg_min(s_suppkey, s_suppkey) FROM supplier WHERE s_nationkey = request_id) AS search FROM n WHERE request_id IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT c_custkey + 100, 'Patient?given=A&family=' || c_name || '&identifier=' || c_custkey || '&' FROM customer""")
def patient_searches(spark, sf_dir):
    """Nations are requests that find their customers of one segment; suppliers stand for conditions. Every customer is searched, too."""
    found = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("request_id"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"))
    conditions = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("request_id"), F.col("s_suppkey").alias("pos"), F.col("s_suppkey").cast("string").alias("condition_id"))
    second = searching.encounter_searches(searching.only_patients(found), conditions)
    none = F.lit(None).cast("string")
    asked = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 100).alias("request_id"), searching.patient_search(F.lit("A"), F.col("c_name"), none, F.col("c_custkey").cast("string"), none).alias("search"))
    return second.unionByName(asked)


_LAC = " AND ".join(f"CASE WHEN a.{c} = b.{c} THEN 1 ELSE 1.0::DOUBLE - levenshtein(a.{c}, b.{c})::DOUBLE / greatest(length(a.{c}), length(b.{c})) END >= 0.7" for c in ("p_name", "p_brand"))


@query(f"""WITH m AS (SELECT a.p_partkey AS root, b.p_partkey AS member FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND left(a.p_name, 4) = left(b.p_name, 4) AND left(a.p_type, 4) = left(b.p_type, 4) AND a.p_size = b.p_size WHERE {_LAC}
UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND left(a.p_name, 4) = left(b.p_name, 4) AND left(a.p_type, 4) = left(b.p_type, 4) AND left(a.p_brand, 4) = left(b.p_brand, 4) WHERE {_LAC}
UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_size = b.p_size WHERE {_LAC}) SELECT root, member FROM m""")
def link_deterministic(spark, sf_dir):
    """The three rules on parts: name and type stand for both names, size for the birth date, brand for the address."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    named = {"first_name": "p_name", "last_name": "p_type", "birthdate": "p_size", "address": "p_brand"}
    passes = [replace(p, funcs={"p_name": FUZZY, "p_brand": FUZZY}, blocks=tuple(BlockKey(named[b.value], b.transformation) for b in p.blocks)) for p in deterministic()]
    return link.link(parts, passes, "p_partkey")


@query("SELECT l_orderkey, l_linenumber, ((row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber) - 1) // 500)::BIGINT AS chunk FROM lineitem")
def batch_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return viewer.chunks(lines, "at").select("l_orderkey", "l_linenumber", "chunk")


@query("SELECT s_nationkey AS organization, count(*) AS n, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS reports FROM supplier GROUP BY s_nationkey")
def labs_by_organization(spark, sf_dir):
    found = viewer.by_organization(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("organization"), F.col("s_suppkey").alias("id")))
    return found.select("organization", "n", F.array_join(F.transform("reports", lambda x: x.cast("string")), ",").alias("reports"))


@query("SELECT n_regionkey AS condition, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS rules FROM nation GROUP BY n_regionkey")
def condition_rules(spark, sf_dir):
    found = viewer.reportable_rules(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("condition"), F.col("n_name").alias("rule"), F.col("n_nationkey").alias("jurisdiction")))
    return found.select("condition", F.array_join(F.transform("rules", lambda r: r["rule"]), ",").alias("rules"))


@query("SELECT c_custkey, c_nationkey % 5 AS area FROM customer WHERE c_nationkey % 5 < 4")
def points_in_areas(spark, sf_dir):
    """Customers placed at (nation % 5 + 0.5, 0.5); area k is the unit square from k."""
    points = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5 + 0.5).alias("lng"), F.lit(0.5).alias("lat"))
    corner = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    areas = spark.range(4).select(F.col("id").cast("int").alias("area"), F.array(corner("id", 0), corner("id + 1", 0), corner("id + 1", 1), corner("id", 1)).alias("ring"))
    return patients.points_by_area(points, areas).select("c_custkey", "area")


@query("SELECT a.s_suppkey AS id, max(b.s_suppkey) AS telecom FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey")
def same_organization(spark, sf_dir):
    none = F.lit(None).cast("string")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("telecom"), F.col("s_nationkey").alias("line"), *[none.alias(c) for c in ("city", "state", "postal_code", "country")])
    return viewer.same_organization(s)
