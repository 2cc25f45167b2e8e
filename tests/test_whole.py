"""Registered queries cover whole texts and whole tables: brute force on small tables, and SQL without cuts."""

import random

import pytest

from healthloom import catalog
from healthloom.functions import phonetic
from healthloom.functions import similarity as sim
from healthloom.operators import linkage as link
from healthloom.operators import mpi
from healthloom.plans.linkage import BlockKey, Pass


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    """Compares a query with SQL over whole tables."""
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "part", "customer"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def same(name, sql):
        df = catalog.queries()[name](spark, sf_dir)
        got = sorted(map(tuple, df.collect()))
        assert got == sorted(duck.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall())
        return got

    return same


def jaro_winkler(a, b):
    """By the definition, one character after the other."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach, used, left = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == x:
                used.add(j)
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    half = sum(x != b[j] for x, j in zip(left, sorted(used), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or len(a) <= k), 4)
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def test_jaro_winkler_of_long_strings():
    rng = random.Random(3)
    some = lambda kinds, n: "".join(rng.choice(kinds) for _ in range(n))
    pairs = [(some(kinds, rng.randrange(1, 300)), some(kinds, rng.randrange(0, 300))) for kinds in ("ab", "abcdefgh éß", "x", "abcdefghijklmnopqrstuvwxyz ") for _ in range(60)]
    pairs += [(a, a[: len(a) // 2] + "zz" + a[len(a) // 2 :]) for a, _ in pairs[:60]]
    # Places beyond each other's reach, both ways.
    pairs += [("a" + "b" * 200 + "a" * 100, "a" * 100 + "c" * 150), ("a" * 100 + "b" * 150, "c" * 200 + "a" * 100), ("a" * 80 + "b" * 80, "b" * 80 + "a" * 80)]
    got = sim.jaro_winkler([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([jaro_winkler(a, b) for a, b in pairs], abs=1e-12)


def test_link_fuzzy_jw_compares_whole_names(spark, tmp_path):
    rng = random.Random(4)
    head = "The same long beginning of both names. "
    names = [head + "q" * 300, head + "q" * 299 + "z", head + "z" * 300, "a" * 31, "a" * 33, "", "", None, "short"]
    names += ["".join(rng.choice("ab") for _ in range(rng.randrange(20, 60))) for _ in range(40)]
    rows = [(i, n, i % 2 if i > 9 else 0, "s") for i, n in enumerate(names)] + [(99, head + "q" * 300, 0, "t")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {tuple(r) for r in catalog.link_fuzzy_jw(spark, str(tmp_path)).collect()}
    same = [(x, y) for x in rows for y in rows if x[0] < y[0] and x[2:] == y[2:] and x[1] is not None and y[1] is not None]
    assert got == {(x[0], y[0]) for x, y in same if jaro_winkler(x[1], y[1]) >= 0.96}
    assert {(0, 1), (3, 4), (5, 6)} <= got and (0, 2) not in got


def test_link_deterministic_takes_the_rules_as_they_are(spark, tmp_path):
    """Starts of both names with the birth date (size) or the start of the address (brand), or the birth date alone."""
    rng = random.Random(6)
    rows = [(1, "cold ring", "Brand#11", "SMALL", 7), (2, "gold ring", "Brand#12", "LARGE", 7), (3, "cold rings", "Brand#25", "SMALLER", 8), (4, "cold ring", "Brond#11", "SMALL", 9)]
    rows += [(i, rng.choice(["cold", "gold", "hot"]) + rng.choice([" ring", " rod", " plate"]), rng.choice(["Brand#1", "Brand#12", "Brand#25", "Brond#25", "Other#25"]), rng.choice(["SMALL", "SMALLER", "LARGE"]), rng.randrange(9)) for i in range(10, 90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in catalog.link_deterministic(spark, str(tmp_path)).collect()]
    near = lambda a, b: link._levenshtein(a, b) >= 0.7
    first4 = lambda x, y, *at: all(x[k][:4] == y[k][:4] for k in at)
    pairs = [(x, y) for x in rows for y in rows if x[0] < y[0] and near(x[1], y[1]) and near(x[2], y[2])]
    assert sorted(got) == [(x[0], y[0]) for x, y in pairs if first4(x, y, 1, 3) and (x[4] == y[4] or first4(x, y, 2)) or x[4] == y[4]]
    # By the size alone, by the starts alone, and by no rule.
    assert {(1, 2), (1, 3)} <= set(got) and (1, 4) not in got and (2, 3) not in got


def test_std_name_covers_whole_texts(whole):
    got = whole("std_name", "SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} ]', '', 'g'), '\\p{N}', '', 'g'), ' ')) AS name FROM documents")
    assert max(len(name) for _, name in got if name) > 80


def test_double_metaphone_encodes_whole_names(spark, tmp_path):
    names = ["Van der Berg", "ab", "x y", "spring green yellow purple", None]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = dict(map(tuple, catalog.double_metaphone(spark, str(tmp_path)).collect()))
    assert got == {i: None if n is None else "|".join(phonetic.double_metaphone(n)) for i, n in enumerate(names)}
    assert got[0] != "|".join(phonetic.double_metaphone("Van"))


_BLOCK = "FROM customer a JOIN customer b ON right(a.c_name, 3) = right(b.c_name, 3) AND left(a.c_mktsegment, 4) = left(b.c_mktsegment, 4)"


@pytest.mark.parametrize(
    ("name", "sql"),
    [
        ("mpi_flat_view", "SELECT c_custkey::VARCHAR AS patient_id, 'p' || c_custkey AS person_id, right(c_name, 4) AS first_name, c_name AS last_name, right(c_name, 3) AS mrn, c_mktsegment AS address, c_nationkey::VARCHAR AS city FROM customer"),
        ("blocking_semi_join", "SELECT c_custkey::VARCHAR AS patient_id FROM customer WHERE left(c_name, 4) = 'Cust' AND left(c_mktsegment, 4) = 'BUIL'"),
        (
            "link_incremental",
            f"""WITH r AS (SELECT a.c_custkey::VARCHAR AS patient_id, 'p' || b.c_custkey AS person_id, jaro_winkler_similarity(a.c_name, b.c_name) >= 0.9 AND a.c_nationkey = b.c_nationkey AS hit {_BLOCK}),
            g AS (SELECT patient_id, person_id, count(*) FILTER (hit) / count(*)::DOUBLE AS ratio FROM r GROUP BY ALL), m AS (SELECT patient_id, min(person_id) AS person_id FROM g WHERE ratio >= 0.9 GROUP BY patient_id)
            SELECT c.c_custkey::VARCHAR AS patient_id, m.person_id IS NOT NULL AS matched, coalesce(m.person_id, 'new-' || sha256(c.c_custkey::VARCHAR)) AS person_id FROM customer c LEFT JOIN m ON m.patient_id = c.c_custkey::VARCHAR""",
        ),
    ],
)
def test_the_index_holds_all_customers(whole, name, sql):
    got = whole(name, sql)
    assert name == "blocking_semi_join" or any(int(r[0]) % 2 == 0 for r in got) and any(int(r[0]) % 2 for r in got)


def test_blocking_finds_even_customers(spark, tmp_path):
    rows = [(2, "Customer#000000001", 1, "BUILDING"), (3, "Customer#000000001", 1, "BUILDING"), (4, "Customer#000000001", 1, "MACHINERY")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    assert {r[0] for r in catalog.blocking_semi_join(spark, str(tmp_path)).collect()} == {"2", "3"}


def test_codes_of_all_parts_are_listed(whole):
    sql = """WITH f AS (SELECT p_partkey, unnest(list_distinct([p_brand, regexp_replace(p_brand, '[^\\p{L}\\p{N}]', '', 'g')])) AS code FROM part),
    l AS (SELECT DISTINCT p_type AS condition_id, replace(p_brand, '#', '') AS code FROM part) SELECT DISTINCT p_partkey, condition_id FROM f JOIN l USING (code)"""
    assert whole("stamp_codes", sql)


@pytest.mark.parametrize("f", ["address", "city", "state", "zip"])
@pytest.mark.parametrize("name", ["feature_match_fuzzy_string", "feature_match_exact", "feature_match_log_odds_fuzzy_compare", "feature_match_log_odds_exact"])
def test_all_addresses_are_compared(spark, f, name):
    old = {"address": ["12 Main St"], "city": ["Anywhere"], "state": ["CA"], "zip": ["90909"]}
    others = ["1 Elm", "zzzz", None, "qqqq"]
    rows = [("fifth", *[[*others, *old[a]] for a in old]), ("none", *[others] * 4), ("empty", *[[]] * 4), ("null", *[None] * 4)]
    records = spark.createDataFrame([(n, "John", "Shepard", None, None, "M-1", *a) for n, *a in rows], mpi.RECORD)
    flat = spark.createDataFrame([("old", "p", "1980-01-01", "male", "M-1", "Shepard", "John", *[old[a][0] for a in old])], "patient_id string, person_id string, birthdate string, sex string, mrn string, last_name string, first_name string, address string, city string, state string, zip string")
    rule = {"matching_rule": "eval_log_odds_cutoff", "true_match_threshold": 5.0, "log_odds": {f: 6.0}} if "odds" in name else {"matching_rule": "eval_perfect_match"}
    p = Pass({f: name}, (BlockKey("mrn"),), cluster_ratio=0.9, **rule)
    assert {r["patient_id"] for r in mpi.best_persons(records, flat, [p]).collect()} == {"fifth"}


def test_a_later_address_can_be_the_best(spark):
    records = spark.createDataFrame([("n", "John", "Shepard", None, None, "M-1", ["12 Main Road", "x", "y", "z", "12 Main St"], ["A"], ["CA"], ["1"])], mpi.RECORD)
    flat = spark.createDataFrame([("p", "old", "M-1", "12 Main St")], "person_id string, patient_id string, mrn string, address string")
    p = Pass({"address": "feature_match_log_odds_fuzzy_compare"}, (BlockKey("mrn"),), "eval_log_odds_cutoff", 0.9, true_match_threshold=5.99, log_odds={"address": 6.0})
    assert [mpi.best_persons(records, flat, [p], best_address=b).count() for b in (True, False)] == [1, 0]
