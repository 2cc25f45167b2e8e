import random
import re

import pytest
from pyspark.sql import functions as F

from healthloom.functions import similarity as sim
from healthloom.operators import linkage as link
from healthloom.plans.linkage import BASIC, ENHANCED, BlockKey, Pass, deterministic, pass_from, read_algorithm, write_algorithm

#: Two families whose records were typed by hand, and people without a double.
PEOPLE = [
    (10, "Marguerite", "Okonkwo", "1971-04-02", "60601"),
    (11, "Margerite", "Okonkwo", "1971-04-02", "60601"),
    (12, "Marguerite", "Okonkvo", "1971-04-02", "60601"),
    (13, "Rita", "Okonkwo", "1971-04-02", "60601"),
    (20, "Tomas", "Lindqvist", "1999-12-31", "98101"),
    (21, "Thomas", "Lindqvist", "1999-12-31", "98101"),
    (22, "Tomas", "Lindquist", "1999-12-30", "98101"),
    (30, "Wei", "Zhang", "1985-06-15", "77002"),
    (31, "Ilse", "", "1950-01-09", "33130"),
]
FUNCS = {"first_name": "feature_match_fuzzy_string", "last_name": "feature_match_fuzzy_string", "birthdate": "feature_match_exact", "zip": "feature_match_exact"}
ALL = (BlockKey("everyone"),)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, first_name string, last_name string, birthdate string, zip string").withColumn("everyone", F.lit(1))


def clusters(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    return [found[k] for k in sorted(found)]


def greedy(people, ratio, threshold):
    """Records in the order of their ids; each joins the first cluster that enough of whose members it matches."""
    same = lambda x, y: x[3:] == y[3:] and all(sim.jaro_winkler([a], [b])[0] >= threshold for a, b in zip(x[1:3], y[1:3], strict=True))
    found = []
    for x in people:
        home = next((c for c in found if sum(same(x, y) for y in c) / len(c) >= ratio), None)
        if home is None:
            found.append([x])
        else:
            home.append(x)
    return [{x[0] for x in c} for c in found]


@pytest.mark.parametrize(("ratio", "threshold"), [(1.0, 0.8), (0.6, 0.8), (0.3, 0.5)])
def test_greedy_clusters(people, ratio, threshold):
    got = clusters(link.match_clusters(people, Pass(FUNCS, ALL, "eval_perfect_match", ratio, threshold=threshold), "id"))
    want = greedy(PEOPLE, ratio, threshold)
    assert sorted(map(sorted, got)) == sorted(map(sorted, want)) and max(map(len, want)) > 1


@pytest.mark.parametrize(
    ("funcs", "options", "want"),
    [
        (dict.fromkeys(FUNCS, "feature_match_exact"), {}, set()),
        (FUNCS, {"threshold": 0.9}, {(10, 11), (10, 12), (11, 12), (20, 21)}),
        (FUNCS, {"similarity_measure": "Levenshtein", "threshold": 0.95}, set()),
        (FUNCS, {"similarity_measure": "Levenshtein", "threshold": 0.85}, {(10, 11), (10, 12), (11, 12)}),
    ],
)
def test_pairs(people, funcs, options, want):
    assert {tuple(r) for r in link.match_pairs(people, Pass(funcs, ALL, "eval_perfect_match", **options), "id").collect()} == want


def test_clusters_use_the_cutoff_of_log_odds(people):
    p = Pass({"first_name": "feature_match_log_odds_fuzzy_compare"}, (BlockKey("zip"),), "eval_log_odds_cutoff", 0.0, true_match_threshold=4.0, log_odds={"first_name": 5.0})
    assert clusters(link.match_clusters(people.where("zip = '98101'"), p, "id")) == [{20, 21, 22}]


@pytest.fixture(scope="module")
def typed(spark):
    """Many copies of a few values, nulls and empty texts among them, in two blocks."""
    rng, names = random.Random(11), ["anna", "anan", "ana", "hannah", "", None, "otto"]
    rows = [(i, rng.choice("xyy") if i % 17 else None, rng.choice(names), rng.choice([1, 2, None])) for i in range(120)]
    return rows, spark.createDataFrame(rows, "id int, b string, v string, n int")


def brute(rows, p):
    """The pairs of a block, one record with each other."""
    score = link._scores([], p)
    found = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] is not None and x[1] == y[1]:
                a, b = dict(zip(("b", "v", "n"), x[1:], strict=True)), dict(zip(("b", "v", "n"), y[1:], strict=True))
                told = [link._local_feature(n, f, a[f], b[f], p, score) for f, n in p.funcs.items()]
                if all(told) if p.matching_rule == "eval_perfect_match" else sum(told) >= p.true_match_threshold:
                    found.add((x[0], y[0]))
    return sorted(found)


@pytest.mark.parametrize("measure", ["DamerauLevenshtein", "Levenshtein", "JaroWinkler"])
@pytest.mark.parametrize("funcs", [{"v": "feature_match_fuzzy_string"}, {"v": "feature_match_fuzzy_string", "n": "feature_match_exact"}, {"v": "feature_match_four_char"}])
def test_pairs_of_copies_and_nulls(typed, measure, funcs):
    p = Pass(funcs, (BlockKey("b"),), "eval_perfect_match", similarity_measure=measure, threshold=0.6)
    want = brute(typed[0], p)
    assert sorted(map(tuple, link.match_pairs(typed[1], p, "id").collect())) == want and want


def test_values_of_copies_are_compared_once(spark, monkeypatch):
    """400 records of two names are 79,800 pairs, but three pairs of names."""
    import pandas as pd

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return pd.Series(sim.damerau(a.tolist(), b.tolist()))

    monkeypatch.setitem(sim.MEASURES, "DamerauLevenshtein", counted)
    rows = spark.range(400).select("id", F.lit("x").alias("b"), F.when(F.col("id") % 2 == 0, "anna").otherwise("otto").alias("v"))
    p = Pass({"v": "feature_match_fuzzy_string"}, (BlockKey("b"),), "eval_perfect_match", similarity_measure="DamerauLevenshtein", threshold=0.55)
    assert link.match_pairs(rows, p, "id").count() == 2 * 200 * 199 // 2
    assert 0 < seen.value <= 3


def test_levenshtein_is_taken_of_values_and_not_of_records(typed):
    """Records are grouped below the join that compares them."""
    p = Pass({"v": "feature_match_fuzzy_string"}, (BlockKey("b"),), "eval_perfect_match", similarity_measure="Levenshtein", threshold=0.55)
    plan = link.match_pairs(typed[1], p, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("levenshtein") :]


def test_pairs_of_few_values_are_dealt_to_many_tasks(spark):
    """2,500 records of two near names are small tables and 3,123,750 pairs, which one task made."""
    rows = spark.range(2500).select("id", F.lit("x").alias("b"), F.when(F.col("id") % 2 == 0, "anna").otherwise("anne").alias("v"))
    p = Pass({"v": "feature_match_fuzzy_string"}, (BlockKey("b"),), "eval_perfect_match", similarity_measure="Levenshtein", threshold=0.55)
    tasks = link.match_pairs(rows, p, "id").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("id_j").alias("j"), F.min(F.col("id_j") - F.col("id_i")).alias("apart")).collect()
    assert sum(r.n for r in tasks) == 2500 * 2499 // 2 and sum(r.j for r in tasks) == sum(k * k for k in range(2500)) and min(r.apart for r in tasks) == 1
    assert len(tasks) > 1


@pytest.mark.parametrize("measure", ["Levenshtein", "JaroWinkler"])
def test_pairs_of_groups_longer_than_a_list(typed, monkeypatch, measure):
    monkeypatch.setattr(link, "MEMBERS", 2)
    p = Pass({"v": "feature_match_fuzzy_string"}, (BlockKey("b"),), "eval_perfect_match", similarity_measure=measure, threshold=0.55)
    want = brute(typed[0], p)
    assert sorted(map(tuple, link.match_pairs(typed[1], p, "id").collect())) == want and want


@pytest.mark.parametrize(("cutoff", "implied"), [(7.0, ["v", "n"]), (6.0, ["v"]), (1.5, []), (7.6, ["v", "n"]), (0.0, [])])
def test_log_odds_join_on_what_the_cutoff_implies(typed, cutoff, implied):
    p = Pass({"v": "feature_match_log_odds_exact", "n": "feature_match_log_odds_exact"}, (BlockKey("b"),), "eval_log_odds_cutoff", true_match_threshold=cutoff, log_odds={"v": 6.0, "n": 1.5})
    got = link.match_pairs(typed[1], p, "id")
    # What is implied is a key of the join, nulls agreeing with nulls.
    plan = re.sub(r"#\d+", "", got._jdf.queryExecution().analyzed().toString())
    assert sum(bool(re.search(f"[ia]__e{k} <=> [jb]__e{k}", plan)) for k in range(2)) == len(implied)
    assert link._implied(p) == implied
    assert sorted(map(tuple, got.collect())) == brute(typed[0], p)


def test_pairs_of_join_keys_are_made_by_many_tasks(spark, tmp_path):
    """A table that is read by one task and small enough to broadcast: that task made all its pairs."""
    spark.range(0, 200_000, 1, 1).select("id", F.lpad((F.col("id") % 50_000).cast("string"), 40, "0").alias("b"), (F.col("id") % 50_000).alias("v")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    p = Pass({"v": "feature_match_log_odds_exact"}, (BlockKey("b"),), "eval_log_odds_cutoff", true_match_threshold=5.0, log_odds={"v": 6.0})
    tasks = link.match_pairs(rows, p, "id").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min(F.col("id_j") - F.col("id_i")).alias("apart"), F.max((F.col("id_j") - F.col("id_i")) % 50_000).alias("off")).collect()
    assert sum(r.n for r in tasks) == 50_000 * 6 and {(r.apart, r.off) for r in tasks} == {(50_000, 0)}
    assert len(tasks) > 1 and max(r.n for r in tasks) < 200_000


def test_log_odds_of_fuzzy_and_exact_fields(typed):
    p = Pass({"v": "feature_match_log_odds_fuzzy_compare", "n": "feature_match_log_odds_exact"}, (BlockKey("b"),), "eval_log_odds_cutoff", true_match_threshold=5.0, log_odds={"v": 4.0, "n": 1.5})
    want = brute(typed[0], p)
    assert sorted(map(tuple, link.match_pairs(typed[1], p, "id").collect())) == want and want


@pytest.mark.parametrize("repeated", [False, True])
def test_passes_of_one_judgement_give_each_pair_once(spark, repeated):
    rng = random.Random(8)
    rows = [(i // 2 if repeated else i, rng.choice(["anna", "anan", "ottilie", "otto", None]), rng.choice(["a1", "a2", None]), rng.choice([1, 2, 3, None])) for i in range(90)]
    data = spark.createDataFrame(rows, "id int, v string, b string, n int")
    p = lambda *blocks: Pass({"v": "feature_match_fuzzy_string", "b": "feature_match_fuzzy_string"}, blocks, "eval_perfect_match", similarity_measure="Levenshtein", threshold=0.5)
    passes = [p(BlockKey("v", "first4"), BlockKey("n")), p(BlockKey("b"), BlockKey("n")), p(BlockKey("v", "last4"))]
    want = {tuple(r) for q in passes for r in link.match_pairs(data, q, "id").collect()}
    got = link.link(data, passes, "id")
    assert sorted(map(tuple, got.collect())) == sorted(want) and all(link.match_pairs(data, q, "id").count() for q in passes)
    # Pairs are made distinct only where ids are repeated.
    assert got._jdf.queryExecution().analyzed().toString().startswith("Deduplicate") == repeated


def test_an_earlier_block_that_holds_the_block_leaves_nothing(spark):
    rows = [(1, "anna", "a", 1), (2, "anna", "a", 1), (3, "anna", "b", 1), (4, "anna", None, 1), (5, "anna", "a", None), (6, "anna", "a", None)]
    data = spark.createDataFrame(rows, "id int, v string, b string, n int")
    p = lambda *blocks: Pass({"v": "feature_match_fuzzy_string"}, blocks, "eval_perfect_match", similarity_measure="Levenshtein")
    pairs = lambda q, *earlier: sorted(map(tuple, link.match_pairs(data, q, "id", earlier).collect()))
    n, b, both = p(BlockKey("n")), p(BlockKey("b")), p(BlockKey("n"), BlockKey("b"))
    assert pairs(both) == [(1, 2)] and pairs(both, n) == [] and pairs(both, b) == []
    assert pairs(n, both) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)] and pairs(b, both) == [(1, 5), (1, 6), (2, 5), (2, 6), (5, 6)]


def test_null_keys_are_in_no_block(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "x", None), (4, "x", None)], "id int, b string, v string")
    p = Pass({"v": "feature_match_exact"}, (BlockKey("b"),), "eval_perfect_match")
    assert [tuple(r) for r in link.match_pairs(rows, p, "id").collect()] == [(3, 4)]


def test_compile_score_and_expansion(spark):
    pairs = spark.createDataFrame([(5, 1), (1, 5), (1, 11)], "id_i int, id_j int")
    groups = spark.createDataFrame([("b", 0, 23), ("b", 0, 24), ("b", 0, 31), ("b", 1, 9)], "block string, cluster int, id int")
    assert {tuple(r) for r in link.compiled([pairs, groups]).collect()} == {(1, 5), (1, 11), (23, 24), (23, 31)}
    found = spark.createDataFrame([(1, 2), (1, 3)], "root int, member int")
    truth = spark.createDataFrame([(1, 2), (2, 3)], "root int, member int")
    assert tuple(link.score(found, truth, 4).first()) == (0.5, 0.75, 0.5, 0.5)
    assert tuple(link.score(found, truth, 4, clusters=True).first()) == (1.0, 0.75, 0.667, 0.8)


def test_scores_of_a_known_run(spark):
    """12 records make 66 pairs: 16 found, 12 of them true, none missed. The scores of such a run."""
    truth = [(a, b) for a in range(5) for b in range(a + 1, 5)] + [(5, 6), (7, 8)]
    wrong = [(0, 11), (4, 11), (5, 11), (9, 10)]
    frame = lambda rows: spark.createDataFrame(rows, "root int, member int")
    assert tuple(link.score(frame(truth + wrong), frame(truth), 12).first()) == (1.0, 0.926, 0.75, 0.857)


def test_deterministic_rules_and_derived_columns(spark):
    rows = [(1, "Amalia", "Brandt", "1960-05-04", "9 Elm Row", "a@x", "00123"), (2, "Amalie", "Brandt", "1960-05-04", "9 Elm Row", "a@x", "00123"), (3, "Amalia", "Brandt", "1961-05-04", "9 Elm Rd", "a@x", "00123"), (4, "Zoe", "Quist", "1960-05-04", "1 Oak", "z@x", "987"), (5, None, None, "unknown", None, None, None)]
    people = spark.createDataFrame(rows, "id int, first_name string, last_name string, birthdate string, address string, email string, mrn string")
    assert {tuple(r) for r in link.link(people, deterministic(), "id").collect()} == {(1, 2), (1, 3), (2, 3)}
    got = {r["id"]: r for r in link.derived(people).collect()}
    assert [(got[i]["mrn4"], got[i]["birth_month"], got[i]["birth_year"]) for i in (1, 4, 5)] == [("0123", "05", "1960"), ("987", "05", "1960"), (None, "unknown", "unknown")]
    assert got[1]["dm_first"] == got[2]["dm_first"] and got[5]["dm_last"] is None


def test_numbers_are_dense(spark):
    got = link.numbered(spark.range(5000).select(F.concat(F.lit("r"), "id").alias("i")), parts=7).collect()
    assert sorted(r["k"] for r in got) == list(range(5000)) and len({r["i"] for r in got}) == 5000


def test_score_without_pairs_is_null(spark):
    none = spark.createDataFrame([], "root int, member int")
    assert tuple(link.score(none, none, 3).first()) == (None, 1.0, None, None)


def test_u_probabilities_count_without_pairs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a")], "id int, v string")
    truth = spark.createDataFrame([(1, 2), (3, 4)], "root int, member int")
    # 10 pairs, 2 of them true; (1,5) and (2,5) agree.
    assert link.u_probabilities(truth, rows, ["v"], "id").first()["probability"] == pytest.approx(3 / 9)
    assert link.m_probabilities(truth, rows, ["v"], "id").first()["probability"] == pytest.approx(2 / 3)
    assert 0 < link.u_probabilities(truth, rows, ["v"], "id", n_samples=50).first()["probability"] <= 1


def test_probabilities_by_key_are_those_of_the_true_pairs(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, rng.choice(["k", "l", "m", None]), rng.choice(["a", "b", None]), rng.choice([1, 2])) for i in range(60)], "id int, key string, v string, w int")
    truth = link.true_pairs(rows, "key", "id")
    m = {r["column"]: r["probability"] for r in link.m_probabilities(truth, rows, ["v", "w"], "id").collect()}
    u = {r["column"]: r["probability"] for r in link.u_probabilities(truth, rows, ["v", "w"], "id").collect()}
    assert {r["column"]: (r["m"], r["u"]) for r in link.probabilities_by_key(rows, "key", ["v", "w"]).collect()} == {c: (m[c], u[c]) for c in ("v", "w")}
    none = link.probabilities_by_key(rows.where("id < 0"), "key", ["v"]).collect()
    assert [tuple(r) for r in none] == [("v", 1.0, 1.0)]


def test_u_probabilities_of_a_shared_key_make_no_pairs(spark):
    """100,000 records of one key are 5 billion true pairs."""
    from healthloom import catalog

    rows = spark.range(100_000).select(F.lit("k").alias("key"), (F.col("id") % 2).alias("v"))
    n, half = 100_000, 50_000
    m = (1 + half * (half - 1)) / (1 + n * (n - 1) // 2)
    assert tuple(link.probabilities_by_key(rows, "key", ["v"]).first()) == ("v", m, 1.0)
    plan = catalog.queries()["link_u_probs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Only the one-row counts are joined.
    assert "Join Cross" in plan and "Join Inner" not in plan


def test_log_odds_of_a_shared_key_make_no_pairs(spark):
    from healthloom import catalog

    plan = catalog.queries()["link_log_odds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The joins besides that of m and u by column are of one-row counts; rows meet nowhere.
    assert plan.count("Join Inner") == 1 and "Join Cross" in plan


def test_similarity_against_duckdb():
    import duckdb

    rng, c = random.Random(3), duckdb.connect()
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(600)]
    mine = sim.jaro_winkler([a for a, _ in pairs], [b for _, b in pairs])
    plain = sim.damerau([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), jw, dl in zip(pairs, mine, plain, strict=True):
        want_jw, want_dl = c.execute("SELECT jaro_winkler_similarity(?, ?), damerau_levenshtein(?, ?)", [a, b, a, b]).fetchall()[0]
        if a and b:
            # Byte-wise there, character-wise here: only plain letters compare.
            if a.isascii() and b.isascii():
                assert jw == pytest.approx(want_jw, abs=1e-9), (a, b)
                assert dl == pytest.approx(1 - want_dl / max(len(a), len(b)), abs=1e-9), (a, b)
    assert sim.jaro_winkler([""], [""])[0] == 1.0


def test_config_round_trip(tmp_path):
    for passes in (BASIC, ENHANCED):
        write_algorithm(passes, str(tmp_path / "a.json"))
        assert read_algorithm(str(tmp_path / "a.json")) == passes
    with pytest.raises(KeyError):
        pass_from({"funcs": {"a": "feature_match_log_odds_exact"}, "blocks": ["a"], "matching_rule": "eval_log_odds_cutoff"})
    with pytest.raises(ValueError):
        pass_from({"funcs": {"a": "nothing"}, "blocks": ["a"], "matching_rule": "eval_perfect_match"})


def test_profile(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, v string")
    pairs = spark.createDataFrame([(1, 2, True), (1, 3, False)], "root int, member int, is_match boolean")
    p = Pass({"v": "feature_match_log_odds_exact"}, (BlockKey("v"),), "eval_log_odds_cutoff", true_match_threshold=1.0, log_odds={"v": 10.0})
    assert {tuple(r) for r in link.profile_log_odds(pairs, rows, p, "id").collect()} == {(31, 1, 0), (1, 0, 1)}
