"""Batch record linkage: blocking, features, pair and cluster passes, compilation and statistics.

A pair pass is one equi-join on the block keys with the pair order as its second condition; native features are part of the
join's filter, and pairs reach a similarity UDF only after they pass those. Record ids are an explicit column.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import add, and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..plans.linkage import BlockKey, Pass


def block_value(column: Column, transformation: str | None) -> Column:
    if transformation == "first4":
        return F.left(column, F.lit(4))
    if transformation == "last4":
        return F.right(column, F.lit(4))
    return column


def derived(data: DataFrame) -> DataFrame:
    """data (first_name, last_name, birthdate as year-month-day, mrn) with what evaluations block on: mrn4, birth_month, birth_year,
    dm_first and dm_last (the primary code of the whole name). A date without a hyphen is its own month and year; null stays null."""
    from ..functions.phonetic import double_metaphone_codes

    part = lambda n: F.when(F.contains("birthdate", F.lit("-")), F.split_part("birthdate", F.lit("-"), F.lit(n))).otherwise(F.col("birthdate"))
    code = lambda c: F.get(double_metaphone_codes(c), F.lit(0))
    return data.withColumns({"mrn4": F.right("mrn", F.lit(4)), "birth_month": part(2), "birth_year": part(1), "dm_first": code("first_name"), "dm_last": code("last_name")})


def with_blocks(data: DataFrame, blocks: tuple[BlockKey, ...]) -> DataFrame:
    """data with __b0, __b1, ...; rows with a null key belong to no block."""
    out = data
    for i, b in enumerate(blocks):
        out = out.withColumn(f"__b{i}", block_value(F.col(b.value), b.transformation))
    return reduce(lambda d, i: d.where(F.col(f"__b{i}").isNotNull()), range(len(blocks)), out)


def block_sizes(data: DataFrame, blocks: tuple[BlockKey, ...], above: int = 0) -> DataFrame:
    """Blocks with more records than ``above``, largest first: a report of skew, nothing is left out of a pass."""
    keys = [f"__b{i}" for i in range(len(blocks))]
    return with_blocks(data, blocks).groupBy(*keys).agg(F.count("*").alias("records")).where(F.col("records") > above).orderBy(F.desc("records"), *keys)


def _as_date_text(c: Column, kind: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd") if kind in ("date", "timestamp", "timestamp_ntz") else c.cast("string")


def is_native(name: str, p: Pass) -> bool:
    return name in ("feature_match_exact", "feature_match_four_char", "feature_match_log_odds_exact") or p.similarity_measure == "Levenshtein"


def feature(name: str, field: str, a: Column, b: Column, p: Pass, score: Column | None = None) -> Column:
    """A feature of two values: boolean, or a weight for log-odds features. score: their similarity, if it is known."""
    weight = F.lit(float(p.log_odds.get(field, 0.0)))
    if name == "feature_match_exact":
        return a.eqNullSafe(b)
    if name == "feature_match_four_char":
        return F.left(a, F.lit(4)).eqNullSafe(F.left(b, F.lit(4)))
    if name == "feature_match_log_odds_exact":
        return F.when(a.eqNullSafe(b), weight).otherwise(F.lit(0.0))
    score = F.coalesce(sim.compare_strings(a, b, p.similarity_measure) if score is None else score, F.lit(0.0))
    if name == "feature_match_fuzzy_string":
        return F.when((a == "") & (b == ""), True).when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(score >= p.threshold)
    return F.when(score >= p.threshold, score * weight).otherwise(F.lit(0.0))


def rule(p: Pass, features: list[Column]) -> Column:
    if p.matching_rule == "eval_perfect_match":
        return reduce(and_, features, F.lit(True))
    return reduce(add, features, F.lit(0.0)) >= F.lit(float(p.true_match_threshold))


def _implied(p: Pass) -> list[str]:
    """Exact and four-character fields that must agree in every pair that the rule takes. For log-odds these are the exact ones
    without which all the others together stay below the cut-off; the sum is taken in the rule's order, so it bounds every score."""
    if p.matching_rule == "eval_perfect_match":
        return [f for f, n in p.funcs.items() if n in ("feature_match_exact", "feature_match_four_char")]
    if any("log_odds" not in n for n in p.funcs.values()):
        return []
    most = lambda without: reduce(add, [0.0 if f == without else max(0.0, float(p.log_odds.get(f, 0.0))) for f in p.funcs], 0.0)
    return [f for f, n in p.funcs.items() if n == "feature_match_log_odds_exact" and most(f) < float(p.true_match_threshold)]


def match_pairs(data: DataFrame, p: Pass, record_id: str, earlier: tuple[Pass, ...] = ()) -> DataFrame:
    """id_i < id_j of the pairs of a block that the rule takes. Skewed blocks are split by adaptive execution.

    What the rule implies to be equal is a join key beside the block's. The other values are compared once for each two
    combinations of a block that differ, or that several records have, and only what is taken is joined with their members' ids.
    These are lists of at most MEMBERS ids, dealt to all cores list by list: the tables are small where the pairs are many, so
    their size tells adaptive execution nothing. earlier: passes of the same features whose blocks' pairs are left out.
    """
    kinds = dict(data.dtypes)
    implied = _implied(p)
    fields = list(p.funcs)
    rest = [f for f in fields if f not in implied]
    # What is a key of this block, too, is alike in all its pairs.
    told = [[b for b in q.blocks if b not in p.blocks] for q in earlier]
    before = dict.fromkeys(b for q in told for b in q)
    keyed = with_blocks(data.select(F.col(record_id).alias("__id"), *{*fields, *(b.value for b in (*p.blocks, *before))}), p.blocks)
    value = lambda f: _as_date_text(F.col(f), kinds[f])
    keys, equal = [f"__b{i}" for i in range(len(p.blocks))], [f"__e{i}" for i in range(len(implied))]
    records = keyed.select(
        "__id", *keys, *[(F.left(value(f), F.lit(4)) if p.funcs[f] == "feature_match_four_char" else value(f)).alias(e) for e, f in zip(equal, implied, strict=True)],
        *[value(f).alias(f"__v{i}") for i, f in enumerate(rest)], *[block_value(F.col(b.value), b.transformation).alias(f"__o{i}") for i, b in enumerate(before)],
    )
    values, others = [f"__v{i}" for i in range(len(rest))], [f"__o{i}" for i in range(len(before))]
    side = lambda d, s, *cs: d.select(*[F.col(c).alias(f"{s}{c}") for c in cs])
    same = lambda a, b, cs: [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in cs]
    on = lambda a, b: [*[F.col(f"{a}{c}") == F.col(f"{b}{c}") for c in keys], *same(a, b, equal)]
    at = {b: f"__o{i}" for i, b in enumerate(before)}
    # A null key is in no block, so plain equality tells what an earlier pass compared.
    new = reduce(and_, [~F.coalesce(reduce(and_, [F.col(f"i{at[b]}") == F.col(f"j{at[b]}") for b in q], F.lit(True)), F.lit(False)) for q in told], F.lit(True))
    records = records.where(F.col("__id").isNotNull())
    if not rest:
        left, right = side(records, "i", "__id", *keys, *equal, *others), side(records, "j", "__id", *keys, *equal, *others)
        weights = [F.lit(float(p.log_odds.get(f, 0.0))) for f in fields] if p.matching_rule != "eval_perfect_match" else []
        # Where the table is broadcast, only the few tasks that read it would make the pairs, however many they are.
        return left.hint("merge").join(right, [*on("i", "j"), F.col("i__id") < F.col("j__id"), new]).where(rule(p, weights)).select(F.col("i__id").alias("id_i"), F.col("j__id").alias("id_j"))
    member = F.struct("__id", *others) if others else F.col("__id")
    whole = records.groupBy(*keys, *equal, *values).agg(F.sort_array(F.collect_list(member)).alias("__ids")).withColumn("__n", F.size("__ids"))
    lists = whole.withColumn("__c", F.explode(_lists(F.lit(0), "__n"))).withColumn("__ids", F.slice("__ids", F.col("__c") * MEMBERS + 1, F.lit(MEMBERS)))
    left, right = side(lists, "i", *keys, *equal, *values, "__c", "__ids"), side(lists, "j", *keys, *equal, *values, "__c", "__ids")
    # Jaro-Winkler may depend on the order of its strings, and the lower id's comes first.
    ordered = p.similarity_measure not in ("Levenshtein", "DamerauLevenshtein") and any("fuzzy" in p.funcs[f] for f in rest)
    groups = records.groupBy(*keys, *equal, *values).agg(F.min("__id").alias("__lo"), F.max("__id").alias("__hi"), F.count("__id").cast("int").alias("__n"))
    one, two = side(groups, "a", *keys, *equal, *values, "__lo", "__hi", "__n"), side(groups, "b", *keys, *equal, *values, "__lo", "__hi", "__n")
    all_of = lambda s: F.struct(*[F.col(f"{s}{c}") for c in values])
    both = one.join(two, [*on("a", "b"), F.lit(True) if ordered else all_of("a") <= all_of("b"), (F.col("a__lo") < F.col("b__hi")) | (F.lit(not ordered) & (F.col("b__lo") < F.col("a__hi")))])
    compared = lambda f: feature(p.funcs[f], f, F.col(f"a__v{rest.index(f)}"), F.col(f"b__v{rest.index(f)}"), p)
    if p.matching_rule == "eval_perfect_match":
        # Native features first: pairs that fail them, or whose lengths and prefixes rule out the threshold, never reach Python.
        for f, v in zip(rest, values, strict=True):
            if p.funcs[f] == "feature_match_fuzzy_string" and p.similarity_measure == "JaroWinkler":
                both = both.where(F.coalesce(sim.jaro_winkler_bound(F.col(f"a{v}"), F.col(f"b{v}")) >= p.threshold - 1e-9, F.lit(True)))
        for f in sorted(rest, key=lambda f: not is_native(p.funcs[f], p)):
            both = both.where(compared(f))
    else:
        both = both.where(rule(p, [compared(f) if f in rest else F.lit(float(p.log_odds.get(f, 0.0))) for f in fields]))
    alike = reduce(and_, same("a", "b", values))
    found = both.select(*[f"a{c}" for c in (*keys, *equal, *values)], *[F.col(f"b{v}") for v in values], "b__n", alike.alias("__alike"), F.explode(_lists(F.lit(0), "a__n")).alias("a__c"))
    found = found.withColumn("b__c", F.explode(_lists(F.when(F.col("__alike"), F.col("a__c")).otherwise(0), "b__n")))
    first = found.join(left, [*on("a", "i"), *same("a", "i", values), F.col("a__c") == F.col("i__c")])
    pairs = _dealt(first, [f"a{k}" for k in keys], [*[f"a{e}" for e in equal], *[f"b{v}" for v in values]], "b__c").join(right, [*on("a", "j"), *same("b", "j", values), F.col("b__c") == F.col("j__c")])
    return _members(pairs, F.col("__alike") & (F.col("a__c") == F.col("b__c")), ordered, bool(others), new)


#: Ids in a list of a group's members at most, so that two lists make a million pairs.
MEMBERS = 1024


def _lists(first: Column, n: str) -> Column:
    """Numbers of the lists of n members, n at least 1, from the first given on."""
    return F.sequence(first, F.expr(f"cast(({n} - 1) div {MEMBERS} as int)"))


def _dealt(rows: DataFrame, keys: list[str], nullable: list[str], number: str) -> DataFrame:
    """rows dealt by the keys of the join that follows, which compares the nullable texts as Spark does for <=>."""
    session = rows.sparkSession
    n = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys, *[x for c in nullable for x in (F.coalesce(c, F.lit("")), F.isnull(c))], number)


def _members(lists: DataFrame, same_list: Column, ordered: bool, structs: bool, new: Column) -> DataFrame:
    """id_i < id_j of the members i__ids and j__ids; of a list with itself each two once. ordered: the one of j is the larger."""
    one = lists.select(F.posexplode("i__ids").alias("__at", "i"), "j__ids", same_list.alias("__same"))
    later = F.slice("j__ids", F.col("__at") + 2, F.lit(MEMBERS))
    two = one.select("i", F.explode(F.when(F.col("__same"), later).otherwise(F.col("j__ids"))).alias("j"))
    if structs:
        two = two.select(*[F.col(f"{s}.{f.name}").alias(f"{s}{f.name}") for s in "ij" for f in two.schema[s].dataType.fields])
    else:
        two = two.select(F.col("i").alias("i__id"), F.col("j").alias("j__id"))
    i, j = F.col("i__id"), F.col("j__id")
    if ordered:
        return two.where((i < j) & new).select(i.alias("id_i"), j.alias("id_j"))
    return two.where((i != j) & new).select(F.least(i, j).alias("id_i"), F.greatest(i, j).alias("id_j"))


def _local_feature(name: str, field: str, a, b, p: Pass, known) -> float:
    weight = p.log_odds.get(field, 0.0)
    null = a is None and b is None
    if name == "feature_match_exact":
        return a == b
    if name == "feature_match_four_char":
        return (a or "")[:4] == (b or "")[:4] if (a is None) == (b is None) else False
    if name == "feature_match_log_odds_exact":
        return weight if a == b else 0.0
    if name == "feature_match_fuzzy_string" and (null or (a == "" and b == "")):
        return True
    score = known(a, b) if a is not None and b is not None else 0.0
    if name == "feature_match_fuzzy_string":
        return score >= p.threshold
    return score * weight if score >= p.threshold else 0.0


def _scores(records: list[dict], p: Pass):
    """Similarity of two values of a block. With few distinct values all pairs of them are scored in one vector call."""
    of = {"JaroWinkler": sim.jaro_winkler, "DamerauLevenshtein": sim.damerau}.get(p.similarity_measure)
    found: dict[tuple[str, str], float] = {}
    fuzzy = [f for f, n in p.funcs.items() if "fuzzy" in n]
    values = sorted({r[f] for r in records for f in fuzzy if r[f] is not None})
    if of and 1 < len(values) <= MOST_SCORED:
        left, right = [a for a in values for _ in values], [b for _ in values for b in values]
        found = dict(zip(zip(left, right, strict=True), of(left, right).tolist(), strict=True))

    def known(a: str, b: str) -> float:
        if (a, b) not in found:
            found[a, b] = float(of([a], [b])[0]) if of else _levenshtein(a, b)
        return found[a, b]

    return known


#: Distinct values of a block that are all scored against each other at once.
MOST_SCORED = 100


def _levenshtein(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1.0 - row[-1] / max(len(a), len(b))


def greedy_clusters(records: list[dict], p: Pass) -> list[list[int]]:
    """Places of records by cluster: each joins the first cluster of which it matches the ratio or more, else starts its own."""
    ratio, clusters, seen, known = p.cluster_ratio or 0.0, [], {}, _scores(records, p)

    def matches(i: int, j: int) -> bool:
        key = tuple((records[i][f], records[j][f]) for f in p.funcs)
        if key not in seen:
            values = [_local_feature(n, f, records[i][f], records[j][f], p, known) for f, n in p.funcs.items()]
            seen[key] = all(values) if p.matching_rule == "eval_perfect_match" else sum(values) >= p.true_match_threshold
        return seen[key]

    for i in range(len(records)):
        for c in clusters:
            if sum(matches(i, j) for j in c) / len(c) >= ratio:
                c.append(i)
                break
        else:
            clusters.append([i])
    return clusters


def match_clusters(data: DataFrame, p: Pass, record_id: str, order_by: str | None = None) -> DataFrame:
    """block, cluster, id: the clusters of each block, records taken in the order of ``order_by`` (by default the id).

    The order matters, so a block is one group in memory; block_sizes tells which blocks are large.
    """
    kinds, fields, order = dict(data.dtypes), list(p.funcs), order_by or record_id
    keyed = with_blocks(data, p.blocks)
    block = F.to_json(F.array(*[F.col(f"__b{i}").cast("string") for i in range(len(p.blocks))]))
    rows = keyed.select(block.alias("block"), F.col(order).alias("__order"), F.col(record_id).cast("string").alias("id"), *[_as_date_text(F.col(f), kinds[f]).alias(f"f_{f}") for f in fields])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__order", "id"], kind="stable")
        records = [{f: (None if pd.isna(v) else v) for f, v in zip(fields, row, strict=True)} for row in group[[f"f_{f}" for f in fields]].itertuples(index=False)]
        ids = group["id"].tolist()
        found = [(group["block"].iloc[0], k, ids[i]) for k, c in enumerate(greedy_clusters(records, p)) for i in c]
        return pd.DataFrame(found, columns=["block", "cluster", "id"])

    made = rows.groupBy("block").applyInPandas(run, "block string, cluster int, id string")
    return made.withColumn("id", F.col("id").cast(kinds[record_id]))


def linkage_pass(data: DataFrame, p: Pass, record_id: str, order_by: str | None = None) -> DataFrame:
    """Pairs without a cluster ratio, clusters with one (0 included)."""
    return match_pairs(data, p, record_id) if p.cluster_ratio is None else match_clusters(data, p, record_id, order_by)


def compiled(found: list[DataFrame]) -> DataFrame:
    """root < member of all passes together, distinct. A cluster's root is its smallest id."""
    parts = []
    for f in found:
        if "cluster" in f.columns:
            roots = f.groupBy("block", "cluster").agg(F.min("id").alias("root"))
            parts.append(f.join(roots, ["block", "cluster"]).where("id <> root").select("root", F.col("id").alias("member")))
        else:
            parts.append(f.select(F.least("id_i", "id_j").alias("root"), F.greatest("id_i", "id_j").alias("member")))
    return reduce(DataFrame.unionByName, parts).distinct()


def expanded(matches: DataFrame) -> DataFrame:
    """matches with the pairs among members of one root as well."""
    a, b = matches.alias("a"), matches.alias("b")
    among = a.join(b, F.expr("a.root = b.root AND a.member < b.member")).select(F.col("a.member").alias("root"), F.col("b.member").alias("member"))
    return matches.unionByName(among).distinct()


def true_pairs(data: DataFrame, key: str, record_id: str) -> DataFrame:
    """root < member of records that share a known identity."""
    k = data.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(record_id).alias("i"))
    return k.alias("a").join(k.alias("b"), F.expr("a.k = b.k AND a.i < b.i")).select(F.col("a.i").alias("root"), F.col("b.i").alias("member"))


def missed(found: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.join(found, ["root", "member"], "left_anti")


def affected(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("root", "member")).alias("id")).distinct()


def score(found: DataFrame, truth: DataFrame, records: int, clusters: bool = False) -> DataFrame:
    """sensitivity, specificity, ppv, f1, rounded to 3, from distinct pairs; null where a denominator is 0."""
    found = expanded(found) if clusters else found.distinct()
    both = found.withColumn("f", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), ["root", "member"], "full")
    total = records * (records - 1) // 2
    counts = both.agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))
    counts = counts.withColumn("tn", F.lit(total) - F.col("tp") - F.col("fp") - F.col("fn"))
    ratio = lambda a, b: F.bround(F.try_divide(a.cast("double"), b), 3)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(tp, tp + fp).alias("ppv"), ratio(2 * tp, 2 * tp + fn + fp).alias("f1"))


def agreement(pairs: DataFrame, data: DataFrame, columns: list[str], record_id: str) -> DataFrame:
    """column, probability: (1 + agreeing pairs) / (1 + pairs), for root, member pairs. Null agrees with nothing."""
    side = lambda s, on: data.select(F.col(record_id).alias(on), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    joined = pairs.join(side("a", "root"), "root").join(side("b", "member"), "member")
    summed = joined.agg(*[((1 + F.count_if(F.col(f"a_{c}") == F.col(f"b_{c}"))) / (1 + F.count("*"))).alias(c) for c in columns])
    return summed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("probability")) for c in columns])).alias("x")).select("x.*")


def m_probabilities(truth: DataFrame, data: DataFrame, columns: list[str], record_id: str) -> DataFrame:
    return agreement(truth, data, columns, record_id)


def u_probabilities(truth: DataFrame, data: DataFrame, columns: list[str], record_id: str, n_samples: int | None = None, seed: int = 0) -> DataFrame:
    """Agreement of pairs that aren't true ones.

    Without a sample no pair is made: agreeing pairs of a column are n(n-1)/2 over its value counts, less those of true pairs.
    With one, n_samples pairs are drawn by position; draws that are true pairs or repeats are left out.
    """
    if n_samples is None:
        n = data.count()
        everything, true = n * (n - 1) // 2, truth.distinct()
        true_n = true.count()
        t = {r["column"]: r["probability"] for r in agreement(true, data, columns, record_id).collect()}
        rows = []
        for c in columns:
            agree = data.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
            agree -= round(t[c] * (1 + true_n)) - 1
            rows.append(Row(column=c, probability=(1 + agree) / (1 + everything - true_n)))
        return data.sparkSession.createDataFrame(rows, "column string, probability double")
    ordered = numbered(data.select(F.col(record_id).alias("i")))
    n = data.count()
    draws = data.sparkSession.range(2 * n_samples).select(F.floor(F.rand(seed) * n).alias("x"), F.floor(F.rand(seed + 1) * n).alias("y")).where("x < y").distinct()
    drawn = draws.join(ordered.select(F.col("k").alias("x"), F.col("i").alias("root")), "x").join(ordered.select(F.col("k").alias("y"), F.col("i").alias("member")), "y")
    return agreement(drawn.select("root", "member").join(truth, ["root", "member"], "left_anti").limit(n_samples), data, columns, record_id)


def probabilities_by_key(data: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, m, u: m_probabilities and unsampled u_probabilities of true_pairs(data, key, ...), where each row is a record of its
    own. All are counts of rows by value, so neither the true pairs nor the others are made, however many rows share a key."""
    rows = data.select(F.col(key).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])

    def pairs(name: str, *by: str) -> DataFrame:
        known = reduce(lambda d, c: d.where(F.col(c).isNotNull()), by, rows)
        sizes = known.groupBy(*by).agg(F.count("*").alias("n"))
        return sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(name))

    # Without grouping columns all rows are one group.
    counts = [pairs("every"), pairs("true", "k"), *[pairs(f"a{i}", f"c{i}") for i in range(len(columns))], *[pairs(f"t{i}", "k", f"c{i}") for i in range(len(columns))]]
    n = reduce(lambda a, b: a.crossJoin(b), counts)
    m = lambda i: (1 + F.col(f"t{i}")) / (1 + F.col("true"))
    u = lambda i: (1 + F.col(f"a{i}") - F.col(f"t{i}")) / (1 + F.col("every") - F.col("true"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), m(i).alias("m"), u(i).alias("u")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def log_odds(m: DataFrame, u: DataFrame) -> DataFrame:
    """column, log_odds = ln m - ln u; both need the same columns."""
    a, b = ({r["column"] for r in x.select("column").collect()} for x in (m, u))
    if a != b:
        raise ValueError("m and u probabilities are of different columns")
    return m.withColumnRenamed("probability", "m").join(u.withColumnRenamed("probability", "u"), "column").select("column", (F.log("m") - F.log("u")).alias("log_odds"))


def profile_log_odds(pairs: DataFrame, data: DataFrame, p: Pass, record_id: str, bins: int = 75, low: float = 0.0, high: float = 25.0) -> DataFrame:
    """bin, matches, others: how the summed log-odds of labelled pairs (root, member, is_match) spread."""
    fields = list(p.funcs)
    side = lambda s, on: data.select(F.col(record_id).alias(on), *[F.col(f).cast("string").alias(f"{s}_{f}") for f in fields])
    joined = pairs.join(side("a", "root"), "root").join(side("b", "member"), "member")
    total = reduce(add, [feature(p.funcs[f], f, F.col(f"a_{f}"), F.col(f"b_{f}"), p) for f in fields], F.lit(0.0))
    return joined.select("is_match", F.width_bucket(total, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count_if("is_match").alias("matches"), F.count_if(~F.col("is_match")).alias("others"))


def link(data: DataFrame, passes: list[Pass], record_id: str) -> DataFrame:
    """root, member of all passes of an algorithm.

    Where all passes compare pairs by the same features and no id is repeated, each leaves out the pairs of the blocks of those before,
    which they have judged alike, so that the pairs of all need not be made distinct.
    """
    judged = [replace(p, blocks=()) for p in passes]
    if len(passes) > 1 and judged[0].cluster_ratio is None and all(j == judged[0] for j in judged) and data.groupBy(F.col(record_id).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        found = [match_pairs(data, p, record_id, tuple(passes[:k])) for k, p in enumerate(passes)]
        return reduce(DataFrame.unionByName, found).select(F.col("id_i").alias("root"), F.col("id_j").alias("member"))
    return compiled([linkage_pass(data, p, record_id) for p in passes])


def numbered(ids: DataFrame, parts: int = 1024) -> DataFrame:
    """ids (i) with their place k from 0, in no set order: numbered within parts by hash, after the counts of the parts before."""
    dealt = ids.select("i", F.pmod(F.xxhash64("i"), F.lit(parts)).alias("part"))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("i")) - 1 + F.col("start")
    return dealt.join(F.broadcast(starts), "part").select("i", place.cast("long").alias("k"))
