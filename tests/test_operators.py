"""Operators against known shapes and brute force."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ledgerloom.functions import formatting as fm
from ledgerloom.operators import cases, claims, evaluation, facts, graph, motif_scores, text
from ledgerloom.operators import statistics as st


def edges(spark, pairs, case="c/1"):
    data = [(case, s, d, datetime(2024, 1, 1) + timedelta(hours=i), 100.0 + i, 100.0 + i, "USD", "USD", False, f"k{i}", None) for i, (s, d) in enumerate(pairs)]
    return spark.createDataFrame(data, "case_id string, src string, dst string, ts timestamp_ntz, amount_paid double, amount_received double, payment_currency string, receiving_currency string, is_laundering boolean, transaction_key string, pattern_id string")


SHAPES = {
    "chain": ([("a", "b"), ("b", "c"), ("c", "d")], {"cycle_length": None, "chain_length": 3, "chain": True, "bipartite": True, "left_size": 2, "stack_depth": None, "diameter": 3}),
    "cycle": ([("a", "b"), ("b", "c"), ("c", "a")], {"cycle_length": 3, "chain_length": 2, "bipartite": False, "bipartite_score": round(2 / 3 / 2, 6), "diameter": 1}),
    "star": ([("a", "b"), ("a", "c"), ("a", "d"), ("a", "a")], {"cycle_length": None, "chain_length": 1, "chain": False, "bipartite": False, "bipartite_score": round(1 / 3, 6), "stack_depth": None, "diameter": 2}),
    "apart": ([("a", "b"), ("c", "d")], {"diameter": 1, "bipartite": True, "bipartite_score": 1.0}),
    "back": ([("a", "b"), ("b", "a")], {"cycle_length": None, "chain_length": 1}),
    "stack": ([("s", f"{x}1") for x in "pq"] + [(f"{x}{k}", f"{y}{k + 1}") for k in (1, 2) for x in "pq" for y in "pq"], {"stack_depth": 3, "layer_widths": [2, 2, 2], "chain_length": 3}),
    "branch": ([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "b"), ("x", "a")], {"chain_length": 4, "cycle_length": 3, "diameter": 3}),
    "loop": ([("a", "a")], {"chain_length": 0, "bipartite": False, "bipartite_score": 0.0, "diameter": None, "stack_depth": None}),
    "long": ([(f"v{i:02d}", f"v{i + 1:02d}") for i in range(50)], {"chain_length": 50, "diameter": 50}),
}


def test_longest_path_is_enumeration():
    from itertools import permutations

    from ledgerloom.operators.case_matrices import Case

    rng = random.Random(5)
    for _ in range(30):
        pairs = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for _ in range(rng.randrange(1, 14))]
        case = Case(*zip(*pairs, strict=True))
        arcs = {(a, b) for a, b in pairs if a != b}
        names = sorted({x for p in pairs for x in p})
        want = max((k - 1 for k in range(1, len(names) + 1) for way in permutations(names, k) if all(x in arcs for x in zip(way, way[1:], strict=False))), default=0)
        assert case.longest_path(40) == want and case.longest_path(0) <= want


def test_roles_and_focal(spark):
    pairs = [("x", "x"), ("a", "h"), *[(f"i{k}", "h") for k in range(4)], *[("h", f"o{k}") for k in range(5)], ("p", "q"), ("q", "r"), ("o0", "z"), ("o0", "y")]
    got = {r["node_id"]: r["role"] for r in facts.roles(edges(spark, pairs)).collect()}
    assert (got["x"], got["a"], got["h"], got["q"], got["r"], got["o0"]) == ("terminal", "originator", "hub", "pass_through", "beneficiary", "intermediary")
    focal = lambda seed: tuple(facts.select_focal(edges(spark, pairs), spark.createDataFrame([("c/1", seed)], "case_id string, seed_node string")).first())
    assert focal("q") == ("c/1", "q", "extraction_seed") and focal("nobody") == ("c/1", "h", "max_degree")


def test_hops_without_a_limit(spark):
    e = edges(spark, [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(12)] + [("u", "w")]).withColumn("is_laundering", F.col("src") == "v00")
    got = {r["node_id"]: r["hops"] for r in facts.hops_to_flagged(e).collect()}
    assert got["v12"] == 11 and got["u"] is None and got["v01"] == 0


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(spark, name):
    pairs, want = SHAPES[name]
    got = facts.shape_motifs(edges(spark, pairs), "case_id").first().asDict()
    assert {k: got[k] for k in want} == want


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert dict(rows(graph.weak_components(edges(spark, pairs)))) == {v: find(v) for p in pairs for v in p}


def test_empty_graph(spark):
    none = edges(spark, [("a", "b")]).where("false")
    assert graph.node_table(none).count() == 0
    assert graph.weak_components(none).count() == 0
    assert facts.structure(none).count() == 0


def test_prune_keeps_protected(spark):
    e = edges(spark, [("a", "b"), ("c", "d"), ("a", "c"), ("e", "f")]).withColumn("is_laundering", F.col("src") == "e")
    got = {(r["src"], r["dst"]) for r in graph.prune(e, 3).collect()}
    assert ("e", "f") in got and len({x for p in got for x in p}) <= 4


def test_hub_cap(spark):
    e = edges(spark, [("h", f"x{i}") for i in range(100)])
    seeds = spark.createDataFrame([("c", "h", datetime(2023, 1, 1), datetime(2025, 1, 1))], "case_id string, node_id string, start timestamp_ntz, end timestamp_ntz")
    assert graph.expand(e, seeds, 1, 10).count() == 11


def test_flow_reasons(spark):
    e = edges(spark, [("a", "b"), ("a", "b")]).withColumn("payment_currency", F.when(F.col("transaction_key") == "k0", "EUR").otherwise("USD"))
    got = {r["node_id"]: r.asDict(True) for r in facts.account_flow(e).collect()}
    assert got["a"]["total_out"] == {"available": False, "reason": facts.MULTI_CURRENCY, "value": None}
    assert got["a"]["total_in"]["reason"] == facts.NO_TRANSFERS
    assert got["b"]["total_in"]["value"] == pytest.approx(201.0)
    assert got["b"]["retained"]["reason"] == facts.MULTI_CURRENCY  # also where a side is missing


def test_burst_ties(spark):
    t = datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t + timedelta(hours=h)) for h in (0, 10, 20, 30, 40, 500, 505, 510, 515, 520)], "user_id long, ts timestamp_ntz")
    got = facts.burst(ev, "user_id", "ts").first()
    assert got["burst_n"] == 5 and got["burst_span_hours"] == 20.0


def test_split_edges(spark):
    t = lambda d: datetime(2024, 1, d)
    c = spark.createDataFrame([("a", t(1), t(5)), ("b", t(4), t(6)), ("c", t(5), t(10)), ("d", t(11), t(12))], "case_id string, start timestamp_ntz, end timestamp_ntz")
    lit = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp_ntz")
    got = {r["case_id"]: (r["split"], r["drop_reason"]) for r in cases.assign_splits(c, lit(5), lit(10)).collect()}
    assert got == {"a": ("train", None), "b": (None, "straddles"), "c": ("val", None), "d": ("test", None)}


def test_claim_on_missing_fact_is_never_supported(spark):
    f = spark.createDataFrame([("c", "x", False, "no", None, None, None)], "case_id string, field_path string, available boolean, reason string, number double, text string, unit string")
    c = spark.createDataFrame([("c", "1", "x", "count", 1.0, None, None), ("c", "2", "y", "count", 1.0, None, None)], "case_id string, claim_id string, field_path string, claim_type string, number double, text string, unit string")
    assert {r["verdict"] for r in claims.check(c, f).collect()} == {claims.UNVERIFIABLE}


def test_spans_match_once(spark):
    a = spark.createDataFrame([("c", 1, 0, 10), ("c", 2, 2, 11)], "case_id string, id long, start long, end long")
    b = spark.createDataFrame([("c", 1, 0, 10)], "case_id string, id long, start long, end long")
    assert rows(claims.align_spans(a, b)) == [("c", 1, 1, 1.0)]


def test_identifiers_as_python(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = []
    for r in docs.collect():
        m = r["text"] or ""
        for p in text.MASKS:
            m = re.sub(p, " ", m)
        want += [(r["doc_id"], k, x.group(0)) for k, p in text.IDENTIFIERS for x in re.finditer(p, m)]
    assert rows(text.identifiers(docs)) == sorted(want, key=repr)


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, base), (2, base + " more"), (3, "other words here that are alone"), (4, None), (5, ""), (6, base)], "doc_id long, text string")
    got = {(r["a"], r["b"]) for r in text.lsh_near_duplicates(d).collect()}
    assert got == {(1, 2)}
    assert {r[0] for r in text.drop_near_duplicates(d, text.lsh_near_duplicates(d)).select("doc_id").collect()} == {1, 3, 4, 5}


def test_bootstrap_covers(spark):
    r = spark.range(2000).select(F.lit("g").alias("g"), F.col("id"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    x = evaluation.bootstrap(r, "g", "id", "v").first()
    assert x["low"] < x["mean"] < x["high"] and x["high"] - x["low"] < 60


def test_tails():
    assert st.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert st.student_tail(2.085963447265837, 20) == pytest.approx(0.025, abs=1e-8)
    assert st.normal_tail(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert st.chi2_tail(4.0, 2) == pytest.approx(math.exp(-2)) and st.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9) and st.chi2_tail(0, 3) == 1


def test_formats(spark):
    df = spark.createDataFrame([(1234567.0, 0.5, 0.145)], "v double, h double, p double")
    r = df.select(
        fm.format_money(F.col("v"), F.lit("US Dollar")).alias("m"), fm.format_duration(F.col("h")).alias("d"), fm.format_count(F.lit(12345)).alias("c"),
        fm.parse_money(F.lit("1,235,000 US Dollar"))[0].alias("mv"), fm.parse_money(F.lit("1,235,000 US Dollar"))[1].alias("mc"), fm.parse_duration(F.lit("2.5 days")).alias("h2"), fm.parse_percent(F.lit("15%")).alias("p2"), fm.parse_count(F.lit("12,345")).alias("c2"),
        fm.parse_graph_ref(F.lit("a#b#c"))[0].alias("s"), fm.parse_graph_ref(F.lit("a#b#c"))[1].alias("k"), fm.evaluate_condition(F.col("h"), "<= 6").alias("e"),
    ).first()
    assert tuple(r) == ("1,235,000 US Dollar", "30 minutes", "12,345", 1235000.0, "US Dollar", 60.0, 0.15, 12345, "a", "b#c", True)
    with pytest.raises(Exception, match="not a currency"):
        df.select(fm.format_money(F.col("v"), F.lit("$"))).collect()


def test_late_events_in_their_own_place(spark, tmp_path):
    """An event that comes late, between others, widens no window; it counts where it belongs."""
    from ledgerloom.streaming import events as ev

    assert ev.fullest_of([0, 1, 50, 99, 100, 101], 48) == (3, 99) and ev.fullest_of([0, 10, 20, 300], 20) == (3, 0) and ev.fullest_of([], 1) == (0, None)
    hour = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    for i, part in enumerate(([0, 2, 4], [60, 61], [20, 59])):
        spark.createDataFrame([(1, hour(h), 1.0) for h in part], "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    files = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = rows(ev.drain(ev.fullest_burst(files, 24, "5 days"), "late_burst", "update").select("n", F.unix_seconds("start").alias("s")))
    assert max(got) == (4, 1704067200), got


def test_streamed_burst_equals_batch(spark, tiny):
    from ledgerloom.plans import catalog

    ev = spark.read.parquet(f"{tiny}/events.parquet")
    batch = {r["user_id"]: r["burst_n"] for r in facts.burst(ev, "user_id", "ts", least=1).collect()}
    out = catalog.QUERIES["stream_fullest_burst"](spark, tiny).groupBy("user_id").agg(F.max("n").alias("n"))
    assert {r["user_id"]: r["n"] for r in out.collect()} == batch


def test_near_duplicates_are_greedy(spark, tiny):
    """Against the greedy pass over all pairs in id order (bands of two rows make every pair over 0.8 a candidate)."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(40)] for _ in range(12)]
    rows_ = []
    for i, b in enumerate(base * 6):
        w = list(b)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(3)}"
        rows_.append((i, " ".join(w)))
    sets = {}
    for i, t in rows_:
        w = text.python_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    kept = []
    for i, s in sets.items():
        if not any(len(s & sets[k]) >= 0.8 * len(s | sets[k]) for k in kept):
            kept.append(i)
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    pairs = text.lsh_near_duplicates(d, bands=64)
    assert {r["doc_id"] for r in text.drop_near_duplicates(d, pairs).select("doc_id").collect()} == set(kept)


def test_soft_scores(spark):
    def one(pairs):
        return motif_scores.motif_scores(edges(spark, pairs)).first()

    ring = one([("a", "b"), ("b", "c"), ("c", "a")])
    assert (ring["cycle"], ring["best"], ring["best_score"]) == (1.0, "cycle", 1.0)
    assert one([(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)])["cycle"] == 0.5
    fan = one([("h", f"x{i}") for i in range(16)])
    assert (fan["fan_out"], fan["fan_in"], fan["best"]) == (1.0, 0.0, "fan_out")
    assert one([("h", f"x{i}") for i in range(4)])["fan_out"] == round(1 / 13, 6)
    sg = one([("o", m) for m in "pqrs"] + [(m, "d") for m in "pqrs"])
    assert sg["scatter_gather"] == round(2 / 6, 6)
    gs = one([(f"i{k}", "h") for k in range(4)] + [("h", f"o{k}") for k in range(3)] + [("o0", "h")])
    assert gs["gather_scatter"] == 0.0  # o0 stands on both sides, so two are left on one of them
    two = one([(a, b) for a in "pq" for b in "xy"])
    assert two["bipartite"] == 1.0
    assert one([(a, b) for a in "pq" for b in "xy"] * 2)["bipartite"] == 0.5  # transfers count below, pairs above
    tower = [("s", "a"), ("s", "b")] + [(x, y) for u, v in (("ab", "cd"), ("cd", "ef"), ("ef", "gh")) for x in u for y in v]
    assert one(tower)["stack"] == 1.0
    assert one([("a", "a")])["best"] is None


def test_means_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    from ledgerloom.plans import evaluation_queries

    for i, odd in enumerate(((0.01, 2.05, 0.94), (0.94, 2.05, 0.01))):  # both mean 1, the first a little less in doubles
        rows_ = [(0, 7, 5.0), *[(2 * k + 1, 7, v) for k, v in enumerate(odd)]]
        spark.createDataFrame(rows_, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{i}/events.parquet")
        assert evaluation_queries.pairs(spark, f"{tmp_path}/{i}").first()["b"] == 1.0
    strange = spark.createDataFrame([(1, float("nan")), (1, 1.0), (2, 1e300), (2, 1e300), (3, None), (4, 2.0)], "k int, v double")
    got = {r[0]: r[1] for r in strange.groupBy("k").agg(st.mean("v").alias("m")).collect()}
    assert math.isnan(got[1]) and (got[2], got[3], got[4]) == (1e300, None, 2.0)


def test_equal_means_tie(spark):
    from ledgerloom.operators import experiments

    values = [("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.3), ("b", 0.2), ("b", 0.1)]
    out = spark.createDataFrame([(s, "c", v) for s, v in values], "system string, case_id string, value double").coalesce(1)
    assert tuple(experiments.compare_systems(out).first()) == ("a", "b", 1, 0.0, 0, 0, 1)


def test_boundaries_are_enumeration_and_broadcast_no_cases(spark):
    rng = random.Random(3)
    day = lambda k: datetime(2024, 1, 1) + timedelta(days=k)
    spans = [(a, a + rng.choice((0, 1, 3, 40))) for a in (rng.randrange(100) for _ in range(300))]
    at = [0, 7, 20, 21, 33, 60, 61, 90, 139, 150]
    c = spark.createDataFrame([(f"c{i}", day(a), day(b)) for i, (a, b) in enumerate(spans)], "case_id string, start timestamp_ntz, end timestamp_ntz")
    months = spark.createDataFrame([(day(k),) for k in at], "b timestamp_ntz")
    best = None
    for i, x in enumerate(at):
        for y in at[i + 1 :]:
            kept = [(a, b) for a, b in spans if not (a < x < b or a < y < b)]
            train, test = sum(b <= x for _, b in kept), sum(a >= y and b > y for a, b in kept)
            if kept:
                error = abs(train / len(kept) - 0.7) + abs((len(kept) - train - test) / len(kept) - 0.15) + abs(test / len(kept) - 0.15)
                row = (round(error + 1.5 * (1 - len(kept) / len(spans)), 9), x, y, train, len(kept) - train - test, test)
                best = row if best is None or row < best else best
    out = cases.boundary_grid(c, months)
    r = out.first()
    assert (r["score"], r["b1"], r["b2"], r["n_train"], r["n_val"], r["n_test"]) == (best[0], day(best[1]), day(best[2]), *best[3:])
    assert "case_id" not in out._jdf.queryExecution().toString()


def test_negatives_are_not_broadcast(spark, monkeypatch):
    day = lambda k: datetime(2024, 1, 1) + timedelta(days=k)
    c = spark.createDataFrame([(f"c{i}", "small", day(i % 5), day(i % 5 + 2), int(i % 4 == 0)) for i in range(40)], "case_id string, size_bucket string, start timestamp_ntz, end timestamp_ntz, n_flagged int")
    plans, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df, s: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, s))
    assert cases.match_negatives(c, 2).count() == 20
    assert any("SortMergeJoin" in p and "negative" in p for p in plans)
    assert not any("BroadcastHashJoin" in line and ("k#" in line or "positive" in line) for p in plans for line in p.splitlines())


def test_small_cases_share_batches(spark):
    from ledgerloom.operators.case_matrices import Case

    rings = [(f"n{i}", f"n{(i + 1) % (3 + c % 4)}", f"c{c:02d}") for c in range(40) for i in range(3 + c % 4)] + [("a", "b", None)] * 20
    e = spark.createDataFrame(rings, "src string, dst string, case_id string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = motif_scores.ordered_scores(e, "case_id")
        got = {r["case_id"]: r["cycle"] for r in out.collect()}
        assert out.count() == len(got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {f"c{c:02d}": 1 - (c % 4) / 6 for c in range(40)} | {None: 0.0}
    for star in (["ab", "ac", "aa", "ad"], ["ba", "ca", "aa"], ["aa"], ["ab"] * 3, ["cb", "ca", "ca"]):  # they are not looked into
        case = Case(*zip(*star, strict=True))
        sides = case.sides()
        assert case.cycle(3, 6) is None and min(sides.sum(), (~sides).sum()) < 2 and len(case.layers(2)) < 2
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_near_duplicates_in_few_rounds(spark, monkeypatch):
    """Buckets of many different sets take few rounds; the decision by joins is the same as the driver's."""
    from ledgerloom.sources import stores

    def shared(i):
        return " ".join([f"w{k}" for k in range(60)] + [f"x{i}_{k}" for k in range(18)])

    chain = [" ".join(f"v{k}" for k in range(6 * i, 80 + 6 * i)) for i in range(8)]  # each is near the next alone
    rows_ = [(i, shared(i)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(chain)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    tables, real = [], stores.scratch_table
    monkeypatch.setattr(stores, "scratch_table", lambda *a: tables.append(1) or real(*a))
    got = text.lsh_near_duplicates(d, bands=64)
    assert len(tables) < 20
    want = [(100 + i, 101 + i) for i in range(0, 8, 2)]
    assert [(a, b) for a, b, _ in rows(got)] == want
    monkeypatch.setattr(text, "NEAR_PAIRS", 0)
    assert [(a, b) for a, b, _ in rows(text.lsh_near_duplicates(d, bands=64))] == want


@pytest.mark.parametrize("n_max", [1, 2, 3, 4, 5, 8, 50])
def test_prune_in_order(spark, n_max):
    """Against the pass over all edges in order, without a Python group by case."""
    rng = random.Random(n_max)
    es = [(f"c{rng.randrange(6)}", f"a{rng.randrange(7)}", f"a{rng.randrange(7)}", float(rng.randrange(9)), rng.random() < 0.04, f"k{i:03d}") for i in range(240)]
    have, want = {}, set()
    for c, s, d, _, flag, key in sorted(es, key=lambda x: (-x[4], -x[3], x[5])):
        h = have.setdefault(c, set())
        if flag or len(h | {s, d}) <= n_max:
            h |= {s, d}
            want.add(key)
    df = graph.prune(spark.createDataFrame(es, "case_id string, src string, dst string, amount_paid double, is_laundering boolean, transaction_key string"), n_max)
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    assert {r["transaction_key"] for r in df.collect()} == want


def test_components_over_few_edges(spark, monkeypatch):
    """A dense graph's labels spread over each account's extreme neighbours alone; what these leave apart is joined after."""
    sizes, real = [], graph._spread
    monkeypatch.setattr(graph, "_spread", lambda e, s: sizes.append(e.count()) or real(e, s))
    dense = [(f"s{i:02d}", f"d{j:02d}") for i in range(20) for j in range(20)]
    assert {r[1] for r in graph.weak_components(edges(spark, dense)).collect()} == {"d00"} and max(sizes) <= 80
    halves = [(f"{x}{i}", f"{x}{j}") for x in "az" for i in range(5) for j in range(5, 10)]
    e = edges(spark, [*halves, ("a2", "z7"), ("m", "m")])
    assert dict(rows(graph.weak_components(e))) == {**{f"{x}{i}": "a0" for x in "az" for i in range(10)}, "m": "m"}


def test_all_pairs_of_vectors_without_copies(spark, monkeypatch):
    """Blocks meet in a product, not by copies of the vectors; against brute force, with equal vectors and several blocks."""
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 6)).astype(np.float32).round(1)
    v[40:60] = v[3]
    label = rng.integers(0, 3, 150)
    df = spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(150)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(st, "BLOCK_ROWS", 40)
    monkeypatch.setattr(st, "STRIP", 16)
    e = v.astype(np.float64)
    d = np.zeros((150, 150))
    for c in range(6):
        d += (e[:, None, c] - e[None, :, c]) ** 2
    p, s = [], []
    for i in range(150):
        best = sorted((x for x in range(150) if x != i), key=lambda x: (d[i, x], x))[:10]
        p.append(np.mean(label[best] == label[i]))
        far = np.sqrt(d[i])
        a = far[label == label[i]].sum() / ((label == label[i]).sum() - 1)
        b = min(far[label == c].mean() for c in range(3) if c != label[i])
        s.append((b - a) / max(a, b))
    for f, want in ((st.knn_purity, p), (st.silhouette, s)):
        got = f(df)
        assert "Generate" not in got._jdf.queryExecution().toString()
        assert {r[0]: (round(r[1], 9), r[2]) for r in got.collect()} == {c: (round(float(np.mean(np.array(want)[label == c])), 9), int((label == c).sum())) for c in range(3)}


def test_large_cases_have_every_score(spark, monkeypatch):
    """A ring under thousands of transfers scores as one; lists of neighbours tell what the tables tell."""
    from ledgerloom.operators.case_matrices import Case, LargeCase

    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    assert motif_scores.ordered_scores(edges(spark, ring * 600), "case_id").first()["cycle"] == motif_scores.ordered_scores(edges(spark, ring), "case_id").first()["cycle"] > 0
    rng = random.Random(3)
    for k in range(120):
        n = 2 + k % 14
        es = [(f"a{rng.randrange(n)}", f"a{rng.randrange(n)}") for _ in range(rng.randrange(1, 2 * n))] + [("a0", "a0")]
        x, y = Case(*zip(*es, strict=True)), LargeCase(*zip(*es, strict=True))
        assert x.n_transfers() == y.n_transfers() and (x.sides() == y.sides()).all() and x.across() == y.across() and x.layers(2) == y.layers(2)
        assert all(x.cycle(a, b) == y.cycle(a, b) for a, b in ((3, 6), (2, 4), (4, 8)))
    monkeypatch.setattr(motif_scores, "TABLE_ACCOUNTS", 3)
    long = [(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]
    assert motif_scores.ordered_scores(edges(spark, long), "case_id").first()["cycle"] == 0.5


def test_prune_query_leaves_room_for_unprotected_edges(spark):
    from ledgerloom.plans import graph_queries

    d = "/root/testdata/sf0.01"
    got = graph_queries.case_prune(spark, d).groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("is_laundering").alias("k"), F.size(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))).alias("v")).collect()
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    assert len(got) == lines.select(F.expr("l_orderkey div 1164")).distinct().count()
    assert sum(r["k"] for r in got) == lines.where("l_orderkey % 97 = 0").count()
    assert all(r["v"] <= 150 and r["n"] > 2 * r["k"] for r in got) and sum(r["n"] for r in got) < lines.count()
