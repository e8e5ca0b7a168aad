"""Records, stores, corpora, logs and assessment against known values; what must not pass raises."""

import hashlib
import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.functions import canonical
from ledgerloom.operators import cases, evaluation, facts, records
from ledgerloom.sources import corpora, stores


def case(spark, pairs, name="c"):
    data = [(name, f"k{i}", s, d, s[0], d[0], datetime(2024, 1, 1) + timedelta(hours=i), 10.0 + i, 10.0 + i, "USD", "USD", i == 0, "cycle" if i == 0 else None) for i, (s, d) in enumerate(pairs)]
    return spark.createDataFrame(data, "case_id string, transaction_key string, src string, dst string, src_bank string, dst_bank string, ts timestamp_ntz, amount_paid double, amount_received double, payment_currency string, receiving_currency string, is_laundering boolean, typology string")


def test_record(spark, monkeypatch):
    e = case(spark, [("a1", "b1"), ("b1", "c1"), ("c1", "a1"), ("a1", "a1")])
    seeds = spark.createDataFrame([("c", "a1")], "case_id string, seed_node string")
    r = records.extract_facts(e, seeds, order=("cycle",)).first().asDict(True)
    assert r["entity_inventory"] == ["a1", "b1", "c1"] and r["structure"]["n_edges"] == 4 and r["structure"]["diameter"] == 1 and r["structure"]["cross_bank"]
    assert r["focal_entity"] == {"node_id": "a1", "rule": "extraction_seed", "n_senders": 1, "n_receivers": 1, "role": "pass_through"}
    assert r["flow"]["total_out"] == {"available": True, "reason": None, "value": 10.0} and r["flow"]["total_in"]["value"] == 12.0 and r["flow"]["retained"]["value"] == 2.0
    assert r["labels"] == {"n_illicit_transactions": 1, "n_illicit_accounts": 2} and r["motifs"]["cycle"] and r["motifs"]["cycle_length"] == 3
    assert r["typology"] == {"typology": "cycle", "source": "ground_truth", "confidence": 1.0, "scope": "stream_membership"} and r["temporal"]["phase"] == "outflow_then_inflow"
    panel = {(x["section"], x["label"]): x["value"] for x in records.fact_panel(records.extract_facts(e, seeds, order=("cycle",)), "case_id", ["flow", "labels"]).collect()}
    assert panel["flow", "total_out"] == "10.0" and panel["labels", "n_illicit_accounts"] == "2"
    monkeypatch.setattr(records, "INVENTORY", 2)
    with pytest.raises(PySparkException, match="too many accounts"):
        records.extract_facts(e, seeds, order=("cycle",)).collect()


def test_inferred_typology(spark):
    base = {m: False for m in facts.SHAPE_PRIORITY}
    make = lambda *on: spark.createDataFrame([tuple({**base, **dict.fromkeys(on, True)}.values())], ", ".join(f"{m} boolean" for m in base))
    got = [facts.resolve_typology(make(*on), False).select("typology", "source", "confidence").first() for on in ((), ("stack",), ("fan_in", "cycle"), facts.SHAPE_PRIORITY)]
    assert [tuple(x) for x in got] == [("unclassified", "none", 0.0), ("stack", "inferred", 0.5), ("cycle", "inferred", 0.7), ("gather_scatter", "inferred", 0.9)]


def test_encodings(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]
    got = {r["node_id"]: r for r in records.encodings(case(spark, pairs), laplacian=6, walks=3).collect()}
    assert [round(x, 6) for x in got["d"]["walk_pe"]] == [0, round(1 / 3, 6), 0] and got["a"]["walk_pe"][2] == pytest.approx(2 * 1 / 2 * 1 / 3 * 1 / 2, abs=1e-6) and got["e"]["walk_pe"] == [0, 0, 0]
    v = np.array([got[n]["laplacian_pe"] for n in "abcde"])
    assert v.shape == (5, 6) and not v[:, 4:].any() and np.allclose(v[:, :4].T @ v[:, :4], np.eye(4), atol=1e-5)


def test_case_store(spark, tmp_path):
    e = case(spark, [("a", "b"), ("b", "c")]).unionByName(case(spark, [("x", "y")], "d").withColumn("transaction_key", F.lit("z")))
    store = corpora.CaseStore.of(e, e.groupBy("case_id").agg(F.count("*").alias("n")))
    store.save(str(tmp_path / "s"))
    again = corpora.CaseStore.load(spark, str(tmp_path / "s"))
    assert rows(again.cases) == rows(store.cases) and rows(again.case_nodes) == rows(store.case_nodes) and rows(again.case_edges) == rows(store.case_edges)
    one = again.subset(spark.createDataFrame([("d",)], "case_id string"))
    assert one.materialise(e).count() == one.edges_of(e).count() == 1 and one.cases.count() == 1
    about = stores.read_json(spark, str(tmp_path / "s" / "manifest.json"))
    stores.write_json(spark, str(tmp_path / "s" / "manifest.json"), about | {"ids_sha256": "0"})
    with pytest.raises(ValueError, match="ids"):
        corpora.CaseStore.load(spark, str(tmp_path / "s"))
    with pytest.raises(PySparkException, match="not in its case"):
        corpora.check_endpoints(e, store.case_nodes.where("node_id <> 'y'")).collect()
    assert rows(corpora.check_endpoints(e, store.case_nodes).select("transaction_key")) == rows(e.select("transaction_key"))
    assert corpora.passthrough_case(e, "p").select("case_id").distinct().collect()[0][0] == "p"
    with pytest.raises(ValueError):
        corpora.require_transaction_keys(e.drop("transaction_key"))


def test_refusals(spark, tmp_path):
    held = spark.createDataFrame([("g1",)], "case_id string")
    c = spark.createDataFrame([("a", "train", "bronze"), ("g1", "train", "bronze"), ("b", "val", "gold")], "case_id string, split string, tier string")
    assert rows(corpora.load_training_records(c, "train").select("case_id")) == [("a",), ("g1",)]
    for f in (lambda: corpora.load_training_records(c, "train", held), lambda: corpora.load_training_records(c, "val")):
        with pytest.raises(PySparkException):
            f().collect()
    assert corpora.load_training_records(c, "val", held, allow_gold=True).count() == 1
    (tmp_path / "r.json").write_text(json.dumps({"case_ids": ["a", "b"]}))
    assert rows(corpora.load_reservation(spark, str(tmp_path / "r.json"))) == [("a",), ("b",)]
    with pytest.raises(PySparkException, match="test split"):
        corpora.load_reservation(spark, str(tmp_path / "r.json"), c).collect()
    out = spark.createDataFrame([("a", " ", "x", ["y"], "s"), ("b", "n", None, None, "s")], "case_id string, narrative string, text string, texts array<string>, tier string")
    assert rows(corpora.load_system_outputs(out).select("narrative", "system")) == [("n", "s"), ("x", "s")]
    with pytest.raises(PySparkException, match="lacks"):
        corpora.load_system_outputs(out.withColumn("text", F.lit(None).cast("string")).withColumn("texts", F.array(F.lit(" "))).where("case_id = 'a'")).collect()
    with pytest.raises(corpora.Refused):
        corpora.load_system_outputs(out.drop("tier"))
    f = spark.createDataFrame([("a", 1)], "case_id string, n int")
    o = corpora.load_system_outputs(out)
    with pytest.raises(PySparkException, match="no facts"):
        corpora.pair_outputs_with_facts(o, f).collect()
    assert rows(corpora.pair_outputs_with_facts(o, f, o, "skip").select("case_id", "n", "reference")) == [("a", 1, "x")]
    pool = spark.createDataFrame([("i", "t"), ("i", "u")], "item string, text string")
    with pytest.raises(PySparkException, match="twice"):
        corpora.load_narratives(pool).collect()
    with pytest.raises(corpora.Refused):
        corpora.load_narratives(pool.withColumn("model", F.lit(1)))
    j = spark.createDataFrame([('{"a":1,"b":null}',), ('{"a":1}',)], "j string")
    assert rows(corpora.load_case_facts(j.limit(1), "j", "a int, b string").select("facts.a")) == [(1,)]
    with pytest.raises(PySparkException, match="read back"):
        corpora.load_case_facts(j, "j", "a int, b string").collect()


def test_json_lines_with_a_broken_end(spark, tmp_path):
    (tmp_path / "a").write_text('{"id":1}\n\n{"id":2}\n{"id":')
    (tmp_path / "b").write_text('{"id":"x"\n{"id":4}\n')
    assert rows(corpora.read_jsonl_tail(spark, str(tmp_path / "a"), "id int")) == [(1,), (2,)]
    with pytest.raises(ValueError, match="broken"):
        corpora.read_jsonl_tail(spark, str(tmp_path / "b"), "id int")


def test_background(spark, tmp_path):
    assert not corpora.is_available(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        corpora.load_background_graph(spark, str(tmp_path))
    (tmp_path / "background_nodes.csv").write_text("CLUSTERID,f\n01,2\n02,3\n")
    (tmp_path / "background_edges.csv").write_text("src,dst\n01,02\n")
    (tmp_path / "connected_components.csv").write_text("ccId,clusterId,ccLabel\n")
    g = corpora.load_background_graph(spark, str(tmp_path))
    assert rows(g.counts()) == [("edges", 1), ("nodes", 2)] and rows(g.edges.select("src", "dst")) == [("01", "02")]


def test_logs_and_pending_work(spark, tmp_path):
    cache, errors = corpora.ResponseCache(spark, str(tmp_path / "c")), corpora.error_log(spark, str(tmp_path / "e"))
    asks = spark.createDataFrame([("k1", "p1", "a"), ("k2", "bad", "b")], "request_key string, prompt string, case_id string")

    def make():
        def client(prompt):
            if prompt == "bad":
                raise RuntimeError("no")
            return prompt.upper()

        return client

    assert rows(corpora.generate_pending(asks, cache, errors, make).select("request_key", "response")) == [("k1", "P1")]
    assert rows(errors.read().select("case_id", "kind", "message")) == [("b", "RuntimeError", "no")]
    assert rows(cache.split(asks)[1].select("request_key")) == [("k2",)]
    store = corpora.annotation_store(spark, str(tmp_path / "n"))
    for who in ("x", "y"):
        store.append(spark.createDataFrame([("a", who, "{}")], "case_id string, annotator string, payload string"))
    assert rows(store.read().select("annotator", "case_id")) == [("x", "a"), ("y", "a")]


def test_canonical_json(spark, tmp_path):
    value = {"b": [{"y": 1, "x": "é"}, {"y": None, "x": "q"}], "a": {"d": True, "c": None}, "n": 3}
    df = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.from_json("j", "struct<b:array<struct<y:int,x:string>>,a:struct<d:boolean,c:string>,n:int>").alias("v"))
    want = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    got = df.select(canonical.canonical_json(df, "v"), canonical.content_key(df, "v"), canonical.short(canonical.content_key(df, "v"))).first()
    assert tuple(got) == (want, hashlib.sha256(want.encode()).hexdigest(), hashlib.sha256(want.encode()).hexdigest()[:12])
    assert rows(canonical.leaf_paths(df.withColumn("k", F.lit(1)), "k", "v")) == [(1, "a.c", False), (1, "a.d", True), (1, "b", True), (1, "n", True)]
    tag = spark.sql("SELECT named_struct('available', true, 'value', 2) AS a, named_struct('available', false, 'value', 1) AS b")
    assert tuple(tag.select(canonical.greater(F.col("a"), F.col("b")), canonical.equals(F.col("a"), 2), canonical.equals(F.col("b"), 1)).first()) == (False, True, False)
    for name, body in (("x", b"1"), ("a", b"2" * 50)):
        (tmp_path / name).write_bytes(body)
    digests = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a", "x")}
    assert stores.folder_hash(spark, str(tmp_path)) == hashlib.sha256("\n".join(f"{n}:{digests[n]}" for n in ("a", "x")).encode()).hexdigest()
    assert rows(stores.file_digests(spark, str(tmp_path), large=10)) == [("a", 50, digests["a"]), ("x", 1, digests["x"])]


def test_p_values_and_quantiles(spark):
    one = lambda x: spark.createDataFrame([(x,)], "x double")
    assert evaluation.with_p(one(3.841458820694124), "x", "chi2", "1").first()["p"] == pytest.approx(0.05)
    assert evaluation.with_p(one(-1.959963984540054), "x", "normal").first()["p"] == pytest.approx(0.05)
    assert evaluation.with_p(one(2.2281388519649385), "x", "student", "10").first()["p"] == pytest.approx(0.05, abs=1e-6)
    assert all(math.erf(evaluation.inverse_erf(y)) == pytest.approx(y, abs=1e-12) for y in (-0.99, -0.3, 0, 1e-6, 0.7, 0.9999)) and evaluation.inverse_erf(1) == math.inf


def test_average_precision_and_draws(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 200), np.round(rng.normal(size=200), 1)
    want, seen = 0.0, 0
    for t in sorted(set(s), reverse=True):
        hits = int(y[s >= t].sum())
        want += (hits - seen) / y.sum() * hits / (s >= t).sum()
        seen = hits
    assert evaluation.average_precision(y, s) == pytest.approx(want)
    (_, a), (_, b) = evaluation.stratified_draws(y, [3, 3], 1)
    assert (a == b).all() and y[a].sum() == y.sum()
    df = spark.createDataFrame([(int(p), float(q), float(q) + 0.0) for p, q in zip(y, s, strict=True)], "y int, a double, b double")
    got = evaluation.bootstrap_auc_pr(df, "y", "a", resamples=60).first()
    assert got["point"] == pytest.approx(want) and got["low"] < want < got["high"]
    same = evaluation.bootstrap_auc_pr(df, "y", "a", "b", resamples=20).first()
    assert same["point"] == same["low"] == same["high"] == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(evaluation, "EVALUATION_ROWS", 10)
        with pytest.raises(ValueError):
            evaluation.bootstrap_auc_pr(df, "y", "a")


def test_responses(spark):
    said = 'Well:\n```json\n{"claims":[{"field_path":"a","value":2,"evidence":"two"},{"field_path":"b","value":"x","evidence":"gone"},{"field_path":"c","evidence":"two"}]}\n```'
    r = spark.createDataFrame([("c", said, "two or two more"), ("d", "no json", "t")], "case_id string, response string, narrative string")
    assert [tuple(x) for x in evaluation.parse_extraction(r).orderBy("index").collect()] == [("c", 0, "a", "2", "two", 0), ("c", 1, "b", "x", "gone", None), ("c", 2, "c", None, "two", 7)]
    with pytest.raises(ValueError):
        evaluation.cue_rule("[0-9]+", "a", "count")
    with pytest.raises(ValueError):
        evaluation.inverted({"a": "x", "b": "x"})
    assert evaluation.inverted({"a": "x"}) == {"x": "a"}


def test_reports(spark):
    t = spark.createDataFrame([("a_b", 0.5), ("c", None)], "system string, value double")
    assert evaluation.latex_table(t, ["system", "value"]).splitlines()[2:6] == [r"system & value \\", r"\midrule", r"a\_b & 0.500 \\", r"c & -- \\"]
    assert len(evaluation.run_benchmark(lambda x: x, [1, 2], 3, 7)) == 7
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i % 3} and {i % 2}") for i in range(12)], "doc_id long, text string")
    curve = {r["references"]: r["self_bleu"] for r in evaluation.self_bleu_curve(docs, (1, 5)).collect()}
    assert 0 < curve[1] <= curve[5] <= 1.0000001
    rng = random.Random(1)
    ids = spark.createDataFrame([(rng.random(),) for _ in range(300)], "v double").repartition(5)
    got = [r["v"] for r in evaluation.numbered(ids, "v").orderBy("k").collect()]
    assert got == sorted(got) and len(got) == 300
    assert records.realisation(F.lit(0), {"a": 2, "b": 3}).keys() == {"a", "b"}
    x = spark.range(12).select("id", *[c.alias(n) for n, c in records.realisation(F.col("id"), {"a": 2, "b": 3}).items()])
    assert len({(r["a"], r["b"]) for r in x.collect()}) == 6


def test_exemplars_and_caches(spark, tmp_path):
    pool = spark.createDataFrame([("a", "t", "train"), ("b", "t", "train"), ("c", "u", "test")], "case_id string, typology string, split string")
    with pytest.raises(PySparkException, match="training split"):
        records.exemplars(pool.select("case_id"), pool).collect()
    got = [tuple(r) for r in records.exemplars(pool.select("case_id"), pool.withColumn("split", F.lit("train")), 2).orderBy("case_id", "rank").collect()]
    assert [x for x in got if x[0] == "a"] == [("a", 0, "b"), ("a", 1, "c")] and len(got) == 6
    splits = spark.createDataFrame([("a", "train"), ("b", "test")], "case_id string, split string")
    records.build_feature_cache(spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("z", [3.0])], "case_id string, f array<double>"), splits, str(tmp_path / "f"))
    cache = spark.read.parquet(str(tmp_path / "f"))
    assert records.cache_departures(cache, splits).count() == 0
    assert rows(records.cache_departures(cache, spark.createDataFrame([("a", "val"), ("b", "test"), ("n", "val")], "case_id string, split string"))) == [("a", "train", "val"), ("n", None, "val")]


def test_gold_deficits(spark):
    c = spark.createDataFrame([(f"c{i}", "x" if i < 3 else "y") for i in range(9)], "case_id string, block string")
    drawn, short = cases.gold_sample(c, {"x": 5, "y": 2, "z": 1})
    assert drawn.count() == 5 and rows(short.select("block", "found", "deficit")) == [("x", 3, 2), ("y", 2, 0), ("z", 0, 1)]


def test_positions_in_a_total_order(spark):
    from ledgerloom.operators import statistics as st

    df = spark.createDataFrame([(i * 7 % 101, i % 5) for i in range(101)], "v int, n int").repartition(4)
    got = st.running(df, "v", "n").orderBy("v").collect()
    assert [r["_before"] for r in got] == [sum(x["n"] for x in got[:i]) for i in range(101)]


def test_exemplars_are_turned_lists_without_lists_of_the_pool(spark):
    pool = [(f"p{i:02d}", t) for i, t in enumerate(["a"] * 6 + ["b"] * 2 + ["c"] + [None] * 2 + ["a"] * 3)]
    asked = [p[0] for p in pool] + ["x1", "yy2", "z"]
    want = set()
    known = {c: t or "" for c, t in pool}
    for c in asked:
        off = sum(map(ord, c))
        own = [p for p in sorted(known) if known[p] == known.get(c, "") and p != c]
        rest = [p for p in sorted(known) if known[p] != known.get(c, "") and p != c]
        turned = lambda a: a[off % len(a) :] + a[: off % len(a)] if a else []  # noqa: B023, E731
        want |= {(c, r, e) for r, e in enumerate((turned(own) + turned(rest))[:4])}
    p = spark.createDataFrame([(*x, "train") for x in pool], "case_id string, typology string, split string")
    out = records.exemplars(spark.createDataFrame([(c,) for c in asked], "case_id string"), p, 4)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert "array_except" not in out._jdf.queryExecution().toString()
    few = records.exemplars(spark.createDataFrame([("p00",), ("q",)], "case_id string"), p.where("case_id = 'p00'"), 3)
    assert [tuple(r) for r in few.collect()] == [("q", 0, "p00")]
