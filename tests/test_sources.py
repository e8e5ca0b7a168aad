import json

import pytest
from helpers import rows

from ledgerloom.sources import stores
from ledgerloom.sources import transactions as tx

HEADER = ",".join(tx.HEADER)
ROW = "2022/09/01 00:20,010,8000EBD30,010,8000EBD30,3697.34,US Dollar,3697.340,US Dollar,Reinvestment,0"


def test_transactions(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text(f"{HEADER}\n{ROW}\n{ROW.replace(',0', ',1', 0)[:-1]}1\n")
    got = tx.load_transactions(spark, str(f)).collect()
    assert got[0]["transaction_key"] == "2022/09/01 00:20|010|8000EBD30|010|8000EBD30|3697.340"  # the text, not the number
    assert [r["is_laundering"] for r in got] == [False, True]
    assert dict(tx.load_transactions(spark, str(f)).dtypes)["timestamp"] == "timestamp_ntz"
    assert tx.edges_of(tx.load_transactions(spark, str(f), n_rows=1)).first()["src"] == "010|8000EBD30"


def test_header_drift(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("a,b\n1,2\n")
    with pytest.raises(tx.SchemaDrift):
        tx.load_transactions(spark, str(f))


PATTERN = f"BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 16-degree Fan-Out\n{ROW}\n{ROW}\nEND LAUNDERING ATTEMPT - FAN-OUT\n\nBEGIN LAUNDERING ATTEMPT - STACK\n{ROW}\nEND LAUNDERING ATTEMPT - STACK\n"


def test_patterns(spark, tmp_path):
    f = tmp_path / "p.txt"
    f.write_text(PATTERN)
    got = rows(tx.load_patterns(spark, str(f)).select("pattern_id", "typology", "position_in_stream"))
    assert got == [("fan_out_00000", "fan_out", 0), ("fan_out_00000", "fan_out", 1), ("stack_00001", "stack", 0)]


@pytest.mark.parametrize("bad", [
    "BEGIN LAUNDERING ATTEMPT - STACK\nBEGIN LAUNDERING ATTEMPT - STACK\n",
    f"BEGIN LAUNDERING ATTEMPT - STACK\n{ROW}\nEND LAUNDERING ATTEMPT - CYCLE\n",
    "END LAUNDERING ATTEMPT - STACK\n",
    "BEGIN LAUNDERING ATTEMPT - STACK\nEND LAUNDERING ATTEMPT - STACK\n",
    f"BEGIN LAUNDERING ATTEMPT - STACK\n{ROW}\n",
    f"BEGIN LAUNDERING ATTEMPT - NOTHING\n{ROW}\nEND LAUNDERING ATTEMPT - NOTHING\n",
    ROW,
    "BEGIN LAUNDERING ATTEMPT - STACK\na,b\nEND LAUNDERING ATTEMPT - STACK\n",
])
def test_bad_patterns(bad):
    with pytest.raises(tx.SchemaDrift):
        list(tx.parse_patterns(bad))


def test_memberships(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("ccId,clusterId,ccLabel\n1,a, Suspicious\n1,b,1\n2,c,licit\n")
    assert rows(tx.load_memberships(spark, str(f)))[0] == ("1", "a", "suspicious")
    (tmp_path / "n.csv").write_text("ccId,clusterId,ccLabel\n1,a,what\n")
    with pytest.raises(Exception, match="unknown label"):
        tx.load_memberships(spark, str(tmp_path / "n.csv")).collect()
    (tmp_path / "o.csv").write_text("x,y\n1,2\n")
    with pytest.raises(tx.SchemaDrift):
        tx.load_memberships(spark, str(tmp_path / "o.csv"))


def test_graph_round_trip(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",)], "node_id string"), spark.createDataFrame([("a", "a")], "src string, dst string")
    stores.save_graph(nodes, edges, str(tmp_path / "g"), {"name": "x"})
    n, e, about = stores.load_graph(spark, str(tmp_path / "g"))
    assert rows(n) == [("a",)] and rows(e) == [("a", "a")] and about["name"] == "x"
    stores.write_json(spark, str(tmp_path / "g" / "graph.json"), {"version": "0"})
    with pytest.raises(ValueError):
        stores.load_graph(spark, str(tmp_path / "g"))


def test_split_manifest(spark, tmp_path):
    s = spark.createDataFrame([("c1", "train"), ("c2", "test"), ("c3", "train")], "case_id string, split string")
    stores.save_split_manifest(s, str(tmp_path / "s"))
    assert rows(stores.load_split_manifest(spark, str(tmp_path / "s")).select("case_id", "split")) == rows(s)
    about = stores.read_json(spark, str(tmp_path / "s" / "splits.json"))
    about["splits"]["train"]["sha256"] = "0"
    stores.write_json(spark, str(tmp_path / "s" / "splits.json"), about)
    with pytest.raises(ValueError):
        stores.load_split_manifest(spark, str(tmp_path / "s"))


def test_jsonl_broken_tail(spark, tmp_path):
    d = tmp_path / "j"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"id": 1}) + "\n" + '{"id": 2')
    assert rows(stores.read_jsonl(spark, str(d), "id long")) == [(1,)]
    stores.write_jsonl(spark.createDataFrame([(3,)], "id long"), str(tmp_path / "k"))
    stores.write_jsonl(spark.createDataFrame([(4,)], "id long"), str(tmp_path / "k"), append=True)
    assert rows(stores.read_jsonl(spark, str(tmp_path / "k"), "id long")) == [(3,), (4,)]


def test_latest_is_last_line(spark):
    r = spark.createDataFrame([("a", 1, "2024-02-01"), ("a", 2, "2024-01-01")], "k string, line int, at string")
    assert stores.keep_latest(r, ["k"], "line").first()["at"] == "2024-01-01"


def test_files(spark, tmp_path):
    import hashlib

    d = tmp_path / "f"
    d.mkdir()
    (d / "x.bin").write_bytes(b"abc")
    (d / "y.bin").write_bytes(b"abcd")
    sha = hashlib.sha256(b"abc").hexdigest()
    want = spark.createDataFrame([("x.bin", 3, sha), ("y.bin", 3, sha), ("z.bin", 1, sha)], "name string, bytes long, sha256 string")
    assert dict(rows(stores.verify_files(spark, str(d), want))) == {"x.bin": "ok", "y.bin": "size", "z.bin": "missing"}


def test_content_hash_ignores_order(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    assert stores.content_hash(a).collect() == stores.content_hash(b).collect()


def test_release(spark):
    r = spark.createDataFrame([("ann", "i1", 5, "text", False), ("bob", "i1", 3, "text", True)], "rater string, item string, score int, free_text string, has_personal_data boolean")
    key = spark.createDataFrame([("i1", "system-a")], "item string, system string")
    got = stores.prepare_release(r, key, "one", "two")
    assert got.count() == 1 and not {"rater", "free_text"} & set(got.columns)
    with pytest.raises(ValueError):
        stores.prepare_release(r, key, "one", "one")
