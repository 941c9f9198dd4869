import random
from datetime import datetime

import pytest

from quarrylens.operators.hierarchy import all_descendants, build_hierarchy, descendants
from quarrylens.operators.orphans import code_orphans, orphan_report
from quarrylens.operators.records import canonical_id, latest_versions

T = lambda d: datetime(2026, 1, d)
REL = "id string, repository_id string, source_symbol_id string, target_symbol_id string, type string, ingested_at timestamp_ntz, reason string, parent_id string"
CHUNK = "id string, repository_id string, symbol_id string, file_id string, ingested_at timestamp_ntz, is_deleted string"
SYM = "id string, repository_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, _v string"


def brute(parents):
    """root, depth of every node by walking up."""
    out = {}
    for start in parents:
        path = [start]
        while True:
            up = parents[path[-1]]
            if up is None or up not in parents:
                out[start] = (path[-1], len(path) - 1)
                break
            if up in path:
                out[start] = (min(path[path.index(up):]), -1)
                break
            path.append(up)
    return out


@pytest.mark.parametrize("seed", [0, 3, 1000])
def test_hierarchy_matches_walking_up(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(60)]
    parents = {n: rng.choice([None, "gone", *names]) if rng.random() < 0.3 else names[max(0, i - rng.randint(1, 3))] for i, n in enumerate(names)}
    rows = [(n, p, "x", 1) for n, p in parents.items()]
    df = spark.createDataFrame(rows, "id string, parent_id string, path string, size int")
    got = {r["id"]: r for r in build_hierarchy(df).collect()}
    assert {k: (v["root_id"], v["depth"]) for k, v in got.items()} == brute(parents)
    for r in got.values():
        if r["depth"] >= 0:
            assert r["path"][0] == r["root_id"] and r["path"][-1] == r["id"] and len(r["path"]) == r["depth"] + 1
    # nested ranges say the same as the paths
    for a in got.values():
        inside = {b["id"] for b in got.values() if b["tree_id"] == a["tree_id"] and a["lft"] < b["lft"] <= a["rgt"]}
        assert len(inside) == a["n_descendants"]
        if a["depth"] >= 0:
            assert inside == {b["id"] for b in got.values() if b["path"] and a["id"] in b["path"] and b["id"] != a["id"]}


def test_hierarchy_edge_cases(spark):
    schema = "id string, parent_id string"
    assert build_hierarchy(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", "a"), ("b", "a"), (None, "a"), ("c", None), ("d", "c"), ("d", "c")]
    got = {r["id"]: (r["root_id"], r["depth"]) for r in build_hierarchy(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("a", -1), "b": ("a", -1), "c": ("c", 0), "d": ("c", 1)}
    deep = [(f"{i:04d}", f"{i - 1:04d}" if i else None) for i in range(150)]
    tree = build_hierarchy(spark.createDataFrame(deep, schema))
    assert tree.agg({"depth": "max"}).first()[0] == 149
    wide = [("r", None), *[(f"w{i}", "r") for i in range(500)]]
    hot = build_hierarchy(spark.createDataFrame(wide, schema))
    assert sorted(r["lft"] for r in hot.collect()) == list(range(501))
    assert descendants(hot).count() == 500


def orphans(spark, rel=(), chunks=(), symbols=(), files=()):
    return code_orphans(spark.createDataFrame(list(rel), REL), spark.createDataFrame(list(chunks), CHUNK),
                        spark.createDataFrame(list(symbols), SYM), spark.createDataFrame(list(files), SYM))


def test_orphans_by_reason(spark):
    symbols = [("S1", "r", T(1), None, ""), ("dead", "r", T(1), None, ""), ("dead", "r", T(3), T(2), ""), ("other", "q", T(1), None, ""),
               ("late", "r", T(9), None, ""), ("back", "r", T(1), T(1), ""), ("back", "r", T(2), None, "")]
    rel = [("E1", "r", " s1\t", "dead", "CALLS", T(5), "", ""), ("e2", "R", "other", "LATE", "CALLS", T(5), "", ""),
           ("e3", "r", "back", None, "CALLS", T(5), "", ""), ("e4", "r", "", "s1", "CALLS", T(5), "", ""),
           ("e4", "r", "nowhere", "s1", "CALLS", T(4), "", ""), ("e5", None, "s1", "s1", "CALLS", T(5), "", "")]
    chunks = [("c1", "r", None, "f1", T(5), ""), ("c2", "r", "s1", "f2", T(5), ""), ("c2", "r", "s1", "f2", T(5), "")]
    got = {(r["record_id"], r["field_name"]): r["reason"] for r in orphans(spark, rel, chunks, symbols, [("F1", "r", T(5), None, "")]).collect()}
    assert got == {
        ("e1", "target_symbol_id"): "deleted", ("e2", "source_symbol_id"): "foreign", ("e2", "target_symbol_id"): "late",
        ("e4", "source_symbol_id"): "missing", ("e5", "source_symbol_id"): "foreign", ("e5", "target_symbol_id"): "foreign",
        ("c2", "file_id"): "missing"}


def test_orphans_null_times_and_empty_tables(spark):
    assert orphans(spark).count() == 0
    assert orphan_report(orphans(spark)).count() == 0
    rel = [("e1", "r", "s1", "s1", "CALLS", None, "", "")]
    got = orphans(spark, rel, [], [("s1", "r", T(1), None, "")]).collect()
    assert {r["reason"] for r in got} == {"late"} and len(got) == 2
    assert orphans(spark, rel).count() == 2


def test_hot_parent(spark):
    rel = [(f"e{i}", "r", "hot", "gone" if i % 3 else "hot", "CALLS", T(5), "", "") for i in range(300)]
    got = orphans(spark, rel, [], [("hot", "r", T(1), None, "")])
    assert got.count() == 200


def test_latest_versions_and_ids(spark):
    rows = [("A ", 1, T(1)), ("a", 2, T(2)), ("\ta", 3, T(2)), (None, 4, T(3)), ("b", None, None)]
    df = spark.createDataFrame(rows, "id string, x int, ingested_at timestamp_ntz").withColumn("id", canonical_id("id"))
    got = {r["id"]: (r["x"], r["arrived_at"]) for r in latest_versions(df, ["x"]).collect()}
    assert got == {"a": (3, T(1)), "b": (None, None)}


def test_descendants_behind_cycles(spark):
    """A parent on a cycle keeps its pairs with the nodes behind it; as many pairs as the nested ranges count."""
    rows = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("e", "d"), ("r", None), ("s", "r")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string")
    got = {tuple(r) for r in all_descendants(nodes).collect()}
    assert got == {("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("c", "d", 1), ("c", "e", 2), ("d", "e", 1), ("r", "s", 1)}
    assert len(got) == build_hierarchy(nodes).agg({"n_descendants": "sum"}).first()[0]
