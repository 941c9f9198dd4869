from datetime import datetime, timedelta

import pytest

from quarrylens.operators import search as S
from quarrylens.operators.rates import aligned_windows, anchored_windows
from quarrylens.operators.traversal import Graph
from quarrylens.streaming import rates as R


def unit(i, j=None, w=0.0):
    v = [0.0] * 384
    v[i] = 1.0
    if j is not None:
        v[j] = w
    return v


@pytest.fixture(scope="module")
def world(spark):
    symbols = spark.createDataFrame(
        [("s1", "r", "paymentService", 1, "a.ts"), ("s2", "r", "helper", 5, "a.ts"), ("s3", "r", "other", 9, "b.ts"), ("f", "q", "paymentService", 1, "z.ts")],
        "id string, repository_id string, name string, start_line int, file_path string").withColumn("type", __import__("pyspark").sql.functions.lit("METHOD")).selectExpr(
        "*", "start_line + 2 AS end_line")
    edges = spark.createDataFrame([("e1", "r", "s1", "s2", "CALLS"), ("e2", "r", "s2", "s3", "CALLS")], "id string, repository_id string, source_symbol_id string, target_symbol_id string, type string")
    chunks = spark.createDataFrame(
        [("c1", "r", "s1", 1, unit(0)), ("c2", "r", "s2", 5, unit(0, 1, 1.0)), ("c3", "r", None, 9, unit(2)), ("c4", "r", "s3", 9, None), ("cq", "q", "f", 1, unit(0)), ("c5", "r", "s3", 1, [0.0] * 384)],
        "id string, repository_id string, symbol_id string, start_line int, vector array<double>")
    queries = spark.createDataFrame([("x", "r", "where is the payment", unit(0)), ("none", "r", "helpers", None)], "query_id string, repository_id string, text string, vector array<double>")
    return Graph(symbols, edges), chunks, queries


def test_semantic(world):
    _, chunks, queries = world
    got = [(r["query_id"], r["chunk_id"], round(r["similarity"], 4)) for r in S.semantic_top(queries, chunks, 2).orderBy("query_id", "rank").collect()]
    assert got == [("x", "c1", 1.0), ("x", "c2", 0.7071)]
    with pytest.raises(ValueError):
        S.semantic_top(queries, chunks, 0)


def test_names_and_structure(world):
    graph, chunks, queries = world
    names = {(r["query_id"], r["symbol_id"]): r["rank"] for r in S.name_matches(queries, graph.symbols).collect()}
    assert names == {("x", "s1"): 1, ("none", "s2"): 1}
    got = [r["evidence_id"] for r in S.structural_search(queries.filter("query_id = 'x'"), graph, chunks).orderBy("rank").collect()]
    assert sorted(got) == ["chunk:c1", "chunk:c2", "relationship:e1"]


def test_hybrid_and_packing(spark, world):
    graph, chunks, queries = world
    rows = {(r["query_id"], r["evidence_id"]): (r["provenance"], round(r["score"], 4)) for r in S.hybrid_evidence(queries, graph, chunks, k=1).collect()}
    assert rows["x", "chunk:c1"] == ("BOTH", 2.35) and rows["x", "chunk:c2"] == ("STRUCTURAL", 0.55) and rows["x", "relationship:e1"] == ("STRUCTURAL", 0.85)
    assert rows["none", "chunk:c2"] == ("STRUCTURAL", 0.8) and rows["none", "chunk:c4"] == ("STRUCTURAL", 0.55) and ("none", "chunk:cq") not in rows
    blocks = spark.createDataFrame([("q", "a", 3.0, "x" * 600), ("q", "b", 2.0, "x" * 500), ("q", "c", 1.0, "x" * 300), ("q", "d", 0.5, "x" * 5000), ("p", "a", 1.0, "😀" * 501)],
                                   "query_id string, evidence_id string, score double, block string")
    packed = [(r["query_id"], r["evidence_id"], r["chars_so_far"]) for r in S.pack_context(blocks, 1000).orderBy("query_id", "position").collect()]
    assert packed == [("q", "a", 600), ("q", "c", 902)]


def test_names_by_parts(spark, world):
    graph = world[0]
    asked = spark.createDataFrame([("a", "r", "pay_ent", None), ("b", "r", "a_b_c_d_", None), ("c", "r", "ervice helper", None), ("d", "r", "hel", None)],
                                  "query_id string, repository_id string, text string, vector array<double>")
    got = {(r["query_id"], r["symbol_id"]): r["rank"] for r in S.name_matches(asked, graph.symbols).collect()}
    assert got == {("a", "s1"): 1, ("c", "s2"): 1, ("c", "s1"): 2}


def test_search_modes(world):
    graph, chunks, queries = world
    def run(mode, depth=1):
        return {(r["query_id"], r["evidence_id"]): (r["semantic_available"], r["effective_depth"]) for r in S.search(queries, graph, chunks, mode, 2, depth).collect()}
    semantic = run("semantic")
    assert {e for q, e in semantic if q == "x"} == {"chunk:c1", "chunk:c2"} and semantic["x", "chunk:c1"] == (True, 1)
    assert semantic["none", "chunk:c1"] == (False, 1) and semantic["none", "relationship:e1"] == (False, 1)
    assert {v for v in run("structural").values()} == {(None, 1)}
    hybrid = run("hybrid", 4)
    assert hybrid["x", "chunk:c1"] == (True, 2) and hybrid["none", "chunk:c2"] == (False, 2)
    with pytest.raises(ValueError):
        S.search(queries, graph, chunks, "other")


def test_pruned_result(spark, world):
    graph, chunks, queries = world
    evidence = S.hybrid_evidence(queries, graph, chunks, k=1)
    packed = spark.createDataFrame([("x", "chunk:c1", 1, 100), ("x", "relationship:e2", 2, 150)], "query_id string, evidence_id string, position int, chars_so_far long")
    edges, symbols, summary = S.pruned_result(evidence.unionByName(evidence.filter("evidence_id = 'relationship:e1' AND query_id = 'x'").replace(
        "relationship:e1", "relationship:e2", ["evidence_id"])), packed, graph)
    assert [tuple(r) for r in edges.collect()] == [("x", "e2")]
    assert {tuple(r) for r in symbols.collect()} >= {("x", "s1"), ("x", "s2"), ("x", "s3")}
    got = {r["query_id"]: (r["n_selected"], r["context_chars"], r["truncated"]) for r in summary.collect()}
    assert got["x"] == (2, 150, True) and got["none"] == (0, 0, True)


def events(spark, rows):
    start = datetime(2026, 1, 1)
    return spark.createDataFrame([(i, None if s is None else start + timedelta(seconds=s), u) for i, s, u in rows], "event_id long, ts timestamp_ntz, user_id long")


def test_aligned_windows(spark):
    df = events(spark, [(1, 0, 7), (2, 30, 7), (3, 59, 7), (4, 60, 7), (5, 30, 8), (6, None, 8), (7, 30, 7), (8, 10, None)])
    got = {r["event_id"]: (r["request_no"], r["rejected"], r["retry_after"]) for r in aligned_windows(df, ["user_id"], 60, 2).collect()}
    assert got == {1: (1, False, 60), 2: (2, False, 30), 7: (3, True, 30), 3: (4, True, 1), 4: (1, False, 60), 5: (1, False, 30), 8: (1, False, 50)}


def brute(rows, width, limit):
    state, out = {}, {}
    for i, s, u in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        end, used = state.get(u, (-1, 0))
        if end <= s:
            end, used = s + width, 0
        out[i] = used >= limit
        state[u] = (end, used + (not out[i]))
    return out


def test_anchored_windows_match_loops_in_batch_and_stream(spark, tmp_path):
    rows = [(i, (i * 37) % 400, i % 3) for i in range(80)]
    df = events(spark, rows)
    want = brute(rows, 60, 2)
    assert {r["event_id"]: r["rejected"] for r in anchored_windows(df, "user_id", 60, 2).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "events.parquet")).selectExpr("event_id", "cast(ts as timestamp) ts", "user_id")
    assert {r["event_id"]: r["rejected"] for r in R.drain(R.anchored_limits(stream, "user_id", 60, 2)).collect()} == want
    counts = R.drain(R.window_counts(stream, ["user_id"], "1 minute", "1 second")).collect()
    assert sum(r["n_requests"] for r in counts) == sum(s < 360 for _, s, _ in rows)


def test_embedding_texts_hold_the_content(spark):
    from quarrylens.plans.retrieval import embedding_texts

    d = "/root/testdata/sf0.001"
    got = {r["id"]: r["embedding_text"] for r in embedding_texts(spark, d).collect()}
    delivered = {}
    for r in spark.read.parquet(f"{d}/code_chunks.parquet").select("id", "content").collect():
        delivered.setdefault((r["id"] or "").strip(" \t\r\n").lower(), set()).add(r["content"])
    assert got and all(t is None or t.split("\n\n", 1)[1] in delivered[i] for i, t in got.items())
    assert sum(t is None or t.endswith("\n\n*") for t in got.values()) <= sum(bool(v & {None, "*"}) for v in delivered.values())
