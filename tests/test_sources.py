from datetime import datetime

import pytest

from quarrylens.functions.text import (
    HashingEmbeddings, RetryingEmbeddings, UpstreamError, ask, check_embedding, clean_answer, clean_url, embed_query, hashed_client, json_rows, normal_path,
    query_tokens, upstream_status)
from quarrylens.sources.discovery import Limits, TooLarge, discover
from quarrylens.sources.indexing import index_repository
from quarrylens.sources.parse import build_chunks, extract, split_large
from quarrylens.sources.store import InvalidRows, Store

BASE = '''package app;
public class Base { public void shared() { } protected void only() { } }
'''
SERVICE = '''package app;
import app.Base;
import app.Missing;
import java.util.*;
public class Service extends Base implements Runnable, Port {
    private int a = 1, b;
    public Service() { helper(); }
    public void run() { helper(); only(); only(); unknownName(); new Base(); }
    void helper() {
        Runnable r = new Runnable() {
            public void go() { shared(); }
        };
    }
}
interface Port { void open(); }
'''
TS = '''import thing, { helper as h, missing } from "./lib/util";
import * as all from "react";
export const view = (x: number) => { helper(x); this.draw(x); };
function draw(a) { return a; }
'''
UTIL = '''export default function thing() { return helper(1); }
export function helper(a) { return a; }
'''


def facts(path, text, tag):
    return [f for f in extract(path, text) if f.tag == tag]


def test_java_facts():
    s = {(f.name, f.kind, f.parent) for f in facts("A.java", SERVICE, "symbol")}
    assert s == {("Service", "CLASS", None), ("a", "FIELD", "Service"), ("b", "FIELD", "Service"), ("Service", "CONSTRUCTOR", "Service"), ("run", "METHOD", "Service"),
                 ("helper", "METHOD", "Service"), ("go", "METHOD", "Service"), ("Port", "INTERFACE", None), ("open", "METHOD", "Port")}
    assert [f.name for f in facts("A.java", SERVICE, "call")] == ["helper", "helper", "only", "only", "unknownName", "shared"]
    assert [(f.name, f.kind, f.parent) for f in facts("A.java", SERVICE, "heritage")] == [
        ("Base", "EXTENDS", "Service"), ("Runnable", "IMPLEMENTS", "Service"), ("Port", "IMPLEMENTS", "Service")]
    assert [f.text for f in facts("A.java", SERVICE, "import")] == ["app.Base", "app.Missing"]


def test_script_facts():
    assert {(f.name, f.kind) for f in facts("a.ts", TS, "symbol")} == {("view", "FUNCTION"), ("draw", "FUNCTION")}
    assert [(f.name, f.kind) for f in facts("a.ts", TS, "import")] == [("thing", "DEFAULT"), ("helper", "NAMED"), ("missing", "NAMED"), ("all", "NAMESPACE")]
    assert [f.name for f in facts("a.ts", TS, "call")] == ["helper", "draw"]
    assert facts("a.js", UTIL, "symbol")[0].extra == "default"
    assert extract("a.py", "def f(): pass") == [] and extract(None, None) == [] and extract("a.ts", "") == []
    assert facts("a.ts", "((({{{", "symbol") == []


def test_chunks():
    assert [(c.name, c.kind) for c in facts("A.java", SERVICE, "chunk")][:4] == [("Service", "CLASS"), ("a", "FIELD"), ("Service", "CONSTRUCTOR"), ("run", "METHOD")]
    long = "function big() {\n" + "  work();\n" * 170 + "\n" + "  more();\n" * 250 + "}\n"
    parts = facts("a.js", long, "chunk")
    assert len(parts) > 1 and all(p.end_line - p.start_line < 180 and p.name == "big" for p in parts)
    assert parts[0].end_line == 172
    assert build_chunks("// only\nimport x;\n", []) == []
    assert split_large(["a"] * 400, 1) == [(1, 180), (181, 360), (361, 400)]
    assert [c.kind for c in facts("a.js", "start();\n", "chunk")] == ["FILE"]


def write(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    write(root, {"app/Base.java": BASE, "app/Service.java": SERVICE, "web/main.ts": TS, "web/lib/util.js": UTIL, "node_modules/x.js": "bad(", "README.md": "x", "dist/y.ts": "z"})
    return root


def test_discovery(spark, tree):
    got = {r["path"]: r["language"] for r in discover(spark, str(tree)).collect()}
    assert got == {"app/Base.java": "java", "app/Service.java": "java", "web/main.ts": "typescript", "web/lib/util.js": "javascript"}
    with pytest.raises(TooLarge):
        discover(spark, str(tree), max_files=3)
    for limits in (Limits(bytes=10), Limits(file_bytes=10), Limits(entries=3), Limits(seconds=-1.0)):
        with pytest.raises(TooLarge):
            discover(spark, str(tree), limits=limits)
    (tree / "web" / "bad.js").write_bytes(b"let a = '\xff';\n")
    (tree / "web" / "UPPER.TS").write_text("let b = 1;\n")
    (tree / "web" / "link.js").symlink_to(tree / "web" / "bad.js")
    got = {r["path"]: (r["content"], r["is_valid_utf8"]) for r in discover(spark, str(tree), limits=Limits(follow_links=False)).collect()}
    assert got["web/bad.js"] == ("let a = '\ufffd';\n", False) and got["web/UPPER.TS"][1] and "web/link.js" not in got
    assert discover(spark, "file://" + str(tree)).count() == 7
    empty = tree.parent / "empty"
    empty.mkdir()
    assert discover(spark, str(empty)).count() == 0


def test_calls_over_type_arguments_and_in_templates():
    text = "function a() {\n  foo<Bar>(x);\n  const s = `v ${baz(1)} ${`n ${deep()}`}`;\n  if (a) /\"/.test(y);\n  last(\"z\");\n  if (i < n && k > (m)) z();\n}\n"
    assert sorted((f.name, f.start_line) for f in facts("a.ts", text, "call")) == [("baz", 3), ("deep", 3), ("foo", 2), ("last", 5), ("test", 4), ("z", 6)]


def test_indexing_end_to_end(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = index_repository(spark, store, "demo", str(tree), "2026-01-01 00:00:00")
    second = index_repository(spark, store, "demo", str(tree), "2026-01-02 00:00:00")
    assert first == second and first["files"] == 4
    names = {r["id"]: r["name"] for r in store.read("symbols").collect()}
    edges = {(names[r["source_symbol_id"]], r["type"], names[r["target_symbol_id"]]) for r in store.read("relationships").collect()}
    assert edges >= {("run", "CALLS", "helper"), ("run", "CALLS", "only"), ("Service", "EXTENDS", "Base"), ("Service", "IMPLEMENTS", "Port"), ("Service", "IMPORTS", "Base"),
                     ("view", "IMPORTS", "thing"), ("view", "IMPORTS", "helper"), ("view", "CALLS", "draw"), ("thing", "CALLS", "helper"), ("go", "CALLS", "shared")}
    # helper is defined twice, so the call from another file stays open; a constructor is never a source
    assert ("view", "CALLS", "helper") not in edges and not any(s == "helper" and t == "CALLS" for s, t, _ in edges)
    parents = {r["name"]: names.get(r["parent_symbol_id"]) for r in store.read("symbols").collect()}
    assert parents["run"] == "Service" and parents["Base"] is None
    other = index_repository(spark, store, "second", str(tree), "2026-01-03 00:00:00")
    assert store.table_sizes(other["repository_id"])["symbols"] == first["symbols"]
    rid = first["repository_id"]
    heads = [r["text"] for r in store.missing_texts(rid).collect()]
    assert len(heads) == first["chunks"] and all(h.startswith("File: ") and "\n\n" in h for h in heads)

    class Down:
        def embed(self, texts, purpose):
            raise RuntimeError("service is down")

    broken = store.generate_missing(rid, Down(), batch=2)
    assert broken["created"] == 0 and broken["failed"] == broken["processed"] > 0 and broken["failures"][0][1] == "service is down"
    done = store.generate_missing(rid, HashingEmbeddings())
    assert done["created"] == first["chunks"] and store.generate_missing(rid, HashingEmbeddings())["processed"] == 0
    assert store.clear_embeddings(rid) == first["chunks"]
    store.delete_repository(rid)
    assert store.table_sizes(rid) == {"files": 0, "symbols": 0, "relationships": 0, "code_chunks": 0}
    assert store.table_sizes(other["repository_id"])["symbols"] == first["symbols"] and store.read("repositories").count() == 1


def test_store_rules(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("r", "a.ts", "typescript", 5), ("r", "a.ts", "typescript", 7), ("q", "a.ts", None, None)], "repository_id string, path string, language string, size long")
    store.save_files(files)
    store.save_files(files.filter("repository_id = 'r'").limit(0).unionByName(spark.createDataFrame([("r", "b.ts", "typescript", 1)], files.schema)))
    kept = {(r["repository_id"], r["path"]): (r["id"], r["size"]) for r in store.read("files").collect()}
    assert set(kept) == {("r", "a.ts"), ("r", "b.ts"), ("q", "a.ts")} and kept["r", "a.ts"][1] == 7
    edges = spark.createDataFrame([("x", "y", "CALLS")] * 3, "source_symbol_id string, target_symbol_id string, type string")
    assert store.replace_relationships("r", edges) == 1 and store.replace_relationships("r", edges.limit(0)) == 0
    fid = kept["r", "a.ts"][0]
    schema = "file_id string, symbol_id string, start_line int, end_line int, content string"
    assert store.replace_chunks("r", spark.createDataFrame([(fid, None, 1, 2, "a"), (fid, None, 1, 2, "a")], schema)) == 1
    for bad in [(kept["q", "a.ts"][0], None, 1, 2, "a"), (fid, "nope", 1, 2, "a"), (fid, None, 3, 2, "a"), (fid, None, 1, 2, " ")]:
        with pytest.raises(InvalidRows):
            store.replace_chunks("r", spark.createDataFrame([bad], schema))
    assert store.read("code_chunks").count() == 1
    cid = store.read("code_chunks").first()["id"]
    vec = lambda *v: spark.createDataFrame([(cid, list(v))], "id string, embedding array<float>")
    with pytest.raises(InvalidRows):
        store.save_embeddings("r", vec(0.0, 0.0), 2)
    assert store.save_embeddings("q", vec(1.0, 0.0), 2) == 0 and store.save_embeddings("r", vec(1.0, 0.0), 2) == 1 and store.save_embeddings("r", vec(0.0, 1.0), 2) == 0
    assert store.get_or_create_repository("n", "u", "2026-01-01") == store.get_or_create_repository("n", "u", "2026-02-01") != store.get_or_create_repository("n", None, "2026-01-01")


def test_text_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Find Services for user_name in classes", "a/./b\\..//c.ts"), (None, None), ("", "")], "q string, p string")
    got = df.select(query_tokens(F.col("q")).alias("t"), normal_path(F.col("p")).alias("n")).collect()
    assert got[0]["t"] == ["find", "services", "service", "for", "user_name", "in", "classes", "classe"] and got[0]["n"] == "a/c.ts"
    assert got[1]["n"] is None and got[2]["n"] == "" and got[2]["t"] == []
    assert clean_url("https://u:p@h.example:8080/x?token=1&a=2#f") == "https://h.example:8080/x?a=2"
    assert "403" in upstream_status("provider said 403 with key=abc") and "abc" not in upstream_status("provider said 403 with key=abc")
    assert clean_url("https://h.example/x?client_secret=1&access_key=2&b=3") == "https://h.example/x?b=3"
    assert clean_url("git@host.example:a/b.git?token=x#y") == "git@host.example:a/b.git" and clean_url("no address") == "[hidden-url]"
    assert clean_url("ssh://git:pw@h.example/x") == "ssh://git@h.example/x" and clean_url("https://h:bad/x") == "[hidden-url]"
    assert hashed_client("1.2.3.4", "s") == hashed_client("1.2.3.4", "s") != hashed_client(None, "s") and len(hashed_client("a", "b")) == 64
    assert [r["json"] for r in json_rows(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == ['{"a":1,"b":null}']


CHUNK_EVIDENCE = {"id": "chunk:1", "kind": "CHUNK", "symbol": "run", "path": "a.ts", "start": 1, "end": 2}
EDGE_EVIDENCE = {"id": "relationship:2", "kind": "RELATIONSHIP", "symbol": "run", "path": "a.ts", "start": 1, "end": 2}


def test_answers():
    said = clean_answer("See [chunk:1], [relationship:2]  and [chunk:9] in a.ts:4.", [CHUNK_EVIDENCE, EDGE_EVIDENCE])
    assert said == "See [chunk:1], [relationship:2] and in .\n\nVerified sources:\n- [1] run — a.ts:1-2"

    class Echo:
        asked = 0

        def generate(self, system, prompt):
            self.asked += 1
            return "yes"

    llm = Echo()
    empty = ask("q", [], "", llm)
    assert empty["insufficient_evidence"] and empty["citations"] == [] and llm.asked == 0
    got = ask("q", [EDGE_EVIDENCE, CHUNK_EVIDENCE], "x", llm)
    assert got["answer"].endswith("- [1] run — a.ts:1-2") and [c["id"] for c in got["citations"]] == ["chunk:1"] and llm.asked == 1


def test_retrying_embeddings():
    answers: list = [OSError("reset by peer, key=K"), UpstreamError("busy K", 429, 3.0), [[1.0], [2.0]]]
    seen, waits = [], []

    def send(texts, timeout):
        seen.append(texts)
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    provider = RetryingEmbeddings(send, "K", wait=waits.append)
    assert provider.embed(["a", "b"], "query") == [[1.0], [2.0]] and waits == [0.25, 3.0] and seen[0][0] == "task: code retrieval | query: a"
    assert provider.embed([]) == []
    for failures, status in (([UpstreamError("no K", 403)], 403), ([UpstreamError("later", 503, 500.0)], 503), ([OSError("K down")] * 3, None)):
        answers[:] = failures
        with pytest.raises(UpstreamError) as error:
            provider.embed(["a"])
        assert error.value.status == status and "K" not in str(error.value) and not answers
    answers[:] = [[[1.0, 0.0]]]
    assert embed_query(provider, "x", 2) == [1.0, 0.0]
    answers[:] = [[[0.0, 0.0]]]
    with pytest.raises(ValueError):
        embed_query(provider, "x", 2)


def test_vectors():
    v = HashingEmbeddings().embed(["loadSession twice", ""])
    assert all(abs(sum(x * x for x in e) - 1) < 1e-9 for e in v) and check_embedding(v[0]) == v[0]
    with pytest.raises(ValueError):
        check_embedding([0.0] * 384)
