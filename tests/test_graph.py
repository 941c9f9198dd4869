import random

import pytest

from quarrylens.operators import traversal as T

SYMBOLS = "id string, repository_id string, file_path string, start_line int, name string, file_id string"
EDGES = "id string, repository_id string, source_symbol_id string, target_symbol_id string, type string"

# Two repositories: K holds a and d; a -> b -> c, d -> c, c -> a, e -> b, e -> d, importer -> c.
PLACES = [("K", "controller", 1), ("a", "controller", 2), ("d", "controller", 10), ("b", "service", 2), ("c", "repository", 3), ("e", "handler", 4),
          ("contract", "contracts", 1), ("impl", "implementation", 2), ("sub", "implementation", 8), ("importer", "isolated", 3), ("twin", "isolated", 7)]
LINKS = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("d", "c", "CALLS"), ("c", "a", "CALLS"), ("e", "b", "CALLS"), ("e", "d", "CALLS"),
         ("importer", "c", "CALLS"), ("importer", "c", "IMPORTS"), ("impl", "contract", "IMPLEMENTS"), ("sub", "impl", "EXTENDS")]


def make(spark, places, links, repo="A", extra=()):
    symbols = [(i, repo, f"src/{f}.ts", line, i, f) for i, f, line in places] + [("foreign", "B", "src/other.ts", 1, "foreign", "other")]
    edges = [(f"{t}-{s}-{d}", repo, s, d, t) for s, d, t in links] + list(extra)
    return T.Graph(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES))


@pytest.fixture(scope="module")
def graph(spark):
    return make(spark, PLACES, LINKS, extra=[("x", "B", "foreign", "c", "CALLS")])


def seeds(spark, *ids, col="symbol_id"):
    return spark.createDataFrame([(i, "A", i) for i in ids], f"query_id string, repository_id string, {col} string")


def hits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["symbol_id"]] = r["depth"]
    return out


def test_trace_batch(spark, graph):
    assert hits(T.trace(graph, seeds(spark, "a", "twin"), "OUTGOING", 2)) == {"a": {"b": 1, "c": 2}}
    assert hits(T.trace(graph, seeds(spark, "c"), "INCOMING", 2)) == {"c": {"b": 1, "d": 1, "importer": 1, "a": 2, "e": 2}}
    assert hits(T.trace(graph, seeds(spark, "foreign"), "INCOMING", 2)) == {}
    with pytest.raises(ValueError):
        T.trace(graph, seeds(spark, "a"), "OUTGOING", 6)
    with pytest.raises(ValueError):
        T.trace(graph, seeds(spark, "a"), "OUTGOING", 1, ["USES"])


def test_chains(spark, graph):
    got = {(r["query_id"], tuple(r["path"])) for r in T.chains(graph, seeds(spark, "e", "twin"), "OUTGOING", 3).collect()}
    assert got == {("e", p) for p in [("e", "b"), ("e", "d"), ("e", "b", "c"), ("e", "d", "c"), ("e", "b", "c", "a"), ("e", "d", "c", "a")]}
    assert all(len(r["path"]) == r["depth"] + 1 and r["path"][-1] == r["end_id"] for r in T.chains(graph, seeds(spark, "c"), "INCOMING", 5).collect())


def test_expand(spark, graph):
    s, e = T.expand(graph, seeds(spark, "a"), 1)
    assert {r["symbol_id"] for r in s.collect()} == {"a", "b", "c"} and e.count() == 2
    s, e = T.expand(graph, seeds(spark, "a"), 0)
    assert s.count() == 0 and e.count() == 0


def paths(spark, graph, pairs, **kw):
    q = spark.createDataFrame([(f"{a}>{b}", "A", a, b) for a, b in pairs], "query_id string, repository_id string, from_id string, to_id string")
    return {r["query_id"]: r for r in T.shortest_paths(graph, q, **kw).collect()}


def test_shortest_paths(spark, graph):
    got = paths(spark, graph, [("a", "c"), ("contract", "a"), ("a", "a"), ("a", "foreign")])
    assert [[s["i"] for s in p] for p in got["a>c"]["paths"]] == [["a", "b", "c"]]
    assert not got["contract>a"]["found"] and not got["contract>a"]["traversal_truncated"]
    assert got["a>a"]["path_length"] == 0 and "a>foreign" not in got
    both = paths(spark, graph, [("importer", "c")], types=["CALLS", "IMPORTS"], depth=1)["importer>c"]
    assert both["n_paths"] == 2


def brute_paths(edges, keys, start, goal, depth, budget, most):
    """The same search by loops: states in order of current node and path, edges in order of target, type, id."""
    out = {}
    for s, d, t, i in edges:
        out.setdefault(s, []).append((s, d, t, i))
    step = lambda n, t="", i="": (*keys[n], t, i)
    frontier = [(start, [step(start)])]
    left, truncated, found, more = budget, False, [], False
    for _ in range(depth):
        frontier.sort(key=lambda x: (keys[x[0]], x[1]))
        here = {x[0] for x in frontier}
        adjacent = sorted((e for n in here for e in out.get(n, [])), key=lambda e: (e[2], keys[e[0]], keys[e[1]], e[3]))
        has_more, adjacent = len(adjacent) > left, adjacent[:left]
        truncated |= has_more
        following = []
        for node, path in frontier:
            stop = False
            for e in sorted((e for e in adjacent if e[0] == node), key=lambda e: (keys[e[1]], e[2], e[3])):
                if left == 0:
                    truncated = stop = True
                    break
                left -= 1
                if any(p[3] == e[1] for p in path):
                    continue
                longer = [*path, step(e[1], e[2], e[3])]
                if e[1] == goal:
                    if len(found) < most:
                        found.append(longer)
                    else:
                        more = True
                else:
                    following.append((e[1], longer))
            if stop:
                break
        if found or truncated:
            break
        frontier = following
    return sorted(found), truncated, more


@pytest.mark.parametrize("budget", [10_000, 25, 7])
def test_shortest_paths_match_loops(spark, budget):
    rng = random.Random(budget)
    places = [(f"n{i}", f"f{rng.randint(0, 3)}", rng.randint(1, 4)) for i in range(14)]
    links = sorted({(f"n{rng.randint(0, 13)}", f"n{rng.randint(0, 13)}", rng.choice(["CALLS", "IMPORTS"])) for _ in range(45)})
    g = make(spark, places, links)
    keys = {i: (f"src/{f}.ts", line, i, i) for i, f, line in places}
    edges = [(s, d, t, f"{t}-{s}-{d}") for s, d, t in links]
    pairs = [("n0", "n5"), ("n1", "n9"), ("n2", "n13"), ("n3", "n7")]
    got = paths(spark, g, pairs, depth=4, types=["CALLS", "IMPORTS"], max_edges=budget, max_paths=2)
    for a, b in pairs:
        want, truncated, more = brute_paths(edges, keys, a, b, 4, budget, 2)
        r = got[f"{a}>{b}"]
        assert [[tuple(s) for s in p] for p in (r["paths"] or [])] == want, (a, b)
        assert (r["traversal_truncated"], r["alternatives_truncated"]) == (truncated, more), (a, b)


def test_impact(spark, graph):
    rows, flags = T.impact(graph, seeds(spark, "c", "contract", "impl", "twin"), 5)
    s = {(r["query_id"], r["symbol_id"]): r for r in T.affected_symbols(rows).collect()}
    assert {k[1] for k in s if k[0] == "c"} == {"a", "b", "d", "e", "importer"}
    assert s["c", "e"]["min_depth"] == 2 and s["c", "e"]["classification"] == "indirect"
    assert s["c", "importer"]["categories"] == "caller,importer" and s["c", "importer"]["scopes"] == "FILE,SYMBOL"
    e_paths = [[x["i"] for x in r["path"]] for r in rows.filter("query_id = 'c' AND symbol_id = 'e'").collect()]
    assert sorted(e_paths) == [["c", "b", "e"], ["c", "d", "e"]]
    assert {(r["query_id"], r["symbol_id"], r["category"]) for r in T.implementations(rows).collect()} == {
        ("contract", "impl", "implementor"), ("impl", "sub", "subclass")}
    files = {r["file_path"]: r for r in T.affected_files(rows.filter("query_id = 'c'"), graph.symbols).collect()}
    assert files["src/controller.ts"]["min_depth"] == 1 and files["src/controller.ts"]["n_symbols"] == 2
    assert not any(r["traversal_truncated"] for r in flags.collect())


def star(spark, n, kinds=("CALLS",)):
    places = [("t", "t", 1), *[(f"m{i}", "m", i + 1) for i in range(n)]]
    return make(spark, places, [(f"m{i}", "t", k) for k in kinds for i in range(n)])


@pytest.mark.parametrize(("n", "budget", "found", "cut"), [(3, 3, 3, False), (4, 3, 3, True), (2, 2, 2, False), (1, 0, 0, True)])
def test_impact_budget(spark, n, budget, found, cut):
    rows, flags = T.impact(star(spark, n), seeds(spark, "t"), 1, max_edges=budget)
    assert rows.count() == found and flags.first()["traversal_truncated"] == cut


def test_impact_result_cap_and_evidence_paths(spark):
    rows, flags = T.impact(star(spark, 4), seeds(spark, "t"), 1, max_results=3)
    assert rows.count() == 3 and flags.first()["results_truncated"]
    rows, flags = T.impact(star(spark, 3), seeds(spark, "t"), 1, max_results=3)
    assert rows.count() == 3 and not flags.first()["results_truncated"]
    places = [("t", "t", 1), ("shared", "s", 1), *[(f"m{i}", "m", i + 1) for i in range(6)]]
    g = make(spark, places, [(f"m{i}", "t", "CALLS") for i in range(6)] + [("shared", f"m{i}", "CALLS") for i in range(6)])
    rows, flags = T.impact(g, seeds(spark, "t"), 2)
    f = flags.first()
    assert rows.filter("symbol_id = 'shared'").count() == 5 and f["evidence_truncated"] and f["traversal_truncated"] and not f["results_truncated"]
    two = star(spark, 2, ("CALLS", "IMPORTS"))
    rows, flags = T.impact(two, seeds(spark, "t"), 1, max_edges=3)
    assert rows.count() == 3 and flags.first()["traversal_truncated"]
