import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlens.operators import chains, graph, variables
from flowlens.session import shared_dir


def random_graph(seed, n=14, m=22, acyclic=True):
    rng = random.Random(seed)
    edges = []
    for _ in range(m):
        a, b = rng.sample(range(n), 2)
        edges.append((min(a, b), max(a, b)) if acyclic else (a, b))
    return [f"n{i}" for i in range(n)], [(f"n{a}", f"n{b}") for a, b in edges]


def closure_of(nodes, edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    hops = {}
    for s in nodes:
        seen, frontier, d = {s}, [s], 0
        while frontier:
            d += 1
            frontier = sorted({y for x in frontier for y in out[x]} - seen)
            seen |= set(frontier)
            for y in frontier:
                hops[(s, y)] = d
    return hops


def test_closure_matches_breadth_first(spark, make_connections):
    for seed, acyclic in ((1, True), (2, False)):
        nodes, edges = random_graph(seed, acyclic=acyclic)
        e = graph.edges_of(make_connections([("t", a, b) for a, b in edges]))
        for stride in (1, 4):
            got = {(r["src"], r["dst"]): r["hops"] for r in graph.closure(e, stride=stride).collect()}
            assert got == closure_of(nodes, edges)
        capped = {(r["src"], r["dst"]) for r in graph.closure(e, max_hops=2).collect()}
        assert capped == {k for k, d in closure_of(nodes, edges).items() if d <= 2}


def test_cycle_pairs(spark, make_connections):
    e = graph.edges_of(make_connections([("t", "a", "b"), ("t", "b", "c"), ("t", "c", "a"), ("t", "c", "d")]))
    assert {(r["node_a"], r["node_b"]) for r in graph.cycle_pairs(e).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_components_match_mutual_reachability(spark, make_connections):
    rows, want = [], set()
    for seed in range(4):
        nodes, edges = random_graph(seed, n=16, m=24, acyclic=False)
        rows += [(f"t{seed}", a, b) for a, b in edges] + [(f"t{seed}", "n0", "n0")]
        hops = closure_of(nodes, edges)
        for x in nodes:
            group = sorted({x} | {y for y in nodes if (x, y) in hops and (y, x) in hops})
            if len(group) > 1:
                want.add((f"t{seed}", group[0], len(group), tuple(group)))
    ring = [f"r{i:03}" for i in range(70)]
    rows += [("ring", a, b) for a, b in zip(ring, ring[1:] + ring[:1])] + [("dag", a, b) for a, b in zip(ring, ring[1:])]
    want.add(("ring", "r000", 70, tuple(ring)))
    edges = graph.edges_of(make_connections(rows))
    got = {(r["template"], r["component"], r["size"], tuple(r["members"])) for r in graph.cycles(edges).collect()}
    assert got == want
    pairs = {tuple(r) for r in graph.cycle_pairs(edges).collect()}
    assert pairs == {(t, a, b) for t, _, _, group in want for i, a in enumerate(group) for b in group[i + 1:]}
    assert graph.cycles(edges.limit(0)).collect() == [] and graph.longest_paths(edges.limit(0)).collect() == []


def test_components_walk_only_templates_with_a_way_back(spark, make_connections):
    names = [f"p{i}" for i in range(8, 13)]
    dag = [("dag", a, b) for a, b in zip(names, names[1:])]
    ring = [("ring", a, b) for a, b in zip(names, names[1:] + names[:1])]
    edges = graph.edges_of(make_connections(dag + ring))
    assert {tuple(r) for r in graph._turning(edges.select("template", "src", "dst")).collect()} == set(ring)


def simple_paths_of(edges, start, limit):
    out, found = defaultdict(list), []
    for a, b in edges:
        out[a].append(b)

    def walk(path):
        found.append(tuple(path))
        if len(path) < limit:
            for nxt in out[path[-1]]:
                if nxt not in path:
                    walk(path + [nxt])

    walk([start])
    return sorted(found)


def test_simple_paths_match_depth_first(spark, make_connections):
    nodes, edges = random_graph(5, n=9, m=16, acyclic=False)
    e = graph.edges_of(make_connections([("t", a, b) for a, b in edges]))
    starts = spark.createDataFrame([("t", "n0"), ("t", "n3")], "template string, start string")
    for stride, limit in ((1, 6), (3, 6), (4, 20)):
        got = sorted((r["start"], tuple(r["path"])) for r in graph.simple_paths(e, starts, limit, stride).collect())
        want = sorted((s, p) for s in ("n0", "n3") for p in simple_paths_of(edges, s, limit))
        assert got == want


def test_longest_paths_on_acyclic_and_cyclic_graphs(spark, make_connections):
    rows = [("t", "a", "b"), ("t", "b", "c"), ("t", "a", "c"), ("t", "x", "c"), ("u", "p", "q"), ("u", "q", "r"), ("u", "r", "p")]
    edges = graph.edges_of(make_connections(rows)).select("template", "src", "dst")
    got = [(r["template"], r["path"], r["nodes"], r["hops"]) for r in graph.longest_paths(edges).orderBy("template", "rank").collect()]
    assert got == [("t", ["a", "b", "c"], 3, 2), ("u", ["p", "q", "r"], 3, 2), ("u", ["q", "r", "p"], 3, 2), ("u", ["r", "p", "q"], 3, 2)]


def test_longest_paths_match_depth_first(spark, make_connections):
    rows, want = [], set()
    for seed in range(5):
        nodes, edges = random_graph(seed, n=10, m=15, acyclic=seed == 0)
        edges = sorted(set(edges))
        rows += [(f"t{seed}", a, b) for a, b in edges]
        paths = {p for x in nodes for p in simple_paths_of(edges, x, 99)}
        most = max(map(len, paths))
        want |= {(f"t{seed}", p) for p in paths if len(p) == most}
    edges = graph.edges_of(make_connections(rows))
    assert {(r["template"], tuple(r["path"])) for r in graph.longest_paths(edges).collect()} == want


def test_only_the_farthest_pairs_are_made_longer(spark, make_connections, monkeypatch):
    seen = []
    plain = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    rows = [("t", f"n{i}", f"n{i + d}") for i in range(20) for d in (1, 5)]
    near = graph.hop_table(graph.edges_of(make_connections(rows)), 8)
    assert all(re.search(rf"hops#\d+ = {width}\)", seen[-1]) for width in (1, 2, 4))
    want = {(f"n{a}", f"n{a + d}"): d // 5 + d % 5 for a in range(20) for d in range(1, 25) if a + d < 25 and d // 5 + d % 5 <= 8}
    got = {(r["src"], r["dst"]): r["hops"] for r in near.collect()}
    assert {k: v for k, v in got.items() if int(k[1][1:]) < 20} == {k: v for k, v in want.items() if int(k[1][1:]) < 20}


def test_tables_that_grow_stay_off_the_driver(spark, make_connections):
    edges = graph.edges_of(make_connections([("t", "a", "b"), ("t", "b", "c"), ("u", "p", "q"), ("u", "q", "p")]))
    for rows in (graph.components(edges), graph._path_bounds(edges.select("template", "src", "dst"), 4), graph.longest_paths(edges)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def ladder(rungs):
    """Two ways from each rung to the next: 2 ** rungs paths."""
    return [("t", a, b) for i in range(rungs) for a, b in
            ((f"s{i}", f"x{i}"), (f"s{i}", f"y{i}"), (f"x{i}", f"s{i + 1}"), (f"y{i}", f"s{i + 1}"))]


def test_flows_only_follow_edges_towards_users(spark, make_connections, make_processors, monkeypatch):
    names = sorted({x for _, a, b in ladder(20) for x in (a, b)})
    set_at = {"s0": ("UpdateAttribute", {"v": "1", "w": "2"})}
    written, counted = [], graph.cut_counted

    def counting(df, where="true"):
        rows, n = counted(df, where)
        written.append(rows.count())
        return rows, n

    monkeypatch.setattr(graph, "cut_counted", counting)
    monkeypatch.setattr(graph, "cut", lambda df: counting(df)[0])
    for use, want in (({}, []), ({"x1": {"q": "${w}"}}, [("s0", "x0", "s1", "x1"), ("s0", "y0", "s1", "x1")])):
        rows = [("t", x, x, *(set_at.get(x, ("X", use.get(x, {})))[:1]), "Root", set_at.get(x, ("X", use.get(x, {})))[1]) for x in names]
        written.clear()
        got = sorted(tuple(r["flow_chain"]) for r in variables.flows(make_processors(rows), make_connections(ladder(20))).collect())
        assert got == want and sum(written) < 1000


def test_flows_match_plain_search(spark, make_connections, make_processors):
    for seed in range(3):
        nodes, edges = random_graph(seed, n=9, m=14, acyclic=False)
        edges = sorted(set(edges))
        setters, users = {"v": nodes[:2], "w": nodes[1:3]}, {"v": nodes[4:7], "w": [nodes[2], nodes[8]]}
        rows = []
        for x in nodes:
            props = {v: "1" for v in "vw" if x in setters[v]} | {f"use {v}": f"${{{v}}}" for v in "vw" if x in users[v]}
            rows.append(("t", x, x, "UpdateAttribute" if any(x in s for s in setters.values()) else "X", "Root", props))
        p, c = make_processors(rows), make_connections([("t", a, b) for a, b in edges])
        got = sorted((r["variable"], tuple(r["flow_chain"])) for r in variables.flows(p, c).collect())
        d = {(r["variable"], r["processor_id"]) for r in variables.definitions(p).collect()}
        u = {(r["variable"], r["processor_id"]) for r in variables.usages(p).collect()}
        assert got == sorted((v, path) for v, x in d for path in simple_paths_of(edges, x, 99) if (v, path[-1]) in u)


def test_group_paths(spark):
    rows = [("t", "1", "A", None), ("t", "2", "B", "1"), ("t", "3", "C", "2"), ("t", "4", "D", "gone")]
    g = spark.createDataFrame(rows, "template string, group_id string, name string, parent_id string")
    assert {r["group_id"]: r["path"] for r in graph.group_paths(g).collect()} == {"1": "A", "2": "A/B", "3": "A/B/C", "4": "D"}


def resolve(edges, own, node, cache=None, visiting=None):
    """Reference semantics: merge upstream in connection order, then own values."""
    cache = {} if cache is None else cache
    visiting = visiting or set()
    if node in cache:
        return cache[node]
    if node in visiting:
        return {}
    out = {}
    for a, b in edges:
        if b == node:
            out.update(resolve(edges, own, a, cache, visiting | {node}))
    out.update(own.get(node, {}))
    cache[node] = out
    return out


def test_variable_resolution_last_incoming_wins(spark, make_connections, make_processors):
    nodes, edges = random_graph(11, n=16, m=28)
    own = {"n0": {"v": "0"}, "n1": {"v": "1", "w": "w1"}, "n4": {"v": "4"}, "n7": {"w": "w7"}}
    p = make_processors([("t", x, x, "UpdateAttribute", "Root", own.get(x, {})) for x in nodes])
    got = graph.resolve_variables(variables.literals(variables.definitions(p)), make_connections([("t", a, b) for a, b in edges]), p).collect()
    want = {(n, v): x for n in nodes for v, x in resolve(edges, own, n).items()}
    assert {(r["processor_id"], r["variable"]): r["value"] for r in got} == want


def test_variable_resolution_ends_on_cycles(spark, make_connections, make_processors):
    p = make_processors([("t", x, x, "UpdateAttribute", "Root", {"v": "1"} if x == "a" else {}) for x in "abcd"])
    c = make_connections([("t", "a", "b"), ("t", "c", "b"), ("t", "b", "c"), ("t", "d", "d")])
    got = {r["processor_id"]: r["value"] for r in graph.resolve_variables(variables.literals(variables.definitions(p)), c, p).collect()}
    assert got == {"a": "1", "b": "1", "c": "1"}


def test_flattened_edges_through_ports(spark, make_connections, make_processors):
    p = make_processors([("t", x, x, "X", "Root", {}) for x in "abcd"])
    c = make_connections([
        ("t", "a", "in1", "PROCESSOR", "INPUT_PORT"), ("t", "in1", "b", "INPUT_PORT", "PROCESSOR"),
        ("t", "b", "out1", "PROCESSOR", "OUTPUT_PORT"), ("t", "out1", "c", "OUTPUT_PORT", "PROCESSOR"),
        ("t", "b", "out2", "PROCESSOR", "OUTPUT_PORT"), ("t", "out2", "in2", "OUTPUT_PORT", "INPUT_PORT"), ("t", "in2", "d", "INPUT_PORT", "PROCESSOR"),
        ("t", "a", "d"),
    ])
    pairs = lambda mode: sorted((r["src"], r["dst"], r["via_port"]) for r in graph.flattened_edges(c, p, mode).fillna("").collect())
    assert pairs("ports") == [("a", "b", "in1"), ("a", "d", ""), ("b", "c", "out1")]
    assert pairs("closure") == [("a", "b", "in1"), ("a", "d", ""), ("b", "c", "out1"), ("b", "d", "out2")]


def chains_of(order, edges):
    """Reference rules: follow single links from nodes without parents or with several children."""
    out, inc = defaultdict(list), defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        inc[b].append(a)
    seen, result = set(), set()
    for s in order:
        if s in seen or not (len(inc[s]) == 0 or len(out[s]) > 1):
            continue
        cur, pos = s, 0
        while cur and cur not in seen:
            seen.add(cur)
            result.add((s, pos, cur))
            pos += 1
            cur = out[cur][0] if len(out[cur]) == 1 and inc[out[cur][0]] == [cur] else None
    return result


def test_linear_chains_match_the_sequential_rules(spark, make_connections, make_processors):
    for seed in range(4):
        nodes, edges = random_graph(seed, n=18, m=17, acyclic=seed % 2 == 0)
        order = random.Random(seed).sample(nodes, len(nodes))
        p = make_processors([("t", x, x, "X", "Root", {}) for x in order])
        got = chains.chain_members(p, make_connections([("t", a, b) for a, b in edges])).collect()
        assert {(r["chain_root"], r["position"], r["processor_id"]) for r in got} == chains_of(order, edges)


def test_flows_include_the_definer_and_split_parallel_edges(spark, make_connections, make_processors):
    p = make_processors([("t", "a", "a", "UpdateAttribute", "Root", {"v": "${v}"}), ("t", "b", "b", "X", "Root", {"q": "${v:trim()}"})])
    c = make_connections([("t", "a", "b"), ("t", "a", "b")])
    got = sorted(tuple(r["flow_chain"]) for r in variables.flows(p, c).collect())
    assert got == [("a",), ("a", "b"), ("a", "b")]
    hops = variables.hop_pairs(variables.flows(p, c)).collect()
    assert {(r["from_processor"], r["to_processor"], tuple(r["relationships"])) for r in hops} == {("a", "b", ("success",))}


def _hops(rows):
    return {tuple(r[c] for c in ("template", "variable", "from_processor", "to_processor", "n", "first_hop", "relationships")) for r in rows.collect()}


def _listed_hops(processors, connections):
    return _hops(variables.hop_pairs(variables.flows(processors, connections)).groupBy("template", "variable", "from_processor", "to_processor").agg(
        F.count("*").alias("n"), F.min("hop").alias("first_hop"), F.min(F.array_join("relationships", ",")).alias("relationships")))


def test_hops_are_counted_without_their_flows(spark, make_connections, make_processors):
    """20 ** 7 flows, which can't be listed; more ways than a long can hold lead on from their user, to nowhere."""
    layer = lambda i: ["s"] if i == 0 else [f"{i}_{k}" for k in range(20)]
    edges = [("t", a, b) for i in range(16) for a in layer(i) for b in layer(i + 1)]
    p = make_processors([("t", "s", "s", "UpdateAttribute", "Root", {"v": "1"})] + [
        ("t", x, x, "X", "Root", {"q": "${v}"} if x == "8_0" else {}) for i in range(1, 17) for x in layer(i)])
    got = _hops(variables.flow_hops(p, make_connections(edges)))
    assert got == {("t", "v", a, b, 20 ** (5 if 0 < i < 7 else 6), i + 1, "success")
                   for i in range(8) for a in layer(i) for b in layer(i + 1) if i < 7 or b == "8_0"}


def test_hops_match_listed_flows(spark, make_connections, make_processors):
    """Templates without and with cycles, parallel connections, loops of a node on itself."""
    processors, connections = [], []
    for seed in range(4):
        nodes, edges = random_graph(seed, n=9, m=14, acyclic=seed % 2 == 0)
        for i, x in enumerate(nodes):
            props = ({"v": "1", "w": "2"} if i < 2 else {"w": "3"} if i == 3 else {}) | ({"q": "${v} ${w}"} if i in (1, 4, 6, 8) else {})
            processors.append((f"t{seed}", x, x, "UpdateAttribute" if i in (0, 1, 3) else "X", "Root", props))
        connections += [(f"t{seed}", a, b) for a, b in [*edges, edges[0], edges[0], (nodes[0], nodes[0])]]
    p, c = make_processors(processors), make_connections(connections)
    got = _hops(variables.flow_hops(p, c))
    assert got == _listed_hops(p, c) and len({r[0] for r in got}) > 1 and max(r[4] for r in got) > 2


def test_hops_of_growing_tables_stay_off_the_driver(spark, make_connections, make_processors, monkeypatch):
    plans, plain = [], graph.cut_counted
    monkeypatch.setattr(graph, "cut_counted", lambda df, where="true": plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, where))
    edges = make_connections(ladder(6)).selectExpr("template", "source AS src", "destination AS dst", "1L AS times")
    seeds = spark.createDataFrame([("t", "v", "s0")], "template string, variable string, node string")
    got = {(r["node"], r["hops"], int(r["n"])) for r in graph.walks(edges, seeds, ["template", "variable"]).collect()}
    assert got == {("s0", 0, 1)} | {x for i in range(6) for x in ((f"x{i}", 2 * i + 1, 2**i), (f"y{i}", 2 * i + 1, 2**i), (f"s{i + 1}", 2 * i + 2, 2 ** (i + 1)))}
    assert len(plans) > 2 and not any("BroadcastHashJoin" in x for x in plans)


def test_group_paths_of_any_depth_and_of_cycles(spark):
    chain = [("t", str(i), f"n{i}", str(i - 1) if i else None) for i in range(200)]
    rows = [*chain, ("t", "x", "X", "y"), ("t", "y", "Y", "x"), ("t", "z", "Z", "z")]
    found = {r["group_id"]: r["path"] for r in graph.group_paths(
        spark.createDataFrame(rows, "template string, group_id string, name string, parent_id string")).collect()}
    assert found["199"] == "/".join(f"n{i}" for i in range(200))
    assert (found["x"], found["y"], found["z"]) == ("X", "Y", "Z")


def test_simple_paths_have_no_length_limit(spark, make_connections):
    edges = graph.edges_of(make_connections([("t", f"p{i}", f"p{i + 1}") for i in range(60)])).withColumn("relationships", F.array(F.lit("success")))
    starts = spark.createDataFrame([("t", "p0")], "template string, start string")
    longest = graph.simple_paths(edges, starts).agg(F.max(F.size("path"))).first()[0]
    assert longest == 61


def test_cut_folder_must_be_shared():
    assert shared_dir("s3a://b/x", "file:/w", "yarn") == "s3a://b/x"
    assert shared_dir(None, "file:/w/", "local[8]") == "file:/w/_cuts"
    assert shared_dir(None, "hdfs://n/w", "yarn") == "hdfs://n/w/_cuts"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            shared_dir(None, "file:/w", master)
