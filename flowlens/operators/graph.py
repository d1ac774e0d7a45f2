"""Edge-list operators: closure, simple paths, chains, group paths, variable resolution.

All graphs are DataFrames keyed by ``(template, node)``; every step is an equi-join, so a single
huge template spreads over tasks by node. Iterations advance several hops per round: edges are
first composed up to ``stride`` hops, which divides the number of rounds (and Spark jobs).
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.session import cut, cut_counted, off_driver


def edges_of(connections: DataFrame, skip_unknown: bool = False) -> DataFrame:
    """(template, conn_ord, src, dst, relationships) for connections with both ends present."""
    edges = connections.filter("source <> '' AND destination <> ''")
    if skip_unknown:
        edges = edges.filter("source <> 'Unknown' AND destination <> 'Unknown'")
    return edges.select(
        "template", "conn_ord", F.col("source").alias("src"), F.col("destination").alias("dst"), "relationships"
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def neighbor_lists(connections: DataFrame) -> DataFrame:
    """Ordered incoming and outgoing neighbours of every connected processor (parallel edges repeat)."""
    edges = edges_of(connections)
    ends = edges.select(
        "template",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("processor_id"), F.lit("out").alias("side"),
                         F.struct("conn_ord", F.col("dst").alias("id")).alias("n")),
                F.struct(F.col("dst").alias("processor_id"), F.lit("in").alias("side"),
                         F.struct("conn_ord", F.col("src").alias("id")).alias("n")),
            )
        ).alias("e"),
    ).select("template", "e.*")
    pick = lambda side: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("n")))), lambda x: x["id"]
    )
    return ends.groupBy("template", "processor_id").agg(
        pick("in").alias("incoming"), pick("out").alias("outgoing")
    )


def adjacency(connections: DataFrame, processors: DataFrame) -> DataFrame:
    """Neighbour lists of every processor, empty where it has none."""
    lists = neighbor_lists(connections)
    empty = F.array().cast("array<string>")
    return processors.select("template", "processor_id").join(lists, ["template", "processor_id"], "left").select(
        "template", "processor_id",
        F.coalesce("incoming", empty).alias("incoming"),
        F.coalesce("outgoing", empty).alias("outgoing"),
    )


# --- reachability --------------------------------------------------------------------------


def hop_table(edges: DataFrame, stride: int) -> DataFrame:
    """Node pairs within ``stride`` hops and their shortest hop count (stride: a power of two)."""
    reach = cut(edges.select("template", "src", "dst").distinct().withColumn("hops", F.lit(1)))
    width = 1
    while width < stride:
        # the shortest way to a node farther off has a node that is ``width`` hops from its start
        l, r = reach.filter(F.col("hops") == width).alias("l"), reach.alias("r")
        longer = l.join(
            r, (F.col("l.template") == F.col("r.template")) & (F.col("l.dst") == F.col("r.src"))
        ).select("l.template", "l.src", "r.dst", (F.col("l.hops") + F.col("r.hops")).alias("hops"))
        reach = reach.unionByName(longer).groupBy("template", "src", "dst").agg(F.min("hops").alias("hops"))
        width *= 2
    return cut(reach)


def spread(
    edges: DataFrame, seeds: DataFrame, label: str, max_hops: int | None = None, stride: int = 8
) -> DataFrame:
    """Spread labels downstream: (template, label, node, hops) with the shortest hop count, seeds at 0.

    Semi-naive: a round joins only the farthest rows found in the previous round, with the pairs of up
    to ``stride`` hops, so a graph of depth d takes d / stride rounds. The work is bounded by
    labels x nodes actually reached.
    """
    near = hop_table(edges, stride)
    frontier = cut(seeds.select("template", label, "node").distinct().withColumn("hops", F.lit(0)))
    found, covered = [frontier], 0
    while max_hops is None or covered < max_hops:
        step = frontier.filter(F.col("hops") == covered).join(
            near.select("template", F.col("src").alias("node"), "dst", F.col("hops").alias("more")), ["template", "node"]
        ).select("template", label, F.col("dst").alias("node"), (F.col("hops") + F.col("more")).alias("hops"))
        if max_hops is not None:
            step = step.filter(F.col("hops") <= max_hops)
        fresh = step.groupBy("template", label, "node").agg(F.min("hops").alias("hops")).join(
            union_all(found), ["template", label, "node"], "left_anti"
        )
        frontier, n = cut_counted(fresh)
        if n == 0:
            break
        found.append(frontier)
        covered += stride
    return union_all(found)


def closure(
    edges: DataFrame, starts: DataFrame | None = None, max_hops: int | None = None, stride: int = 8
) -> DataFrame:
    """(template, src, dst, hops): every other node reached from each start, by shortest hops.

    ``starts`` (template, src) limits the sources; ``max_hops`` bounds the depth.
    """
    sources = edges if starts is None else starts
    seeds = sources.select("template", "src", F.col("src").alias("node")).distinct()
    return spread(edges, seeds, "src", max_hops, stride).filter("src <> node").select(
        "template", "src", F.col("node").alias("dst"), "hops"
    )


def reached(edges: DataFrame, seeds: DataFrame, keys: list[str], stride: int = 4) -> DataFrame:
    """(keys, node) of every node that a seed (keys, node) reaches along the edges, itself included.

    ``edges`` have ``src``, ``dst`` and some or all of ``keys``. Only nodes first found in the last round are followed,
    ``stride`` edges in one job: edges from each node to itself keep what is found on the way. No pairs of nodes are built.
    """
    frontier, n = cut_counted(seeds.select(*keys, "node").distinct())
    found = [frontier]
    on = [k for k in keys if k in edges.columns]
    lazy = cut(_lazy(edges, on)).withColumnRenamed("src", "node") if n else None
    while n:
        step = frontier
        for _ in range(stride):
            step = step.join(lazy, [*on, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier, n = cut_counted(step.join(union_all(found), [*keys, "node"], "left_anti"))
        if n:
            found.append(frontier)
    return union_all(found)


def _lazy(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, src, dst) and an edge from every node to itself."""
    both = F.array(F.struct("src", "dst"), F.struct("src", F.col("src").alias("dst")), F.struct(F.col("dst").alias("src"), "dst"))
    return edges.select(*keys, F.explode(both).alias("e")).select(*keys, "e.*").distinct()


#: Beyond any count that a long can hold; ways to nodes that don't matter in the end may be more than that.
MANY = Decimal(10**19)


def walks(edges: DataFrame, seeds: DataFrame, keys: list[str], stride: int = 4) -> DataFrame:
    """(keys, node, hops, n): how many walks of so many edges lead from the seeds (keys, node) to a node, ``MANY`` at most.

    ``edges`` (``src``, ``dst``, ``times``, some or all of ``keys``) have no cycle. Each round takes the walks of the last length
    ``stride`` edges on; the edges are shuffled once a round, whatever their size, and what is counted once an edge.
    """
    on = [k for k in keys if k in edges.columns]
    count = lambda c: F.least(c, F.lit(MANY)).cast("decimal(20,0)").alias("n")
    ends = "src IS NOT NULL AND dst IS NOT NULL"  # said once for all: a shuffle is only used again by an equal plan
    arcs = off_driver(edges.filter(ends).select(*on, F.col("src").alias("node"), "dst", "times"))
    frontier, left = cut_counted(seeds.select(*keys, "node").distinct().select("*", F.lit(0).alias("hops"), count(F.lit(1))))
    found, covered = [frontier], 0
    while left:
        steps = [frontier]
        for _ in range(stride):
            step = steps[-1].join(arcs, [*on, "node"]).select(*keys, F.col("dst").alias("node"), "hops", (F.col("n") * F.col("times")).alias("n"))
            steps.append(step.repartition(*on, "node").groupBy(*keys, "node").agg((F.first("hops") + 1).alias("hops"), count(F.sum("n"))))
        covered += stride
        rows, left = cut_counted(union_all(steps[1:]), f"hops = {covered}")
        found.append(rows)
        frontier = rows.filter(F.col("hops") == covered)
    return union_all(found)


# --- strongly connected components ---------------------------------------------------------

#: Random orders of the nodes that are used at once.
ORDERS = 4


def components(edges: DataFrame, stride: int = 4) -> DataFrame:
    """(template, node, component, size) of nodes on cycles; a component is named by its smallest node.

    Templates without an edge against the order of the nodes' names have no cycle and are left out. Then ends without an edge
    in or out go, as long as that at least halves the edges. Then every node learns the least
    mark (a hash) of those that reach it and of those it reaches, in some random orders at once. Where both are one node's,
    the node is in its component; of the rest only edges between nodes of equal marks can be in a component. The number of
    rounds grows with the logarithm of the number of components. An edge from a node to itself is no cycle.
    """
    live, n = cut_counted(_turning(edges.select("template", "src", "dst").filter("src <> dst").distinct()))
    before = 2 * n
    while n and 2 * n <= before:
        before = n
        live, n = cut_counted(_inner(_inner(live)))
    found = [live.limit(0).select("template", F.col("src").alias("node"), F.struct(F.xxhash64("src").alias("h"), "src").alias("root"))]
    while n:
        marks = _least_marks(live, stride)
        found.append(marks.filter("root IS NOT NULL").select("template", "node", "root"))
        rest = marks.filter("root IS NULL").drop("root")
        live, n = cut_counted(
            live.join(off_driver(rest.withColumnRenamed("node", "src")), ["template", "src"])
            .join(off_driver(rest.withColumnRenamed("node", "dst")), ["template", "dst", "up", "down"])
            .select("template", "src", "dst")
        )
    rows = union_all(found)
    named = rows.groupBy("template", "root").agg(F.min("node").alias("component"), F.count("*").alias("size")).filter("size > 1")
    return rows.join(off_driver(named), ["template", "root"]).select("template", "node", "component", "size")


def _turning(edges: DataFrame) -> DataFrame:
    """Edges of templates where some edge goes back in one order of the nodes; every cycle has such an edge, whatever the order."""
    order = lambda node: F.struct(F.length(node), F.col(node))
    back = edges.filter(order("src") > order("dst")).select("template").distinct()
    return edges.join(off_driver(back), "template", "left_semi")


def _inner(edges: DataFrame) -> DataFrame:
    """Edges from nodes with an edge in to nodes with an edge out."""
    into = edges.select("template", F.col("dst").alias("src"))
    out = edges.select("template", F.col("src").alias("dst"))
    return edges.join(off_driver(into), ["template", "src"], "left_semi").join(off_driver(out), ["template", "dst"], "left_semi")


def _least_marks(edges: DataFrame, stride: int) -> DataFrame:
    """(template, node, up, down, root): least marks (hash, node) in each order among the nodes that reach a node and among
    those it reaches; root is the first that is both."""
    sides = F.array(
        F.struct(F.lit("up").alias("side"), "src", "dst"),
        F.struct(F.lit("down").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    keys = ["template", "side"]
    lazy = off_driver(cut(_lazy(edges.select("template", F.explode(sides).alias("e")).select("template", "e.*"), keys)))
    orders = [f"m{i}" for i in range(ORDERS)]
    marks = [F.struct(F.xxhash64(F.lit(m), "template", "src").alias("h"), "src").alias(m) for m in orders]
    state, changed = cut_counted(lazy.filter("src = dst").select(*keys, F.col("src").alias("node"), *marks))
    while changed:
        step = state.withColumn("was", F.struct(*orders))
        for _ in range(stride):
            step = (
                step.withColumnRenamed("node", "src").join(lazy, [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node"))
                .agg(*[F.min(m).alias(m) for m in orders], F.min(F.when(F.col("src") == F.col("dst"), F.col("was"))).alias("was"))
            )
        state, changed = cut_counted(step, " OR ".join(f"{m} <> was.{m}" for m in orders))
        state = state.drop("was")
    pick = lambda side: F.min(F.when(F.col("side") == side, F.struct(*orders))).alias(side)
    both = state.groupBy("template", "node").agg(pick("up"), pick("down"))
    return cut(both.withColumn("root", F.coalesce(*[F.when(F.col(f"up.{m}") == F.col(f"down.{m}"), F.col(f"up.{m}")) for m in orders])))


def cycles(edges: DataFrame) -> DataFrame:
    """(template, component, size, members): every strongly connected component of two nodes or more, members in order."""
    return components(edges).groupBy("template", "component").agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")
    )


def cycle_pairs(edges: DataFrame) -> DataFrame:
    """Node pairs (a < b) that reach each other: the pairs inside components, which is the result itself."""
    members = cut(components(edges).select("template", "component", "node"))
    return members.withColumnRenamed("node", "node_a").join(
        members.withColumnRenamed("node", "node_b"), ["template", "component"]
    ).filter("node_a < node_b").select("template", "node_a", "node_b")


# --- simple paths --------------------------------------------------------------------------


def _segments(edges: DataFrame, stride: int, keys: list[str]) -> DataFrame:
    """Simple paths of 1..stride edges: first node, later nodes, relationships per hop."""
    one = edges.filter("src <> dst").select(
        *keys, F.col("src").alias("first"), F.array("dst").alias("nodes"), F.array("relationships").alias("rels"),
        F.col("dst").alias("last"),
    )
    found, current = [one], one
    for _ in range(stride - 1):
        s, e = current.alias("s"), one.alias("e")
        current = s.join(e, _same(keys, "s", "e") & (F.col("s.last") == F.col("e.first"))).filter(
            (F.col("e.last") != F.col("s.first")) & ~F.array_contains(F.col("s.nodes"), F.col("e.last"))
        ).select(
            *[f"s.{k}" for k in keys], "s.first", F.concat("s.nodes", "e.nodes").alias("nodes"),
            F.concat("s.rels", "e.rels").alias("rels"), "e.last",
        )
        found.append(current)
    return union_all(found)


def _same(keys: list[str], left: str, right: str):
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def simple_paths(
    edges: DataFrame, starts: DataFrame, max_nodes: int | None = None, stride: int = 4, keys: tuple[str, ...] = ("template",)
) -> DataFrame:
    """All simple paths from each start: (keys, start, last, path, rels). ``max_nodes`` bounds their length if asked.

    Edges and starts of different ``keys`` don't meet. ``rels`` keeps one relationship array per hop; parallel connections
    give separate paths. The result is inherently path-many; nothing is dropped, and each round is one equi-join.
    """
    keys = list(keys)
    seeds = starts.select(*keys, "start").distinct().select(
        *keys, "start", F.col("start").alias("last"), F.array("start").alias("path"),
        F.array().cast("array<array<string>>").alias("rels"),
    )
    segments = cut(_segments(edges, stride, keys))
    frontier, found, grown = seeds, [seeds], 1
    while max_nodes is None or grown < max_nodes:
        p, s = frontier.alias("p"), segments.alias("s")
        step = p.join(s, _same(keys, "p", "s") & (F.col("p.last") == F.col("s.first"))).filter(
            ~F.arrays_overlap(F.col("p.path"), F.col("s.nodes"))
            & (F.lit(max_nodes is None) | (F.size("p.path") + F.size("s.nodes") <= F.lit(max_nodes or 0)))
        ).select(
            *[f"p.{k}" for k in keys], "p.start", "s.last", F.concat("p.path", "s.nodes").alias("path"),
            F.concat("p.rels", "s.rels").alias("rels"),
        )
        step, n = cut_counted(step)
        if n == 0:
            break
        found.append(step)
        grown += stride
        frontier = step.filter(F.size("path") == grown)
    return union_all(found)


def longest_paths(edges: DataFrame, max_examples: int | None = None, stride: int = 4) -> DataFrame:
    """Longest simple paths per template over (template, src, dst): path, nodes, hops, rank.

    Bounds come from the graph of components: no path through a component has more nodes than it, and one that
    passes it has at least one. A path is dropped once it can't reach the template's lower bound, so on acyclic
    templates, where both bounds meet, only beginnings of longest paths are walked. Inside components all simple paths
    that may still be longest are tried.
    """
    arcs = cut(edges.select("template", "src", "dst").distinct().filter("src <> dst"))
    bound = off_driver(cut(_path_bounds(arcs, stride)))
    goals = bound.groupBy("template").agg(F.max("least").alias("goal"))
    ahead = off_driver(cut(arcs.join(
        bound.select("template", F.col("node").alias("dst"), F.col("component").alias("to"), F.col("most").alias("to_most")), ["template", "dst"]
    )))
    frontier, n = cut_counted(bound.join(goals, "template").filter("most >= goal").select(
        "template", "goal", F.col("node").alias("last"), F.col("component").alias("at"), F.lit(1).cast("long").alias("inside"),
        F.array("node").alias("path"),
    ))
    done, length = [], 1
    while n:
        step = frontier
        for _ in range(stride):
            p, e = step.alias("p"), ahead.alias("e")
            inside = F.when(F.col("p.at") == F.col("e.to"), F.col("p.inside") + 1).otherwise(F.lit(1).cast("long"))
            fits = (
                (F.col("p.template") == F.col("e.template")) & (F.col("p.last") == F.col("e.src"))
                & ~F.array_contains("p.path", F.col("e.dst"))
                & (F.size("p.path") + 1 + F.col("e.to_most") - inside >= F.col("p.goal"))
            )
            grew = F.col("e.dst").isNotNull()
            step = p.join(e, fits, "left").select(
                "p.template", "p.goal", F.coalesce("e.dst", "p.last").alias("last"), F.coalesce("e.to", "p.at").alias("at"),
                F.when(grew, inside).otherwise(F.col("p.inside")).alias("inside"),
                F.when(grew, F.array_append("p.path", F.col("e.dst"))).otherwise(F.col("p.path")).alias("path"),
            )
        length += stride
        step, n = cut_counted(step, f"size(path) = {length}")
        done.append(step.filter(F.size("path") < length) if n else step)
        frontier = step.filter(F.size("path") == length)
    rows = union_all(done or [frontier])
    paths = rows.select("template", "path", F.size("path").alias("nodes"))
    longest = paths.groupBy("template").agg(F.max("nodes").alias("nodes"))
    kept = paths.join(off_driver(longest), ["template", "nodes"], "left_semi")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("template").orderBy("path")))
    if max_examples is not None:
        ranked = ranked.filter(F.col("rank") <= max_examples)
    return ranked.select("template", "rank", "path", "nodes", (F.col("nodes") - 1).alias("hops"))


def _path_bounds(edges: DataFrame, stride: int) -> DataFrame:
    """(template, node, component, most, least): bounds of the number of nodes on a longest simple path from the component on.

    A node without a cycle is a component of its own. Bounds are raised along the edges between components, ``stride``
    of them in one job, until none changes.
    """
    nodes = edges.select("template", F.explode(F.array("src", "dst")).alias("node")).distinct()
    placed = off_driver(cut(nodes.join(off_driver(components(edges, stride)), ["template", "node"], "left").select(
        "template", "node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("size")
    )))
    side = lambda end, name: placed.select("template", F.col("node").alias(end), F.col("component").alias(name))
    between = edges.join(side("src", "a"), ["template", "src"]).join(side("dst", "b"), ["template", "dst"]).select(
        "template", F.col("a").alias("src"), F.col("b").alias("dst")
    ).unionByName(placed.select("template", F.col("component").alias("src"), F.col("component").alias("dst")))
    sizes = placed.groupBy("template", "component").agg(F.max("size").alias("size"))
    steps = off_driver(cut(between.distinct().join(sizes.withColumnRenamed("component", "src"), ["template", "src"]).withColumnRenamed("dst", "component")))
    state, changed = cut_counted(sizes.select("template", "component", F.col("size").alias("most"), F.least("size", F.lit(2)).alias("least")))
    while changed:
        step = state.withColumn("was", F.struct("most", "least"))
        stay = F.col("src") == F.col("component")
        for _ in range(stride):
            step = step.join(steps, ["template", "component"]).groupBy("template", "src").agg(
                F.max(F.col("most") + F.when(stay, 0).otherwise(F.col("size"))).alias("most"),
                F.max(F.col("least") + F.when(stay, 0).otherwise(1)).alias("least"),
                F.max(F.when(stay, F.col("was"))).alias("was"),
            ).withColumnRenamed("src", "component")
        state, changed = cut_counted(step, "most <> was.most OR least <> was.least")
        state = state.drop("was")
    return placed.select("template", "node", "component").join(state, ["template", "component"]).select(
        "template", "node", "component", "most", "least"
    )


# --- pointer structures --------------------------------------------------------------------


def follow_pointers(pointers: DataFrame, keys: list[str], to: str) -> tuple[DataFrame, int]:
    """Root and distance of every row of a one-pointer-per-key forest, by pointer jumping.

    ``pointers`` has ``keys`` and a struct column ``to`` with the key it points at (null: a root).
    Returns (keys + root struct + dist, number of rows left out because their chain never ends).
    A round quadruples the jump, so chains of length n take log4(n) rounds of equi-joins.
    """
    me = F.struct(*keys)
    state, n = cut_counted(
        pointers.select(
            me.alias("k"),
            F.coalesce(F.col(to), me).alias("next"),
            F.when(F.col(to).isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("dist"),
            F.col(to).isNull().alias("settled"),
        ),
        "NOT settled",
    )
    span, stuck, total = 1, n, n
    while stuck and span <= total:
        ahead = state.select(
            F.col("k").alias("next"), F.col("next").alias("jump"), F.col("dist").alias("more"), F.col("settled").alias("there")
        )
        jumped = state
        for _ in range(3):
            jumped = jumped.join(ahead, "next").select(
                "k", F.col("jump").alias("next"), (F.col("dist") + F.col("more")).alias("dist"),
                (F.col("settled") | F.col("there")).alias("settled"),
            )
        state, stuck = cut_counted(jumped, "NOT settled")
        span *= 4
    return state.filter("settled").select("k.*", F.col("next").alias("root"), "dist"), stuck


def group_paths(groups: DataFrame) -> DataFrame:
    """Slash path of every process group: names from the outermost known ancestor down.

    ``groups`` has (template, group_id, name, parent_id). An unknown parent contributes nothing.
    The list of names grows by doubling, so depth d needs log2(d) joins. Groups that are their own
    ancestors have no outermost one; each of them keeps its own name.
    """
    known = groups.select("template", F.col("group_id").alias("parent_id"), F.lit(True).alias("known"))
    state = groups.join(known, ["template", "parent_id"], "left").select(
        "template", "group_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), F.array("name").alias("names")
    )
    state, below = cut_counted(state, "up IS NOT NULL")
    total, reach = state.count() if below else 0, 1
    while below and reach <= total:
        reach *= 2
        parents = state.select(
            "template", F.col("group_id").alias("up"), F.col("up").alias("next_up"), F.col("names").alias("above")
        )
        state, below = cut_counted(
            state.join(parents, ["template", "up"], "left").select(
                "template", "group_id", F.col("next_up").alias("up"),
                F.when(F.col("above").isNotNull(), F.concat("above", "names")).otherwise(F.col("names")).alias("names"),
            ), "up IS NOT NULL"
        )
    names = F.when(F.col("up").isNull(), F.col("names")).otherwise(F.slice("names", -1, 1))
    return state.select("template", "group_id", F.array_join(names, "/").alias("path"))


def resolve_variables(literals: DataFrame, connections: DataFrame, processors: DataFrame) -> DataFrame:
    """(template, processor_id, variable, value): own literal, else from the last incoming edge.

    First the monotone part: which (processor, variable) are reached from any definer, and in how
    many hops. Then each takes one pointer, to the last incoming edge whose source
    resolves the variable, and pointers are followed to the defining literal. On cycles a pointer
    only goes to a source closer to a definer, so every chain ends.
    """
    edges = edges_of(connections).select("template", "conn_ord", "src", "dst")
    own = literals.select("template", "processor_id", "variable", "value")
    resolved = spread(edges, own.withColumnRenamed("processor_id", "node"), "variable").select(
        "template", F.col("node").alias("src"), "variable", F.col("hops").alias("round")
    )
    keys = ["template", "processor_id", "variable"]
    target = resolved.filter("round > 0").select(
        "template", F.col("src").alias("dst"), "variable", F.col("round").alias("own_round")
    )
    offers = target.join(edges, ["template", "dst"]).join(resolved, ["template", "src", "variable"])

    def pointing(rows: DataFrame) -> DataFrame:
        return rows.groupBy("template", F.col("dst").alias("processor_id"), "variable").agg(
            F.max_by("src", "conn_ord").alias("src")
        ).select(*keys, F.struct("template", F.col("src").alias("processor_id"), "variable").alias("to"))

    roots = resolved.filter("round = 0").select("template", F.col("src").alias("processor_id"), "variable").withColumn(
        "to", F.lit(None).cast("struct<template:string,processor_id:string,variable:string>")
    )
    placed, stuck = follow_pointers(roots.unionByName(pointing(offers)), keys, "to")
    if stuck:
        settled = placed.filter("dist > 0").select(*keys, F.col("root").alias("to"))
        earlier = pointing(offers.filter("round < own_round")).join(settled, keys, "left_anti")
        placed, _ = follow_pointers(union_all([roots, settled, earlier]), keys, "to")
    source = own.withColumnRenamed("processor_id", "origin_processor_id")
    return placed.select(*keys, F.col("root.processor_id").alias("origin_processor_id")).join(
        source, ["template", "origin_processor_id", "variable"]
    ).select(*keys, "value", "origin_processor_id")


# --- ports ---------------------------------------------------------------------------------


def flattened_edges(connections: DataFrame, processors: DataFrame, through: str = "ports") -> DataFrame:
    """Processor-to-processor edges, direct or across one input or output port.

    ``through="closure"`` also follows port-to-port and funnel hops of any length.
    """
    known = processors.select("template", F.col("processor_id").alias("dst"))
    c = connections.select(
        "template", "conn_ord", F.col("source").alias("src"), F.col("destination").alias("dst"),
        "source_type", "destination_type", "relationships",
    )
    none = F.lit(None).cast("string")
    direct = (
        c.filter("source_type = 'PROCESSOR' AND destination_type = 'PROCESSOR'")
        .join(known, ["template", "dst"], "left_semi")
        .join(known.withColumnRenamed("dst", "src"), ["template", "src"], "left_semi")
        .select("template", "conn_ord", "src", "dst", "relationships", none.alias("via_port"))
    )
    inward = c.filter("source_type = 'PROCESSOR' AND destination_type <> 'PROCESSOR'").select(
        "template", "conn_ord", "src", F.col("dst").alias("via_port"), F.col("destination_type").alias("kind"), "relationships"
    )
    outward = c.filter("source_type <> 'PROCESSOR' AND destination_type = 'PROCESSOR'").select(
        "template", F.col("src").alias("via_port"), "dst", F.col("source_type").alias("kind")
    )
    if through == "ports":
        bridged = inward.filter("kind IN ('INPUT_PORT', 'OUTPUT_PORT')").join(outward, ["template", "via_port", "kind"])
    else:
        hops = c.filter("source_type <> 'PROCESSOR' AND destination_type <> 'PROCESSOR'").select("template", "src", "dst")
        far = closure(hops).select("template", F.col("src").alias("via_port"), F.col("dst").alias("exit"))
        stay = outward.select("template", F.col("via_port"), F.col("via_port").alias("exit")).distinct()
        exits = far.unionByName(stay).distinct()
        bridged = inward.drop("kind").join(exits, ["template", "via_port"]).join(
            outward.select("template", F.col("via_port").alias("exit"), "dst"), ["template", "exit"]
        )
    bridged = bridged.join(known, ["template", "dst"], "left_semi").select(
        "template", "conn_ord", "src", "dst", "relationships", "via_port"
    )
    return direct.unionByName(bridged)
