"""The relationship graph: nodes, edges, projection, statistics, ranking, communities and backbone.

Edges are (source, target, edge_type, weight, confidence, item_id, ts), undirected. Iterative jobs join on node ids and
are written to the shared folder each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.functions.scores import lookup
from caselink.operators.components import component_roots
from caselink.operators.correlate import proximity_pairs
from caselink.session import discard, durable, ship


def graph_nodes(occ: DataFrame) -> DataFrame:
    """Case, item and entity nodes with their number of occurrences; rows are counted by id, names are made of the counts."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("node_id")
    cases = occ.groupBy("case_id").agg(F.count("*").alias("n")).select(named("case:", "case_id"), F.lit("case").alias("node_type"), "n")
    items = occ.groupBy("item_id").agg(F.count("*").alias("n")).select(named("item:", "item_id"), F.lit("evidence").alias("node_type"), "n")
    kind = lookup("entity_type", K.NODE_TYPES)
    values = occ.withColumn("node_type", kind).where("node_type is not null").groupBy("node_type", "value").agg(F.count("*").alias("n"))
    return cases.unionByName(items).unionByName(values.select(F.concat_ws(":", "node_type", "value").alias("node_id"), "node_type", "n"))


def graph_edges(occ: DataFrame) -> DataFrame:
    """Case to item ('contains') and item to entity ('mentions') edges; rows are told apart by id before names are made,
    so that occurrences dealt by item stay where they are."""
    item = F.concat(F.lit("item:"), F.col("item_id").cast("string"))
    held = occ.select("case_id", "item_id").distinct()
    holds = held.select(F.concat(F.lit("case:"), F.col("case_id").cast("string")).alias("source"), item.alias("target"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("confidence"), "item_id")
    said = occ.withColumn("kind", lookup("entity_type", K.NODE_TYPES)).where("kind is not null").select("item_id", "kind", "value").distinct()
    says = said.select(item.alias("source"), F.concat_ws(":", "kind", "value").alias("target"), F.lit("mentions").alias("edge_type"), F.lit(0.9).alias("confidence"), "item_id")
    return holds.unionByName(says)


def temporal_edges(events: DataFrame, hours: float = 48.0) -> DataFrame:
    """Pairs of reconstructed events within the window; weight falls from 1 to 0 with their distance."""
    real = events.where("source <> 'upload' and ts is not null")
    pairs = proximity_pairs(real, F.unix_micros("ts") / 1e6, ["case_id"], "item_id", hours)
    return pairs.select("case_id", "a", "b", F.round(1 - F.col("seconds") / (hours * 3600), 4).alias("weight"))


def finalize_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered ends and type, that of the highest confidence (clamped to 0..1), the first item in a tie."""
    own = edges.withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target"), "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))})
    best = own.groupBy("u", "v", "edge_type").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "item_id")).alias("m"), F.count("*").alias("merged"))
    return best.select("u", "v", "edge_type", (-F.col("m.c")).alias("confidence"), F.col("m.item_id").alias("item_id"), "merged")


def project_simple(edges: DataFrame, type_weights: dict[str, float]) -> DataFrame:
    """Undirected simple graph: the strongest edge between two nodes, its distance; no self loops."""
    w = F.greatest(F.lit(0.001), F.least(F.lit(1.0), F.col("confidence")) * F.coalesce(lookup("edge_type", type_weights), F.lit(1.0)))
    return (edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max(w).alias("weight")).withColumn("distance", 1 / F.col("weight")))


def degrees(simple: DataFrame) -> DataFrame:
    both = simple.select(F.col("u").alias("node")).union(simple.select("v"))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def graph_statistics(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """Nodes, edges, density, mean degree and the best connected node."""
    n, e = nodes.agg(F.count("*").alias("nodes")), simple.agg(F.count("*").alias("edges"))
    top = degrees(simple).agg(F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("m")).select(F.col("m.node").alias("top_hub"), (-F.col("m.d")).alias("top_degree"))
    return n.join(e).join(top).select("nodes", "edges", (2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"), (2 * F.col("edges") / F.col("nodes")).alias("mean_degree"), "top_hub", "top_degree")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node reaches."""
    roots = component_roots(edges, a, b)
    return nodes.select(F.col(node).alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def pagerank(simple: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 200) -> DataFrame:
    """Weighted PageRank of an undirected simple graph (no node is dangling), to an absolute change below the tolerance.

    The first round starts from equal ranks, so it sends each link once, by the node that it leads to, and joins nothing.
    Where it settles the ranks, as it must in graphs of more than 2 / tolerance nodes, links are never written."""
    both = simple.select("u", "v", "weight").union(simple.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    links = both.select("u", "v", (F.col("weight") / F.sum("weight").over(Window.partitionBy("u"))).alias("share"))
    first = durable(links.groupBy(F.col("v").alias("node")).agg(F.sum("share").alias("in")), "pagerank")
    n = max(first.count(), 1)
    rank = first.select("node", (F.lit((1 - damping) / n) + damping * F.col("in") / n).alias("rank"))
    moved, old = rank.agg(F.sum(F.abs(F.col("rank") - 1.0 / n))).first()[0], first
    if rounds and (not moved or moved < tolerance * n):
        return rank
    links = durable(links, "pagerank-links")
    for _ in range(rounds - 1):
        got = links.join(rank.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("in"))
        new = durable(rank.withColumnRenamed("rank", "old").join(got, "node", "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"), "old"), "pagerank")
        discard(old)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank, old = new.select("node", "rank"), new
        if moved < tolerance * n:
            discard(links)
            return rank
    raise RuntimeError("PageRank did not settle")


def numbered(simple: DataFrame, **more: Column) -> tuple[DataFrame, DataFrame]:
    """(names, edges): every node (node, id), numbered in the order of the names, and the edges u, v, weight by number.
    ``more`` are columns of a node's name: names have them, and edges have them of both ends, as name_u and name_v."""
    ends = simple.select(F.col("u").alias("node")).union(simple.select("v")).distinct()
    names = durable(ends.orderBy("node").withColumns({"id": F.monotonically_increasing_id(), **more}), "graph-names")
    side = lambda c: names.select(F.col("node").alias(c), F.col("id").alias(f"id_{c}"), *(F.col(m).alias(f"{m}_{c}") for m in more))
    both = simple.select("u", "v", "weight").join(side("u"), "u").join(side("v"), "v")
    return names, durable(both.select(F.col("id_u").alias("u"), F.col("id_v").alias("v"), "weight", *(f"{m}_{c}" for m in more for c in "uv")), "graph-edges")


def communities(simple: DataFrame, rounds: int = 100) -> DataFrame:
    """Weighted label propagation: every node takes the label with the most weight around it, the smallest in a tie;
    a round moves half of the nodes and the next the others, other halves every time, so that labels don't swap for ever;
    the job ends when two such rounds move nothing.

    Nodes and labels are numbers in the order of the names. A node's turns are bits of a number that its edges have, so a
    round moves the edges of its own half only. Weights are summed as whole 2^-32ths: a tie doesn't hang on the order of rows.
    """
    if rounds > 128:
        raise ValueError("a node's turns are 64 bits")
    turns = F.expr(f"aggregate(sequence(0, {(rounds - 1) // 2}), 0L, (b, r) -> b | shiftleft(pmod(xxhash64(node, r), 2L), r))")
    names, edges = numbered(simple, turns=turns)
    whole = F.round(F.col("weight") * 2**32).cast("long").alias("w")
    both = edges.select("u", "v", whole, F.col("turns_u").alias("turns")).union(edges.select(F.col("v"), F.col("u"), whole, F.col("turns_v")))
    label = names.select("id", "turns", F.col("id").alias("label"))
    old, still = [], 0
    for i in range(rounds):
        turn = F.expr(f"shiftright(turns, {i // 2}) & 1L = {i % 2}L")
        votes = both.where(turn).select("u", "v", "w").join(label.select(F.col("id").alias("v"), "label"), "v").select("u", "label", "w")
        # dealt by node once: the sums and the choice are made where the rows are
        sums = votes.repartition("u").groupBy("u", "label").agg(F.sum("w").alias("w"))
        best = sums.groupBy(F.col("u").alias("id")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("m")).select("id", F.col("m.label").alias("best"))
        new = label.join(best, "id", "left").select("id", "turns", F.coalesce("best", "label").alias("label"), (F.col("best") != F.col("label")).alias("moved"))
        moved = durable(new, "labels")
        discard(*old)
        old, label = [moved], moved.select("id", "turns", "label")
        still = still + 1 if moved.where("moved").isEmpty() else 0
        if still >= 2 and i % 2:
            named = label.select("id", "label").join(names.select("id", "node"), "id")
            return named.join(names.select(F.col("id").alias("label"), F.col("node").alias("community")), "label").select("node", "community")
    raise RuntimeError("communities did not settle")


def _tops(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """(c, top): the root of every c, from (c, p): each step joins a parent with its own parent. Roots are their own."""
    old = []
    for _ in range(rounds):
        up = parents.select(F.col("c").alias("p"), F.col("p").alias("q"))
        new = durable(parents.join(up, "p").select("c", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "boruvka-tops")
        discard(*old)
        old, parents = [new], new.select("c", "p")
        if new.where("moved").isEmpty():
            return parents.withColumnRenamed("p", "top")
    raise RuntimeError("the trees did not settle")


def locally_needed(edges: DataFrame) -> DataFrame:
    """Edges (u, v, weight) without loops and without those that are the last of a cycle among the edges of one range of v,
    and so in no maximum spanning forest of all of them, ties by the ends. A task holds the nodes of its range's edges."""
    ship(edges.sparkSession)
    rows = edges.select(F.lit(0).alias("scope"), "u", "v", "weight").repartitionByRange("v").sortWithinPartitions(F.col("weight").desc(), "u", "v")
    return rows.mapInArrow(_forests, rows.schema).drop("scope")


def backbone(simple: DataFrame, rounds: int = 64) -> DataFrame:
    """Maximum spanning forest by Boruvka rounds: each component takes its heaviest outgoing edge, ties by the ends.

    Nodes are numbers in the order of the names. Edges that the edges of neighbouring nodes make needless go before the first
    round. A round contracts the graph: of the edges between two components only
    the best stays, so edges and components shrink together; what is chosen is a tree whose roots are found by jumping.
    """
    names, whole = numbered(simple)
    edges = durable(locally_needed(whole), "backbone-edges")
    discard(whole)
    # m orders edges: best first
    live = edges.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct((-F.col("weight")).alias("w"), "u", "v").alias("m"))
    chosen, old = None, [edges]
    for _ in range(rounds):
        ways = live.select(F.col("a").alias("c"), "m", F.col("b").alias("to")).union(live.select("b", "m", "a"))
        best = durable(ways.groupBy("c").agg(F.min(F.struct("m", "to")).alias("x")).select("c", "x.m", F.col("x.to").alias("p")), "boruvka")
        if best.isEmpty():
            break
        new = best.select("m.u", "m.v")
        chosen = new if chosen is None else chosen.union(new)
        # two components that chose the same edge point at each other: the smaller one is the root
        back = best.select(F.col("c").alias("p"), F.col("p").alias("back"))
        root = F.col("back").eqNullSafe(F.col("c")) & (F.col("c") < F.col("p"))
        top = _tops(best.select("c", "p").join(back, "p").select("c", F.when(root, F.col("c")).otherwise(F.col("p")).alias("p")))
        end = lambda c: top.select(F.col("c").alias(c), F.col("top").alias(f"of_{c}"))  # noqa: E731,B023
        inside = live.join(end("a"), "a").join(end("b"), "b").where("of_a <> of_b")
        live = durable(inside.groupBy(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).agg(F.min("m").alias("m")), "boruvka-live")
        discard(*old, top)
        old = [live]
    else:
        raise RuntimeError("the forest did not settle")
    if chosen is None:
        return simple.select("u", "v").limit(0)
    of = lambda c: names.select(F.col("id").alias(c), F.col("node").alias(f"name_{c}"))
    return chosen.distinct().join(of("u"), "u").join(of("v"), "v").select(F.col("name_u").alias("u"), F.col("name_v").alias("v"))


def _joins(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Kruskal over rows (scope, u, v, ...) sorted by scope and best edge first: each batch and which rows join two trees."""
    root, scope = {}, None

    def find(x):
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        keep = []
        for s, u, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if s != scope:
                root, scope = {}, s
            a, b = find(u), find(v)
            keep.append(a != b)
            if a != b:
                root[a] = b
        yield batch, pa.array(keep, pa.bool_())


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.filter(keep) for batch, keep in _joins(batches))


def marked_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, with a last column that says whether the row joins two trees."""
    return (pa.RecordBatch.from_arrays([*batch.columns, keep], names=[*batch.schema.names, "chosen"]) for batch, keep in _joins(batches))


def scoped_backbone(edges: DataFrame, scope: str) -> DataFrame:
    """Maximum spanning forest of every scope's own graph, ties by the ends: ``edges`` (scope, u, v, weight and others)
    reduced to the chosen ones. Spark sorts the edges of a scope, its nodes alone are held, in one task."""
    ship(edges.sparkSession)
    rows = edges.select(scope, "u", "v", *(c for c in edges.columns if c not in (scope, "u", "v")))
    return rows.repartition(scope).sortWithinPartitions(scope, F.col("weight").desc(), "u", "v").mapInArrow(_forests, rows.schema)


def node_importance(simple: DataFrame, rank: DataFrame) -> DataFrame:
    """Degree centrality and PageRank (scaled to its largest), blended 0.45 to 0.20 and renormalised."""
    deg = durable(degrees(simple), "degrees")
    top = rank.agg(F.max("rank").alias("top")).withColumn("n", F.lit(deg.count()))
    return deg.join(rank, "node").join(top).select("node", "degree", F.round((0.45 * F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)) + 0.20 * F.col("rank") / F.col("top")) / 0.65, 6).alias("importance"))


def graph_summary(importance: DataFrame, n: int = 5) -> DataFrame:
    """The n most important nodes that aren't cases or items."""
    return importance.where(~F.col("node").startswith("case:") & ~F.col("node").startswith("item:")).orderBy(F.col("importance").desc(), "node").limit(n)


def evidence_pair_projection(edges: DataFrame) -> DataFrame:
    """Items tied by an edge's source items: one row per pair and edge type with the highest confidence."""
    return (edges.select("edge_type", "confidence", F.explode("items").alias("a"), "items").select("edge_type", "confidence", "a", F.explode("items").alias("b")).where("a < b")
            .groupBy("a", "b", "edge_type").agg(F.max("confidence").alias("confidence")))


def top_connected_entity(pairs: DataFrame) -> DataFrame:
    """The entity of the most pairs, then the highest confidence, then the first name; one row."""
    return pairs.groupBy("entity").agg(F.count("*").alias("pairs"), F.max("confidence").alias("confidence")).orderBy(F.col("pairs").desc(), F.col("confidence").desc(), "entity").limit(1)
