"""Graph primitives: components, spanning forests, frontier walks.

Every function takes edges of many graphs at once; ``group`` names the graph.
All large graphs are solved together by rounds of joins, whatever their size, so
no graph has to fit in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.numeric import mat4_mul, similarity_inverse
from proofgrid.operators.ranking import join_back
from proofgrid.session import cut_lineage, discard, stored

MAX_ROUNDS = 200
EDGES_A_TASK = 3_000_000  # of a graph that one task may solve: some 0.5 GB
POSES_A_TASK = 1_000_000  # edges of a tree whose transforms one task may compose: some 0.7 GB
MATRICES_AT_ONCE = 50_000
OPEN_SHARE = 20  # pointers are followed until fewer than one vertex in so many still moves
ROWS_AT_ONCE = 200_000  # edges of graphs solved together


def components_by_rounds(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest vertex of each vertex's component, by hooking and shortcutting.

    Parents and grandparents are minimised over edges each round (the published
    FastSV scheme), so the number of rounds grows with the logarithm of the
    component size rather than with its diameter.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("w")).filter("u <> w")
    e = cut_lineage(e.unionByName(e.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct())
    f = e.select(F.col("u").alias("v")).distinct().withColumn("p", F.col("v"))
    for _ in range(MAX_ROUNDS):
        parents = f.select(F.col("v").alias("__pv"), F.col("p").alias("g"))
        gp = f.join(parents, f.p == parents["__pv"]).drop("__pv")
        near = e.join(gp.select(F.col("v").alias("w"), "g"), "w").groupBy("u").agg(F.min("g").alias("m"))
        t = gp.join(near.withColumnRenamed("u", "v"), "v", "left")
        hook = t.filter("m is not null").groupBy(F.col("p").alias("v")).agg(F.min("m").alias("h"))
        nxt = t.join(hook, "v", "left").select("v", F.least("p", "g", "m", "h").alias("q"), "p")
        nxt = cut_lineage(nxt)
        moved = nxt.filter("q <> p").limit(1).count()
        f = nxt.select("v", F.col("q").alias("p"))
        if not moved:
            return f.select("v", F.col("p").alias("component"))
    raise RuntimeError("components did not settle")


def _least_vertices(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of the component of each of ``n`` vertices."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, before[end], low)
        label = label[label]
        if (label == before).all():
            return label


def _least_forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the forest's edges, which come best first, and the smallest vertex of each vertex's tree; Boruvka's rounds."""
    label, chosen, left = np.arange(n), [], np.flatnonzero(a != b)
    while True:
        x, y = label[a[left]], label[b[left]]
        out = x != y
        left, x, y = left[out], x[out], y[out]
        if not len(left):
            return np.sort(np.concatenate([np.empty(0, np.int64), *chosen])), label
        best = np.full(n, len(a))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        chosen.append(np.unique(best[best < len(a)]))
        label = _least_vertices(label[a[chosen[-1]]], label[b[chosen[-1]]], n)[label]


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """First rows of the groups of sorted rows."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for n in names:
        code = table[n].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Rank of each value among the distinct ones, and those; a null comes first, as in Spark's order."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def _graphs(table: pa.Table, names: list[str]) -> tuple:
    """Ends of all edges as numbers over all graphs, each vertex's (first row of its graph, value), and each row's graph."""
    first = _starts(table, names)
    code, values = _codes(pa.chunked_array([*table["a"].chunks, *table["b"].chunks]))
    graph = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(table))))
    node, place = np.unique(np.tile(graph, 2) * len(values) + code, return_inverse=True)
    return place[:len(table)], place[len(table):], first[node // len(values)], node % len(values), values, graph


def _by_groups(batches, names: list[str], solve):
    """``solve`` over tables of whole groups, some ``ROWS_AT_ONCE`` rows or one group at a time, of sorted batches."""
    held, size, last = [], 0, 0  # last: the first row of the last group
    for batch in batches:
        if not len(batch):
            continue
        before = [held[-1].slice(len(held[-1]) - 1)] if held else []
        first = int(_starts(pa.Table.from_batches([*before, batch]), names)[-1]) - len(before)
        last = size + first if first >= 0 and (first or before) else last
        held.append(batch)
        size += len(batch)
        if last and size >= ROWS_AT_ONCE:
            table = pa.Table.from_batches(held)
            yield from solve(table.slice(0, last)).to_batches()
            held, size, last = table.slice(last).to_batches(), size - last, 0
    if size:
        yield from solve(pa.Table.from_batches(held)).to_batches()


def _components_of_groups(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group..., vertex, component) of graphs that each fit a task; a null vertex comes first, as in Spark's order."""
    names = [f"__g{i}" for i in range(len(group))]
    rows = edges.select(*[F.col(g).alias(n) for g, n in zip(group, names)], "a", "b")
    schema = T.StructType([*[T.StructField(n, edges.schema[g].dataType) for g, n in zip(group, names)],
                           T.StructField("vertex", edges.schema["a"].dataType), T.StructField("component", edges.schema["a"].dataType)])

    def solve(table: pa.Table) -> pa.Table:
        a, b, row, value, values, _ = _graphs(table, names)
        least = _least_vertices(a, b, len(row))
        met = np.zeros(len(row), bool)
        met[a[a != b]] = met[b[a != b]] = True  # an edge to itself makes no component
        return pa.table([*table.select(names).take(pa.array(row[met])).columns, values.take(pa.array(value[met])),
                         values.take(pa.array(value[least[met]]))], names=[*names, "vertex", "component"])

    solved = rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(lambda batches: _by_groups(batches, names, solve), schema)
    return solved.select(*[F.col(n).alias(g) for g, n in zip(group, names)], "vertex", "component")


def _forest_of_groups(edges: DataFrame, group: list[str], a: str, b: str, order: list[Column], edge_id: str,
                      labelled: bool = True, part: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The forest's edges with ``__tree``, the struct of their tree's component (null where end a has none), and (group...,
    vertex, component), as ``forest_and_labels``, of graphs that each fit a task; only the columns of ``edges`` are sent.
    ``part`` names further columns that tell graphs apart."""
    graphs = [*group, *(part or [])]
    names = [f"__g{i}" for i in range(len(graphs))]
    vertex = edges.schema[a].dataType
    row = T.StructType([T.StructField(f.name, f.dataType) for f in edges.schema])
    schema = T.StructType([*[T.StructField(n, edges.schema[g].dataType) for g, n in zip(graphs, names)], T.StructField("row", row),
                           T.StructField("vertex", vertex), T.StructField("component", vertex), T.StructField("placed", T.BooleanType())])

    def solve(table: pa.Table) -> pa.Table:
        named = pa.table([table[g] for g in graphs] + [table[a], table[b]], names=[*names, "a", "b"])
        x, y, first, value, values, graph = _graphs(named, names)
        best, least = _least_forest(x, y, len(first))
        ids, distinct = _codes(table[edge_id])
        ids += graph * len(distinct)
        best = np.flatnonzero(np.isin(ids, ids[best]))  # an id may name several edges
        met = np.zeros(len(first), bool)
        met[x[x != y]] = met[y[x != y]] = True
        kept, n = table.take(pa.array(best)), len(best)
        kept = pa.StructArray.from_arrays([c.combine_chunks() for c in kept.columns], fields=list(kept.schema))
        placed = met[x[best]] & np.asarray(table[a].is_valid())[best]
        found = np.flatnonzero(met) if labelled else np.empty(0, np.int64)
        m = len(found)
        at = named.select(names).take(pa.array(np.concatenate([best, first[found]])))
        return pa.table([*at.columns, pa.chunked_array([kept, pa.nulls(m, kept.type)]),
                         pa.chunked_array([pa.nulls(n, values.type), values.take(pa.array(value[found]))]),
                         values.take(pa.array(value[least[np.concatenate([x[best], found])]])),
                         pa.array(np.concatenate([placed, np.ones(m, bool)]))], names=[*names, "row", "vertex", "component", "placed"])

    solved = stored(edges.repartition(*graphs).sortWithinPartitions(*graphs, *order, edge_id)
                    .mapInArrow(lambda batches: _by_groups(batches, graphs, solve), schema), "forest")
    named = [F.col(n).isNotNull() for n in names[:len(group)]]
    forest = solved.filter(reduce(lambda x, y: x & y, named, F.col("row").isNotNull())) \
        .select("row.*", F.when(F.col("placed"), F.struct("component")).alias("__tree")).filter(F.col(edge_id).isNotNull())
    labels = solved.filter("row is null").select(*[F.col(n).alias(g) for g, n in zip(group, names)], "vertex", "component")
    return forest, labels


def connected_components(edges: DataFrame, *, group: list[str], a: str, b: str,
                         vertices: DataFrame | None = None) -> DataFrame:
    """M06 primitive: (group..., vertex, component) where component is its smallest vertex.

    ``vertices`` (group..., vertex) keeps singletons.  Graphs of up to ``EDGES_A_TASK`` edges lie side by side in sorted
    partitions and are solved many at once; larger ones are contracted by rounds of joins until they are that small.
    """
    edges = stored(edges.select(*group, F.col(a).alias("a"), F.col(b).alias("b")), "edges")  # read several times below
    labels = component_labels(edges, group)
    if vertices is None:
        return labels
    return vertices.distinct().join(labels, [*group, "vertex"], "left").withColumn(
        "component", F.coalesce("component", "vertex"))


def component_labels(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group..., vertex, component) of stored edges (group..., a, b)."""
    live, rounds = edges, []
    while True:
        large = stored(live.groupBy(*group).count().filter(F.col("count") > EDGES_A_TASK).select(*group), "large")
        if large.isEmpty():
            break
        kept = join_back(live, large.withColumn("__large", F.lit(True)), group)
        joined = _joined_vertices(kept.filter("__large"), group)
        moved = kept.filter("__large and not (a <=> b)")
        for end in ("a", "b"):
            to = joined.select(*group, F.col("__v").alias(end), F.col("__p").alias(f"__n{end}"))
            moved = join_back(moved, to, [*group, end], "inner")
        low = F.when(F.col("__na").isNotNull() & F.col("__nb").isNotNull(), F.least("__na", "__nb"))  # a null vertex comes first
        moved = moved.filter("not (__na <=> __nb)").select(*group, low.alias("a"), F.greatest("__na", "__nb").alias("b")).distinct()
        live = stored(kept.filter("__large is null").select(*group, "a", "b").unionByName(moved), "live")
        rounds.append((large, joined))
    labels = stored(_components_of_groups(live, group), "labels")
    for large, joined in reversed(rounds):
        others = join_back(labels, large.withColumn("__large", F.lit(True)), group).filter("__large is null").drop("__large")
        known = labels.select(*group, F.col("vertex").alias("__p"), "component", F.lit(True).alias("__known"))
        back = join_back(joined, known, [*group, "__p"]).select(*group, F.col("__v").alias("vertex"), F.when(
            F.col("__known"), F.col("component")).otherwise(F.col("__p")).alias("component"))
        labels = stored(others.unionByName(back), "labels")
    return labels


def _joined_vertices(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group..., v, p) of every vertex with an edge to another: a vertex p of the same component.

    Every vertex points to the smallest of its neighbours and itself, and pointers are doubled.  Whatever their number,
    p is of v's component and the smallest vertex points to itself, so two vertices are connected exactly if their p are
    when edges are drawn between the p, and the smallest vertex stays the name of its component.
    """
    e = edges.filter("not (a <=> b)")
    both = e.select(*group, F.col("a").alias("__v"), F.col("b").alias("__w")).unionByName(
        e.select(*group, F.col("b").alias("__v"), F.col("a").alias("__w")))
    least = both.groupBy(*group, "__v").agg(F.min("__w").alias("__m"), F.max(F.col("__w").isNull()).alias("__none"))
    first = F.when(F.col("__v").isNotNull() & ~F.col("__none"), F.least("__v", "__m"))  # a null vertex comes first
    now = stored(least.select(*group, "__v", first.alias("__p")), "parents")
    total = now.count()
    while True:
        up = now.select(*group, F.col("__v").alias("__p"), F.col("__p").alias("__g"))
        nxt = stored(join_back(now, up, [*group, "__p"], "inner").select(
            *group, "__v", F.col("__g").alias("__p"), F.expr("not (__p <=> __g)").alias("__open")), "parents")
        discard(now)
        now = nxt.select(*group, "__v", "__p")
        if nxt.filter("__open").count() * OPEN_SHARE <= total:
            return now


def _rooted(best: DataFrame) -> DataFrame:
    """(c, p): the tree root of every component, from its best edge (c, to).

    Best edges under an order without ties form trees around one mutual pair each; its smaller end is the root.  A job
    goes four steps up, so a chain of any length takes a quarter of its length's binary logarithm of jobs and more.
    """
    back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
    root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
    now = best.join(back, "to").select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("p"))
    now = stored(now, "parents")
    while True:
        up = now.select(F.col("c").alias("p"), F.col("p").alias("g"))
        higher = now
        for step in range(3):
            higher = higher.join(up, "p").select("c", F.col("g").alias("p"), F.col("p").alias("was"))
        higher = stored(higher.select("c", "p", (F.col("p") != F.col("was")).alias("open")), "parents")
        discard(now)
        now = higher.select("c", "p")
        if higher.filter("open").isEmpty():
            return now


def forest_by_rounds(edges: DataFrame, order: str, labelled: bool = True) -> tuple[DataFrame | None, DataFrame | None]:
    """Ids of the spanning forest of best edges, and (v, root) of every vertex with an edge if asked for; Boruvka's rounds.

    ``edges`` has a, b (comparable vertices), id and the total order column, smallest first.  Each round every component
    takes its best outgoing edge, the trees these form are contracted to their roots, and of parallel edges between two
    components only the best stays.  Components at least halve each round, so all tables of one kind together are no
    larger than twice the first.
    """
    live = stored(edges.select("id", order, F.col("a").alias("ca"), F.col("b").alias("cb")).filter("ca <> cb"), "live")
    chosen, merges = [], []
    while not live.isEmpty():
        halves = [live.select(F.col(c).alias("c"), F.struct(order, "id", F.col(to).alias("to")).alias("e"))
                  for c, to in (("ca", "cb"), ("cb", "ca"))]
        best = stored(halves[0].unionByName(halves[1]).groupBy("c").agg(F.min("e").alias("e")).select("c", "e.id", "e.to"), "best")
        chosen.append(best.select("id"))
        merges.append(_rooted(best.select("c", "to")))
        to_a, to_b = (merges[-1].select(F.col("c").alias(c), F.col("p").alias(p)) for c, p in (("ca", "na"), ("cb", "nb")))
        moved = live.join(to_a, "ca").join(to_b, "cb").filter("na <> nb")
        before, live = live, stored(moved.groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb")).agg(
            F.min(F.struct(order, "id")).alias("e")).select("e.id", f"e.{order}", "ca", "cb"), "live")
        discard(before)
    if not chosen:
        return None, None
    return reduce(DataFrame.unionByName, chosen).distinct(), _labels(merges) if labelled else None


def _labels(merges: list[DataFrame]) -> DataFrame:
    """(v, root) through all rounds: a round's roots are the next round's vertices, unless they were done."""
    labels = merges[-1].select(F.col("c").alias("v"), F.col("p").alias("root"))
    for m in reversed(merges[:-1]):
        labels = m.join(labels, m.p == labels.v, "left").select(m.c.alias("v"), F.coalesce("root", "p").alias("root"))
    return stored(labels, "labels")


def forest_and_labels(edges: DataFrame, *, group: list[str], a: str, b: str, order: list[Column],
                      edge_id: str) -> tuple[DataFrame, DataFrame]:
    """M09 primitive: the edges of the best spanning forest under a total order, and (group..., vertex, component),
    where component is the smallest vertex of a tree.

    Taking edges best first and skipping those that close a cycle gives one forest only, whatever the method, because
    the order has no ties: pass a unique last key in ``order``.  Graphs of up to ``EDGES_A_TASK`` edges are solved in sorted
    partitions, larger ones component by component, and only larger components by rounds.
    """
    forest, labels = _forests(edges, group, a, b, order, edge_id, True)
    return forest.drop("__tree"), labels


def forest_of_trees(edges: DataFrame, *, group: list[str], a: str, b: str, order: list[Column], edge_id: str) -> DataFrame:
    """The forest's edges with ``component``, the smallest vertex of their tree."""
    forest, _ = _forests(edges, group, a, b, order, edge_id, False)
    return forest.filter("__tree is not null").withColumn("component", F.col("__tree.component")).drop("__tree")


def spanning_forest(edges: DataFrame, *, group: list[str], a: str, b: str, order: list[Column],
                    edge_id: str) -> DataFrame:
    """The edges of the best spanning forest alone."""
    return _forests(edges, group, a, b, order, edge_id, False)[0].drop("__tree")


def _forests(edges: DataFrame, group: list[str], a: str, b: str, order: list[Column], edge_id: str,
             labelled: bool) -> tuple[DataFrame, DataFrame]:
    """As ``_forest_of_groups``, for graphs of any size."""
    edges = stored(edges, "edges")  # read several times below
    large = stored(edges.groupBy(*group).count().filter(F.col("count") > EDGES_A_TASK).select(*group), "large")
    if large.isEmpty():
        found = _forest_of_groups(edges, group, a, b, order, edge_id, labelled)
        discard(edges)
        return found
    kept = join_back(edges, large.withColumn("__large", F.lit(True)), group)
    forest, labels = _forest_of_groups(kept.filter("__large is null").drop("__large"), group, a, b, order, edge_id, labelled)
    more, found = _forest_of_large(kept.filter("__large").drop("__large"), group, a, b, order, edge_id)
    discard(edges)
    return forest.unionByName(more), labels.unionByName(found)


def _forest_of_large(edges: DataFrame, group: list[str], a: str, b: str, order: list[Column], edge_id: str) -> tuple[DataFrame, DataFrame]:
    """The same of stored edges of large graphs: components, which need vertices only, then each component as a graph."""
    labels = component_labels(edges.select(*group, F.col(a).alias("a"), F.col(b).alias("b")), group)
    of = labels.select(*group, F.col("vertex").alias(a), F.col("component").alias("__of"))
    placed = stored(join_back(edges, of, [*group, a], "inner"), "placed")  # an edge to itself may be of none
    inner = [*group, "__of"]
    giant = stored(placed.groupBy(*inner).count().filter(F.col("count") > EDGES_A_TASK).select(*inner, F.lit(True).alias("__giant")), "giant")
    split = join_back(placed, giant, inner)
    named = reduce(lambda x, y: x & y, [F.col(g).isNotNull() for g in group])
    few = split.filter(named & F.col("__giant").isNull()).drop("__giant")
    forest = _forest_of_groups(few, group, a, b, order, edge_id, False, ["__of"])[0].drop("__of")
    if not giant.isEmpty():
        many = _forest_of_giants(split.filter(named & F.col("__giant")).drop("__giant"), group, a, b, order, edge_id)
        forest = forest.unionByName(many.withColumn("__tree", F.when(F.col(a).isNotNull(), F.struct(F.col("__of").alias("component")))).drop("__of"))
    return forest, labels


def _forest_of_giants(edges: DataFrame, group: list[str], a: str, b: str, order: list[Column], edge_id: str) -> DataFrame:
    """The forest's edges by rounds, which know an edge by its place in the order."""
    by = [*order, F.col(edge_id), *[F.col(g) for g in group]]
    ranked = stored(edges.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__rank", F.monotonically_increasing_id()), "ranked")
    found, _ = forest_by_rounds(ranked.select(F.col("__rank").alias("id"), F.col("__rank").alias("__ord"), F.struct(*group, F.col(a).alias("x")).alias("a"),
                                              F.struct(*group, F.col(b).alias("x")).alias("b")), "__ord", False)
    if found is None:
        return edges.limit(0)
    best = ranked.join(found.withColumnRenamed("id", "__rank"), "__rank", "left_semi").select(*group, edge_id)
    return ranked.drop("__rank").join(stored(best, "ids"), [*group, edge_id], "left_semi")  # an id may name several edges


IDENTITY = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def _rooted_with(best: DataFrame) -> DataFrame:
    """(c, p, m) as in ``_rooted``, with the transform of every component into its root; doubling, two steps a job."""
    back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
    root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
    same = F.array(*[F.lit(v) for v in IDENTITY])
    now = best.join(back, "to").select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("p"),
                                       F.when(root, same).otherwise(F.col("m")).alias("m"))
    now = stored(now, "parents")
    while True:
        up = now.select(F.col("c").alias("p"), F.col("p").alias("g"), F.col("m").alias("n"))
        higher = now
        for step in range(2):
            higher = higher.join(up, "p").select("c", F.col("g").alias("p"), mat4_mul(F.col("n"), F.col("m")).alias("m"),
                                                 F.col("p").alias("was"))
        higher = stored(higher.select("c", "p", "m", (F.col("p") != F.col("was")).alias("open")), "parents")
        discard(now)
        now = higher.select("c", "p", "m")
        if higher.filter("open").isEmpty():
            return now


def _inverses(m: np.ndarray) -> np.ndarray:
    """``similarity_inverse`` of many 4x4 matrices."""
    scale = np.cbrt(np.abs(np.einsum("ni,ni->n", m[:, 0, :3], np.cross(m[:, 1, :3], m[:, 2, :3]))))
    out = np.zeros_like(m)
    out[:, :3, :3] = m[:, :3, :3].transpose(0, 2, 1) / (scale * scale)[:, None, None]
    out[:, :3, 3] = -np.einsum("nij,nj->ni", out[:, :3, :3], m[:, :3, 3])
    out[:, 3, 3] = 1.0
    return out


def _slices(rows: np.ndarray):
    return (rows[i:i + MATRICES_AT_ONCE] for i in range(0, len(rows), MATRICES_AT_ONCE))


def _into_roots(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The root of each vertex's tree and the transform into it, by the rounds of ``_poses_by_rounds`` in memory."""
    root, into = np.arange(n), np.tile(np.eye(4), (n, 1, 1))
    live = np.flatnonzero(a != b)
    x, y, m = a[live], b[live], m[live]
    while len(x):
        rank = np.empty(len(x), np.int64)
        rank[np.lexsort((np.maximum(x, y), np.minimum(x, y)))] = np.arange(len(x))
        best = np.full(n, len(x))
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        c = np.flatnonzero(best < len(x))
        edge = np.argsort(rank)[best[c]]
        place = np.full(n, -1)
        place[c] = np.arange(len(c))
        turned = x[edge] == c
        up, step = place[np.where(turned, y[edge], x[edge])], m[edge]
        step[turned] = _inverses(step[turned])
        top = np.flatnonzero((up[up] == np.arange(len(c))) & (np.arange(len(c)) < up))
        up[top], step[top] = top, np.eye(4)
        moving = np.flatnonzero(up[up] != up)
        while len(moving):
            for part in _slices(moving):  # a vertex and its transform always name the same parent
                step[part], up[part] = step[up[part]] @ step[part], up[up[part]]
            moving = moving[up[up[moving]] != up[moving]]
        for part in _slices(np.flatnonzero(place[root] >= 0)):
            at = place[root[part]]
            into[part], root[part] = step[at] @ into[part], c[up[at]]
        x, y = place[x], place[y]
        for part in _slices(np.flatnonzero(up[x] != up[y])):
            m[part] = step[x[part]] @ m[part] @ _inverses(step[y[part]])
        left = up[x] != up[y]
        x, y, m = c[up[x[left]]], c[up[y[left]]], m[left]
    return root, into


def _matrices(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4)


def _matrix_lists(m: np.ndarray, nulls: bool) -> pa.Array:
    ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * 16)
    return pa.ListArray.from_arrays(ends, pa.array(m.reshape(-1), from_pandas=nulls))


def _sixteen(m: str) -> Column:
    return F.array(*[F.get(F.col(m), i).cast("double") for i in range(16)])


def _poses_of_groups(live: DataFrame, starts: DataFrame, group: list[str]) -> DataFrame:
    """(v, pose) as ``compose_poses`` of trees that each fit a task; every anchor goes to the task of its tree."""
    names = [f"__g{i}" for i in range(len(group))]
    fields = [F.col(f"ca.{g}").alias(n) for g, n in zip(group, names)]
    kind = live.schema["ca"].dataType
    rows = live.select(*fields, F.col("ca.x").alias("a"), F.col("cb.x").alias("b"), _sixteen("m").alias("m"), F.lit(False).alias("start")) \
        .unionByName(starts.select(*[F.col(f"v.{g}").alias(n) for g, n in zip(group, names)], F.col("v.x").alias("a"), F.col("v.x").alias("b"),
                                   F.array(*[F.lit(v) for v in IDENTITY]).alias("m"), F.lit(True).alias("start")))
    schema = T.StructType([*[T.StructField(n, kind[g].dataType) for g, n in zip(group, names)], T.StructField("vertex", kind["x"].dataType),
                           T.StructField("pose", T.ArrayType(T.DoubleType()))])

    def solve(table: pa.Table) -> pa.Table:
        a, b, row, value, values, _ = _graphs(table, names)
        root, into = _into_roots(a, b, _matrices(table["m"]), len(row))  # the row of an anchor is an edge to itself
        anchors = a[table["start"].to_numpy()]
        order = np.argsort(root, kind="stable")
        first, past = (np.searchsorted(root[order], root[anchors], side) for side in ("left", "right"))
        size = past - first
        reached = order[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
        anchor = np.repeat(anchors, size)
        pose = np.empty((len(reached), 4, 4))
        for part in _slices(np.arange(len(reached))):
            pose[part] = _inverses(into[anchor[part]]) @ into[reached[part]]
        at = table.select(names).take(pa.array(row[reached]))
        return pa.table([*at.columns, values.take(pa.array(value[reached])), _matrix_lists(pose, bool(table["m"].combine_chunks().flatten().null_count))],
                        names=[*names, "vertex", "pose"])

    solved = rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(lambda batches: _by_groups(batches, names, solve), schema)
    return solved.select(F.struct(*[F.col(n).alias(g) for g, n in zip(group, names)], F.col("vertex").alias("x")).alias("v"), "pose")


def _roots_of_groups(live: DataFrame, group: list[str]) -> DataFrame:
    """(c, p, m) of all vertices of trees that each fit a task: their tree's root and the transform into it."""
    names = [f"__g{i}" for i in range(len(group))]
    kind = live.schema["ca"].dataType
    rows = live.select(*[F.col(f"ca.{g}").alias(n) for g, n in zip(group, names)], F.col("ca.x").alias("a"), F.col("cb.x").alias("b"),
                       _sixteen("m").alias("m"))
    schema = T.StructType([*[T.StructField(n, kind[g].dataType) for g, n in zip(group, names)],
                           *[T.StructField(n, kind["x"].dataType) for n in ("vertex", "root")], T.StructField("m", T.ArrayType(T.DoubleType()))])

    def solve(table: pa.Table) -> pa.Table:
        a, b, row, value, values, _ = _graphs(table, names)
        root, into = _into_roots(a, b, _matrices(table["m"]), len(row))
        return pa.table([*table.select(names).take(pa.array(row)).columns, values.take(pa.array(value)), values.take(pa.array(value[root])),
                         _matrix_lists(into, bool(table["m"].combine_chunks().flatten().null_count))], names=[*names, "vertex", "root", "m"])

    solved = rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(lambda batches: _by_groups(batches, names, solve), schema)
    groups = [F.col(n).alias(g) for g, n in zip(group, names)]
    return stored(solved.select(F.struct(*groups, F.col("vertex").alias("x")).alias("c"), F.struct(*groups, F.col("root").alias("x")).alias("p"), "m"),
                  "parents")


def _large_groups(live: DataFrame, group: list[str]) -> DataFrame:
    """Groups with more edges than one task may compose."""
    return stored(live.groupBy(*[F.col(f"ca.{g}").alias(g) for g in group]).count().filter(F.col("count") > POSES_A_TASK).select(*group), "large")


def compose_poses(tree: DataFrame, anchors: DataFrame, *, group: list[str], a: str, b: str, transform: str) -> DataFrame:
    """(group..., vertex, pose): transforms of every frame into the anchor's frame along tree edges.

    ``transform`` maps b into a; walking an edge the other way uses the inverse.  Frames are expressed in their tree's root
    and then in the anchor; frames of other trees have no pose, an anchor without an edge has the identity.  Groups of up
    to ``POSES_A_TASK`` edges lie side by side in partitions and are composed many at once; larger ones are contracted by
    rounds of joins until they are that small.
    """
    live = tree.select(F.struct(*group, F.col(a).alias("x")).alias("ca"), F.struct(*group, F.col(b).alias("x")).alias("cb"),
                       F.col(transform).alias("m")).filter("ca <> cb")  # read twice, the first time without matrices
    vertex = live.schema["ca"].dataType
    starts = anchors.select(F.struct(*[F.col(g) for g in group], F.col("anchor").alias("x")).cast(vertex).alias("v"))
    large = _large_groups(live, group)
    if large.isEmpty():
        reached = _poses_of_groups(live, starts, group)
    else:
        marked = large.withColumn("__large", F.lit(True))
        kept, begun = (join_back(df.select(*[F.col(f"{end}.{g}").alias(g) for g in group], *df.columns), marked, group).drop(*group)
                       for df, end in ((live, "ca"), (stored(starts, "starts"), "v")))
        (many, some), (far, near) = ((df.filter("__large").drop("__large"), df.filter("__large is null").drop("__large"))
                                     for df in (kept, begun))
        reached = _poses_of_groups(some, near, group).unionByName(_poses_by_rounds(stored(many, "live"), stored(far, "starts"), group))
    return reached.select(*[F.col(f"v.{g}").alias(g) for g in group], F.col("v.x").alias("vertex"), "pose")


def _poses_by_rounds(live: DataFrame, starts: DataFrame, group: list[str]) -> DataFrame:
    """(v, pose) of stored edges (ca, cb, m) and anchors (v).

    The forest is contracted in rounds until every tree fits a task: every component hooks to its neighbour by one edge,
    pointer doubling with the matrix product as monoid carries all of a tree to its root, and the edges left between
    components take over the transforms of their ends.
    """
    same = F.array(*[F.lit(v) for v in IDENTITY])
    merges = []
    while not _large_groups(live, group).isEmpty():
        edge = F.struct(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"))
        halves = live.select(F.col("ca").alias("c"), edge.alias("o"), F.struct(
            F.col("cb").alias("to"), similarity_inverse(F.col("m")).alias("m")).alias("e")).unionByName(
            live.select(F.col("cb").alias("c"), edge.alias("o"), F.struct(F.col("ca").alias("to"), "m").alias("e")))
        best = stored(halves.groupBy("c").agg(F.min_by("e", "o").alias("e")).select("c", "e.to", "e.m"), "best")
        merges.append(_rooted_with(best))
        to_a, to_b = (merges[-1].select(F.col("c").alias(c), F.col("p").alias(n), F.col("m").alias(t))
                      for c, n, t in (("ca", "na", "ma"), ("cb", "nb", "mb")))
        moved = live.join(to_a, "ca").join(to_b, "cb").filter("na <> nb")
        before, live = live, stored(moved.select(F.col("na").alias("ca"), F.col("nb").alias("cb"), mat4_mul(
            mat4_mul(F.col("ma"), F.col("m")), similarity_inverse(F.col("mb"))).alias("m")), "live")
        discard(best)
        discard(before)
    merges.append(_roots_of_groups(live, group))
    poses = merges[-1].select(F.col("c").alias("v"), F.col("p").alias("root"), "m")
    for below in reversed(merges[:-1]):
        above = poses.select(F.col("v").alias("p"), F.col("root").alias("top"), F.col("m").alias("n"))
        poses = below.join(above, "p", "left").select(
            F.col("c").alias("v"), F.coalesce("top", "p").alias("root"),
            F.when(F.col("n").isNull(), F.col("m")).otherwise(mat4_mul(F.col("n"), F.col("m"))).alias("m"))
    poses = stored(poses, "poses")
    base = stored(starts.join(poses, "v").select("root", similarity_inverse(F.col("m")).alias("n")), "base")  # a row an anchor
    reached = poses.join(base, "root").select("v", mat4_mul(F.col("n"), F.col("m")).alias("pose"))
    return reached.unionByName(starts.join(poses.select("v"), "v", "left_anti").select("v", same.alias("pose")))


def walk_distances(cells: DataFrame, seeds: DataFrame, *, group: list[str], x: str, y: str) -> DataFrame:
    """Number of 4-neighbour steps from the seeds to every reachable cell.

    ``cells`` are the passable cells.  All groups advance one step per round.
    """
    keys = [*group, x, y]
    passable = cut_lineage(cells.select(*keys).distinct())
    frontier = cut_lineage(seeds.select(*keys).distinct().join(passable, keys, "left_semi").withColumn("steps", F.lit(0)))
    done, rounds = frontier, 0
    moves = F.explode(F.array(*[F.struct((F.col(x) + dx).alias("nx"), (F.col(y) + dy).alias("ny"))
                                for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    while not frontier.isEmpty():
        rounds += 1
        reached = frontier.select(*group, moves.alias("__n")).select(
            *group, F.col("__n.nx").alias(x), F.col("__n.ny").alias(y)).distinct()
        frontier = cut_lineage(reached.join(passable, keys, "left_semi").join(done, keys, "left_anti")
                               .withColumn("steps", F.lit(rounds)))
        done = done.unionByName(frontier)
        if rounds % 32 == 0:
            done = cut_lineage(done)
    return done


LEVELS_A_JOB = 4


def _settled(pairs: DataFrame, live: DataFrame, group: list[str]) -> DataFrame:
    """Groups in which all seeds with a live front are joined by pairs; a group has few seeds (labels of a sheet)."""
    def check(rows: pd.DataFrame) -> pd.DataFrame:
        top: dict = {}

        def find(v):
            while top.get(v, v) != v:
                v = top[v]
            return v

        for a, b in zip(rows["a"], rows["b"]):
            if find(a) != find(b):
                top[find(a)] = find(b)
        return rows[group].iloc[:1 if len({find(v) for v in rows["a"][rows["live"]]}) <= 1 else 0]

    rows = pairs.select(*group, "a", "b", F.lit(False).alias("live")).unionByName(
        live.select(*group, F.col("s").alias("a"), F.col("s").alias("b"), F.lit(True).alias("live")).distinct())
    return rows.groupBy(*group).applyInPandas(check, rows.select(*group).schema)


def meeting_distances(cells: DataFrame, seeds: DataFrame, *, group: list[str], seed: str, x: str, y: str) -> DataFrame:
    """F12 primitive: (group..., a, b, steps), the 4-neighbour steps between seeds, shortest first until no more
    can join what is apart: all pairs up to some length, among them every edge of the shortest forest.

    A labelled wavefront: every cell of a front carries the seed it came from, all fronts of all groups advance
    together, and a pair's distance arises where its fronts first meet, halfway, on a cell that one of them enters in
    this step and the other in this or the one before.  The grid has two colours, so a front never runs into itself but
    for the step before last, and two levels are all the state there is.  Pairs not met after n levels are longer than 2 n, and a
    front that has ended has met all seeds of its region, so a group stops when pairs join all its live fronts.
    """
    passable = stored(cells.select(*group, x, y).distinct(), "passable")
    at = [*group, x, y]
    start = seeds.select(*group, F.col(seed).alias("s"), x, y).join(passable, at, "left_semi").distinct()
    here = stored(start.withColumn("level", F.lit(0)), "front")
    moves = F.explode(F.array(*[F.struct((F.col(x) + dx).alias("nx"), (F.col(y) + dy).alias("ny"))
                                for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    pairs, done = None, 0
    while True:
        left = here.filter(F.col("level") >= done - LEVELS_A_JOB)
        right = left.select(*at, F.col("s").alias("b"), F.col("level").alias("lb"))
        met = left.join(right, at).filter((F.col("s") < F.col("b")) & (F.abs(F.col("level") - F.col("lb")) <= 1)) \
            .groupBy(*group, F.col("s").alias("a"), "b").agg(F.min(F.col("level") + F.col("lb")).alias("steps"))
        if pairs is not None:
            met = met.join(pairs, [*group, "a", "b"], "left_anti").unionByName(pairs)
        pairs = stored(met, "met")
        finished = _settled(pairs, here.filter(F.col("level") == done), group)
        key = [*group, "s"]
        here = stored(here.filter(F.col("level") >= done - 1).join(finished, group, "left_anti"), "front") \
            if done else here
        last, before = (here.filter(F.col("level") == n).select(*key, x, y) for n in (done, done - 1))
        fronts = []
        for step in range(1, LEVELS_A_JOB + 1):
            ahead = last.select(*key, moves.alias("m")).select(*key, F.col("m.nx").alias(x), F.col("m.ny").alias(y)).distinct() \
                .join(passable, at, "left_semi").join(before, [*key, x, y], "left_anti")
            before, last = last, ahead
            fronts.append(ahead.withColumn("level", F.lit(done + step)))
        keep = here.filter(F.col("level") == done)
        here = stored(reduce(DataFrame.unionByName, [keep, *fronts]), "front")
        if here.filter(F.col("level") > done).isEmpty():
            return pairs
        done += LEVELS_A_JOB
