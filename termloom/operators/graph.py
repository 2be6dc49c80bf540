"""A typed graph of terms: edges from definitions, compounds and vectors, and walks over them.

Nodes are (term, definition); edges are (source, target, type, weight), and repeated edges stay.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.similarity import dot
from termloom.functions.text import pair_key, repaired, strip
from termloom.operators.contain import containing
from termloom.operators.nearby import usable

#: Patterns whose capture names a category, and the edge types: fixed values.
CATEGORY_PATTERNS = ("(.+?)の一種", "(.+?)に属する", "(.+?)系")
COMPOUND_OF, SIMILAR_MEANING, PARENT_TERM, CATEGORY = "COMPOUND_OF", "SIMILAR_MEANING", "PARENT_TERM", "CATEGORY"


def _edge(source: Column | str, target: Column | str, kind: str, weight: Column | float = 1.0) -> list[Column]:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return [col(source).alias("source"), col(target).alias("target"), F.lit(kind).alias("type"), (weight if isinstance(weight, Column) else F.lit(float(weight))).alias("weight")]


def compound_edges(partial: DataFrame, nodes: DataFrame) -> DataFrame:
    """partial (surface, compound): an edge from each compound that is a node to its part."""
    return partial.join(nodes.select(F.col("term").alias("compound")), "compound", "left_semi").select(*_edge("compound", "surface", COMPOUND_OF))


def similar_edges(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, similarity): an edge each way. Pairs are found once for both."""
    way = lambda source, target: F.struct(*_edge(source, target, SIMILAR_MEANING, F.col("similarity")))
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def parent_edges(nodes: DataFrame) -> DataFrame:
    """An edge from each term to every other term that its lower-cased definition holds, once for each node of that name. Terms
    are compared as they are, so one with a capital is nobody's parent."""
    d = nodes.select("term", F.lower("definition").alias("text"))
    other = nodes.select(F.col("term").alias("needle")).where("needle <> '' AND needle = lower(needle)")
    held = containing(d.select("text"), [], other)
    return d.join(held, "text").join(other, "needle").where("term <> needle").select(*_edge("term", "needle", PARENT_TERM))


def captures(text: Column, marker: str) -> Column:
    """What "(.+?)marker" captures, match after match, in the lines of a text. A line is read up to its last marker, so that every
    place where a match can begin has one, and time grows with the text's length alone."""
    upto = lambda line: F.substring(line, F.lit(1), F.length(line) - F.length(F.substring_index(line, marker, -1)))
    own = lambda line: F.regexp_extract_all(upto(line), F.lit(rf"(?d)(.+?)\Q{marker}\E"), F.lit(1))
    return F.flatten(F.transform(F.split(text, "\n"), own))


def category_edges(nodes: DataFrame, patterns: tuple[str, ...] = CATEGORY_PATTERNS) -> DataFrame:
    """An edge from each term to every capture of a pattern in its definition that is a node, once for each match.

    A capture begins where its line or the match before ends, so it takes the whole prefix; it may be the term itself."""
    found = [captures(F.col("definition"), p.removeprefix("(.+?)")) for p in patterns]
    captured = nodes.select("term", F.explode(F.concat(*found)).alias("c")).select("term", strip(F.col("c")).alias("category"))
    return captured.join(nodes.select(F.col("term").alias("category")), "category", "left_semi").select(*_edge("term", "category", CATEGORY))


def cooccurrence(contexts: DataFrame, terms: DataFrame) -> DataFrame:
    """a, b (a < b), once each: a term, and another that one of its contexts (term, context) holds in any case."""
    lowered = terms.select(F.col("term").alias("other"), F.lower("term").alias("needle")).where("needle <> ''")
    own = contexts.select("term", F.lower("context").alias("text")).distinct()
    met = own.join(containing(own.select("text"), [], lowered), "text").join(lowered, "needle").where("term <> other")
    a, b = pair_key(F.col("term"), F.col("other"))
    return met.select(a.alias("a"), b.alias("b")).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """seed, node, depth: what each seed (column `seed`) reaches along outgoing edges in `depth` steps at most, itself at 0.

    A join for each step, over the nodes that the last one reached anew; all seeds walk together."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    edge = seen
    for d in range(1, depth + 1):
        step = edge.join(out, "node").select("seed", F.col("next").alias("node")).distinct()
        edge = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(edge)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that seeds which are nodes reach: seed, term, depth and definition (null for an end that is no node), and
    all edges out of reached nodes, those beyond the depth and repeated ones among them."""
    known = seeds.join(nodes.select(F.col("term").alias("seed")), "seed", "left_semi")
    reached = bfs(edges, known, depth)
    return (
        reached.join(nodes.withColumnRenamed("term", "node"), "node", "left").select("seed", F.col("node").alias("term"), "depth", "definition"),
        reached.select("seed", F.col("node").alias("source")).join(edges, "source").select("seed", "source", "target", "type", "weight"),
    )


def top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """rank, id and score of the k vectors (id, embedding) nearest to the one row of query (embedding), ties to smaller ids. Vectors
    that usable() leaves out take no part."""
    own, length, _ = usable(vectors)
    asked = query.where(F.size("embedding") == length).select(F.col("embedding").alias("_q"))
    scored = own.join(F.broadcast(asked)).select("id", dot(F.col("embedding"), F.col("_q")).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score"))).alias("x"))
    return best.select(F.posexplode("x").alias("p", "r")).select((F.col("p") + 1).alias("rank"), "r.id", "r.score")


def neighbours(found: DataFrame, edges: DataFrame, incoming: str, outgoing: str) -> DataFrame:
    """found (id) with two sorted lists: sources of incoming edges of one type, and targets of outgoing ones of another.

    Each side is aggregated before it is joined, so the two lists never multiply."""
    side = lambda kind, end, before, related: F.when(F.col("type") == kind, F.struct(F.col(end).alias("id"), before.alias("before"), related.alias("related")))
    none, no = F.array().cast("array<string>"), lambda c: F.lit(None).cast(edges.schema[c].dataType)
    ends = F.array(side(incoming, "target", F.col("source"), no("target")), side(outgoing, "source", no("source"), F.col("target")))
    each = edges.select(F.inline(F.filter(ends, lambda e: e.isNotNull())))  # edges are made once for both sides
    lists = each.groupBy("id").agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in ("before", "related")))
    return found.join(lists, "id", "left").withColumns({c: F.coalesce(F.col(c).cast("array<string>"), none) for c in ("before", "related")})


def first_of_type(edges: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first n edges of each type by `order`. Spark cuts each task's rows to n a type before it deals them out."""
    place = F.row_number().over(Window.partitionBy("type").orderBy(order))
    return edges.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def merge_entities(rows: DataFrame, separator: str = "<SEP>") -> DataFrame:
    """rows (entity, entity_type, description, source_id): one row an entity, with its commonest type (ties to the least) and
    its distinct descriptions and sources, sorted and joined."""
    counted = rows.groupBy("entity", "entity_type").agg(F.count("*").alias("n"))
    most = counted.groupBy("entity").agg(F.max("n").alias("n"))
    best = counted.join(most, ["entity", "n"]).groupBy("entity").agg(F.min("entity_type").alias("entity_type"))
    joined = rows.groupBy("entity").agg(*(F.array_join(F.sort_array(F.collect_set(c)), separator).alias(c) for c in ("description", "source_id")))
    return joined.join(best, "entity").select("entity", "entity_type", "description", "source_id")


def merge_edges(rows: DataFrame, separator: str = "<SEP>") -> DataFrame:
    """rows (source, target, weight, description, source_id, order): one row a pair of entities, whichever comes first, with the
    sum of weights, the least order, and distinct descriptions and sources, sorted and joined."""
    a, b = pair_key(F.col("source"), F.col("target"))
    joined = (F.array_join(F.sort_array(F.collect_set(c)), separator).alias(c) for c in ("description", "source_id"))
    return rows.groupBy(a.alias("source"), b.alias("target")).agg(F.sum("weight").alias("weight"), F.min("order").alias("order"), *joined)


NODES_JSON = "nodes array<struct<id string, label string, properties struct<name string, definition string>>>"
EDGES_JSON = "relationships array<struct<type string, start_node_id string, end_node_id string>>"


def extracted(replies: DataFrame, keys: list[str], types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a model's replies (keys, reply), JSON objects with nodes and relationships: keys, id, label, name and
    definition; keys, source, target (names) and type.

    Ids count within their reply; of an id given twice the last node counts. A reply without an object has no rows, nor has a
    relationship whose ends aren't both nodes of its reply, or whose type isn't among `types`."""
    own = replies.select(*keys, F.from_json(repaired(F.col("reply")), f"{NODES_JSON}, {EDGES_JSON}").alias("r"))
    each = own.select(*keys, F.posexplode("r.nodes").alias("at", "n")).where("n.id IS NOT NULL")
    last = each.groupBy(*keys, F.col("n.id").alias("id")).agg(F.max_by("n", "at").alias("n"))
    nodes = last.select(*keys, "id", "n.label", "n.properties.name", "n.properties.definition")
    edges = own.select(*keys, F.explode("r.relationships").alias("e")).select(*keys, "e.*")
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    end = lambda c, name: nodes.select(*keys, F.col("id").alias(c), F.col("name").alias(name))
    met = edges.join(end("start_node_id", "source"), [*keys, "start_node_id"]).join(end("end_node_id", "target"), [*keys, "end_node_id"])
    return nodes, met.select(*keys, "source", "target", "type")


def in_order(compounds: DataFrame, similar: DataFrame, parents: DataFrame, categories: DataFrame) -> DataFrame:
    """All edges of a graph with seq, the order in which they are added: compounds, then by kind, source and target."""
    kinds = [x.withColumn("stage", F.lit(k)) for k, x in enumerate((compounds, similar, parents, categories))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    return numbered(every, ["stage", "source", "target"], "seq").drop("stage")


def unembedded(nodes: DataFrame) -> DataFrame:
    """The nodes (term, definition, embedding) that lack an embedding: term, and the text to embed."""
    return nodes.where("embedding IS NULL").select("term", F.coalesce("definition", F.lit("")).alias("definition"))


def spherical_layout(df: DataFrame, index: str, n: Column) -> DataFrame:
    """x, y, z of the index-th of n points on a spiral around the unit sphere; one point alone is a pole."""
    z = F.when(n > 1, 2.0 * F.col(index) / (n - 1) - 1.0).otherwise(-1.0)
    theta = F.acos(z)
    phi = F.sqrt(n * math.pi) * theta
    return df.withColumns({"x": F.sin(theta) * F.cos(phi), "y": F.sin(theta) * F.sin(phi), "z": z})


def numbered(df: DataFrame, order: str | list[str], place: str) -> DataFrame:
    """df with a row's place (from 0) by `order`: range partitions are counted, and each is numbered from where the one before
    ends, so that only a row for each partition meets in one task. Needs a checkpoint folder, which keeps the partitions."""
    order = [order] if isinstance(order, str) else order
    df = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("_pid").agg(F.count("*").alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return df.withColumn("_row", inside).join(F.broadcast(parts), "_pid").withColumn(place, F.col("_before") + F.col("_row") - 1).drop("_pid", "_row", "_before")


def _to_least(links: DataFrame, upwards: bool) -> DataFrame:
    """Of every node, its greater neighbours (upwards) or its smaller ones and itself, linked to the least of all of them."""
    pairs = links.select(F.col("high").alias("node"), F.col("low").alias("other"))
    if upwards:
        pairs = pairs.unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("other")))
    least = pairs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    met = pairs.join(least, "node")
    ends = met.where("other > node").select(F.col("other").alias("high"), F.col("m").alias("low")) if upwards else met.select(F.explode(F.array("node", "other")).alias("high"), F.col("m").alias("low"))
    return ends.where("high <> low").distinct()


#: Edges that a task gathers before it leaves those out that join nothing; nodes up to which their labels go to every task.
GATHERED, NEAR_NODES = 1 << 20, 1 << 22


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the root of each) of edges."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, up = at[: len(a)], at[len(a) :], np.arange(len(node))
    while len(u):
        low, high = np.minimum(up[u], up[v]), np.maximum(up[u], up[v])
        np.minimum.at(up, high, low)
        while not np.array_equal(up, on := up[up]):
            up = on
        apart = up[u] != up[v]
        u, v = u[apart], v[apart]
    return node, node[up]


def forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as trees of what each task has: node and root, a row for each of a task's nodes, however many edges there are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append((frame["a"].to_numpy(), frame["b"].to_numpy()))
            n += len(frame)
            if n > GATHERED + 2 * len(held[0][0]):
                held, n = [_roots(*map(np.concatenate, zip(*held, strict=True)))], 0
        if held:
            node, root = _roots(*map(np.concatenate, zip(*held, strict=True)))
            for k in range(0, len(node), 1 << 16):
                yield pd.DataFrame({"node": node[k : k + (1 << 16)], "root": root[k : k + (1 << 16)]})

    kind = edges.schema["a"].dataType.simpleString()
    ends = edges.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a IS NOT NULL")
    return ends.mapInPandas(run, f"node {kind}, root {kind}")


def connected(edges: DataFrame) -> DataFrame:
    """node and component (the least node) of undirected edges (a, b).

    Of each task's edges a forest alone is stored. Each round links neighbourhoods to their least node, first those above a node and
    then those below; the rounds grow as the logarithm of the longest way, and each is cut by a checkpoint. A hub's links are split
    by AQE's join for skewed keys."""
    trees = forests(edges).checkpoint()
    own = trees.select("node").distinct()
    links = trees.where("node <> root").select(F.greatest("node", "root").alias("high"), F.least("node", "root").alias("low")).distinct().checkpoint()
    before = None
    while (now := links.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()) != before:
        before, links = now, _to_least(_to_least(links, True), False).checkpoint()
    roots = links.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return own.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _turn(node: Column, round_: int) -> Column:
    """Whether a node may change its label in a round: half of them may, by a hash, so that two neighbours don't swap for ever."""
    return (F.ascii(F.substring(F.md5(node.cast("string")), 1, 1)) + round_) % 2 == 0


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node and community (its least node) of undirected weighted edges (a, b, weight), by label propagation.

    Each node begins with itself as its label. In a round, the nodes whose turn it is take the label that their neighbours have with
    the most weight, ties to the least label; weights count in millionths, so that sums don't depend on their order. Edges to
    the node itself and those without a positive weight have no say; repeated edges add up. Edges are stored once, one way, in packed
    columns, and labels, a row for each node, after each round. Labels of up to NEAR_NODES nodes go to the edges, else these are
    dealt out; votes are summed before they are. Stops when no label has changed in two rounds. Needs a checkpoint folder."""
    spark = edges.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/edges-{uuid.uuid4().hex}"
    weight = F.when(F.col("weight") > 0, F.round(F.col("weight") * 1_000_000).cast("long"))
    edges.select("a", "b", weight.alias("w")).write.option("compression", "zstd").parquet(path)
    edges = spark.read.parquet(path)
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col("w"))
    both = edges.where("w IS NOT NULL AND a <> b").select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels, still = ends.select("node", F.col("node").alias("label")).checkpoint(), 0
    near = F.broadcast if labels.count() <= NEAR_NODES else lambda df: df
    for r in range(rounds):
        asking = both.where(_turn(F.col("a"), r))
        votes = asking.join(near(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best"))
        told = labels.join(best, "node", "left").select("node", F.coalesce("best.label", "label").alias("label"), (F.coalesce("best.label", "label") != F.col("label")).alias("moved")).checkpoint()
        still = 0 if told.where("moved").limit(1).count() else still + 1
        labels = told.select("node", "label")
        if still == 2:
            break
    least = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(least, "label").select("node", "community")


def modularity(edges: DataFrame, found: DataFrame) -> DataFrame:
    """communities and modularity (how much more weight lies within them than their nodes' weights would have by chance) of
    undirected edges (a, b, weight) and found (node, community)."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("community").alias(f"{c}_in"))
    own = edges.where("weight > 0 AND a <> b").join(of("a"), "a").join(of("b"), "b")
    inner = own.where("a_in = b_in").groupBy(F.col("a_in").alias("community")).agg(F.sum("weight").alias("within"))
    sides = own.select(F.col("a_in").alias("community"), "weight").unionByName(own.select(F.col("b_in").alias("community"), "weight"))
    total = own.agg(F.sum("weight").alias("total"))
    each = sides.groupBy("community").agg(F.sum("weight").alias("side")).join(inner, "community", "left").join(F.broadcast(total))
    part = F.coalesce("within", F.lit(0.0)) / F.col("total") - F.pow(F.col("side") / (2 * F.col("total")), 2)
    return each.agg(F.count("*").alias("communities"), F.sum(part).alias("modularity"))
