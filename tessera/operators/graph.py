"""Knowledge graphs as ``nodes(id, label)`` / ``edges(from, to,
type)`` frames.

Raw model output is parsed with built-ins (fence strip + ``from_json``); bad
input gives an empty graph, never an error. ``term_graph`` derives a graph
from chunk keywords (the offline stand-in for the reference's model call):
keyword pairs of one chunk become ``co_occurs`` edges. The number of pairs
per chunk is bounded by the keyword count, so no group emits unbounded
pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

GRAPH_SCHEMA = ("nodes array<struct<id:string,label:string>>, "
                "edges array<struct<`from`:string,`to`:string,type:string>>")
FENCE = r"(?s)```(?:json)?(.*?)```"
CO_OCCURS = "co_occurs"


def strip_fence(raw="raw"):
    """G1: if the text contains a code fence, take the first fenced body
    (optional ``json`` tag), stripped; an unclosed fence gives NULL."""
    c = F.col(raw) if isinstance(raw, str) else raw
    body = F.regexp_extract(c, FENCE, 1)
    fenced = F.when(c.rlike(FENCE), F.regexp_replace(body, r"^\s+|\s+$", ""))
    return F.when(c.contains("```"), fenced).otherwise(c)


def parse_graph(df: DataFrame, raw: str = "raw", out: str = "graph") -> DataFrame:
    """JSON text -> graph struct; text that is not a JSON object gives a
    NULL graph (``from_json`` alone would return a struct of NULL fields),
    so a store keeps the previous graph for it."""
    body = strip_fence(raw)
    valid = F.json_object_keys(body).isNotNull()
    return df.withColumn(out, F.when(valid, F.from_json(body, GRAPH_SCHEMA)))


def graph_nodes(df: DataFrame, keys: list[str], graph: str = "graph") -> DataFrame:
    """One row per node; an absent node list gives no rows."""
    return df.select(*keys, F.explode(F.col(f"{graph}.nodes")).alias("__n")).select(
        *keys, F.col("__n.id").alias("id"), F.col("__n.label").alias("label"))


def graph_edges(df: DataFrame, keys: list[str], graph: str = "graph") -> DataFrame:
    """One row per directed edge; a missing type becomes ''."""
    return df.select(*keys, F.explode(F.col(f"{graph}.edges")).alias("__e")).select(
        *keys, F.col("__e.from").alias("from"), F.col("__e.to").alias("to"),
        F.coalesce(F.col("__e.type"), F.lit("")).alias("type"))


def term_graph(keywords: DataFrame, group: list[str], unit: list[str], min_count: int = 1):
    """``(nodes, edges)`` per ``group`` from keyword arrays per ``unit``
    (e.g. per chunk). Nodes are the distinct keywords; an edge joins two
    keywords of the same unit (``from < to``), weighted by the number of
    units, kept from ``min_count``.

    ``keywords`` has one row per unit with a bounded keyword array (the top-n
    annotation keywords), so a unit's pairs are generated inside its row
    from the sorted distinct array (at most n * (n - 1) / 2 of them) and
    counted with a partial aggregate: no self-join, no shuffle before the
    count."""
    kw = keywords.select(*group, *unit, F.explode(F.array_distinct("keywords")).alias("term"))
    nodes = kw.select(*group, F.col("term").alias("id")).distinct().withColumn("label", F.col("id"))
    srt = F.array_sort(F.filter(F.array_distinct("keywords"), lambda x: x.isNotNull()))
    later = F.flatten(F.transform(srt, lambda x, i: F.transform(
        F.slice(srt, i + 2, F.greatest(F.size(srt), F.lit(1))),
        lambda y: F.struct(x.alias("from"), y.alias("to")))))
    pairs = keywords.select(*group, F.explode(later).alias("__p")).select(*group, "__p.from", "__p.to")
    edges = (pairs.groupBy(*group, "from", "to").agg(F.count(F.lit(1)).alias("weight"))
             .filter(F.col("weight") >= min_count).withColumn("type", F.lit(CO_OCCURS)))
    return nodes, edges


def graph_json(nodes: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """Pack per-group node/edge rows into the JSON text the parser reads.
    Only for bounded graphs (one per question): it gathers a group."""
    n = nodes.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("nodes"))
    e = edges.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("from", "to", "type"))).alias("edges"))
    j = n.join(e, group, "full")
    return j.select(*group, F.to_json(F.struct(
        F.coalesce("nodes", F.array().cast("array<struct<id:string,label:string>>")).alias("nodes"),
        F.coalesce("edges", F.array().cast("array<struct<from:string,to:string,type:string>>")).alias("edges")))
        .alias("raw"))


ROW = ["element", "id", "label", "from", "to", "type"]


def graph_rows(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes and edges as one table ``(keys..., element, id, label, from, to,
    type)``."""
    none = F.lit(None).cast("string")
    return nodes.select(*keys, F.lit("node").alias("element"), "id", "label", none.alias("from"), none.alias("to"),
                        none.alias("type")).unionByName(
        edges.select(*keys, F.lit("edge").alias("element"), none.alias("id"), none.alias("label"), "from", "to", "type"))


def graph_changed(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame,
                  new_edges: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference of two graphs per ``keys`` as
    ``(keys..., element, change, id, label, from, to, type)`` rows;
    ``element`` is node/edge, ``change`` added/removed. Empty = unchanged."""
    old, new = graph_rows(old_nodes, old_edges, keys), graph_rows(new_nodes, new_edges, keys)
    # both differences from one count per row: how many more there are in the new graph
    rows = new.withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(-1)))
    rows = rows.groupBy(*keys, *ROW).agg(F.sum("n").alias("n")).filter("n <> 0")
    change = F.when(F.col("n") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change")
    each = F.explode(F.array_repeat(change, F.abs("n").cast("int"))).alias("change")
    return rows.select(*keys, *ROW, each)


def graph_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., size, digest)`` per graph: the number of its rows and two
    sums of 64-bit row hashes. Sums do not depend on the order of rows and count
    repeated ones; they are partial before the shuffle, so a huge graph sends
    one row per task."""
    def total(salt):
        return F.sum(F.xxhash64(*ROW, F.lit(salt)).cast("decimal(20,0)"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.struct(total("a").alias("a"), total("b").alias("b")).alias("digest"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"__{k}"])
    return on


def graph_states(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame,
                 graphs: DataFrame, keys: list[str]) -> DataFrame:
    """G6 for many graphs: ``(keys..., state, added, removed)`` for every graph
    of ``graphs`` (its key columns). ``absent``: there is no new graph;
    ``unchanged``: both have the same rows; ``changed`` with the numbers of
    added and removed rows otherwise (all added where there was no old one).

    Graphs are compared by digest first; only the rows of graphs whose
    digests differ are compared themselves."""
    old, new = graph_rows(old_nodes, old_edges, keys), graph_rows(new_nodes, new_edges, keys)
    named = [F.col(k).alias(f"__{k}") for k in keys]
    before = graph_digests(old, keys).select(*named, F.struct("size", "digest").alias("before"))
    after = graph_digests(new, keys).select(*named, F.struct("size", "digest").alias("after"))
    g = graphs.select(*keys).distinct()
    g = g.join(before, _same(g, before, keys), "left").drop(*[f"__{k}" for k in keys])
    g = g.join(after, _same(g, after, keys), "left").drop(*[f"__{k}" for k in keys])
    state = (F.when(F.col("after").isNull(), "absent").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed"))
    g = materialize(g.select(*keys, state.alias("state")))  # one row per graph, read three times below
    differ = g.filter("state = 'changed'").select(*named)

    def of_changed(rows):
        return rows.join(differ, _same(rows, differ, keys), "left_semi")
    old, new = of_changed(old), of_changed(new)
    rows = new.exceptAll(old).withColumn("n", F.lit(1)).unionByName(old.exceptAll(new).withColumn("n", F.lit(-1)))
    found = rows.groupBy(*keys).agg(F.count_if(F.col("n") == 1).alias("added"), F.count_if(F.col("n") == -1).alias("removed")) \
        .select(*named, "added", "removed")
    g = g.join(found, _same(g, found, keys), "left")
    return g.select(*keys, "state", F.coalesce("added", F.lit(0)).cast("long").alias("added"),
                    F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))
