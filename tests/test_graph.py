from pyspark.sql import functions as F

from tessera.operators import graph as G

GRAPHS = [
    (1, '{"nodes":[{"id":"mill","label":"A"}],"edges":[{"from":"mill","to":"river","type":"turns"}]}'),
    (2, 'text\n```json\n{"nodes":[{"id":"mill","label":"A"}],"edges":[]}\n```\nmore'),
    (3, '```\n{"nodes":[{"id":"lock","label":"B"}]}\n```'),
    (4, '```json\n{"nodes":[]}'),                                   # unclosed fence
    (5, '{"nodes":[{"id":"mill","label":"A"}],"edges":[{"from":"mill","to":"river"}]}'),  # missing type
    (6, 'not json at all'),
]


def test_parse_nodes_edges(spark):
    df = G.parse_graph(spark.createDataFrame(GRAPHS, "gid int, raw string"))
    nodes = sorted((r.gid, r.id, r.label) for r in G.graph_nodes(df, ["gid"]).collect())
    assert nodes == [(1, "mill", "A"), (2, "mill", "A"), (3, "lock", "B"), (5, "mill", "A")]
    edges = sorted((r.gid, r["from"], r.to, r.type) for r in G.graph_edges(df, ["gid"]).collect())
    assert edges == [(1, "mill", "river", "turns"), (5, "mill", "river", "")]
    bad = {r.gid: r.graph for r in df.filter("gid in (4, 6)").collect()}
    assert bad[4] is None or (bad[4].nodes is None and bad[4].edges is None)


def test_graph_changed(spark):
    n = "k int, id string, label string"
    e = "k int, from string, to string, type string"
    old_n = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (2, "a", "A"), (3, "a", "A")], n)
    old_e = spark.createDataFrame([(1, "a", "b", "t"), (3, "a", "b", "t")], e)
    new_n = spark.createDataFrame([(1, "b", "B"), (1, "a", "A"), (2, "a", "A2"), (3, "a", "A")], n)
    new_e = spark.createDataFrame([(1, "a", "b", "t")], e)
    ch = G.graph_changed(old_n, old_e, new_n, new_e, ["k"])
    got = sorted((r.k, r.element, r.change) for r in ch.collect())
    assert got == [(2, "node", "added"), (2, "node", "removed"), (3, "edge", "removed")]
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,), (1,)], "k int")
    st = {r.k: (r.state, r.added, r.removed) for r in G.graph_states(old_n, old_e, new_n, new_e, keys, ["k"]).collect()}
    assert st == {1: ("unchanged", 0, 0), 2: ("changed", 1, 1), 3: ("changed", 0, 1), 4: ("absent", 0, 0)}


def test_graph_states_count_repeated_rows_and_skip_equal_graphs(spark):
    n, e = "k int, id string, label string", "k int, from string, to string, type string"
    old = [(1, "a", "A"), (1, "a", "A"), (2, "x", "X"), (2, "y", None), (None, "q", "Q"), (5, "gone", "G")]
    new = [(1, "a", "A"), (2, "y", None), (2, "x", "X"), (None, "q", "Q"), (3, "n", "N"), (3, "m", "M")]
    none = spark.createDataFrame([], e)
    keys = spark.createDataFrame([(1,), (2,), (3,), (None,), (5,)], "k int")
    states = G.graph_states(spark.createDataFrame(old, n), none, spark.createDataFrame(new, n), none, keys, ["k"])
    assert {r.k: (r.state, r.added, r.removed) for r in states.collect()} == {
        1: ("changed", 0, 1), 2: ("unchanged", 0, 0), 3: ("changed", 2, 0), None: ("unchanged", 0, 0), 5: ("absent", 0, 0)}
    rows = G.graph_rows(spark.createDataFrame(old, n), none, ["k"])
    digest = {r.k: r.digest for r in G.graph_digests(rows, ["k"]).collect()}
    again = {r.k: r.digest for r in G.graph_digests(rows.orderBy(F.desc("id")).repartition(5), ["k"]).collect()}
    assert digest == again


def test_term_graph(spark):
    kw = spark.createDataFrame([(1, 1, ["a", "b", "c"]), (1, 2, ["b", "a"]), (2, 1, ["x"])],
                               "g int, u int, keywords array<string>")
    nodes, edges = G.term_graph(kw, ["g"], ["u"])
    assert sorted((r.g, r.id) for r in nodes.collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "x")]
    got = sorted((r.g, r["from"], r.to, r.weight) for r in edges.collect())
    assert got == [(1, "a", "b", 2), (1, "a", "c", 1), (1, "b", "c", 1)]
    raw = G.graph_json(nodes, edges.drop("weight"), ["g"])
    back = G.graph_nodes(G.parse_graph(raw), ["g"])
    assert back.count() == 4


def test_graph_store_keeps_previous_on_failed_parse(spark, workdir):
    from tessera.sources.store import read_graph, write_graph
    root = workdir + "/graphs"
    assert read_graph(spark, root, "k int") is None
    first = G.parse_graph(spark.createDataFrame(
        [(1, '{"nodes":[{"id":"a","label":"A"}],"edges":[]}'), (2, '{"nodes":[{"id":"b","label":"B"}]}')],
        "k int, raw string"))
    assert write_graph(first, root, ["k"], "k int") == 1
    second = G.parse_graph(spark.createDataFrame(
        [(1, "not json"), (2, '{"nodes":[{"id":"c","label":"C"}]}')], "k int, raw string"))
    assert write_graph(second, root, ["k"], "k int") == 2
    saved = read_graph(spark, root, "k int")
    got = sorted((r.k, r.id) for r in G.graph_nodes(
        saved.selectExpr("k", "struct(nodes, edges) AS graph"), ["k"]).collect())
    assert got == [(1, "a"), (2, "c")]  # key 1 kept its graph, key 2 replaced
    failed = G.parse_graph(spark.createDataFrame([(1, "```json\n{")], "k int, raw string"))
    assert write_graph(failed, root, ["k"], "k int") is None
