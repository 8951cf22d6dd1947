"""

``queries()`` maps a name to ``(spark, sf_dir) -> DataFrame``; every query
reads the driver's tables under ``sf_dir`` (whole tables, whole texts).
``oracle_sql()`` gives the independent DuckDB SQL for the same name.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.token_costs import vocabulary_cost
from tessera.session import materialize, release
from tessera.sources.objects import read_object_lines, read_objects, write_objects
from tessera.sources.sales import discover_keys, load_sales, schema_catalog, customers_from, table_dump
from tessera.operators import sales as S
from tessera.operators import report as R
from tessera.operators import quality as Q
from tessera.operators import listing as L
from tessera.operators import indexing as D
from tessera.operators import annotate as AN
from tessera.operators import retrieval as T
from tessera.operators.long_chunking import chunk_blocks, line_blocks
from tessera.operators.postings import build_postings
from tessera.plans import answering as ANS
from tessera.plans.indexing_run import index_documents, index_updates
from tessera.operators import graph as G
from tessera.operators import topics as TP
from tessera.operators import transcripts as C
from tessera.streaming.corpus_index import index_new_objects, published_index, stored_statuses

SF0001 = "/root/testdata/sf0.001"

# Low-stock threshold for the driver tables: p_size is 1..50 there, so the
# reference default of 50 would select nearly everything.
DRIVER_LOW_STOCK = 10


def _present(module: str) -> bool:
    try:
        return importlib.util.find_spec(module) is not None
    except ModuleNotFoundError:  # its package is missing
        return False


# The training-data operators are an optional subpackage. Only its absence is
# passed over; a fault inside it is raised.
LLM = None
if _present("tessera.llm.queries") and _present("corpus_pipeline"):
    from tessera.llm import queries as LLM


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: J5 product sales summary on sf0.001."""
    t = load_sales(spark, SF0001)
    return S.product_sales_summary(t["products"], t["order_items"])


def _sales(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_sales(spark, sf_dir))
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        # sales: projections, joins, aggregates
        "product_sales_summary": _sales(lambda t: S.product_sales_summary(t["products"], t["order_items"])),
        "low_stock": _sales(lambda t: S.low_stock(t["products"], DRIVER_LOW_STOCK)),
        "shipping_address": _sales(lambda t: S.with_shipping_address(t["orders"], t["customers"])),
        "top_products": _sales(lambda t: S.top_products(t["products"], t["order_items"])),
        "category_sales": _sales(lambda t: S.category_sales(t["products"], t["order_items"])),
        "top_customers": _sales(lambda t: S.top_customers(t["customers"], t["orders"])),
        "customer_orders_summary": _sales(lambda t: S.customer_orders_summary(t["customers"], t["orders"])),
        "price_lookup": _sales(lambda t: S.price_lookup(t["order_items"], t["products"])),
        "sales_totals": _sales(lambda t: S.sales_totals(t["orders"])),
        "status_breakdown": _sales(lambda t: S.status_breakdown(t["orders"])),
        "products_per_category": _sales(lambda t: S.products_per_category(t["products"])),
        "customer_count": _sales(lambda t: S.customer_count(t["customers"])),
        "customers_per_state": _sales(lambda t: S.customers_per_state(t["customers"])),
        "inventory_stats": _sales(lambda t: S.inventory_stats(t["products"])),
        "payment_breakdown": _sales(lambda t: S.payment_breakdown(t["orders"])),
        "order_totals": _sales(lambda t: S.order_totals(t["order_items"])),
        "order_total_reconciliation": _sales(lambda t: S.order_total_reconciliation(t["orders"], t["order_items"])),
        "table_dump": _sales(lambda t: table_dump(t, "products")),
        # report
        "sales_report_lines": _sales(lambda t: R.sales_report_lines(
            t, generated_on=REPORT_STAMP, low_stock_threshold=DRIVER_LOW_STOCK)),
        # catalog and data quality
        "schema_catalog": _sales(schema_catalog),
        "discovered_keys": _sales(discover_keys),
        "null_violations": _sales(_null_violations),
        "duplicate_order_items": _sales(lambda t: Q.unique_violations(t["order_items"], ["order_item_id"])),
        "orphan_counts": _sales(lambda t: Q.orphan_counts([
            ("orders.customer_id", t["orders"], t["customers"], "customer_id", "customer_id"),
            ("order_items.order_id", t["order_items"], t["orders"], "order_id", "order_id"),
            ("order_items.product_id", t["order_items"], t["products"], "product_id", "product_id")])),
        "orders_without_items": _sales(lambda t: Q.orphans(t["orders"], t["order_items"], "order_id")
                                       .drop("shipping_address")),
        "append_customers": _append_customers,
        # object listing
        "folders": lambda spark, d: L.folders(_page_keys(spark, d)),
        "files": lambda spark, d: L.files(_page_keys(spark, d)),
        "listing_lines": lambda spark, d: L.listing_lines(_page_keys(spark, d)),
        "supported_files": lambda spark, d: L.supported_files(_page_keys(spark, d)),
        "event_stamps": lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select(
            "event_id", R.now_stamp(F.col("ts")).alias("stamp")),
        # document indexing
        "chunk_documents": lambda spark, d: D.chunk_documents(_doc_objects(spark, d)),
        "chunk_documents_200": lambda spark, d: D.chunk_documents(_doc_objects(spark, d), max_tokens=200),
        "chunk_by_vocabulary": _chunk_by_vocabulary,
        "word_counts": lambda spark, d: D.tokenize_words(_doc_objects(spark, d)).select(
            "key", F.size("words").alias("n_words")),
        "decode_text": _decode_text,
        "decode_damaged_text": _decode_damaged_text,
        "filled_replies": lambda spark, d: D.fill_failed(_partial_replies(spark, d), "summary"),
        "chunk_counts": lambda spark, d: D.chunk_counts(_chunks(spark, d)),
        "annotate_chunks": lambda spark, d: AN.annotate_chunks(_chunks(spark, d)).withColumn(
            "keywords", F.array_join("keywords", ", ")),
        "topic_model": _topic_model,
        "chunk_topics": lambda spark, d: AN.chunk_topics(AN.annotate_chunks(_chunks(spark, d))),
        "index_status": lambda spark, d: _index_run(spark, d)[0],
        "index_errors": _index_errors,
        "read_objects": _read_objects,
        "chunk_object_lines": _chunk_object_lines,
        "streamed_index": lambda spark, d: _streamed(spark, d, published_index),
        "streamed_statuses": lambda spark, d: _streamed(spark, d, stored_statuses),
        "index_status_hash": lambda spark, d: _hash_run(spark, d)[0],
        "saved_index": _saved_index,
        "index_run_summary": lambda spark, d: D.index_run_summary(_index_run(spark, d)[0]),
        "upsert_index": lambda spark, d: _index_run(spark, d)[1],
        "pack_index": lambda spark, d: D.pack_index(_index_run(spark, d)[1]),
        "explode_index": lambda spark, d: D.explode_index(D.pack_index(_index_run(spark, d)[1])),
        # retrieval over the benchmark questions
        "score_chunks": lambda spark, d: _answer(spark, d, T.score_chunks),
        "parse_scored_reply": lambda spark, d: T.parse_scored_reply(_replies(spark, d)).drop("reply"),
        "top_chunks": lambda spark, d: _answer_by_blocks(spark, d, ANS.top_candidates),
        "top_scored_chunks": lambda spark, d: T.top_chunks(_answer(spark, d, T.score_chunks)),
        "relevant_chunks": lambda spark, d: _answer_by_blocks(spark, d, ANS.relevant),
        "build_context": lambda spark, d: _answer(spark, d, ANS.contexts),
        "truncate_context": lambda spark, d: T.truncate_context(_answer(spark, d, ANS.contexts), limit=300, keep=100),
        "clip_output": lambda spark, d: T.clip_output(_answer(spark, d, ANS.contexts), "context", 200),
        "summarize_context": _summarize_context,
        "diverse_summary": _diverse_summary,
        "filled_summaries": lambda spark, d: D.fill_failed(_summarize_context(spark, d), "summary"),
        "build_prompts": _build_prompts,
        # knowledge graphs
        "term_graph_nodes": lambda spark, d: _corpus_graph(spark, d, 8)[0],
        "term_graph_edges": lambda spark, d: _corpus_graph(spark, d, 8)[1],
        "graph_changed": _graph_changed,
        "graph_state": _graph_state,
        "graph_nodes": lambda spark, d: G.graph_nodes(_question_graphs(spark, d), ["query_id"]),
        "graph_edges": lambda spark, d: G.graph_edges(_question_graphs(spark, d), ["query_id"]),
        "saved_graph_nodes": _saved_graph_nodes,
        # conversation transcripts
        "cap_rounds": lambda spark, d: C.cap_rounds(_conv(spark, d), max_rounds=2),
        "tool_results": lambda spark, d: C.tool_results(_conv(spark, d)),
        "stop_round": lambda spark, d: C.stop_round(_conv(spark, d)),
        "assemble_response": lambda spark, d: C.assemble_response(_conv(spark, d)),
        "followup_prompts": lambda spark, d: C.followup_prompts(_conv(spark, d)),
        "round_summary": lambda spark, d: C.round_summary(_conv(spark, d)),
    }
    if LLM is not None:
        q.update(LLM.queries())
    return q


def _conv(spark, sf_dir):
    """The conversations, with every second assistant turn wrapped as the
    result of a tool (the given table has none)."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tool = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    return c.withColumn("text", F.when(tool, F.concat(F.lit("[lookup result]:\n"), F.col("text"))).otherwise(F.col("text")))


GRAPH_MIN_COUNT = 1


def _corpus_graph(spark, sf_dir, n_keywords):
    return _keyword_graph(_chunks(spark, sf_dir), n_keywords)


def _keyword_graph(chunks, n_keywords):
    # nodes and edges both read the keywords
    ann = materialize(AN.annotate_chunks(chunks, n_keywords=n_keywords).select("key", "chunk_no", "keywords"))
    return G.term_graph(ann, [], ["key", "chunk_no"], GRAPH_MIN_COUNT)


def _graph_changed(spark, sf_dir):
    """G6 between the term graph of 5 and of 8 keywords per chunk."""
    ch = _chunks(spark, sf_dir)
    on, oe = _keyword_graph(ch, 5)
    nn, ne = _keyword_graph(ch, 8)
    return G.graph_changed(on, oe.drop("weight"), nn, ne.drop("weight"), [])


def _graph_state(spark, sf_dir):
    """G6 per question: an older graph without the nodes from 'm' on, the
    same or none at all, against the present one, which every fifth lacks."""
    graphs = materialize(_question_graphs(spark, sf_dir))
    nodes, edges = G.graph_nodes(graphs, ["query_id"]), G.graph_edges(graphs, ["query_id"])
    old_nodes = nodes.filter("query_id % 3 = 0 OR query_id % 3 = 1 AND id < 'm'")
    old_edges = edges.filter("query_id % 3 <> 2")
    return G.graph_states(old_nodes, old_edges, nodes.filter("query_id % 5 <> 4"), edges.filter("query_id % 5 <> 4"),
                          _questions(spark, sf_dir), ["query_id"])


def _topic_model(spark, sf_dir):
    """D5 topics: eight topic weights per chunk of the documents."""
    ch, table = _index(spark, sf_dir)
    release(ch)  # the terms are all that is read on
    return TP.topic_model(table)[0]


def _saved_graph_nodes(spark, sf_dir):
    """S6 round trip: question graphs written as JSON to the shared
    checkpoint folder, read back, exploded into nodes."""
    import uuid
    from tessera.session import scratch_path
    from tessera.sources.store import read_graph, write_graph
    path = scratch_path(spark, f"graphs-{uuid.uuid4().hex}")
    write_graph(_question_graphs(spark, sf_dir), path, ["query_id"], "query_id bigint")
    saved = read_graph(spark, path, "query_id bigint")
    return G.graph_nodes(saved.select("query_id", F.struct("nodes", "edges").alias("graph")), ["query_id"])


def _question_graphs(spark, sf_dir):
    """Per question: the term graph of its kept chunks, rendered as fenced
    JSON (the model-output shape) and parsed back (G1, G2). Keywords are taken
    for kept chunks only, with the statistics of the whole corpus."""
    ch, table = _index(spark, sf_dir)
    best = T.best_chunks(_questions(spark, sf_dir), None, table=table)
    kept = materialize(T.relevant_only(best).select("query_id", "file", "chunk"))
    keys = ["file", "chunk"]
    kw = AN.keywords(AN.tfidf(ch.join(kept, keys, "left_semi"), "text", keys, statistics=T.frequencies(ch, table)), keys=keys)
    nodes, edges = G.term_graph(materialize(kept.join(kw, keys)), ["query_id"], keys)
    raw = G.graph_json(nodes, edges.drop("weight"), ["query_id"]).withColumn(
        "raw", F.concat(F.lit("```json\n"), F.col("raw"), F.lit("\n```")))
    return G.parse_graph(raw)


def _chunks(spark, sf_dir, max_tokens=D.MAX_TOKENS):
    """The chunk table feeds several operators in one query, so it is written
    once to the shared checkpoint folder instead of re-running the chunker
    in every branch."""
    return materialize(D.chunk_documents(_doc_objects(spark, sf_dir), max_tokens=max_tokens))


def _rchunks(spark, sf_dir):
    """Chunks in the retrieval shape ``(file, chunk, text)``."""
    ch = _chunks(spark, sf_dir)
    out = ch.select(F.col("key").alias("file"), F.col("chunk_no").alias("chunk"), F.col("chunk").alias("text"))
    out._written = ch._written
    return out


def _index(spark, sf_dir):
    """``(chunks, table)``: the chunk table and its term table, each written
    once to the shared checkpoint folder."""
    ch = _rchunks(spark, sf_dir)
    return ch, T.term_table(ch)


def _answer(spark, sf_dir, fn):
    """Run an answering operator over the benchmark questions."""
    ch, table = _index(spark, sf_dir)
    return fn(_questions(spark, sf_dir), ch, table=table)


def _answer_by_blocks(spark, sf_dir, fn):
    """As ``_answer``, from impact-ordered postings."""
    ch, table = _index(spark, sf_dir)
    return fn(_questions(spark, sf_dir), ch, index=build_postings(table))


def _summarize_context(spark, sf_dir):
    qs = _questions(spark, sf_dir)
    ch, table = _index(spark, sf_dir)
    return T.summarize_context(qs, T.relevant_only(T.best_chunks(qs, ch, table=table)), ch)


def _diverse_summary(spark, sf_dir):
    qs = _questions(spark, sf_dir)
    ch, table = _index(spark, sf_dir)
    return T.diverse_summary(qs, materialize(T.relevant_only(T.best_chunks(qs, ch, table=table))), ch)


def _chunk_by_vocabulary(spark, sf_dir):
    """Chunks of at most 200 tokens of an installed vocabulary."""
    import public_tokenizers
    counter = vocabulary_cost(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return D.chunk_documents(_doc_objects(spark, sf_dir), 200, counter)


def _replies(spark, sf_dir):
    """Model replies about every document, six forms in turn: regular, comma
    in the reason, fraction as score, no answer, no score, two replies."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = F.concat(F.lit("Score: "), F.expr("CAST(n_chars % 11 AS STRING)"))
    reason, answer = F.concat(F.lit(", Reason: "), F.col("source")), F.concat(F.lit(", Anser: "), F.col("text"))
    form = F.col("doc_id") % 6
    reply = (F.when(form == 0, F.concat(score, reason, answer))
             .when(form == 1, F.concat(score, reason, F.lit(", "), F.col("lang"), answer))
             .when(form == 2, F.concat(score, F.lit("/10"), reason, answer))
             .when(form == 3, F.concat(score, reason))
             .when(form == 4, F.col("text"))
             .otherwise(F.concat(score, reason, answer, F.lit(" "), score, reason, answer)))
    return d.select("doc_id", reply.alias("reply"))


def _questions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), "text")


# The previous index for the registered indexing run: the same corpus indexed
# with half the chunk budget, summaries = first sentence of each chunk. Short
# documents keep their chunk count (Cached), long ones change (Processed).
PRIOR_BUDGET = D.MAX_TOKENS // 2


def _prior_index(spark, sf_dir):
    c = _chunks(spark, sf_dir, PRIOR_BUDGET)
    n = D.chunk_counts(c)
    return c.join(n, "key").select("key", "chunk_no", "chunks",
                                   F.regexp_extract("chunk", AN.SENTENCE, 0).alias("summary"))


def _all_objects(spark, sf_dir):
    """Object store stand-in: the documents (``.txt`` keys) plus the web
    pages (keys from their URLs, mostly without a readable extension)."""
    docs = _doc_objects(spark, sf_dir).select("key", F.encode("text", "UTF-8").alias("content"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    page_objs = pages.select(L.url_key("url").alias("key"), F.encode("html", "UTF-8").alias("content"))
    return docs.unionByName(page_objs)


def _index_run(spark, sf_dir):
    return index_documents(_all_objects(spark, sf_dir), _prior_index(spark, sf_dir))


def _hash_run(spark, sf_dir):
    """D7 by hash over the documents: the previous index holds all of them,
    English ones with an older text of as many chunks, which a comparison
    by chunk count would not see. Returns ``(status, updates, previous)``."""
    # read by the hashes and by several steps of the run
    docs = materialize(_doc_objects(spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").select("key", "lang", "text"))
    older = F.when(F.col("lang") == "en", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    hashes = docs.select("key", F.sha2(older, 256).alias("text_hash"))
    ch = _chunks(spark, sf_dir)
    first = ch.select("key", "chunk_no", F.regexp_extract("chunk", AN.SENTENCE, 0).alias("summary"))
    prior = first.join(D.chunk_counts(ch), "key").join(hashes, "key").select("key", "chunk_no", "chunks", "summary", "text_hash")
    objs = docs.select("key", F.encode("text", "UTF-8").alias("content"))
    return *index_updates(objs, prior, by="hash"), prior


def _saved_index(spark, sf_dir):
    """S5 round trip: the previous index written whole, the run's updates
    appended as a second part, the merged index read back."""
    import uuid
    from tessera.session import scratch_path
    from tessera.sources.store import append_index, read_index, write_index
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    _, updates, prior = _hash_run(spark, sf_dir)
    write_index(prior, path)
    append_index(updates, path)
    return read_index(spark, path, hashes=True)


def _index_errors(spark, sf_dir):
    """D10 over the documents: the token counter fails for every text whose
    number of words is a multiple of seven; the others are indexed."""
    def counter(words):
        from tessera.functions.chunking import length_cost
        if len(words) % 7 == 0:
            raise ValueError("counter failed")
        return length_cost(words)
    from tessera.plans.indexing_run import empty_index
    objs = _doc_objects(spark, sf_dir).select("key", F.encode("text", "UTF-8").alias("content"))
    return index_documents(objs, empty_index(spark), counter=counter)[0]


def _decode_text(spark, sf_dir):
    objs = _doc_objects(spark, sf_dir).select("key", F.encode("text", "UTF-8").alias("content"))
    return D.decode_text(objs).select("key", "text")


def _written_objects(spark, docs, *folders):
    """Object store stand-in: one text object per document, named after
    ``doc_id``, in folders named after ``folders``; returns the root. A line break ends
    every object."""
    import uuid
    from tessera.session import scratch_path
    root = scratch_path(spark, f"objects-{uuid.uuid4().hex}")
    write_objects(docs, root, [*folders, "doc_id"])
    return root


DOC_NAME = "doc_id=(-?[0-9]+)[.]txt"


def _read_objects(spark, sf_dir):
    """The documents written as objects; those below the prefix of the
    English ones read back and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = read_objects(spark, _written_objects(spark, docs, "lang"), prefix="lang=en/")
    return D.decode_text(found).select(F.regexp_extract("key", DOC_NAME, 1).cast("long").alias("doc_id"), "length", "text")


def _chunk_object_lines(spark, sf_dir):
    """D3 over objects read in byte ranges, cut by block maps at 200 tokens."""
    root = _written_objects(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "lang")
    lines = read_object_lines(spark, root)
    name = F.regexp_replace("key", "(source|lang|doc_id)=", "")
    return chunk_blocks(line_blocks(lines.withColumn("key", name)), 200)


def _streamed(spark, sf_dir, result):
    """D11 over the documents in two waves of objects: the first has every
    second document and an older text of every third, the second the rest
    and the present texts."""
    import uuid
    from tessera.session import scratch_path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    older = docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("An older text. "), F.upper("text")))
    waves = [docs.filter("doc_id % 2 = 0 AND doc_id % 3 <> 0").unionByName(older),
             docs.filter("doc_id % 2 <> 0 OR doc_id % 3 = 0")]
    src, root = (scratch_path(spark, f"{n}-{uuid.uuid4().hex}") for n in ("incoming", "corpus-index"))
    key = F.concat(F.regexp_extract("path", DOC_NAME, 1), F.lit(".txt"))
    for n, wave in enumerate(waves):
        write_objects(wave.withColumn("wave", F.lit(n)), src, ["wave", "doc_id"])
        index_new_objects(spark, src, root, key)
    return result(spark, root)


def _decode_damaged_text(spark, sf_dir):
    """P6 over objects with bytes that are no UTF-8 between a genuine
    replacement character and the second half of the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = F.floor(F.char_length("text") / 2).cast("int")
    left, right = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.char_length("text"))
    content = F.concat(F.encode(F.concat(left, F.lit("\ufffd")), "UTF-8"), F.lit(b"\xff\xe2\x82\xc3("), F.encode(right, "UTF-8"))
    return D.decode_text(docs.select("doc_id", content.alias("content"))).select("doc_id", "text")


def _partial_replies(spark, sf_dir):
    """Summaries as a model might leave them: none for one document in
    three, an empty one for another, else the first sentence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = F.regexp_extract("text", AN.SENTENCE, 0)
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit(""))
                       .otherwise(first).alias("summary"))


def _build_prompts(spark, sf_dir):
    qs = _questions(spark, sf_dir)
    ch, table = _index(spark, sf_dir)
    top = ANS.relevant(qs, ch, table=table)
    return T.build_prompts(qs, top, T.build_context(qs, top), ch)


def _doc_objects(spark, sf_dir):
    """Documents as objects keyed ``source/lang/doc_id.txt``."""
    return L.keys_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Fixed header stamp for the registered report (P8 is injectable).
REPORT_STAMP = "2024-01-01 00:00:00"

NOT_NULL = {
    "customers": ["first_name", "last_name", "email", "registration_date"],
    "products": ["name", "category", "price", "stock_quantity", "created_date"],
    "orders": ["customer_id", "order_date", "total_amount", "status"],
    "order_items": ["order_id", "product_id", "quantity", "price_per_unit"],
}


def _null_violations(t):
    from functools import reduce
    from pyspark.sql import functions as F
    parts = [Q.null_violations(t[name], cols).select(F.lit(name).alias("table_name"), "*")
             for name, cols in NOT_NULL.items()]
    return reduce(DataFrame.unionByName, parts)


def _page_keys(spark, sf_dir):
    return L.keys_from_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _append_customers(spark, sf_dir):
    """Q4 on driver data: re-insert every customer (all rejected: email
    exists) together with the suppliers as new customers (inserted)."""
    t = load_sales(spark, sf_dir)
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "s_suppkey AS c_custkey", "s_name AS c_name", "s_nationkey AS c_nationkey", "'' AS c_mktsegment")
    new = customers_from(sup, spark.read.parquet(f"{sf_dir}/nation.parquet"))
    cols = ["first_name", "last_name", "email", "state"]
    batch = t["customers"].select(*cols).unionByName(new.select(*cols))
    return Q.append_with_keys(t["customers"], batch, "customer_id", "email")


def oracle_sql() -> dict[str, str]:
    from oracle.sales_sql import SQL as SALES
    from oracle.quality_sql import SQL as QUALITY
    from oracle.report_sql import report_sql
    out = {}
    out.update(SALES)
    out["sales_report_lines"] = report_sql(REPORT_STAMP, DRIVER_LOW_STOCK)
    out.update(QUALITY)
    from oracle.text_sql import SQL as TEXT
    out.update(TEXT)
    from oracle.graph_sql import SQL as GRAPH
    out.update(GRAPH)
    if LLM is not None:
        out.update(LLM.oracle_sql())
    return out
