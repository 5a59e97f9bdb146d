"""Registered queries over the test tables, one for each operator family."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import match, text, vector
from .operators import chunk, embed, evaluate, index, lexical, parse, route, summary, tfidf
from .plans import sandbox
from .plans.guard import check
from .relational import RELATIONAL, TABLES
from .session import configure
from .sources import evalsets, store
from .sources.staging import drop, materialize, new_path, spread

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guarded(sql: str) -> Query:
    """A SELECT over the tables as views, through the read-only guard."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        used = {t for t in TABLES if t in sql}
        for name in used:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(check(spark, sql, used))

    return run


# relational, as DataFrames


def rel_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of a customer at or before each event of the user of that number: one shuffle, no join."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("event_id"), F.lit(None).cast("long").alias("o_orderkey"), F.lit(1).alias("side"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.lit(None).cast("long").alias("event_id"), "o_orderkey", F.lit(0).alias("side"))
    w = Window.partitionBy("key").orderBy("at", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.unionByName(orders).withColumn("last_order", F.last("o_orderkey", ignorenulls=True).over(w))
    return both.where("side = 1").select("event_id", F.col("key").alias("user_id"), "last_order")


def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).alias("n_f"), F.coalesce("O", F.lit(0)).alias("n_o"))


# tokens, lexical scores, embeddings


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, dealt to all cores where the file is small."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def tok_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, plain = text.lexical_tokens(F.col("text")), text.plain_tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.size(plain).cast("long").alias("n_plain"))


def lex_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    return lexical.idf(lexical.postings(documents(spark, sf_dir)), n).select("token", "df", F.round("idf", 9).alias("idf"))


def lex_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = materialize(lexical.forward(documents(spark, sf_dir)), "tokens")
    weights, weights_path = materialize(lexical.idf(docs.select(F.explode("tokens").alias("token")), docs.count()), "weights")
    found, _ = materialize(lexical.lexical_top(questions(spark, sf_dir), docs, weights, 3).withColumn("lexical", F.round("lexical", 6)), "ranked")
    drop(spark, path, weights_path)
    return found


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.hash_vectors(documents(spark, sf_dir)).select("doc_id", "idx", F.round("w", 9).alias("w"))


def embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vectors = embed.sparse_vectors(docs).select("doc_id", F.col("doc_id").alias("seq"), "idx", "w")
    found = index.sparse_search(embed.sparse_vectors(questions(spark, sf_dir), "qid", "question"), vectors, k=3)
    return found.select("qid", "rank", "doc_id", F.round("semantic", 6).alias("semantic"))


def dense_topk(similarity: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("v"))
        asked = rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "v")
        found = index.dense_search(asked, rows, similarity, 5)
        return found.select("qid", "rank", "doc_id", F.round("semantic", 6).alias("score"))

    return run


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dual index over documents as prose blocks, benchmark passages as questions."""
    raw = spread(table(spark, sf_dir, "documents"))
    none = F.lit(None)
    blocks = raw.select(
        F.col("doc_id"), F.col("source"), F.array("doc_id").alias("seq"), F.lit(0).alias("section_idx"), F.lit(0).alias("para_idx"), F.lit("text").alias("kind"), F.col("lang").alias("section"), F.col("text").alias("content"),
        none.cast("string").alias("markdown"), none.cast("array<string>").alias("headers"), none.cast("array<array<string>>").alias("rows"), none.cast("string").alias("source_format"), F.lit("").alias("context_notes"),
    )
    dual = index.DualIndex(spark)
    dual.add_blocks(blocks)
    found, _ = materialize(dual.search(questions(spark, sf_dir), 3).select("qid", "rank", "doc_id", F.round("score", 5).alias("score")), "ranked")
    dual.close()
    return found


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.retrieve(questions(spark, sf_dir), documents(spark, sf_dir), 3).withColumn("score", F.round("score", 6))


def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = F.broadcast(rows.where("vec_id = 0").select(F.col("v").alias("a")))
    return rows.crossJoin(first).select("vec_id", *[F.round(f(F.col("a"), F.col("v")), 6).alias(name) for name, f in vector.METRICS.items()])


# parsing: rendered tables read back


def rendered(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A document for each region: a banner title, a note and its nations as a table."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = {"tsv": "\t", "csv": ",", "pipe": " | ", "markdown": " | "}[kind]
    line = F.concat_ws(by, F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    grid = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n")
    head = by.join(["n_nationkey", "n_name", "n_regionkey"]) + ("\n:--- | --- | ---:" if kind == "markdown" else "")
    docs = nations.groupBy("r_regionkey", "r_name").agg(grid.alias("grid"))
    text_ = F.concat(F.lit("====\nNATIONS - "), "r_name", F.lit("\n====\nNote on "), "r_name", F.lit(f".\n\n{head}\n"), "grid", F.lit("\n"))
    return docs.select(F.col("r_name").alias("source"), F.col("r_regionkey").cast("long").alias("doc_seq"), text_.alias("text"))


def parse_table(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        blocks = parse.parse_documents(rendered(spark, sf_dir, kind)).where("kind = 'table'")
        cells = blocks.select("section", "source_format", "context_notes", F.explode("rows").alias("r"))
        return cells.select("section", "source_format", "context_notes", F.col("r")[0].cast("int").alias("n_nationkey"), F.col("r")[1].alias("n_name"), F.col("r")[2].cast("int").alias("n_regionkey"))

    return run


def parse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections between rules: one document for each region, a part for each nation, titled or not."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "## ").otherwise(""), "n_name", F.lit("\nNumber "), F.col("n_nationkey").cast("string"))
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("part")))), lambda x: x["part"]), "\n---\n")
    docs = both.groupBy("r_name").agg(text_.alias("text"))
    return docs.select("r_name", F.posexplode(parse.sections(F.col("text"))).alias("i", "s")).select("r_name", "i", F.col("s.title").alias("title"), F.col("s.body").alias("body"))


def ingest_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks held after three ingests of rendered documents: the first again changes nothing, texts under one name add up."""
    box = index.DualIndex(spark)
    for kind in ("tsv", "csv", "tsv"):
        box.add_blocks(parse.parse_documents(rendered(spark, sf_dir, kind).withColumn("source", F.lit("all"))))
    held, _ = materialize(box.blocks.groupBy("section", "kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids")), "held")
    box.close()
    return held


def parse_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and paragraphs of documents without banners: one section, its first line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(parse.sections(F.col("text"))).alias("s"))
    return docs.select("doc_id", F.col("s.title").alias("title"), F.char_length("s.body").cast("long").alias("n_chars"), F.size(text.lines(F.col("s.body"))).cast("long").alias("n_lines"))


def parts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand as one table block."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type", "p_size", "p_retailprice"))), lambda p: F.array(p["p_partkey"].cast("string"), p["p_type"], p["p_size"].cast("string"))).alias("rows"))
    headers = F.array(*[F.lit(x) for x in ("p_partkey", "p_type", "p_size")])
    return rows.select(
        F.col("p_brand").alias("doc_id"), F.lit("part").alias("source"), F.array(F.xxhash64("p_brand"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("seq"), F.lit(0).alias("section_idx"), F.lit(0).alias("para_idx"),
        F.lit("table").alias("kind"), F.col("p_brand").alias("section"), F.lit(None).cast("string").alias("content"), parse.markdown(headers, F.col("rows")).alias("markdown"), headers.alias("headers"), "rows", F.lit("pipe").alias("source_format"), F.lit("").alias("context_notes"),
    )


def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunk.chunk_tables(parts_table(spark, sf_dir), 20, 5)
    first, last = F.get("rows", F.lit(0))[0], F.element_at("rows", -1)[0]
    return cut.select("section", F.size("rows").cast("long").alias("n_rows"), first.cast("long").alias("first_key"), last.cast("long").alias("last_key"))


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and the largest slice of each document at the default budget."""
    none = F.lit(None)
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array(F.col("doc_id"), F.col("doc_id"), F.col("doc_id"), F.lit(0).cast("long")).alias("seq"), F.col("doc_id").cast("string").alias("section"), F.col("text").alias("content"), none.cast("string").alias("markdown"))
    cut = chunk.chunk_text(blocks).withColumn("n", F.size(text.words(F.col("content"))))
    return cut.groupBy(F.regexp_extract("section", r"^(\d+)", 1).cast("long").alias("doc_id")).agg(F.sum("n").cast("long").alias("n_words"), (F.max("n") <= 300).alias("within"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("content", F.col("text")).withColumn("section", F.col("lang"))
    return docs.select("doc_id", F.md5(summary.text_summary().cast("binary")).alias("digest"))


def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = parts_table(spark, sf_dir)
    return blocks.select(F.col("section").alias("p_brand"), F.array_join(summary.distinct_values(F.col("rows"), F.lit(1)), ", ").alias("types"), F.size(F.split(summary.table_summary(), "\n")).cast("long").alias("n_lines"))


# typing, routing, matching, evaluation


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types inferred from strings of supplier, orders and part columns."""
    s = table(spark, sf_dir, "supplier").select(F.lit("s_suppkey").alias("col"), F.col("s_suppkey").cast("string").alias("value")).union(table(spark, sf_dir, "supplier").select(F.lit("s_acctbal"), F.format_string("%.2f", "s_acctbal"))).union(table(spark, sf_dir, "supplier").select(F.lit("s_name"), F.col("s_name")))
    o = table(spark, sf_dir, "orders").select(F.lit("o_orderdate"), F.date_format("o_orderdate", "yyyy-MM-dd")).union(table(spark, sf_dir, "orders").select(F.lit("blank"), F.lit(" ")))
    return s.union(o).groupBy("col").agg(sandbox.inferred_type(F.col("value")).alias("type"))


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.sanitized(F.col("p_name")).alias("name"), text.sanitized(F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"))).alias("sized"))


def sandbox_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rendered tables parsed, typed and loaded as views, and Asia's queried through the guard."""
    configure(spark)
    blocks = parse.parse_documents(rendered(spark, sf_dir, "tsv"))
    box = sandbox.TableSandbox(spark)
    (name,) = (n for n in box.load_tables(blocks) if box.tables[n].section == "NATIONS - ASIA")
    return box.query(f"SELECT n_regionkey, COUNT(*) AS n, SUM(n_nationkey) AS total, MIN(n_name) AS first_name FROM {name} GROUP BY n_regionkey")


def route_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("What is the total of ", "Who wrote ", "How many in ", "Per item: ", "The rated ")]), (F.col("turn") % 5 + 1).cast("int")), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", route.route(F.col("text")).alias("route"), route.route(asked, ["wrote"], [r"\bper\s"]).alias("asked_route"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.numbers_in(F.col("text"))
    return table(spark, sf_dir, "conversations").union(table(spark, sf_dir, "documents").select("doc_id", F.lit(-1), F.lit("d"), "text")).select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.coalesce(F.array_max(found), F.lit(0.0)).alias("largest"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and priorities of all orders as gold answers against rounded and scaled predictions, some of which name the priority."""
    o = table(spark, sf_dir, "orders")
    shift = F.element_at(F.array(*[F.lit(x) for x in (1.0, 1.004, 1.02, 0.01)]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    named = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(", priority "), "o_orderpriority")).otherwise("")
    said = F.concat(F.lit("It is $"), F.format_number(F.col("o_totalprice") * shift, 2), F.lit(" in all"), named)
    gold = F.array(F.format_string("%.2f", "o_totalprice"), F.col("o_orderpriority"))
    return o.select("o_orderkey", match.answer_match(said, gold).alias("any_match"), match.answer_match(said, gold, True).alias("all_match"))


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and MRR of ranks taken from labels of nearest vectors."""
    found = dense_topk("cosine")(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("section"), F.lit("s").alias("source"))
    samples = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.array(((F.col("label") + 1) % 10).cast("string"), F.col("label").cast("string")).alias("golden_sections"), F.array().cast("array<string>").alias("golden_sources"))
    ranks = evaluate.hit_ranks(samples, found.where("doc_id <> qid").join(labels, "doc_id"))
    out = evaluate.report(ranks.withColumn("answer_correct", F.lit(None).cast("boolean")), 3, "labels")
    return out.select("dataset", "num_samples", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr_at_k", 6).alias("mrr_at_k"), "exact_match")


# stores, evaluation sets, rendering


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block store with every seventh document replaced and some new ones put in."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.array("doc_id").alias("seq"), "text")
    new = old.where("doc_id % 7 = 0").select("doc_id", "seq", F.lit("new").alias("text")).union(old.where("doc_id % 11 = 0").select((F.col("doc_id") + 10**9).alias("doc_id"), "seq", "text"))
    return store.upsert(old, new).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    return store.remaining(asked, asked.where("qid % 3 = 0"), "qid").select("qid", F.length("question").cast("long").alias("n"))


def evalset_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table records named by region: the first nation's table stays for each."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grid = F.struct(F.when(F.col("n_nationkey") < 20, F.col("r_name")).otherwise("").alias("name"), F.array(F.lit("key"), F.lit("nation")).alias("header"), F.array(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("rows"))
    records = both.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("question"), F.array("n_name").alias("answers"), grid.alias("table"), F.col("n_nationkey").alias("ord"))
    samples, contexts = evalsets.wtq(records)
    named = samples.groupBy(F.col("golden_sources")[0].alias("source")).agg(F.count("*").alias("n_samples"))
    return contexts.join(named, "source")


def evalset_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report records from orders: contexts by customer, answers with and without an original wording."""
    o = table(spark, sf_dir, "orders")
    original = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" no. "), F.col("o_orderkey").cast("string")))
    records = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("context_id"), F.col("o_orderstatus").alias("question"), F.col("o_orderkey").alias("program_answer"), original.alias("original_answer"), F.col("o_orderpriority").alias("context"), F.col("o_orderkey").alias("ord"))
    samples, contexts = evalsets.t2_ragbench(records)
    answered = samples.select(F.col("golden_sources")[0].alias("source"), F.size("answers").alias("n")).groupBy("source").agg(F.sum("n").alias("n_answers"))
    return contexts.join(answered, "source")


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered blocks saved as JSON and loaded again."""
    path = new_path(spark, "store")
    store.save_blocks(parse.parse_documents(rendered(spark, sf_dir, "pipe")), path, "json")
    loaded = store.load_blocks(spark, path, "json").where("kind = 'table'")
    return loaded.select("section", F.size("rows").cast("long").alias("n_rows"), F.element_at("headers", 2).alias("second"))


def sandbox_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of all rendered documents, ingested under one title each: names stay apart and say which rows they hold."""
    configure(spark)
    box = sandbox.TableSandbox(spark)
    names = box.load_tables(parse.parse_documents(rendered(spark, sf_dir, "csv")))
    counted = [box.query(f"SELECT '{n}' AS view, count(*) AS n, min(n_regionkey) AS n_regionkey FROM {n}") for n in names]
    return functools.reduce(DataFrame.unionByName, counted)


def baseline_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the rendered region documents for the baseline, with their previews."""
    docs = rendered(spark, sf_dir, "csv").select("source", F.posexplode(tfidf.chunks(F.col("text"))).alias("i", "chunk"))
    return docs.select("source", "i", tfidf.preview(F.col("chunk"), 2).alias("preview"))


def render_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand as prompt text."""
    return parts_table(spark, sf_dir).withColumn("context_notes", F.lit("checked")).select("section", F.md5(summary.rendered().cast("binary")).alias("digest"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f"rel_{name}": guarded(sql) for name, (sql, _) in RELATIONAL.items()}
    found |= {"rel_asof": rel_asof, "rel_pivot": rel_pivot}
    found |= {"tok_counts": tok_counts, "lex_idf": lex_idf, "lex_topk": lex_topk, "embed_hash": embed_hash, "embed_topk": embed_topk, "hybrid_topk": hybrid_topk, "tfidf_topk": tfidf_topk, "metric_values": metric_values}
    found |= {f"dense_{m}": dense_topk(m) for m in vector.METRICS}
    found |= {f"parse_{kind}": parse_table(kind) for kind in ("tsv", "csv", "pipe", "markdown")} | {"parse_plain": parse_plain, "parse_rules": parse_rules, "ingest_repeated": ingest_repeated}
    found |= {"chunk_tables": chunk_tables, "chunk_text": chunk_text, "sentence_counts": sentence_counts, "summary_text": summary_text, "summary_table": summary_table}
    found |= {"store_upsert": store_upsert, "resume_remaining": resume_remaining, "evalset_contexts": evalset_contexts, "baseline_chunks": baseline_chunks, "render_blocks": render_blocks}
    found |= {"evalset_t2": evalset_t2, "store_round_trip": store_round_trip, "sandbox_names": sandbox_names}
    return found | {"infer_types": infer_types, "sanitize": sanitize, "sandbox_sql": sandbox_sql, "route_turns": route_turns, "numbers": numbers, "answers": answers, "rank_metrics": rank_metrics}
