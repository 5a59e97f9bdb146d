"""Index, baseline, routing, matching and evaluation."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import match, vector
from gridloom.operators import embed, evaluate, index, lexical, route, tfidf
from gridloom.operators.parse import parse_documents
from gridloom.sources import evalsets, store
from gridloom.sources.documents import inline_documents, read_questions

DOCS = ["====\nWAREHOUSE STOCK\n====\nsku,on_hand\nA-1,5\nB-2,7", "====\nSALES NA\n====\nstore,net_rev_usd\nNA-EAST,12.5\nNA-WEST,8.25", "====\nPOLICY\n====\nReturns are accepted for thirty days. Stores keep receipts."]


def blocks(spark):
    return parse_documents(inline_documents(spark, DOCS))


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid int, question string")


def test_hybrid_search(spark):
    dual = index.DualIndex(spark)
    dual.add_blocks(blocks(spark))
    got = dual.search(asked(spark, "how many on_hand in the warehouse", "net revenue for NA-EAST", "returns policy", ""), 2).collect()
    best = {r.qid: r.section for r in got if r["rank"] == 1}
    assert best[0] == "WAREHOUSE STOCK" and best[1] == "SALES NA" and best[2] == "POLICY" and best[3] == "WAREHOUSE STOCK"
    assert len(dual) == 3 and len(dual.all_scores(asked(spark, "x")).collect()) == 3
    assert dual.summary_for("missing") == ""
    dual.add_blocks(blocks(spark))
    assert len(dual) == 3


def test_zero_weight_is_the_vector_score(spark):
    dual = index.DualIndex(spark, lexical_weight=0.0)
    dual.add_blocks(blocks(spark))
    assert all(r.score == r.semantic for r in dual.search(asked(spark, "net revenue"), 3).collect())


@pytest.mark.parametrize("name", ["cosine", "dot", "euclidean"])
def test_metrics(spark, name):
    dense = embed.CallableEmbedder(lambda texts: [[float("stock" in t.lower()), 1.0, 0.5] for t in texts])
    dual = index.DualIndex(spark, dense, similarity=name, lexical_weight=0.0)
    dual.add_blocks(blocks(spark))
    assert dual.search(asked(spark, "stock"), 1).first().section == "WAREHOUSE STOCK"
    with pytest.raises(ValueError):
        vector.metric("manhattan")


def test_metric_values(spark):
    r = spark.createDataFrame([([1.0, 2.0, 9.0], [2.0, 0.0])], "a array<double>, b array<double>").select(*[vector.METRICS[m](F.col("a"), F.col("b")) for m in ("cosine", "dot", "euclidean")]).first()
    assert r[1] == 2.0 and r[2] == pytest.approx(1 / (1 + math.sqrt(5))) and r[0] == pytest.approx(2 / (math.sqrt(86) * 2))


def test_lexical_by_hand(spark):
    texts = spark.createDataFrame([(1, "rev stores a"), (2, "revenue b"), (3, "c")], "doc_id int, text string")
    posted = lexical.postings(texts)
    weights = {r.token: r.idf for r in lexical.idf(posted, 3).collect()}
    assert weights["rev"] == pytest.approx(math.log(4 / 1.5))
    got = {(r.qid, r.doc_id): r.lexical for r in lexical.lexical_scores(asked(spark, "revenue store zzz"), posted, lexical.idf(posted, 3)).collect()}
    w = math.log(4 / 1.5)
    assert got[0, 1] == pytest.approx((0.8 * w + 0.8 * w) / (3 * w)) and got[0, 2] == pytest.approx(w / (3 * w)) and (0, 3) not in got


def test_hash_index(spark):
    import hashlib

    words = ["net_rev", "é", "a", "x-1.2"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(embed.hash_index(F.col("w"))).collect()]
    assert got == [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % 512 for w in words]


def test_tfidf(spark):
    texts = spark.createDataFrame([(i, i, t) for i, t in enumerate(["alpha beta beta", "beta gamma", "delta"])], "doc_id int, seq int, text string")
    for scikit in (False, True):
        got = tfidf.retrieve(asked(spark, "gamma gamma beta", "nothing"), texts, 2, scikit).collect()
        assert {(r.qid, r["rank"], r.doc_id) for r in got} == {(0, 1, 1), (0, 2, 0), (1, 1, 0), (1, 2, 1)}
    assert spark.createDataFrame([("a\n\nb",)], "t string").select(tfidf.chunks(F.col("t"))).first()[0] == ["a", "b"]


def test_route(spark):
    qs = ["What is the total?", "Who wrote it?", "cost per unit", "superb", "SUM up", "TOTAL combien"]
    got = [r[0] for r in asked(spark, *qs).orderBy("qid").select(route.route(F.col("question"))).collect()]
    assert got == [route.classify(q) for q in qs] == ["compute", "lookup", "compute", "lookup", "compute", "compute"]
    assert route.classify("combien de magasins", [r"\bcombien\b"]) == "compute" and route.classify("the total", disable=[r"\btotal\b"]) == "lookup"
    assert route.choose_route("total", 0, "compute") == "lookup" and route.choose_route("x", 1, "compute") == "compute"
    with pytest.raises(ValueError):
        route.choose_route("x", 1, "hybrid")


def test_answer_match(spark):
    cases = [("Revenue was 1,965,043.30", ["1965043.30"], False, True), ("about 1.96m", ["1965043"], False, True), ("3.53 %", ["0.0353"], False, True), ("$42k", ["42000"], False, True), ("only 3310", ["3310", "3000"], True, False), ("5", ["inf"], False, False), ("3,310 and 3295", ["3310", "3295"], True, True), ("The  Warehouse", ["the warehouse"], False, True), ("x", [], False, False), ("none", ["12"], False, False), ("it is 5", ["nan"], False, False), ("x", [""], False, False)]
    df = spark.createDataFrame(cases, "p string, g array<string>, every boolean, want boolean")
    got = df.select("p", "want", match.answer_match(F.col("p"), F.col("g"), F.col("every")).alias("got")).collect()
    assert [r.p for r in got if r.got != r.want] == []
    assert spark.createDataFrame([("$42k and 1.5m, -3",)], "t string").select(match.numbers_in(F.col("t"))).first()[0] == [42000.0, 1500000.0, -3.0]


def test_rank_metrics(spark):
    ranks = spark.createDataFrame([(1, True), (2, None), (None, False), (4, None)], "hit_rank int, answer_correct boolean")
    r = evaluate.report(ranks, 3, "d").first()
    assert (r.recall_at_k, r.mrr_at_k, r.num_generated, r.exact_match) == (0.5, 0.375, 2, 0.5)
    none = evaluate.report(ranks.limit(0), 3).first()
    assert (none.recall_at_k, none.mrr_at_k, none.exact_match) == (0.0, 0.0, None)
    assert "recall@3 50.0%" in evaluate.format_report(r.asDict(), [{"hit_rank": 1, "question": "q", "answer_correct": True}])


def test_hit_rank(spark):
    samples = evalsets.own_samples(spark, [{"qid": "a", "question": "q", "golden_sections": ["sales"]}, {"qid": "b", "question": "q", "golden_sources": ["s2"]}, {"qid": "c", "question": "q", "golden_sections": ["x"], "golden_sources": ["s1"]}])
    found = spark.createDataFrame([(q, i, s, f"s{i}") for q in "abc" for i, s in ((1, "POLICY"), (2, "SALES NA"))], "qid string, rank int, section string, source string")
    assert {r.qid: r.hit_rank for r in evaluate.hit_ranks(samples, found).collect()} == {"a": 2, "b": 2, "c": None}


def test_eval_sets(spark):
    rows = [(1, "q1", ["1", "x"], ("t.csv", ["h", "i"], [["a", "b"]]), 0), (2, "q2", ["2"], ("", ["h"], [["c"]]), 1), (3, "q3", ["3"], ("t.csv", ["z"], []), 2)]
    samples, contexts = evalsets.wtq(spark.createDataFrame(rows, "id int, question string, answers array<string>, table struct<name:string,header:array<string>,rows:array<array<string>>>, ord int"))
    assert {r.source: r.text for r in contexts.collect()} == {"t.csv": "| h | i |\n| --- | --- |\n| a | b |", "table-2": "| h |\n| --- |\n| c |"}
    t2 = [("1", "c", "q", "5", " 5 ", "text", 0), ("2", "c", "q", "5", "5%", "other", 1), ("3", "d", "q", "6", None, "d", 2)]
    samples, contexts = evalsets.t2_ragbench(spark.createDataFrame(t2, "id string, context_id string, question string, program_answer string, original_answer string, context string, ord int"))
    assert {r.qid: r.answers for r in samples.collect()} == {"1": ["5"], "2": ["5", "5%"], "3": ["6"]} and {r.text for r in contexts.collect()} == {"text", "d"}


def test_store(spark, tmp_path):
    path = str(tmp_path / "b")
    for kind in ("parquet", "json"):
        store.save_blocks(blocks(spark), path + kind, kind)
        assert sorted(store.load_blocks(spark, path + kind, kind).collect()) == sorted(blocks(spark).collect())
    changed = blocks(spark).where("kind = 'text'").withColumn("content", F.lit("new"))
    merged = store.upsert(blocks(spark), changed)
    assert merged.count() == 3 and merged.where("content = 'new'").count() == 1
    assert store.get(merged, changed).count() == 1
    (tmp_path / "q.txt").write_text("one\n\n# no\n  two \n")
    qs = read_questions(spark, str(tmp_path / "q.txt"))
    assert [r.question for r in qs.orderBy("qid").collect()] == ["one", "two"]
    assert [r.question for r in store.remaining(qs, qs.where("question = 'one'")).collect()] == ["two"]
