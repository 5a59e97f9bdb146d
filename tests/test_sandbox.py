"""The SQL sandbox, its guard, the agent, the pipeline and streaming."""

import datetime

import pytest

from gridloom.operators.parse import parse_documents
from gridloom.plans.agent import SQLAgent
from gridloom.plans.generate import CallableGenerator, ChatGenerator
from gridloom.plans.guard import check_plan
from gridloom.plans.pipeline import Answering, Computing, Retrieval, RetrieverManager, TablePipeline, run_baseline
from gridloom.plans.sandbox import TableSandbox, column_names
from gridloom.session import configure
from gridloom.sources import evalsets
from gridloom.sources.documents import inline_documents
from gridloom.streaming.ingest import stream_blocks

TEXT = """====
SALES — weekly (usd)
====
Corrected on Monday.

store|day|units|rev|bad_day|huge
N-1|2025-06-14|12|1200.50|2025-13-45|99999999999999999999
N-2|2025-06-14| |700|2025-01-01|1
N-1|2025-06-21|7|-300.25||2

====
SALES
====
a,a,a_2
1,2,3
"""


@pytest.fixture()
def box(spark):
    configure(spark)
    made = TableSandbox(spark)
    assert made.load_tables(parse_documents(inline_documents(spark, [TEXT]))) == ["sales", "sales_2"]
    yield made
    made.close()


def test_types_and_values(box):
    assert dict(box.tables["sales"].columns) == {"store": "STRING", "day": "DATE", "units": "BIGINT", "rev": "DOUBLE", "bad_day": "STRING", "huge": "DOUBLE"}
    assert [c for c, _ in box.tables["sales_2"].columns] == ["a", "a_2", "a_2_2"]
    assert box.execute("SELECT SUM(rev) AS total FROM sales WHERE day = DATE '2025-06-14';") == [{"total": 1900.5}]
    assert box.execute("SELECT units FROM sales WHERE store = 'N-2'") == [{"units": None}]
    assert box.execute('SELECT "day" FROM sales ORDER BY "day" DESC LIMIT 1') == [{"day": datetime.date(2025, 6, 21)}]
    said = box.schema_description()
    assert "sales_2 (a BIGINT, a_2 BIGINT, a_2_2 BIGINT)" in said and "Noted there: Corrected on Monday." in said and "('N-1'," in said


def test_column_names():
    assert column_names(["", "a", "A", "a_2"]) == ["col0", "a", "a_2", "a_2_2"]


@pytest.mark.parametrize("sql", ["DROP TABLE sales", "SELECT 1; SELECT 2", "SELECT * FROM sales WHERE delete = 1", "INSERT INTO sales VALUES (1)", "EXPLAIN SELECT 1", ""])
def test_text_guard(box, sql):
    with pytest.raises(ValueError):
        box.execute(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM parquet.`/tmp/x`", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('a', 'b')", "SELECT * FROM other", "WITH x AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM x",
        "SELECT (SELECT max(value) FROM text.`/etc/passwd`) FROM sales", "SELECT * FROM sales WHERE store IN (SELECT value FROM text.`/etc/passwd`)", "SELECT * FROM sales WHERE EXISTS (SELECT 1 FROM other)", "SELECT * FROM IDENTIFIER('other')",
        "WITH x AS (WITH y AS (SELECT * FROM other) SELECT * FROM y) SELECT * FROM x", "SELECT * FROM sales ASOF JOIN other", "SELECT a FROM VALUES (1) t(a) UNION SELECT value FROM text.`/x`", "SELECT try_reflect('a', 'b') FROM sales",
        "SELECT * FROM (SELECT * FROM sales s JOIN LATERAL (SELECT * FROM other) o)", "SELECT max(store) FROM sales HAVING max(store) > (SELECT max(value) FROM text.`/x`)", "SELECT * FROM sales ORDER BY (SELECT 1 FROM other)", "TABLE other", "SELECT * FROM read_files('/etc')",
    ],
)
def test_plan_guard(spark, box, sql):
    with pytest.raises(ValueError):
        check_plan(spark, sql, set(box.tables))
    with pytest.raises(ValueError):
        box.execute(sql)


@pytest.mark.parametrize("sql", ["WITH x AS (SELECT store FROM sales), y AS (SELECT * FROM x) SELECT count(*) AS n FROM y", "SELECT s.store FROM sales s JOIN sales_2 t ON true WHERE s.units > (SELECT avg(units) FROM sales)", "(SELECT store FROM sales) EXCEPT (SELECT 'x')", "SELECT explode(array(1, 2)) AS x FROM sales", "SELECT store, rank() OVER (ORDER BY rev) AS r FROM sales", "SELECT * FROM range(3)", "SELECT store, sum(rev) AS r FROM sales GROUP BY ROLLUP (store) HAVING sum(rev) > 0"])
def test_plan_guard_lets_reads_pass(box, sql):
    assert box.execute(sql)


def test_agent(box):
    said = iter(["```sql\nSELECT nope FROM sales\n```", "SELECT COUNT(*) AS n FROM sales"])
    prompts = []
    agent = SQLAgent(box, CallableGenerator(lambda p: prompts.append(p) or next(said)), "Amounts are in USD.", [("q", "SELECT 1")])
    assert agent.answer("how many rows") == ("SELECT COUNT(*) AS n FROM sales", [{"n": 3}])
    assert "nope" in prompts[1] and "Amounts are in USD." in prompts[0] and "the question: q\nis answered by:\nSELECT 1" in prompts[0] and prompts[0] in prompts[1]
    calls = []
    failing = CallableGenerator(lambda p: calls.append(p) or "SELECT nope FROM sales")
    assert SQLAgent(box, failing, retries=0).answer("x") == (None, None) and len(calls) == 1
    assert SQLAgent(box, failing, retries=2).answer("x") == (None, None) and len(calls) == 4
    assert SQLAgent(box, CallableGenerator(lambda p: "NO_SQL")).answer("x") == (None, None)
    assert SQLAgent(box, CallableGenerator(lambda p: p), template="{question}|{instructions}", retries=0).prompt("q") == "q|"


def test_pipeline(spark):
    configure(spark)
    prompts = []

    def model(prompt):
        prompts.append(prompt)
        return "SELECT SUM(rev) AS total FROM sales" if prompt.endswith("SQL:") else "Total 1600.25"

    pipe = TablePipeline(spark, CallableGenerator(model, "m"))
    pipe.ingest_text(TEXT)
    result = pipe.query("What is the total rev in sales?")
    assert result.route == "hybrid" and result.sql_result == [{"total": 1600.25}] and result.model == "m" and "1600.25" in result.prompt and "### SALES" in result.prompt
    assert pipe.query("Which stores are there?").route == "lookup" and pipe.query("total", route="lookup").sql is None
    with pytest.raises(ValueError):
        pipe.query("x", route="both")
    pipe.sandbox.close()
    with pytest.raises(RuntimeError):
        TablePipeline(spark).query("x")
    custom = TablePipeline(spark, CallableGenerator(lambda p: p), answering=Answering(builder=lambda system, context, q, sql, sql_result: f"<{q}>"))
    assert custom.query("hi").answer == "<hi>"


def test_evaluation(spark):
    samples = evalsets.own_samples(spark, [{"qid": "1", "question": "units of store N-2", "answers": ["12"], "golden_sections": ["SALES"]}, {"qid": "2", "question": "policy on returns", "answers": ["x"], "golden_sources": ["b"]}])
    contexts = spark.createDataFrame([("a", TEXT), ("b", "Returns policy: thirty days.")], "source string, text string")

    def model(prompt):
        if "policy" in prompt.split("Question")[-1]:
            raise OSError("no answer today")
        return "it is 12"

    pipe = TablePipeline(spark, CallableGenerator(model))
    results, report = pipe.evaluate(samples, contexts, generate=True)
    r = report.first()
    assert r.recall_at_k == 1.0 and r.num_generated == 1 and r.exact_match == 1.0
    by = {x.qid: x for x in results.collect()}
    assert "no answer today" in by["2"].error and by["2"].answer_correct is None and any(x.startswith("table:a:SALES") for x in by["1"].retrieved)
    pipe.sandbox.close()


def test_retrieval_errors_stay_with_their_sample(spark):
    class Refusing:
        """Embeds all but one question."""

        def embed(self, texts):
            if any("forbidden" in t for t in texts):
                raise ValueError("refused")
            return [[float(len(t)), 1.0] for t in texts]

    samples = evalsets.own_samples(spark, [{"qid": q, "question": t, "golden_sources": ["a"]} for q, t in (("1", "units"), ("2", "forbidden"))])
    pipe = TablePipeline(spark, computing=Computing(enabled=False), retrieval=Retrieval(embedder=Refusing(), lexical_weight=0.0))
    results, report = pipe.evaluate(samples, spark.createDataFrame([("a", TEXT)], "source string, text string"))
    by = {x.qid: x for x in results.collect()}
    assert by["1"].error is None and by["1"].hit_rank == 1 and "refused" in by["2"].error and by["2"].hit_rank is None and report.first().recall_at_k == 0.5


def test_builtin_samples(spark):
    samples, contexts = evalsets.builtin(spark)
    pipe = TablePipeline(spark)
    _, report = pipe.evaluate(samples, contexts)
    r = report.first()
    assert r.num_samples == 10 and r.recall_at_k >= 0.8 and r.exact_match is None
    assert len(pipe.sandbox) == 3
    pipe.sandbox.close()


def test_texts_add_up(spark, tmp_path):
    """Later texts, files of one name and repeated ingest: nothing is lost, nothing is doubled."""
    for name, text in (("x", "Gamma pears ripen."), ("y", "Delta plums ripen.")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.txt").write_text(text)
    pipe = TablePipeline(spark, computing=Computing(enabled=False))
    pipe.ingest_text("Alpha apples ripen.")
    pipe.ingest("Beta figs ripen.\n\nThey keep.")
    pipe.ingest_path(f"{tmp_path}/*/r.txt")
    pipe.ingest(tmp_path / "x" / "r.txt")
    pipe.ingest_text("Alpha apples ripen.", "Alpha apples ripen.")
    pipe.ingest(f"{tmp_path}/y/r.txt")
    held = pipe.index.blocks.select("source", "content").collect()
    assert sorted(r.content for r in held) == ["Alpha apples ripen.", "Beta figs ripen.", "Delta plums ripen.", "Gamma pears ripen.", "They keep."]
    assert sorted(r.source for r in held) == ["(inline)"] * 3 + ["r.txt"] * 2
    found = pipe.retrieve(spark.createDataFrame([(0, "which ripen")], "qid int, question string"), 4).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4] and len({r.doc_id for r in found}) == 4
    pipe.index.close()


def test_from_env(spark, monkeypatch):
    monkeypatch.setenv("GRIDLOOM_GENERATOR", "textwrap:dedent")
    pipe = TablePipeline.from_env(spark, computing=Computing(enabled=False))
    assert "Question: hi" in pipe.query("hi").answer


def test_manager_and_baseline(spark):
    manager = RetrieverManager(spark)
    manager.ingest_tables(["a,b\n1,2", "sku|stock\nx|5"])
    (hit,) = manager.as_retriever(1)("stock of sku x")
    assert hit["metadata"]["kind"] == "table" and "sku" in hit["page_content"]
    answer, found = run_baseline(spark, "alpha one\n---\nbeta two", "beta", CallableGenerator(lambda p: p), 1)
    assert "beta two" in answer and "alpha" not in answer.split("Question")[0]


class Hit:
    def __init__(self, content, metadata):
        self.page_content, self.metadata = content, metadata


class Store:
    """A store that refuses relevance scores and holds a document of its own."""

    def __init__(self):
        self.held = [Hit("foreign", {"origin": "else"})]

    def add_texts(self, texts, metadatas):
        self.held += [Hit(t, m) for t, m in zip(texts, metadatas, strict=True)]

    def similarity_search_with_relevance_scores(self, question, k):
        raise ValueError("no relevance function")

    def similarity_search_with_score(self, question, k):
        raise NotImplementedError

    def similarity_search(self, question, k):
        return self.held[:k]


def test_store_mode(spark):
    manager = RetrieverManager(spark, Store())
    manager.ingest_tables(["a,b\n1,2"])
    manager.ingest_tables(["sku|stock\nx|5"])
    foreign, first, second = manager.search("stock", 5)
    assert foreign == {"page_content": "foreign", "metadata": {"origin": "else"}}
    assert first["metadata"]["kind"] == second["metadata"]["kind"] == "table" and "score" not in first["metadata"] and "| sku |" in second["page_content"]
    blended = TablePipeline(spark, computing=Computing(enabled=False), retrieval=Retrieval(store=Store()))
    blended.ingest_text("a,b\n1,2", "sku|stock\nx|5")
    found = blended.retrieve(spark.createDataFrame([(0, "stock of sku")], "qid int, question string"), 2).orderBy("rank").collect()
    assert [r.semantic for r in found] == [0.0, 0.0] and found[0].score > found[1].score and "sku" in found[0].markdown


def test_chat_content_parts():
    class Said:
        content = ["a", {"text": "b"}, {"image": 1}]

    class Chat:
        def invoke(self, prompt):
            return Said()

    assert ChatGenerator(Chat()).generate("x") == "ab"


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", TEXT)], "source string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("source string, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = stream_blocks(source, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
