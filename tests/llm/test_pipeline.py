"""The pipeline's stages, each against brute force on its own input, and the registered queries on small tables."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from gridloom.llm import queries
from gridloom.llm.common import materialize

from .test_operators import brute_components, brute_targets, corpus

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return [(*r, len(r[1] or "")) for r in corpus(90, seed=8)]


@pytest.fixture(scope="module")
def stages(spark, rows):
    """Documents and the result of each stage; the input has columns that clash with those inside."""
    clash = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, score int, cid int"
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], clash)
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], ""), name)[0])
    return [x.collect() for x in out]


def test_columns_and_names(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "mixing", "packing"]
    assert all(list(r.asDict()) == pipeline.COLUMNS for part in stages[1:4] for r in part[:3])


def test_language_stage_keeps_whatever_has_letters(stages, rows):
    wanted = Counter(r[0] for r in rows if any(map(str.isalpha, r[1] or "")))
    assert Counter(r.doc_id for r in stages[1]) == wanted


def test_one_of_each_group_stays(stages):
    groups = brute_components([(r.doc_id, r.text) for r in stages[1]], 5, 80)
    wanted = {d for (d, n, c) in groups if d is not None and (d == c or not n)}
    kept = [r.doc_id for r in stages[2]]
    assert set(kept) - {None} == wanted and len(kept) == len(set(kept))


def test_sources_come_near_their_targets(stages):
    size = lambda t: len(t.split())
    sizes, taken = Counter(), Counter()
    for r in stages[2]:
        sizes[r.source] += size(r.text)
    for r in stages[3]:
        taken[r.source] += size(r.text)
    for source, target in brute_targets(sizes, (5, 2, 1), 1.5, 2).items():
        assert abs(taken[source] - target) <= 2 + 0.02 * target
    text = {r.doc_id: r.text for r in stages[2]}
    assert all(r.text == text[r.doc_id] or text[r.doc_id].split()[: size(r.text)] == r.text.split() for r in stages[3])


def test_packed_pieces_hold_every_copy(stages):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(queries.vocabulary()["vocabulary"])
    wanted = Counter((r.doc_id, len(encode.encode(r.text, add_special_tokens=False).ids) + 1) for r in stages[3])
    got = Counter()
    for r in stages[4]:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({k: k[1] * n for k, n in wanted.items()})
    whole = [r for r in stages[4] if r.length == r.doc_tokens]
    texts = {(r.doc_id, zlib.crc32(np.array([*encode.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes())) for r in stages[3]}
    assert {(r.doc_id, r.ids_crc32) for r in whole} <= texts


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        docs, _ = materialize(stage(spark, docs, ""), name)
        assert docs.isEmpty()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query(spark, name):
    import duckdb

    got = queries.queries()[name](spark, SMALL).toPandas()
    assert len(got)
    sql = queries.oracle_sql().get(name)
    if sql:
        connection = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        other = connection.execute(sql).df()
        key = lambda df: sorted(map(str, df[sorted(df.columns)].fillna(-1).astype(str).replace(r"\.0$", "", regex=True).values.tolist()))
        assert key(got) == key(other)
