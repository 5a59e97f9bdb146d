"""Stages of the pipeline on rows without a doc_id and on rows that share one."""

from collections import Counter

import corpus_pipeline as pipeline
from gridloom.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def mixed(spark, rows):
    return [r.text for r in pipeline.mix(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]


def test_rows_that_share_an_id_are_taken_each(spark):
    """Every text is whole but for one at most, and the words of the source meet the target."""
    for doc_id in (None, 7):
        texts = [words("s", 10), words("m", 100), words("l", 3000)]
        got = mixed(spark, [(doc_id, t, "en", "a", len(t)) for t in texts])
        assert sum(t not in texts for t in got) <= 1
        assert abs(sum(len(t.split()) for t in got) - 1.5 * 3110) <= 1


def test_rows_alike_are_counted_together(spark):
    text = words("x", 20)
    rows = [(None, text, "en", "a", 1)] * 9 + [(3, words("y", 20), "en", "a", 1)]
    got = Counter(mixed(spark, rows))
    assert sum(len(t.split()) * n for t, n in got.items()) == 300
    assert sum(n for t, n in got.items() if t not in {text, words("y", 20)}) <= 1


def test_rows_without_an_id_are_deduplicated(spark):
    long = words("w", 60)
    near = long.replace("w59", "other")
    rows = [(None, long, "en", "a", 1), (None, long, "en", "a", 1), (None, near, "en", "a", 1), (None, words("z", 40), "en", "b", 1), (5, words("q", 30), "en", "a", 1), (None, words("q", 30), "en", "a", 1), (None, None, None, None, None), (None, " ", None, None, None)]
    kept, _ = materialize(pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), ""), "near_duplicates")
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got.pop((None, long), 0) + got.pop((None, near), 0) == 1
    assert got == {(None, words("z", 40)): 1, (5, words("q", 30)): 1, (None, None): 1, (None, " "): 1}


def kept_texts(spark, rows):
    kept, _ = materialize(pipeline.keep_identified(spark, spark.createDataFrame(rows, SCHEMA), ""), "language_id")
    return Counter(r.text for r in kept.collect())


def test_documents_stay_where_no_language_is_known(spark):
    rows = [(1, "abc def", None, "a", 7), (2, "é", None, None, 1), (3, "12 !", None, "a", 4), (4, None, None, "a", None)]
    assert kept_texts(spark, rows) == {"abc def": 1, "é": 1}


def test_documents_of_close_languages_stay(spark):
    """Four of twelve languages share their words, and so the score of each of their documents."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    text = lambda i: "the same words in four of them" if i < 4 else " ".join(alphabet[i + 5] * k + alphabet[i + 10] * k for k in range(1, 7))
    rows = [(12 * j + i, text(i), f"l{i:02}", "a", 30) for i in range(12) for j in range(4)]
    assert kept_texts(spark, rows)[text(0)] == 16
