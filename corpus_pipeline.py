"""The corpus pipeline: language ID, near duplicates, source mixing and packing of ``documents``.

``STAGES`` holds (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns the documents that it keeps, the last one the packed pieces.  ``run`` writes
each stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard, langid, mixing, packing
from gridloom.llm.common import materialize
from gridloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.3  #: of four languages at random one would get a quarter
ABOVE_CHANCE = 1.2  #: the same over chance, where more languages share the score


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (``und``) and those that fit no learned language better than chance.

    The least score falls with the number of learned languages; where no row has a lang,
    nothing is learned and all documents with a letter stay.  Cases: null, empty and
    letterless texts go; a null doc_id, lang or source changes nothing; repeated rows
    stay or go alike; very long texts are read whole; an empty table gives no rows;
    further columns are left out.
    """
    docs = docs.select(*COLUMNS)
    langs, log_p = langid.fit(docs)
    if not langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    least = min(LEAST_SCORE, ABOVE_CHANCE / len(langs))
    named = langid.predict(docs, langs, log_p)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group that shares 80 % of its five-word shingles.

    Documents without words are no one's duplicates.  A document without a doc_id goes by
    a number that its text gives, above usual ids, so that one with a doc_id is kept
    rather; of rows that repeat both doc_id and text one is kept.
    """
    docs = docs.select(*COLUMNS)
    given = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(2**62))
    blank = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    named = docs.where(~blank).select(F.coalesce("doc_id", given).alias("doc_id"), *COLUMNS[1:], F.col("doc_id").isNull().alias("nameless"))
    parts = jaccard.jaccard_components(named, k=5, percent=80)
    stays = (F.col("doc_id") == F.col("component_id")) | (F.col("n_shingles") == 0)
    ids = parts.groupBy(F.col("doc_id").alias("id")).agg(F.max(stays).alias("stays"), (F.count("*") > 1).alias("repeats"))
    ids, _ = materialize(ids.where("stays"), "kept-ids")
    # ids are the hashed side, so texts are dealt out but not sorted; only repeated ids can have rows to drop
    once = named.join(ids.where("not repeats").select("id").hint("shuffle_hash"), F.col("doc_id") == F.col("id")).drop("id")
    more = named.join(ids.where("repeats").select("id"), F.col("doc_id") == F.col("id")).drop("id").dropDuplicates(["doc_id", "text"])
    kept = once.unionByName(more).select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), *COLUMNS[1:])
    return kept.unionByName(docs.where(blank))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that each source has its share of words.

    A document taken once and a half is one whole copy and its first half of words,
    joined by single spaces.  Each row is taken as the mix says, whatever rows share its
    doc_id; only rows alike in all columns are counted together.
    """
    docs = docs.select(*COLUMNS).withColumn("key", F.xxhash64("text", "lang", F.col("lang").isNull(), "n_chars"))
    each = mixing.mix_sources(docs, key="key").withColumn("whole", F.coalesce(F.expr("taken div nullif(size, 0)"), F.lit(0)))
    # the mix cuts one row of a source at most, so a part is of one row
    every = each.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("from"), F.col("key").alias("k"), "size")
    taken, _ = materialize(every.agg(F.sum("whole").alias("whole"), F.max(F.col("taken") - F.col("whole") * F.col("size")).alias("part"), F.count("*").alias("n")).where("whole > 0 or part > 0"), "taken")
    # written apart: usually none, and then sent to the texts rather than these dealt out again
    repeated, _ = materialize(taken.where("n > 1"), "taken-repeated")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("key") == F.col("k"))
    alike = docs.join(repeated, same).dropDuplicates(["id", "from", "k", "size"])
    chosen = docs.join(taken.where("n = 1"), same).unionByName(alike)
    chosen = chosen.select(*COLUMNS, "size", "whole", "part", F.explode(F.sequence(F.lit(1), (F.col("whole") + F.signum("part")).cast("int"))).alias("copy"))
    cut = F.array_join(F.slice(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != ""), 1, F.col("part").cast("int")), " ")
    text = F.when(F.col("copy") > F.col("whole"), cut).otherwise(F.col("text"))
    return chosen.select("doc_id", text.alias("text"), "lang", "source", "n_chars").withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, as ``pack_documents`` gives them.

    Cases: a null or empty text is its closing token alone; rows that share a doc_id, or
    have none, are packed each; long texts are cut into pieces; an empty table gives no
    rows; further columns are ignored.
    """
    return packing.pack_documents(docs, **vocabulary())


STAGES = [("language_id", keep_identified), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: The stages are iterative or use models; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
