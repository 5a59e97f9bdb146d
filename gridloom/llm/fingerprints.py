"""Document fingerprints: threshold-scaled sketches of word shingles, built-in functions only.

A sketch keeps every 63-bit shingle hash below ``2**63 / scale``, and none else.  The
threshold is the same for all texts, so sketches merge by union and containment between
a short and a very long text is estimated without bias.  Beside the sketch stands the
least hash of all: it tells texts apart that keep no hash, and merges as a minimum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"


def sketch(text: Column, scale: int = 4, k: int = 5) -> Column:
    """(kept, least) of ``text``'s ``k``-word shingles; fewer words are one shingle.

    ``kept`` are the sorted distinct hashes below the threshold, ``least`` is the least
    of all.  Null and empty texts, and texts of white space alone, have an empty array
    and a null.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    none = F.array().cast("array<bigint>")

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)).bitwiseAND(F.lit(2**63 - 1)))
        return F.when(F.size(w) == 0, none).otherwise(each)

    def keep(h: Column) -> Column:
        return F.struct(F.array_sort(F.array_distinct(F.filter(h, lambda x: x < F.lit(2**63 // scale)))).alias("kept"), F.array_min(h).alias("least"))

    return let(words, lambda w: let(hashes(w), keep))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return F.struct(F.array_sort(F.array_union(a["kept"], b["kept"])).alias("kept"), F.least(a["least"], b["least"]).alias("least"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once: a lambda would compute it for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fingerprint(of: Column) -> Column:
    """A sketch as text: its hashes in order, 16 hexadecimal digits each; where it keeps none, a tilde and the least hash."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.when(F.size(of["kept"]) > 0, F.array_join(F.transform(of["kept"], digits), " ")).otherwise(F.coalesce(F.concat(F.lit("~"), digits(of["least"])), F.lit("")))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts; where neither keeps a hash, whether their least hashes are equal."""
    shared = F.size(F.array_intersect(a["kept"], b["kept"]))
    total = F.size(a["kept"]) + F.size(b["kept"]) - shared
    return F.when(total == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(shared / total)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds; where ``a`` keeps none, whether it has none or the least one of ``b``."""
    least = F.coalesce(a["least"] == b["least"], a["least"].isNull()).cast("double")
    return F.when(F.size(a["kept"]) == 0, least).otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"]))


def fingerprint_documents(docs: DataFrame, scale: int = 4, k: int = 5) -> DataFrame:
    """Sketch of every document of ``docs`` (doc_id, text), of its edited text, and likenesses.

    "Next" is the following document in descending doc_id, after the last the first.
    The order is cut into ranges at quantiles of doc_id, and of the text's hash for rows
    without one; a range also receives the first document of the following range, so
    texts are shuffled once and each range finds its successors alone.  The edited text
    ends in the first ``floor(n/2)`` code points of the next.

    Cases: null text is empty; rows of one doc_id follow in order of their text's hash,
    as do those without, which come last; a single row is its own next; an empty table
    gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, n_named, low, high = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    # quantiles are doubles, exact up to 2**53: larger ids, and hashes, are ranged by their upper bits
    shift = max(0, max(abs(low or 0), abs(high or 0)).bit_length() - 52)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.shiftright("doc_id", shift).alias("id"))
    docs = docs.withColumn("hash", F.when(F.col("doc_id").isNull(), F.shiftright(F.xxhash64("text"), 12)))

    def quantiles(column: str, rows: int) -> list[int]:
        """The least value, and bounds of about ``ranges`` by the share of ``rows``."""
        m = max(1, ranges * rows // max(1, n))
        found = docs.where(F.col(column).isNotNull()).agg(F.percentile_approx(column, [i / m for i in range(m)] or [0.0], 20 * m)).first()
        return sorted(set(found[0] or []))

    # ranges are numbered in order; a bound is the first id, or hash, of its range
    ids = quantiles("id", n_named)
    top = None if high is None else high >> shift
    bounds = sorted(set(ids) - {top}, reverse=True)
    hashes = quantiles("hash", n - n_named) if n > n_named else []
    first_hash, hashes = (hashes[0], hashes[1:]) if hashes else (None, [])
    named = 0 if top is None else len(bounds) + 1
    last = named + (0 if first_hash is None else len(hashes) + 1) - 1

    def position(table: list[int], before: Callable[[Column], Column]) -> Column:
        """How many of ``table`` are not after the row, by halving steps."""
        n = len(table)
        if not n:
            return F.lit(0)
        held, steps = F.array(*[F.lit(x) for x in table]), F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & before(F.try_element_at(held, at + step)), at + step).otherwise(at))

    def opens(table: list[int], value: Column, place: Column) -> Column:
        return F.try_element_at(F.array(*[F.lit(x) for x in table]), F.nullif(place, F.lit(0))) == value if table else F.lit(False)

    own = F.when(F.col("doc_id").isNull(), named + position(hashes, lambda x: x <= F.col("hash"))).otherwise(position(bounds, lambda x: x >= F.col("id")))
    # the first rows of a range close the one before, the first of all the last one
    guest = (
        F.when(F.col("id") == F.lit(top), F.lit(last))
        .when(F.col("doc_id").isNull() & (F.col("hash") == F.lit(first_hash)), F.lit(named - 1 if named else last))
        .when(F.col("doc_id").isNotNull() & opens(bounds, F.col("id"), F.col("place")), F.col("place") - 1)
        .when(F.col("doc_id").isNull() & opens(hashes, F.col("hash"), F.col("place") - named), F.col("place") - 1)
    )
    spread = (
        docs.withColumn("place", own)
        .withColumn("opens", guest)
        .select("doc_id", "text", F.explode(F.filter(F.array(F.struct(F.col("place").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("opens").alias("range"), F.lit(1).alias("guest"))), lambda x: x["range"].isNotNull())).alias("r"))
        .select("doc_id", "text", "r.range", "r.guest")
        .repartition("range")
        .withColumn("kept", sketch(F.col("text"), scale, k))
    )
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    own = (
        spread.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_kept", F.lead("kept").over(order))
        .where("guest = 0")
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("half", (F.col("n_chars") / 2).cast("int"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars) - half)"), F.expr("substring(next_text, 1, half)")))
        .withColumn("edited_kept", sketch(F.col("edited"), scale, k))
    )
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("kept")).alias("fingerprint"),
        fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
        resemblance(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        resemblance(F.col("kept"), F.col("next_kept")).alias("near_next"),
        containment(F.col("kept"), F.col("next_kept")).alias("held_by_next"),
    )
