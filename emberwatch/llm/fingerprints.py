"""Fingerprints of texts: bottom-k sketches of word-shingle hashes, as DataFrame functions alone.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles, ascending. The sketch of several parts is the k smallest of
their sketches, whatever the parts, so sketches merge across rows, files and days. From two sketches follow estimates of resemblance and
containment, from one that of the number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.llm.shared import documents

SKETCH_SIZE = 256
SHINGLE_WORDS = 5
#: Documents of one range of ids in with_next, and the most ranges; both only lay out the rows.
RANGE_ROWS, MOST_RANGES = 2_000, 2_000


def sketch(text: Column, size: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> Column:
    """Bottom-k sketch, array<long>. Fewer words than a shingle has are one shingle; no words or null: an empty sketch."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # A lambda's variable holds the words, so that they are found once and not for every shingle.
    return F.get(F.transform(F.array(found), lambda held: _sketch_of_words(held, size, words)), 0)


def _sketch_of_words(found: Column, size: int, words: int) -> Column:
    def shingle(word, i):
        return F.xxhash64(word, *[F.get(found, i + j) for j in range(1, words)])

    whole = F.when(F.size(found) > 0, F.array(F.xxhash64(F.array_join(found, " ")))).otherwise(F.array().cast("array<bigint>"))
    several = F.slice(F.transform(found, shingle), 1, F.greatest(F.size(found) - (words - 1), F.lit(0)))
    hashes = F.when(F.size(found) < words, whole).otherwise(several)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def merge(a: Column, b: Column, size: int = SKETCH_SIZE) -> Column:
    """Sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merged(df: DataFrame, keys: list[str], sketch_col: str, size: int = SKETCH_SIZE, salts: int = 64) -> DataFrame:
    """One merged sketch per key, null keys included. A hash is one row; equal hashes meet before the shuffle, and each key is
    merged in ``salts`` parts first, none of which holds more than size hashes of a part."""
    hashes = df.select(*keys, F.explode(sketch_col).alias("_hash")).distinct()
    salted = hashes.withColumn("_salt", F.pmod(F.col("_hash"), F.lit(salts)))
    rank = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy("_hash"))
    part = salted.withColumn("_rank", rank).where(F.col("_rank") <= size)
    found = part.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_hash")), 1, size).alias(sketch_col))
    missing = df.select(*keys).distinct()
    same = [missing[k].eqNullSafe(found[k]) for k in keys]
    empty = F.array().cast("array<bigint>")
    return missing.join(found, same, "left").select(*[missing[k] for k in keys], F.coalesce(found[sketch_col], empty).alias(sketch_col))


def resemblance(a: Column, b: Column, size: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard likeness, 0 to 1: the share of both among the k smallest of either. Two empty sketches are alike."""
    least = merge(a, b, size)
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def distinct_shingles(a: Column, size: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below size."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SKETCH_SIZE) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; nothing is in everything."""
    whole = distinct_shingles(merge(a, b, size), size)
    common = resemblance(a, b, size) * whole
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, size)))


def as_text(a: Column) -> Column:
    """A sketch as text: its hashes in base 16, 16 digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str, text_col: str, make: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, text_col) with next_<text_col> of the row that follows by descending id; after the last comes the first.

    Nulls are the least ids, and rows of one id follow each other by the hash of their text. A single row follows itself. Texts
    cross the network once: ids are cut into ranges, a range is one window, and the greatest row of a range is
    repeated in the one above, where it is the next of the least. ``make`` adds columns before the step and their next_ too.
    """
    make = make or {}
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.col(id_col).alias("_given"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    count = docs.select(id_col).count()
    ranges = max(1, min(MOST_RANGES, math.ceil(count / RANGE_ROWS)))
    cuts = base.agg(F.percentile_approx("_id", [k / ranges for k in range(1, ranges)] or [0.5], 20 * ranges)).first()[0] or []
    cuts = sorted({*cuts}) if ranges > 1 else []
    place = F.lit(0)
    if cuts:
        # Two steps of about the square root of the number of ranges.
        step = max(1, math.isqrt(len(cuts)))
        coarse, fine = cuts[::step], [cuts[k : k + step] for k in range(0, len(cuts), step)]
        group = F.size(F.filter(F.lit(coarse), lambda c: c <= F.col("_id"))) - 1
        within = F.size(F.filter(F.get(F.array(*[F.lit(f) for f in fine]), F.col("_group")), lambda c: c <= F.col("_id")))
        base = base.withColumn("_group", group)
        place = F.when(F.col("_group") < 0, 0).otherwise(F.col("_group") * step + within)
    base = base.withColumn("_range", place.cast("int")).withColumn("_tie", F.xxhash64("_text")).drop("_group")
    tops = base.groupBy("_range").agg(F.max(F.struct("_id", "_tie")).alias("top"))
    # A row per range: the greatest row goes to the next range that has rows, that of the last range to the first.
    rows = sorted((r["_range"], r.top["_id"], r.top["_tie"]) for r in tops.collect())
    goes = [(b[0], a[1], a[2]) for a, b in zip(rows, rows[1:] + rows[:1], strict=True)]
    goes = docs.sparkSession.createDataFrame(goes or [(0, 0, 0)], "_to int, _id long, _tie long")
    guests = base.join(F.broadcast(goes), ["_id", "_tie"]).dropDuplicates(["_id", "_tie", "_to"]).withColumn("_range", F.col("_to")).drop("_to")
    both = base.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    order = W.partitionBy("_range").orderBy(F.col("_guest").desc(), "_id", "_tie")
    out = both.withColumns(make).withColumn(f"next_{text_col}", F.lag("_text").over(order))
    out = out.withColumns({f"next_{name}": F.lag(name).over(order) for name in make})
    out = out.where("_guest = 0").withColumnRenamed("_given", id_col).withColumnRenamed("_text", text_col)
    return out.drop("_id", "_range", "_tie", "_guest")


def edited_with_next(text: Column, following: Column) -> Column:
    """The last third of the characters replaced by as many from the beginning of the following text, or all it has."""
    part = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - part), F.substring(following, F.lit(1), part))


def query(spark, folder: str) -> DataFrame:
    """All documents and their edited texts."""
    text = F.col("_text")
    rows = with_next(documents(spark, folder, "doc_id", "text"), "doc_id", "text", {"sketch": sketch(text)})
    rows = rows.withColumn("edited", edited_with_next(F.col("text"), F.col("next_text"))).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {"op5_document_fingerprints": (query, None)}
