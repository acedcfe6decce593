"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after every run of space, tab, line feed, vertical tab, form feed and
carriage return has become one space. Three combining stages, each keyed by digest *and* full text:

1. every task combines its own copies (the partial aggregation before the first shuffle);
2. salted digest groups merge: the salt is the task's number modulo ``salts``, so the copies of one text
   meet in up to ``salts`` tasks and each task sends one row per text, however hot the text is;
3. the salt winners combine globally.

A digest that stands for one text only (verified by stage 3, which compares texts) then names its group, so
rows find their group by digest alone; rows of digests that several texts share, should there be any, are
matched by full text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import checkpoint

#: Salted groups per digest in stage 2.
SALTS = 32


def normalised(text: Column) -> Column:
    """The text with each white-space run as one space; null as ''. Plain byte replacements, a regular expression only where runs are left."""
    text = F.coalesce(text, F.lit(""))
    for white in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest id among equal texts and group_size their number of rows. Null texts count as
    empty. A null id loses to any other; where a group has only null ids, keep_id is null and all its rows
    are kept. Rows that repeat the same id and text are the same document: each says kept if that id stays.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    local_and_salted = rows.groupBy("_digest", "_text", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt")).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    texts = local_and_salted.groupBy("_digest", "_text").agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    by_digest = texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    # No text is left here: only groups of two rows and more, some dozens of bytes each. The checkpoint cuts
    # the lineage and lets the join below deal both of its sides itself, so that AQE can split a hot digest.
    groups = checkpoint(by_digest.where((F.col("_size") > 1) | (F.col("_texts") > 1)))
    shared_digests = not groups.where(F.col("_texts") > 1).isEmpty()
    # full texts go through the last shuffle only where a digest stands for several of them
    named = rows.select("_id", "_digest", F.sha2("_text", 256).alias("text_sha256"), *["_text"] * shared_digests)
    out = named.join(groups, "_digest", "left")
    single = F.col("_size").isNull()
    keep, size = F.when(single, F.col("_id")).otherwise(F.col("_keep")), F.coalesce("_size", F.lit(1).cast("long"))
    if shared_digests:
        shared = checkpoint(texts.join(groups.where(F.col("_texts") > 1).select("_digest"), "_digest", "left_semi"))
        shared = shared.select(F.col("_digest").alias("_d"), F.col("_text").alias("_t"), F.col("_keep").alias("_k"), F.col("_size").alias("_s"))
        out = out.join(shared, (F.col("_digest") == F.col("_d")) & (F.col("_text") == F.col("_t")), "left")
        several = F.coalesce(F.col("_texts") > 1, F.lit(False))
        keep, size = F.when(several, F.col("_k")).otherwise(keep), F.when(several, F.col("_s")).otherwise(size)
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of ``docs`` of each group of equal texts, with all its columns: the one with the smallest id.

    A null id loses to any other. Of rows that repeat that id and text, as of equal texts without any id, the
    smallest by all columns stays (which must then be sortable). An empty table stays empty.
    """
    found = exact_groups(docs, id_col, text_col, salts).withColumnRenamed(id_col, "_found").withColumnRenamed("text_sha256", "_found_sha")
    once = found.groupBy("_found", "_found_sha").agg(F.count(F.lit(1)).alias("_rows"), F.max(~F.col("kept")).alias("_copy"))
    out = checkpoint(once.where(F.col("_copy") | (F.col("_rows") > 1)))
    sha = F.sha2(normalised(docs[text_col]), 256)
    kept = docs.join(out, docs[id_col].eqNullSafe(out["_found"]) & (sha == out["_found_sha"]), "left_anti")
    again = out.where(~F.col("_copy")).select("_found", "_found_sha")
    if again.isEmpty():
        return kept
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), sha.alias("_sha"))
    chosen = rows.join(again, F.col("_id").eqNullSafe(F.col("_found")) & (F.col("_sha") == F.col("_found_sha")), "left_semi").groupBy("_id", "_sha").agg(F.min("_row").alias("_row"))
    return kept.unionByName(chosen.select("_row.*"))
