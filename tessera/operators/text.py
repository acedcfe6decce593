"""Text and log operators: templates, counts, TF-IDF, sentiment, chunks, retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ordered import numbered


def mask_templates(lines: DataFrame, line: str = "line", number: str = "line_no") -> DataFrame:
    """(template, template_id, n): ids from 0 by first line."""
    t = lines.groupBy(tx.mask_line(F.col(line)).alias("template")).agg(F.min(number).alias("first"), F.count(F.lit(1)).alias("n"))
    return numbered(t, ["first", "template"], "template_id").select("template", "template_id", "n")


def session_templates(lines: DataFrame, session: Column, line: str = "line") -> DataFrame:
    """(session, template, n) of lines that name a session."""
    rows = lines.select(session.alias("session"), tx.mask_line(F.col(line)).alias("template")).where("session is not null and session <> ''")
    return rows.groupBy("session", "template").agg(F.count(F.lit(1)).alias("n"))


def event_count_matrix(counts: DataFrame, templates: list[str]) -> DataFrame:
    """One row a session, one column a template, zeros filled in."""
    return counts.groupBy("session").pivot("template", templates).agg(F.sum("n")).na.fill(0)


def template_idf(counts: DataFrame) -> DataFrame:
    n = counts.agg(F.count_distinct("session").alias("sessions"))  # one row
    df = counts.groupBy("template").agg(F.count_distinct("session").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("template", "df", (F.ln((1 + F.col("sessions")) / (1 + F.col("df"))) + 1).alias("idf"))


def session_rarity(counts: DataFrame) -> DataFrame:
    return counts.join(template_idf(counts), "template").groupBy("session").agg(F.sum(F.col("n") * F.col("idf")).alias("rarity"))


def count_invariants(counts: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(session, violated): whether some template's count, absent ones as 0, lies outside the template's quantile band.

    The zeros are not made: a template's quantiles follow from the counts it has and the number of sessions.
    """
    n = counts.agg(F.count_distinct("session").alias("sessions"))
    w = Window.partitionBy("template").orderBy("n")
    per = counts.groupBy("template", "n").agg(F.count(F.lit(1)).alias("m"))
    seen = per.groupBy("template").agg(F.sum("m").alias("present")).crossJoin(F.broadcast(n))
    ranked = per.join(seen, "template").withColumn("upto", F.col("sessions") - F.col("present") + F.sum("m").over(w))

    def at(q: float) -> Column:
        """Interpolated quantile from cumulated counts; value v holds the ranks below its 'upto'."""
        pos = F.lit(q) * (F.col("sessions") - 1)
        value = lambda p: F.coalesce(F.min(F.when(F.col("upto") > p, F.col("n"))), F.lit(0))
        zero = lambda p: F.max(F.when(F.col("sessions") - F.col("present") > p, 1).otherwise(0)) == 1
        pick = lambda p: F.when(zero(p), 0).otherwise(value(p))
        lo, hi = pick(F.floor(pos)), pick(F.ceil(pos))
        return lo + (hi - lo) * F.max(pos - F.floor(pos))

    bands = ranked.groupBy("template").agg(at(low).alias("lo"), at(high).alias("hi"))
    needed = bands.agg(F.count_if(F.col("lo") > 0).alias("needed"))  # absence violates only bands above 0
    hits = counts.join(bands, "template").groupBy("session").agg(F.max((F.col("n") < F.col("lo")) | (F.col("n") > F.col("hi"))).alias("out"), F.count_if(F.col("lo") > 0).alias("had"))
    return hits.crossJoin(F.broadcast(needed)).select("session", (F.col("out") | (F.col("had") < F.col("needed"))).alias("violated"))


def zscore_flags(df: DataFrame, value: str, z: float) -> DataFrame:
    stats = F.broadcast(df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")))  # one row
    return df.crossJoin(stats).withColumn("flag", F.coalesce((F.col(value) - F.col("_m")) / F.nullif("_s", F.lit(0.0)) > z, F.lit(False))).drop("_m", "_s")


def quantile_flags(df: DataFrame, value: str, q: float) -> DataFrame:
    cut = F.broadcast(df.agg(F.percentile(value, F.lit(q)).alias("_q")))  # one row
    return df.crossJoin(cut).withColumn("flag", F.col(value) > F.col("_q")).drop("_q")


def token_table(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf)"""
    return docs.select(doc, F.explode(tx.alnum_tokens(F.col(text))).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def token_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``token_table`` row by row, without a shuffle: where several rows share a document's id, its terms come once a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["_t"].value_lengths().fill_null(0).to_numpy()
            terms = batch["_t"].flatten().dictionary_encode()
            size = max(1, len(terms.dictionary))
            pairs, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + terms.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([batch[doc].take(pa.array(pairs // size)), terms.dictionary.take(pa.array(pairs % size)), pa.array(n)], [doc, "term", "tf"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, tx.alnum_tokens(F.col(text)).alias("_t")).mapInArrow(count, f"{doc} {kind}, term string, tf long")


def tfidf(docs: DataFrame, doc: str, text: str, normalise: bool = False) -> DataFrame:
    """(doc, term, tf, weight): raw counts times ln((n + 1) / (df + 1)) + 1; L2-normalised on request."""
    tokens = token_table(docs, doc, text)
    n = docs.agg(F.count(F.lit(1)).alias("docs"))  # one row
    df = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = tokens.join(df, "term").crossJoin(F.broadcast(n)).select(doc, "term", "tf", (F.col("tf") * (F.ln((F.col("docs") + 1) / (F.col("df") + 1)) + 1)).alias("weight"))
    if normalise:
        norm = out.groupBy(doc).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        out = out.join(norm, doc).select(doc, "term", "tf", (F.col("weight") / F.col("norm")).alias("weight"))
    return out


def top_terms(weights: DataFrame, doc: str, k: int) -> DataFrame:
    w = Window.partitionBy(doc).orderBy(F.desc(F.round("weight", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bag_of_words(docs: DataFrame, doc: str, text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    tokens = token_table(docs, doc, text)
    return tokens if vocabulary is None else tokens.join(vocabulary.select("term").distinct(), "term", "left_semi").select(doc, "term", "tf")


def sentiment(docs: DataFrame, text: str, lexicon: Mapping[str, float]) -> DataFrame:
    return docs.withColumn("score", tx.lexicon_score(tx.tokenize(F.col(text)), lexicon))


def sentiment_series(scored: DataFrame, date: str, weekly: bool = False) -> DataFrame:
    """Mean score and number per day, or per week labelled by the Sunday that ends it."""
    label = F.date_add(F.date_trunc("week", F.col(date)).cast("date"), 6) if weekly else F.to_date(date)
    return scored.groupBy(label.alias("day")).agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def chunk_documents(docs: DataFrame, doc: str, text: str, size: int = 200, overlap: int = 40) -> DataFrame:
    return docs.select(doc, F.posexplode(tx.word_chunks(F.col(text), size, overlap)).alias("chunk_id", "chunk"))


def retrieve(index: DataFrame, queries: DataFrame, k: int, doc: str, query: str) -> DataFrame:
    """(query, doc, score, rank): top k by dot product of normalised TF-IDF rows; shared terms meet through an inverted index."""
    scores = queries.select(query, "term", F.col("weight").alias("_q")).join(index, "term").groupBy(query, doc).agg(F.sum(F.col("weight") * F.col("_q")).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), doc)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_weights(queries: DataFrame, query: str, text: str, index: DataFrame, docs_n: DataFrame) -> DataFrame:
    """Normalised TF-IDF rows of queries with the corpus's frequencies; unknown words are ignored. ``docs_n``: one row, column docs."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = token_table(queries, query, text).join(df, "term").crossJoin(F.broadcast(docs_n)).select(query, "term", (F.col("tf") * (F.ln((F.col("docs") + 1) / (F.col("df") + 1)) + 1)).alias("weight"))
    norm = rows.groupBy(query).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return rows.join(norm, query).select(query, "term", (F.col("weight") / F.col("norm")).alias("weight"))


def retrieval_quality(ranked: DataFrame, truth: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """Mean recall at k and reciprocal rank over the queries of ``truth(query, relevant)``."""
    first = ranked.join(truth, query).where(F.col(doc) == F.col("relevant")).groupBy(query).agg(F.min("rank").alias("r"))
    return truth.join(first, query, "left").agg(F.coalesce(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias("recall"), F.coalesce(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), F.lit(0.0)).alias("mrr"), F.count(F.lit(1)).alias("n"))


def extractive_answer(ranked: DataFrame, query: str, doc: str, chunk: str) -> DataFrame:
    """Per query: the best chunk, and the distinct sources by rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", doc)))
    return ranked.groupBy(query).agg(F.min_by(chunk, "rank").alias("answer"), F.array_join(F.array_distinct(F.transform(ordered, lambda x: x[doc].cast("string"))), ",").alias("sources"))


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, vec_id: str, vector: str = "embedding") -> DataFrame:
    """Exact top k by cosine of all queries against all vectors: (query, vec, score, rank).

    Queries come to the driver in blocks of QUERY_BLOCK. A block is broadcast as one matrix, so each task scores its
    vectors by a product, a few queries at a time, and keeps k a query a batch; the winners are merged by rank.
    """
    import numpy as np
    import pandas as pd

    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)

    def scorer(ids, matrix):
        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                keys, rows = batch["_i"].to_numpy(), unit(np.stack(batch["_v"].to_numpy()).astype(float))
                few, top = max(1, SCORES // len(keys)), min(k, len(keys))
                for at in range(0, len(ids), few):
                    scores = np.einsum("qd,vd->qv", matrix.value[at : at + few], rows)
                    rounded = np.round(scores, 9)
                    # all that reach the score of the last place, so that ties are settled by key
                    q, v = np.nonzero(rounded >= np.partition(rounded, len(keys) - top, axis=1)[:, len(keys) - top, None])
                    order = np.lexsort((keys[v], -rounded[q, v], q))
                    q, v = q[order], v[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < top
                    yield pd.DataFrame({query_id: ids[at + q[best]], vec_id: keys[v[best]], "score": scores[q[best], v[best]]})

        return run

    spark = queries.sparkSession
    q, v = queries.schema[query_id].dataType.simpleString(), vectors.schema[vec_id].dataType.simpleString()
    schema = f"{query_id} {q}, {vec_id} {v}, score double"
    source = vectors.select(F.col(vec_id).alias("_i"), F.col(vector).alias("_v"))
    best, left = spark.createDataFrame([], schema), queries.select(F.col(query_id).alias("_q"), F.col(vector).alias("_v")).toLocalIterator()
    while rows := list(islice(left, QUERY_BLOCK)):
        block = spark.sparkContext.broadcast(unit(np.array([r["_v"] for r in rows], float)))
        best = best.unionByName(source.mapInPandas(scorer(np.array([r["_q"] for r in rows]), block), schema))
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), vec_id)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries in a block of cosine_topk, which bounds a broadcast; scores that a task holds at once.
QUERY_BLOCK, SCORES = 10_000, 2_000_000


def mmr(pool: DataFrame, k: int, query: str, item: str, vector: str, relevance: str, weight: float = 0.5) -> DataFrame:
    """Greedy choice of k items a query by weight * relevance - (1 - weight) * largest similarity to those chosen; pools are small."""
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([relevance, item], ascending=[False, True]).reset_index(drop=True)
        m = np.stack(rows[vector].to_numpy()).astype(float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        rel, nearest, chosen = rows[relevance].to_numpy(float), np.zeros(len(rows)), []
        while len(chosen) < min(k, len(rows)):
            value = weight * rel - (1 - weight) * nearest
            value[chosen] = -np.inf
            best = int(np.argmax(value))
            chosen.append(best)
            nearest = np.maximum(nearest, np.einsum("nd,d->n", m, m[best])) if len(chosen) > 1 else np.einsum("nd,d->n", m, m[best])
        return pd.DataFrame({query: rows[query].iloc[0], item: rows[item].iloc[chosen], "pick": range(1, len(chosen) + 1)})

    q, i = pool.schema[query].dataType.simpleString(), pool.schema[item].dataType.simpleString()
    return pool.groupBy(query).applyInPandas(run, f"{query} {q}, {item} {i}, pick int")
