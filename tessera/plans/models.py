"""Queries for models; MLlib's optimisers and seeds have no SQL, so most are held to invariants by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import models, text
from tessera.sources.tables import table

from .inputs import places, rounded
from .metrics import _buys


@query()
def als_recommend(spark, sf_dir):
    ratings = _buys(spark, sf_dir).select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), F.col("grade").cast("float").alias("rating"))
    return models.recommend(models.als(ratings, rank=6, iters=5), 5).select("user", "rank", "item")


_RATED = "r AS (SELECT o_custkey AS u, p_size AS item, max(l_linenumber) AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), m AS (SELECT avg(rating) AS mu FROM r), i AS (SELECT item, sum(rating - mu) / (count(*) + 5) AS ib FROM r, m GROUP BY 1), u AS (SELECT u, sum(rating - mu - ib) / (count(*) + 5) AS ub FROM r JOIN i USING (item), m GROUP BY 1)"


@query(f"WITH {_RATED} SELECT u AS \"user\", item, round(rating - mu - ib - ub, 6) AS residual FROM r JOIN i USING (item) JOIN u USING (u), m")
def rating_biases(spark, sf_dir):
    ratings = _buys(spark, sf_dir).withColumn("rating", F.col("grade").cast("double"))
    return rounded(models.biases(ratings).select("user", "item", "residual"), "residual")


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.ln("n_chars").alias("size"), (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.length("text")).alias("letters"), (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.length("text")).alias("upper"))
    return table(spark, sf_dir, "labels").join(d, "doc_id")


@query()
def logistic_predict(spark, sf_dir):
    out = models.logistic(_labelled(spark, sf_dir), ["size", "letters", "upper"], "quality")
    return out.select("doc_id", "quality", F.round(F.col("probability")[1], 3).alias("p"))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])


@query()
def softmax_predict(spark, sf_dir):
    out = models.logistic(_vectors(spark, sf_dir), [f"e{i}" for i in range(8)], "label", multinomial=True)
    return out.select("vec_id", F.inline(models.top_classes(F.col("probability"), 3))).withColumn("probability", F.round("probability", 3))


@query()
def random_forest_predict(spark, sf_dir):
    return models.random_forest(_labelled(spark, sf_dir), ["size", "letters", "upper"], "quality", trees=10).select("doc_id", "quality", "prediction")


@query()
def pca_error(spark, sf_dir):
    return rounded(models.pca_error(_vectors(spark, sf_dir), [f"e{i}" for i in range(8)], 3).select("vec_id", "error"), "error")


_TWO = "v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM v)"


@query(f"WITH {_TWO} SELECT vec_id, round((vb * (a - ma) * (a - ma) - 2 * ab * (a - ma) * (b - mb) + va * (b - mb) * (b - mb)) / (va * vb - ab * ab), 5) AS distance FROM v, m")
def mahalanobis(spark, sf_dir):
    return rounded(models.mahalanobis(_vectors(spark, sf_dir).select("vec_id", F.col("e0").alias("a"), F.col("e1").alias("b")), ["a", "b"]).select("vec_id", "distance"), "distance", digits=5)


@query()
def nmf_topics(spark, sf_dir):
    counts = text.token_rows(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("tf", "n")
    return rounded(text.top_terms(models.nmf_topics(counts, "doc_id", 4, terms=None, iters=8), "topic", 10), "weight", digits=4)


@query()
def bootstrap_ci(spark, sf_dir):
    return rounded(models.bootstrap_mean_ci(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey", rounds=200), "mean", "low", "high", digits=3)


@query()
def gwr(spark, sf_dir):
    p = places(spark, sf_dir).select("place_id", "lat", "lon", F.col("lat").alias("x"), (2 * F.col("lat") + F.col("population") / 100).alias("y"))
    return rounded(models.gwr(p, "place_id", 150), "intercept", "slope", digits=4)


@query()
def als_biased(spark, sf_dir):
    ratings = _buys(spark, sf_dir).select("user", "item", F.col("grade").cast("double").alias("rating"))
    return rounded(models.predict_biased(ratings, *models.als_biased(ratings, rank=2, iters=2)), "pred", digits=4)


@query("WITH p AS (SELECT doc_id, unnest(['low', 'middle', 'high']) AS label, unnest([0, 1, 2]) AS i, unnest([(n_chars % 100) / 200.0::DOUBLE, 0.5, 0.5 - (n_chars % 100) / 200.0::DOUBLE]) AS probability FROM documents) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, i)::INTEGER AS rank, label, round(probability, 6) AS probability FROM p")
def recommend_classes(spark, sf_dir):
    low = F.expr("n_chars % 100 / 200D")
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(low, F.lit(0.5), 0.5 - low).alias("p"))
    return rounded(models.recommend_classes(d, "doc_id", "p", ["low", "middle", "high"]), "probability")
