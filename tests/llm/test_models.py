"""Language ID, quality, toxicity and the pipeline: exact parts against brute force, learnt parts by held-out accuracy."""

import os
import subprocess
import sys
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.llm import language_id, quality, queries, toxicity
from tessera.llm._runtime import BATCH_ROWS, held_out, labelled_sample, smallest_by_hash, table
from tessera.llm._words import WordCache, char_ngrams

from .fixtures import DOCS, docs

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def crf(spark):
    d = table(spark, SMALL, "documents")
    return language_id.train_crf(language_id.training_rows(d, ~held_out("doc_id", 4, 2), per_language=60), sequences=800)


def test_held_out_matches_crc32(spark):
    got = {r["doc_id"]: r["h"] for r in spark.range(300).withColumnRenamed("id", "doc_id").withColumn("h", held_out("doc_id", 3, 1)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)}


def test_forward_backward_is_exact(crf):
    rng = np.random.default_rng(0)
    counts = np.array([1, 2, 31, 32, 33, 64, 200, 5])
    scores = rng.normal(0, 6, (int(counts.sum()), len(crf.languages)))
    got, at = language_id._scan(crf, scores, counts), 0
    for n, shares in zip(counts, got, strict=True):
        e = scores[at : at + n]
        at += n
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = crf.start + e[0]
        for i in range(1, n):
            a[i] = e[i] + np.logaddexp.reduce(a[i - 1][:, None] + crf.transitions, axis=0)
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(crf.transitions + e[i + 1] + b[i + 1], axis=1)
        post = np.exp(a + b - np.logaddexp.reduce(a + b, axis=1)[:, None])
        assert np.allclose(post.sum(axis=0), shares, atol=1e-9)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    e, t, s = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    marks, mask = rng.integers(0, 3, (2, 5)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool)

    def loss(e, t, s):
        total = 0.0
        for b in range(2):
            n = int(mask[b].sum())
            a = s + e[b, 0]
            own = s[marks[b, 0]] + e[b, 0, marks[b, 0]]
            for i in range(1, n):
                a = e[b, i] + np.logaddexp.reduce(a[:, None] + t, axis=0)
                own += t[marks[b, i - 1], marks[b, i]] + e[b, i, marks[b, i]]
            total += np.logaddexp.reduce(a) - own
        return total

    grads = language_id._gradients(e, marks, mask, t, s)
    for k, value in enumerate((e, t, s)):
        for place in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(8)]:
            if k == 0 and not mask[place[0], place[1]]:
                assert grads[0][place] == 0
                continue
            up, down = [x.copy() for x in (e, t, s)], [x.copy() for x in (e, t, s)]
            up[k][place] += 1e-6
            down[k][place] -= 1e-6
            assert grads[k][place] == pytest.approx((loss(*up) - loss(*down)) / 2e-6, abs=1e-5)


def test_language_id_held_out(spark, crf):
    d = table(spark, SMALL, "documents").where(held_out("doc_id", 4, 2))
    got = language_id.identify(d, crf).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges(spark, crf):
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, [*DOCS, (50, "123 ... !!")]), crf).collect()}
    for i in (5, 6, 7, 50):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[8]["lang_pred"] in crf.languages
    assert language_id.identify(docs(spark, []), crf).collect() == []
    alone = language_id.train_crf([("some words", "xx")])
    assert language_id.predict_texts(alone, ["words here", ""])[0] == ["xx", "und"]
    assert language_id.train_crf([]).languages == []


def test_words_of_code_switched_texts_are_labelled(spark, crf):
    d = table(spark, SMALL, "documents").where(held_out("doc_id", 4, 2) & (F.length("text") > 600)).select("lang", "text").collect()
    texts = {lang: [language_id.words_of(r["text"]) for r in d if r["lang"] == lang] for lang in ("en", "de", "fr")}
    mixed, truth = [], {}
    for i in range(12):
        runs = [("en", "de", "fr")[(i + k) % 3] for k in range(3)]
        words = [(w, lang) for k, lang in enumerate(runs) for w in texts[lang][i % len(texts[lang])][k * 15 : k * 15 + 15]]
        mixed.append((i, " ".join(w for w, _ in words)))
        truth |= {(i, p): (w, lang) for p, (w, lang) in enumerate(words)}
    got = {(r["doc_id"], r["position"]): r for r in language_id.label_words(docs(spark, [*mixed, (90, None), (91, "12 !")]), crf).collect()}
    assert got.keys() == truth.keys() and all(got[k]["word"] == w for k, (w, _) in truth.items())
    assert np.mean([got[k]["lang"] == lang for k, (_, lang) in truth.items()]) > 0.9
    assert language_id.label_words(docs(spark, []), crf).collect() == []


def test_word_shares_sum_to_text_shares(crf):
    counts = np.array([1, 31, 32, 33, 70])
    scores = np.random.default_rng(3).normal(0, 3, (int(counts.sum()), len(crf.languages)))
    by_word = language_id._scan(crf, scores, counts, by_word=True)
    assert np.allclose(np.add.reduceat(by_word, np.cumsum(counts) - counts, axis=0), language_id._scan(crf, scores, counts))


def test_code_switched_text_is_shared(crf):
    rows = language_id._scan(crf, np.vstack([np.eye(4)[0] * 9] * 10 + [np.eye(4)[1] * 9] * 10), np.array([20]))[0] / 20
    assert rows[0] == pytest.approx(0.5, abs=0.05) and rows[1] == pytest.approx(0.5, abs=0.05)


def test_quality_scores_equal_plain_dot_products():
    rows = [("good words are here " * 5, 1), ("BAD!! BAD!! BAD!!", 0), ("calm prose again", 1), ("x | y | z | w", 0)] * 5
    model = quality.train_ftrl(rows)
    for text in ("good words", "BAD!! x", "", "a a a b"):
        tokens = quality._TOKEN.findall(text)
        logit = model.bias
        if tokens:
            h = quality.token_hashes(tokens)
            for ids, _ in quality.feature_ids(h[:, 0], h[:, 1], np.zeros(len(tokens), np.int64)):
                logit += sum(float(model.weights[i]) for i in ids) / len(tokens)
        want = 1 / (1 + np.exp(-logit))
        cache = WordCache(quality.token_hashes)
        assert model.score([text], cache)[0] == pytest.approx(want)
        assert model.score(["other text first", text, ""], cache)[1] == pytest.approx(want)


@pytest.mark.parametrize("name,modulus,remainder,label", [("op2_quality", 3, 1, "quality"), ("op10_toxicity", 5, 0, "toxic")])
def test_classifiers_held_out(spark, name, modulus, remainder, label):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    truth, said = np.array([r[label] for r in got]), np.array([r["predicted"] for r in got])
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert (truth == said).mean() > 0.95
    assert (said[truth == 1] == 1 if label == "toxic" else said[truth == 0] == 0).mean() >= 0.9
    assert (said[truth == 0] == 1 if label == "toxic" else said[truth == 1] == 0).mean() < 0.02


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, module):
    labels = spark.createDataFrame([(1, 1, 1), (12, 0, 0), (99, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(docs(spark), labels, F.lit(True))
    got = module.score(docs(spark), model).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (5, 6, 7)}) == 1
    assert module.keep(docs(spark), model).columns == docs(spark).columns
    assert module.score(docs(spark, []), model).collect() == []
    none = module.fit(docs(spark), labels.where("doc_id > 1000"), F.lit(True))
    assert {r["score"] for r in module.score(docs(spark), none).collect()} == {0.5}
    one = module.fit(docs(spark), labels.where("doc_id = 1"), F.lit(True))
    assert {r["predicted"] for r in module.score(docs(spark), one).collect()} == {1}


def test_sample_uses_eligible_rows_only(spark):
    labels = spark.range(1, 13).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = labelled_sample(docs(spark), labels, "quality", F.col("doc_id") > 3, 10, 4_000)
    assert sorted(r[2] for r in rows) == [4, 7, 8, 9, 10, 11, 12]
    assert {r[2]: len(r[0]) for r in rows}[8] == 4_000 and next(r[0] for r in rows if r[2] == 8) in dict(DOCS)[8]


def test_sample_is_the_smallest_hashes(spark):
    ids = spark.range(20_000).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 50, "b").otherwise("c").alias("_key"))
    ids = ids.unionByName(ids.where("_id < 4000"))
    got = {}
    for r in smallest_by_hash(ids, 30, 2).collect():
        got.setdefault(r["_key"], set()).add(r["_id"])
    hashes = {r["_id"]: r["h"] & (1 << 63) - 1 for r in ids.select("_id", F.xxhash64("_id").alias("h")).distinct().collect()}
    assert got == {k: set(sorted((i for i in range(20_000) if (i % 3 == 0) == (k == "a") and (k == "a" or i >= 50)), key=hashes.get)[:30]) for k in "ac"}


def test_toxicity_scores_equal_averaged_bags():
    """Brute force: hash each word's n-grams, average embeddings by word and words by text, softmax."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(80)]
    rows = [(" ".join([*rng.choice(words, 25), *["pathetic"] * (i % 2)]), i % 2) for i in range(120)]
    model = toxicity.train_subwords(rows)
    assert len(model.buckets) and np.allclose(model.softmax.sum(axis=1), 0)
    row = {int(b): e for b, e in zip(model.buckets, model.embeddings, strict=True)}
    for text in (rows[1][0], "Pathetic PATHETIC pathétic", "", "!! ??", "x" * 200, " ".join(words) * 40 + " pathetic"):
        vectors = []
        for word in toxicity._WORD.findall(text.lower()):
            ids, _ = char_ngrams([word], toxicity.LOW, toxicity.HIGH, toxicity.BITS)
            vectors.append(np.mean([row.get(int(i), np.zeros(toxicity.DIM)) for i in ids], axis=0))
        logits = (np.mean(vectors, axis=0) if vectors else np.zeros(toxicity.DIM)) @ model.softmax + model.bias
        want = np.exp(logits[1]) / np.exp(logits).sum()
        for batch, k in (([text], 0), (["first words", text, ""], 1)):
            assert model.score(batch, WordCache(model.word_margins))[k] == pytest.approx(want)


def test_misspelt_insult_is_caught():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    text = lambda extra: " ".join([*rng.choice(words, 30), *extra, *rng.choice(words, 30)])
    bad = ["worthless", "pathetic", "disgusting"]
    rows = [(text([]), 0) for _ in range(150)] + [(text(list(rng.choice(bad, 2))), 1) for _ in range(150)]
    model = toxicity.train_subwords(rows)
    cache = WordCache(model.word_margins)
    assert (model.score([text(["worthles", "disgustingg"]) for _ in range(20)], cache) > 0.5).mean() > 0.9
    assert (model.score([text([]) for _ in range(50)], cache) < 0.5).mean() > 0.95


def test_density_counts_in_a_text_of_any_length():
    """A repeated insult is never divided away, and every word of a long text reaches the score."""
    model = toxicity.SubwordModel(np.zeros(0, np.int64), np.zeros((0, toxicity.DIM)), np.zeros((toxicity.DIM, 2)), np.array([0.5, -0.5]))
    model.word_margins = lambda words: np.array([30.0 if w == "idiot" else -0.1 for w in words])
    cache = WordCache(model.word_margins)
    calm = [f"w{i}" for i in range(50)]
    alone, throughout, once, often = model.score(["idiot", "idiot " * 400, " ".join([*calm, "idiot"]), " ".join([*calm, *["idiot"] * 9])], cache)
    assert throughout == pytest.approx(alone) and once < often <= alone
    short, long = model.score([" ".join([*calm, "idiot"] * n) for n in (1, 3_000)], cache)
    assert short == pytest.approx(long)


def test_filters_keep_all_without_both_classes(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    for module, model in ((quality, quality.train_ftrl([("bad", 0)])), (toxicity, toxicity.train_subwords([("x", 1)])), (toxicity, toxicity.fit(docs(spark), labels, F.lit(False)))):
        assert module.keep(docs(spark), model).count() == len(DOCS)


def test_pipeline_stages_follow_their_operators(spark):
    base = table(spark, SMALL, "documents")
    d = base.union(base.where("doc_id < 30").select((F.col("doc_id") + 100_000).alias("doc_id"), F.replace("text", F.lit(" "), F.lit("\n")), "lang", "source", "n_chars"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "exact_dedup", "simhash", "packing"]
    kept = {"start": {r[0] for r in d.select("doc_id").collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SMALL).cache()
        assert d.columns == base.columns
        ids = [r[0] for r in d.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        kept[name] = set(ids)
    assert kept["exact_dedup"] < kept["quality"] < kept["toxicity"] < kept["start"]
    assert not kept["exact_dedup"] & set(range(100_000, 100_030)) & {i + 100_000 for i in kept["exact_dedup"]}
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SMALL)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == kept["simhash"]


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [DOCS, []])
def test_stages_stand_odd_documents(spark, rows):
    """Nulls in every column, repeated rows, long texts, and no rows at all."""
    d = spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert out.schema.simpleString() == d.schema.simpleString()
        d = out
    packed = corpus_pipeline.STAGES[-1][1](spark, d, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in d.collect()}


_SWITCH = """
from tessera.llm import packing
from tessera.llm._words import WordCache, cache_for

def held():
    return int(next(line for line in open("/proc/self/status") if line.startswith("RssAnon")).split()[1])

def coder():
    return cache_for("ids", lambda: packing.TokenIds(packing.tokenizer_path()))

coder().encode(["one two"])
before = held()
for k in range(3):
    coder().encode([" ".join(f"w{(i * 7919 + k) % 1000003:x}x{i % 97}" for i in range(60_000))])
full = held()
cache_for("other", lambda: WordCache(len))
print(before, full, held())
"""


def test_workers_give_memory_back_between_stages():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    said = subprocess.run([sys.executable, "-c", _SWITCH], capture_output=True, text=True, check=True, cwd=root, env=os.environ | {"PYTHONPATH": root}).stdout
    before, full, after = map(int, said.split())
    assert full > before + 40_000
    assert after < before + (full - before) / 2


def test_pipeline_sends_texts_in_small_batches(spark):
    d = spark.createDataFrame([(i, "some text", "en", "s", 9) for i in range(5_000)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def sent():
        return [r["n"] for r in d.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]

    try:
        for rows, most, (_, stage) in zip((before, "0", "70"), (BATCH_ROWS, BATCH_ROWS, 70), corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[3:4], strict=True):
            spark.conf.set(setting, rows)
            stage(spark, d.limit(0), "/root/testdata/sf0.001")
            assert max(sent()) == most and sum(sent()) == 5_000
        spark.conf.set(setting, "0")
        corpus_pipeline.run(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(setting) == "0"
    finally:
        spark.conf.set(setting, before)
