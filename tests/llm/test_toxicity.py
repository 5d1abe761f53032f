import numpy as np
from pyspark.sql import functions as F

from lagweave.llm import toxicity


def test_held_out_accuracy(spark, documents):
    """Labels of one part of sf0.1 train the chain; those of the other part measure it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = toxicity.label_columns(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    hit = said = is_ = 0
    for part in (0, 1):  # each half measures the chain that the other has trained
        chain = toxicity.train(docs, labels.where(f"doc_id % 2 = {part}"))
        got = toxicity.score(docs, chain).join(labels.where(f"doc_id % 2 = {1 - part}").withColumnRenamed("toxic", "y"), "doc_id").toPandas()
        hit, said, is_ = hit + int((got.toxic & (got.y == 1)).sum()), said + int(got.toxic.sum()), is_ + int((got.y == 1).sum())
    assert hit / said > 0.95 and hit / is_ >= 0.9
    rude = docs.where("text rlike '(?i)\\\\b(idiot|moron|scum|loser|clown|trash|stupid|pathetic|worthless|disgusting)\\\\b'")
    found = toxicity.score(rude, chain)
    assert found.where("toxic").count() > 0.97 * found.count()


def test_repeated_documents_train_once(spark, documents, sf_dir):
    labels = toxicity.label_columns(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    one = toxicity.train(documents, labels, max_train=60)
    more = documents.union(documents).union(documents.where("doc_id % 2 = 0").withColumn("text", F.lit("zz")))
    texts = {r.doc_id: r.h for r in more.groupBy("doc_id").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).alias("h")).collect()}
    same = documents.where(F.col("doc_id").isin([d for d, t in texts.items() if t != "zz"]))
    for docs in (documents.union(documents).repartition(7), documents.union(documents).orderBy(F.desc("doc_id"))):
        got = toxicity.train(docs, labels.union(labels), max_train=60)
        assert (got.words == one.words).all() and all(np.allclose(a, b) for a, b in zip(got.weights, one.weights)) and got.threshold == one.threshold
    assert same.count()


def test_chain_by_plain_loops(spark):
    """Out-of-fold probabilities and the final models against gradient steps written out one by one."""
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (240, 6)).astype(float)
    low = (r.random(240) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 0.3)))).astype(float)
    toxic = (r.random(240) < 1 / (1 + np.exp(-(1.5 * low + 2 * x[:, 2] - 2)))).astype(float)
    words = np.arange(1, 7).astype(np.uint64)
    sets = [words[row > 0] for row in x]
    fold = np.arange(240) % toxicity.FOLDS
    chain = toxicity.fit_chain(sets, np.column_stack([low, toxic]), fold, features=12)

    def descend(a, y):
        w, a1 = np.zeros(a.shape[1] + 1), np.column_stack([a, np.ones(len(a))])
        for _ in range(60_000):
            p = 1 / (1 + np.exp(-a1 @ w))
            w += 0.01 * (a1.T @ (y - p) - toxicity.PENALTY * np.append(w[:-1], 0))
        return w

    on = lambda a, w: 1 / (1 + np.exp(-(a @ w[:-1] + w[-1])))
    known = np.searchsorted(words, chain.words)
    a, weights, p = x[:, known], [], None
    for y in (low, toxic):
        p = np.empty(240)
        for f in range(toxicity.FOLDS):
            p[fold == f] = on(a[fold == f], descend(a[fold != f], y[fold != f]))
        weights.append(descend(a, y))
        a = np.column_stack([a, p])
    assert len(chain.words) >= 3 and all(np.allclose(u, v, atol=1e-4) for u, v in zip(chain.weights, weights))
    cuts = [(1.25 * ((p >= t) & (toxic > 0)).sum() / ((p >= t).sum() + 0.25 * toxic.sum()), t) for t in p]
    assert np.isclose((p >= chain.threshold).sum(), (p >= max(cuts)[1]).sum(), atol=1)
    first = on(x[:, known], weights[0])
    assert np.allclose(chain.predict(x[:, known])[:, 1], on(np.column_stack([x[:, known], first]), weights[1]), atol=1e-4)


def test_stage_agrees_with_scores(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(documents, toxicity.label_columns(labels))
    clean = {r.doc_id for r in toxicity.score(documents, chain).collect() if not r.toxic}
    kept = toxicity.drop_toxic(documents, labels)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == clean


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 1), (4, 1, 1), (4, 1, 1), (6, 0, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(odd, toxicity.label_columns(labels))
    assert toxicity.score(odd, chain).count() == 12 and toxicity.score(none, chain).count() == 0
    empty = toxicity.train(none, toxicity.label_columns(labels))
    assert len(empty.words) == 0 and toxicity.score(odd, empty).where("toxic").count() == 0


def test_logistic_matches_gradient_zero():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (300, 5)).astype(float)
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 0, 1] - 0.5)))).astype(float)
    w = toxicity.fit_logistic(x, y, 0.5)
    p = toxicity.probability(x, w)
    assert np.allclose(x.T @ (y - p), 0.5 * w[:-1], atol=1e-6) and abs((y - p).sum()) < 1e-4
