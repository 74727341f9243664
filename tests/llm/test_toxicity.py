import numpy as np

from tickerloom.llm import toxicity
from tickerloom.llm.queries import QUERIES


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    p = labels.sum()
    return (order[labels == 1].sum() - p * (p + 1) / 2) / (p * (len(labels) - p))


def test_held_out_documents_are_ranked_well(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(out.score.to_numpy(), out.toxic.to_numpy()) > 0.85
    hits = (out.predicted * out.toxic).sum()
    assert hits / out.predicted.sum() > 0.7 and hits / out.toxic.sum() > 0.7
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_score_is_the_same_however_texts_are_batched():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 50, n).astype(np.int32) for n in (0, 1, 2, 3, 40, 0, 7) * 30]
    labels = np.array([float(5 in t) for t in texts])
    model = toxicity.train(texts, labels, [None] * len(texts), np.arange(len(texts)) % 5 == 0, epochs=4)
    together = model.score(texts)[0]
    alone = np.concatenate([model.score([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    assert together[labels == 1].min() > together[labels == 0].max() - 0.5


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    network = toxicity.Network.start(np.zeros(toxicity.BUCKETS, np.float32), np.ones(toxicity.BUCKETS, bool), rng)
    texts, y = [np.array([3, 9, 4], np.int32), np.array([7, 3], np.int32)], np.array([1.0, 0.0])

    def loss(net):
        top, _, _ = net.hidden(texts)
        p = 1 / (1 + np.exp(-(np.maximum(top, 0) @ net.out + net.constant)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = {}
    network._adapt = lambda rows, move, g, rate: grads.update(g, rows=rows, move=move)
    kernel = network.kernel.astype(np.float64)
    network.step(texts, y, 0.0)
    network.kernel = kernel
    for at in [(0, 0), (3, 9), (2, 30)]:
        up, down = kernel.copy(), kernel.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        network.kernel = up
        a = loss(network)
        network.kernel = down
        assert abs((a - loss(network)) / 2e-4 - grads["kernel"][at]) < 1e-3


def test_odd_rows_and_missing_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (8, 1), (8, 0), (None, 1), (77, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(out) == 17 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    nothing = toxicity.fit(odd, labels.filter("false"))
    assert {r.score for r in toxicity.score(odd, nothing, ["doc_id"]).collect()} == {0.0}


def test_every_labelled_row_is_learned_from(spark):
    rows = [(i, "plain words here" + (f" rare{i // 100}" if i % 2 else ""), "en", i % 2) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    path, groups = toxicity.labelled(table.drop("toxic"), table.select("doc_id", "toxic"), group_rows=100)
    assert groups == 10 and spark.read.parquet(path).count() == 1000
    counts, words = toxicity._tallied(spark, path, groups, ["en"])
    held = spark.read.parquet(path).filter("held").count()
    plain, rare = (toxicity.tokens([x])[0] for x in ("plain", "rare0 rare1 rare2 rare3 rare4 rare5 rare6 rare7 rare8 rare9"))
    assert 100 < held < 300 and counts[:, plain[0] // toxicity.BUCKETS].sum() == 1000 - held
    assert words[rare // toxicity.BUCKETS, 0].min() >= 50 and words.sum() == 2 * 3500
    model = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"), group_rows=100)
    out = toxicity.score(table, model, ["toxic"]).toPandas()
    assert (out.predicted == out.toxic).mean() > 0.95


def test_mean_of_the_networks_of_groups_is_by_their_rows(spark):
    table = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} c", "en", i % 2) for i in range(300)], "doc_id bigint, text string, lang string, toxic int")
    path, groups = toxicity.labelled(table, table.select("doc_id", "toxic"), group_rows=100)
    counts, _ = toxicity._tallied(spark, path, groups, ["en"])
    begun = toxicity._begun(counts, 120, 240, 5)
    total, rows = 0.0, 0
    for g in range(groups):
        own, n = begun.unpacked(begun.packed()), 0
        for part in toxicity._rows_of(path, g, ["en"]):
            for texts, y in toxicity._batched(*part.fitted()):
                own.step(texts, y, 0.05)
                n += len(texts)
        total, rows = total + n * own.packed().astype(float), rows + n
    got = toxicity._epoch(spark, path, groups, ["en"], begun, 0.05)
    assert np.allclose(got.packed(), total / rows, atol=1e-6) and not np.allclose(got.packed(), begun.packed(), atol=1e-3)
