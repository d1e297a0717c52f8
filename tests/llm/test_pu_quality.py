import zlib

import numpy as np

from staylight.llm import pu_quality as pu
from staylight.llm.queries import op4_pu_quality

SMALL = pu.Settings(steps=200)


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in op4_pu_quality(spark, folder).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = [(got[i]["predicted"], q) for i, q in truth.items() if got[i]["held_out"]]
    assert np.mean([p == q for p, q in seen]) >= 0.95
    assert np.mean([p for p, q in seen if q == 1]) >= 0.97


def mixture(n, share, seed=0):
    rng = np.random.default_rng(seed)
    width = len(pu.NAMES)
    good = rng.normal(0.0, 1, (n, width))
    good[:, :3] += 2.0
    bad = rng.normal(0.0, 1, (n, width))
    bad[:, :3] -= 2.0
    is_good = rng.random(n) < share
    return np.where(is_good[:, None], good, bad), is_good


def test_prior_and_risk_recover_a_known_mixture():
    positives, _ = mixture(3000, 1.0, 1)
    for share in (0.3, 0.7, 0.9):
        unlabelled, truth = mixture(3000, share, 2)
        net = pu.fit(positives, unlabelled, SMALL)
        assert abs(net.prior - share) < 0.08
        assert ((net.score(unlabelled) >= 0.5) == truth).mean() > 0.97


def test_gradient_is_the_slope_of_the_output():
    x, _ = mixture(20, 0.5)
    net = pu._new(x, x, SMALL)
    slope = np.linspace(-1, 1, 20)
    grads = net.gradient(x, slope)
    for k, weight in enumerate(net.weights):
        flat = weight.reshape(-1)
        for j in range(0, flat.size, max(1, flat.size // 4)):
            held, step = flat[j], 1e-6
            flat[j] = held + step
            up = slope @ net.raw(x)
            flat[j] = held - step
            down = slope @ net.raw(x)
            flat[j] = held
            assert abs((up - down) / (2 * step) - grads[k].reshape(-1)[j]) < 1e-4


def test_held_out_labels_change_nothing(spark, make):
    docs = make([f"good words number {i} in a row.\n" * 5 if i % 4 else f"BAD!! {i} ###" for i in range(120)])
    rows = [(i, int(i % 4 > 0)) for i in range(0, 120)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert 10 < len(held) < 60
    table = lambda data: spark.createDataFrame(data, "doc_id long, quality int")
    flipped = [(i, 1 - q if i in held else q) for i, q in rows]
    a, b = (pu.learn(docs, table(data), SMALL) for data in (rows, flipped))
    assert all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights))
    # A label given twice with different values is not trusted.
    c = pu.learn(docs, table(rows + [(i, 0) for i in range(60)]), SMALL)
    assert not np.array_equal(a.weights[0], c.weights[0])


def test_odd_texts_clashes_nulls_and_empty_tables(spark, make, odd_texts):
    docs = make([*enumerate(odd_texts), (None, "x"), (3, "word")]).selectExpr("*", "1 as score", "0 as quality", "2 as p")
    labels = spark.createDataFrame([(5, 1), (6, None), (None, 1), (999, 1)], "doc_id long, quality int")
    net = pu.learn(docs, labels, SMALL)
    rows = pu.scored(docs, net).collect()
    assert len(rows) == len(odd_texts) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    kept = pu.good_documents(docs, net)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    nothing = pu.learn(docs.limit(0), labels.limit(0), SMALL)
    assert pu.scored(docs.limit(0), nothing).count() == 0
    assert {r["score"] for r in pu.scored(docs, nothing).collect()} == {0.5}
