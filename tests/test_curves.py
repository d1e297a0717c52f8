import numpy as np
import pytest
from pyspark.sql import functions as F

from staylight.operators import curves as C
from staylight.operators.ordering import shuffle_key, stratified_folds, with_positions


def sample(n, seed, hot=0.0):
    """Random labels and scores; a share ``hot`` of the rows has one and the same score."""
    rng = np.random.default_rng(seed)
    score = np.round(rng.random(n), 3 if seed % 2 else 6)
    score[rng.random(n) < hot] = 0.5
    label = (rng.random(n) < 0.2 + 0.5 * score).astype(int)
    return label, score


def brute(label, score):
    """Cumulative counts by falling distinct score."""
    cuts = np.unique(score)[::-1]
    tp = np.array([(label[score >= c]).sum() for c in cuts])
    fp = np.array([(1 - label[score >= c]).sum() for c in cuts])
    return cuts, tp, fp


@pytest.fixture(scope="module", params=[(400, 1, 0.0), (700, 2, 0.4)])
def case(request, spark):
    label, score = sample(*request.param)
    df = spark.createDataFrame(list(zip(map(int, label), map(float, score))), "label int, score double")
    return label, score, df, C.cumulative_counts(df, "label", "score")


def test_cumulative_counts(case):
    label, score, _, curve = case
    cuts, tp, fp = brute(label, score)
    rows = curve.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(cuts) + 1))
    assert np.allclose([r.threshold for r in rows], cuts)
    assert [r.tp for r in rows] == tp.tolist() and [r.fp for r in rows] == fp.tolist()


def test_any_number_of_blocks_gives_the_same(spark, case):
    label, score, df, curve = case
    deep = C.cumulative_counts(df, "label", "score", blocks=37)
    key = ["position", "tp", "fp", "positives", "negatives", "scores_n"]
    assert sorted(deep.select(key).collect()) == sorted(curve.select(key).collect())


def test_metrics(case):
    label, score, df, curve = case
    pos, neg = score[label == 1], score[label == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    _, tp, fp = brute(label, score)
    recall = np.concatenate([[0], tp / tp[-1]])
    ap = float(np.sum(np.diff(recall) * tp / (tp + fp)))
    got = C.ranking_metrics(curve).first()
    assert got.roc_auc == pytest.approx(auc) and got.pr_auc == pytest.approx(ap)
    block = C.score_block(df, "label", "score", 0.5).first()
    flagged = score >= 0.5
    assert block.accuracy == pytest.approx((flagged == label).mean(), abs=5e-5)
    assert block.brier == pytest.approx(((score - label) ** 2).mean(), abs=5e-5)


def test_metrics_per_group(spark, case):
    label, score, df, _ = case
    both = df.withColumn("k", F.explode(F.array(F.lit("a"), F.lit("b"))))
    flipped = both.withColumn("score", F.when(F.col("k") == "b", 1 - F.col("score")).otherwise(F.col("score")))
    curve = C.cumulative_counts(flipped, "label", "score", ("k",))
    got = {r.k: r.roc_auc for r in C.ranking_metrics(curve, ("k",)).collect()}
    assert got["a"] + got["b"] == pytest.approx(1.0)


def test_best_threshold(case):
    label, score, _, curve = case
    cuts, tp, fp = brute(label, score)
    f1 = 2 * tp / (tp + fp + label.sum())
    best = cuts[len(f1) - 1 - int(np.argmax(f1[::-1]))]  # the lowest cut with the best F1
    got = C.best_threshold(curve).first()
    assert got.raw_threshold == pytest.approx(best)
    assert got.threshold == pytest.approx(round(float(np.clip(best, 0.15, 0.85)), 3))


def test_scores_that_differ_in_the_tenth_decimal(spark):
    rng = np.random.default_rng(4)
    score = 0.5 + 1e-10 * rng.permutation(2000)
    label = (rng.random(2000) < 0.3 + 0.2 * (score > 0.5 + 1e-7)).astype(int)
    df = spark.createDataFrame(list(zip(map(int, label), map(float, score))), "label int, score double")
    curve = C.cumulative_counts(df, "label", "score")
    cuts, tp, fp = brute(label, score)
    rows = curve.orderBy("position").collect()
    assert [r.threshold for r in rows] == cuts.tolist()
    assert [r.tp for r in rows] == tp.tolist() and [r.fp for r in rows] == fp.tolist()
    pos, neg = score[label == 1], score[label == 0]
    auc = (pos[:, None] > neg).sum() / (len(pos) * len(neg))
    assert C.ranking_metrics(curve).first().roc_auc == pytest.approx(auc)


def test_the_tuned_threshold_flags_what_it_was_tuned_on(spark):
    df = spark.createDataFrame([(1, 0.4999996), (0, 0.4999994), (1, 0.7), (0, 0.1)], "label int, score double")
    best = C.best_threshold(C.cumulative_counts(df, "label", "score")).first()
    m = C.confusion(df, "label", "score", best.raw_threshold).first()
    f1 = 2 * m.true_positive / (2 * m.true_positive + m.false_positive + m.false_negative)
    assert best.raw_threshold == 0.4999996 and best.best_f1 == f1 == 1.0


def test_threshold_without_scores(spark):
    none = spark.createDataFrame([], "label int, score double")
    assert C.best_threshold(C.cumulative_counts(none, "label", "score")).first().threshold == 0.5


def test_roc_points(case):
    label, score, _, curve = case
    _, tp, fp = brute(label, score)
    keep = np.ones(len(tp), bool)
    for i in range(1, len(tp) - 1):
        keep[i] = tp[i + 1] - 2 * tp[i] + tp[i - 1] != 0 or fp[i + 1] - 2 * fp[i] + fp[i - 1] != 0
    x = np.concatenate([[0], fp[keep] / fp[-1]])
    y = np.concatenate([[0], tp[keep] / tp[-1]])
    rows = C.roc_points(curve).orderBy("point").collect()
    assert [r.point for r in rows] == list(range(len(rows))) and rows[0].points_n == len(rows)
    assert np.allclose([r.x for r in rows], x) and np.allclose([r.y for r in rows], y)


def test_pr_points(case):
    label, score, _, curve = case
    _, tp, fp = brute(label, score)
    rows = C.pr_points(curve).orderBy("point").collect()
    assert np.allclose([r.x for r in rows], np.concatenate([(tp / tp[-1])[::-1], [0]]))
    assert np.allclose([r.y for r in rows], np.concatenate([(tp / (tp + fp))[::-1], [1]]))


@pytest.mark.parametrize("n", [1, 2, 59, 60, 61, 100, 119, 120, 1000, 4321])
def test_thinning(spark, n):
    points = spark.range(n).select(
        F.col("id").alias("point"), F.lit(n).alias("points_n"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y")
    )
    want = range(n) if n <= 60 else np.unique(np.linspace(0, n - 1, 60).astype(int)).tolist()
    assert sorted(r.point for r in C.thinned(points).collect()) == list(want)


def test_confusion_without_flags(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2)], "label int, score double")
    matrix = C.confusion(df, "label", "score", 0.9)
    assert tuple(matrix.first()) == (1, 0, 1, 0)
    assert tuple(C.decision_metrics(matrix).first()) == (0.5, 0.0, 0.0, 0.0)


def test_positions_equal_a_global_row_number(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("g"), shuffle_key(F.col("id"), F.lit("x")).alias("k")
    )
    got = {r.id: r.position for r in with_positions(df, ["g"], "k", "id").collect()}
    for g in (0, 1):
        ordered = sorted((r.k, r.id) for r in df.collect() if r.g == g)
        assert all(got[i] == n + 1 for n, (_, i) in enumerate(ordered))


def test_folds_are_even_and_differ_between_repeats(spark):
    df = spark.range(503).select("id", (F.col("id") < 100).cast("int").alias("label"))
    folds = stratified_folds(df, "id", "label", 5, 2, 1)
    sizes = folds.groupBy("repeat", "label", "fold").count().collect()
    assert len(sizes) == 20
    assert {r["count"] for r in sizes if r.label == 1} == {20}
    assert {r["count"] for r in sizes if r.label == 0} == {80, 81}
    wide = folds.groupBy("id").pivot("repeat", [0, 1]).agg(F.first("fold"))
    assert 300 < wide.filter("`0` <> `1`").count() < 480
