"""Every operator as a query over the star schema, named after its survey id."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracles import (
    FOLD_REPEATS,
    FOLDS,
    IMPORTANCE_REPEATS,
    SEED,
    STAMP,
    THRESHOLD,
)
from staylight.bindings import ACCOUNTS, DOCUMENTS
from staylight.functions import derived as D
from staylight.functions.text import indian_amount, short_amount
from staylight.operators import breakdowns as B
from staylight.operators import clean as K
from staylight.operators import curves as C
from staylight.operators import explain as E
from staylight.operators import models as M
from staylight.operators import newton as N
from staylight.operators import scoring as S
from staylight.operators.features import engineer, model_frame
from staylight.operators.headlines import headlines
from staylight.operators.importance import feature_importance, top_features
from staylight.operators.ordering import stratified_folds
from staylight.operators.quality import quality_checks
from staylight.operators.typical import typical_entity, typical_table
from staylight.plans import training as TR
from staylight.plans.analysis import write_analysis
from staylight.plans.batch import Batch, score_batch
from staylight.scorecards import ACCOUNT_SCORECARD
from staylight.sources import files, log, store
from staylight.sources.accounts import account_panel, document_panel
from staylight.streaming import scoring as ST
from staylight.workspace import new_path, shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
SPEC = ACCOUNTS
ID = SPEC.entity_id
RUN_AT = dt.datetime.fromisoformat(STAMP)


# --- shared inputs ------------------------------------------------------------------
def panel(spark: SparkSession, sf: str) -> DataFrame:
    return account_panel(spark, sf)


def dirty_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a careless export would hold it: padded text, numbers as text that
    may not parse, unknown categories, missing cells. Which flaw a row gets depends on
    its own segment, tier and so on."""
    c = F.col
    return panel(spark, sf).withColumns(
        {
            ID: F.concat(F.lit("  ACC-"), c(ID).cast("string"), F.lit("\t")),
            "nation": F.concat(F.lit(" "), c("nation"), F.lit(" ")),
            "monthly_spend": F.when(c("segment") == "AUTOMOBILE", "abc")
            .when(c("segment") == "BUILDING", F.lit(None))
            .when(c("segment") == "FURNITURE", " 1.5e3 ")
            .when(c("segment") == "HOUSEHOLD", "12d")
            .otherwise(F.concat(F.lit(" "), F.floor("monthly_spend").cast("string"))),
            "orders_n": F.when(c("returns") == "Frequent", F.concat(c("orders_n").cast("string"), F.lit(".5")))
            .otherwise(c("orders_n").cast("string")),
            "orders_last_year": F.when(
                c("tier") == "Entry", F.concat(F.lit("-"), c("orders_last_year").cast("string"))
            )
            .when(c("tier") == "Junior", "Infinity")
            .otherwise(F.concat(F.lit("+"), c("orders_last_year").cast("string"))),
            "suppliers_n": c("suppliers_n").cast("string"),
            "tier": F.concat(F.lit("\n"), c("tier")),
            "discount": F.when(c("discount") == "Premium", "Platinum").otherwise(c("discount")),
            "fulfilment": F.when(c("fulfilment") != "Low", c("fulfilment")),
            "churned": F.upper("churned"),
        }
    )


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return engineer(panel(spark, sf), SPEC)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return S.score(panel(spark, sf), SPEC, ACCOUNT_SCORECARD)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_target(scored(spark, sf), SPEC).select(ID, "label", "probability")


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return C.cumulative_counts(_level(labelled(spark, sf)), "label", "probability")


def _level(df: DataFrame) -> DataFrame:
    """Scores as the SQL side has them: the two engines' ``exp`` may differ in its last bit, which
    would tell equal scores apart, so the comparison (not the library) rounds its input."""
    return df.withColumn("probability", F.round(F.col("probability") * 1_000_000, 0).cast("bigint") / 1_000_000)


class _Level:
    """A scorer whose scores are levelled."""

    def __init__(self, scorer):
        self.scorer, self.label = scorer, scorer.label

    def score(self, frame: DataFrame) -> DataFrame:
        return _level(self.scorer.score(frame))


def _p6(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.bround("probability", 6).alias("probability"))


# --- cleaning and contracts -----------------------------------------------------------
def s2_load_clean(spark, sf):
    path = new_path(spark, "panel")
    panel(spark, sf).write.parquet(path)
    return files.load_clean(spark, path, SPEC, fmt="parquet")


def p2_coerce_numerics(spark, sf):
    df = K.coerce_numerics(dirty_panel(spark, sf), SPEC)
    return df.select(ID, *SPEC.numerics)


def p3_target_flag(spark, sf):
    return K.with_target(dirty_panel(spark, sf), SPEC).select(ID, "churned", "label")


def p5_model_frame(spark, sf):
    return model_frame(panel(spark, sf), SPEC, ID)


def p6_violations(spark, sf):
    return K.violation_rows(K.trim_strings(dirty_panel(spark, sf)), SPEC)


def p6_valid_rows(spark, sf):
    valid, _ = K.split_valid(K.trim_strings(dirty_panel(spark, sf)), SPEC)
    return valid.select(ID)


def p7_defaults(spark, sf):
    sparse = panel(spark, sf).drop("discount", "tenure_years")
    return K.apply_defaults(sparse, SPEC)


def p11_keep_first(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return K.keep_first(orders, "o_custkey", F.struct("o_orderdate", "o_orderkey"))


# --- small lookups ----------------------------------------------------------------------
def j1_level_rank(spark, sf):
    rank = D.level_rank(F.col("tier"), SPEC.level_ranks)
    return panel(spark, sf).select(ID, "tier", rank.alias("level_rank"))


def j2_category_order(spark, sf):
    return B.breakdowns(enriched(spark, sf), SPEC).select("attribute", "category", "position")


def _what_ifs(spark, sf, kind, typical=None):
    return E.variants(panel(spark, sf), SPEC, typical, (kind,))


def j3_upgrades(spark, sf):
    return _what_ifs(spark, sf, "action").select(
        ID, "field", F.col("value").alias("from"), F.col("display").alias("to"), "step"
    )


def j5_band_table(spark, sf):
    bands = spark.createDataFrame(
        list(D.RISK_BANDS), "low double, high double, band string, advice string"
    )
    return S.banded(scored(spark, sf), bands).select(ID, "risk_band", "advice")


def _kept(spark, sf):
    """The enriched panel as a written table, for operators that read it several times."""
    return written(enriched(spark, sf), "enriched")


def _typical(spark, sf):
    return typical_entity(_kept(spark, sf), SPEC)


def j6_typical_pairs(spark, sf):
    return _what_ifs(spark, sf, "driver", _typical(spark, sf)).select(
        ID, "field", "value", F.col("display").alias("compared_to")
    )


# --- derived columns ------------------------------------------------------------------
def f5_decision(spark, sf):
    decided = S.with_decision(scored(spark, sf), SPEC, THRESHOLD)
    return _p6(decided, ID, "percent", "will_leave", "risk_band", "advice")


def f6_cost_at_risk(spark, sf):
    return S.with_decision(scored(spark, sf), SPEC, THRESHOLD).select(ID, "cost_at_risk")


def f7_pay_rises(spark, sf):
    return _what_ifs(spark, sf, "pay").select(ID, "display", F.col(SPEC.income).alias("raised"))


def _amounts(formatter):
    def query(spark, sf):
        cents = F.round(F.col("o_totalprice") * 100, 0)
        orders = spark.read.parquet(f"{sf}/orders.parquet")
        return orders.select("o_orderkey", formatter(cents).alias("amount"))

    return query


def _log(spark, sf, source="batch"):
    return log.log_rows(scored(spark, sf), SPEC, THRESHOLD, source, RUN_AT, F.col(ID))


def _log_columns(rows: DataFrame) -> DataFrame:
    """The log with its payload read back out of the JSON text."""
    return rows.withColumns(
        {
            "payload_tier": F.get_json_object("payload", "$.tier"),
            "payload_id": F.get_json_object("payload", f"$.{ID}"),
            "payload_spend": F.get_json_object("payload", "$.monthly_spend").cast("double"),
        }
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).drop("payload", "run")


# --- reports -----------------------------------------------------------------------------
def a2_tier_breakdown(spark, sf):
    return B.breakdowns(enriched(spark, sf), SPEC, ["tier"])


def a5_risk_segments(spark, sf):
    df = enriched(spark, sf)
    return B.risk_segments(B.breakdowns(df, SPEC), B.overall_rate(df, SPEC), SPEC)


def a5_document_segments(spark, sf):
    df = document_panel(spark, sf)
    return B.risk_segments(B.breakdowns(df, DOCUMENTS), B.overall_rate(df, DOCUMENTS), DOCUMENTS)


def t2_ranked_batch(spark, sf):
    return S.ranked_batch(scored(spark, sf), SPEC, THRESHOLD, F.lit(0)).drop("row")


def t3_recent_log(spark, sf):
    newest = log.recent(_log(spark, sf).withColumn("run", F.lit("one")), 25)
    return newest.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


# --- evaluation -----------------------------------------------------------------------
def _points(make):
    def query(spark, sf):
        return make(curve(spark, sf)).select(
            "point", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y")
        )

    return query


def _thinned(make, name):
    def query(spark, sf):
        return C.thinned(make(curve(spark, sf))).select(F.lit(name).alias("curve"), "*")

    return query


def w5_best_threshold(spark, sf):
    return C.best_threshold(curve(spark, sf)).withColumn("best_f1", F.bround("best_f1", 6))


def w6_stratified_folds(spark, sf, repeats=FOLD_REPEATS):
    flagged = K.with_target(panel(spark, sf), SPEC).select(ID, "label")
    return stratified_folds(flagged, ID, "label", FOLDS, repeats, SEED)


# --- models ------------------------------------------------------------------------------
def m1_one_hot_slots(spark, sf):
    frame = model_frame(panel(spark, sf), SPEC, ID)
    hot = M.fit_encoder(frame, SPEC).transform(frame)
    slots = [
        F.struct(
            F.lit(c).alias("field"),
            (F.array_position(vector_to_array(F.col(f"{c}__hot")), F.lit(1.0)) - 1)
            .cast("int")
            .alias("slot"),
        )
        for c in SPEC.model_categoricals
    ]
    return hot.select(ID, F.inline(F.array(*slots)))


def m2_scaling_stats(spark, sf):
    frame = written(model_frame(panel(spark, sf), SPEC, ID), "scaling-rows")
    encoded = M.fit_encoder(frame, SPEC).transform(frame)
    scaler, correction = M.fit_scaler(encoded, encoded.count())
    figures = spark.createDataFrame(
        M.scaling_figures(scaler, correction, SPEC), "field string, mean double, sd double"
    )
    return figures.select("field", F.bround("mean", 6).alias("mean"), F.bround("sd", 6).alias("sd"))


def m7_permutation_importance(spark, sf, repeats=IMPORTANCE_REPEATS):
    frame = written(TR.training_rows(panel(spark, sf), SPEC), "importance-rows")
    return feature_importance(
        frame, SPEC, TR.LABEL, _Level(ACCOUNT_SCORECARD), repeats, SEED
    )


def t7_top_features(spark, sf, repeats=IMPORTANCE_REPEATS):
    return top_features(m7_permutation_importance(spark, sf, repeats))


def m9_drivers(spark, sf):
    return E.drivers(panel(spark, sf), SPEC, ACCOUNT_SCORECARD, _typical(spark, sf))


def m10_actions(spark, sf):
    return E.actions(panel(spark, sf), SPEC, ACCOUNT_SCORECARD)


def m11_explained(spark, sf):
    full = E.explained(
        panel(spark, sf), SPEC, ACCOUNT_SCORECARD, _typical(spark, sf), THRESHOLD
    )
    zero = F.lit(0.0)

    def total(items, name):
        return F.bround(F.aggregate(items, zero, lambda a, x: a + x[name]), 4)

    steps = F.transform("actions", lambda a: F.concat(a["field"], F.lit(">"), a["display"]))
    return full.select(
        ID, "probability", "percent", "will_leave", "risk_band", "engineered.*", "cost_at_risk",
        F.array_join(F.col("drivers.field"), ",").alias("driver_fields"),
        total("drivers", "impact").alias("driver_total"),
        F.array_join(steps, ",").alias("action_fields"),
        total("actions", "reduction").alias("action_total"),
    )


#: The whole job: 5 folds x 10 repeats, 300 trees, 120 boosting rounds, 30 importance repeats.
FULL = TR.TrainSettings()
#: Cut model sizes for the checks against SQL; :func:`full_queries` has the same queries uncut.
SMALL = TR.TrainSettings(
    folds=3, repeats=2, trees=20, boosting_rounds=10, importance_repeats=2, parallel_fits=4
)


@functools.cache
def trained(spark: SparkSession, sf: str, settings: TR.TrainSettings = SMALL) -> TR.Trained:
    # One folder per input: the queries of a session, and a later one with the same shared folder, go on
    # with the steps that are there.
    folder = f"{shared_folder(spark)}/training-{files.fingerprint(spark, sf)}"
    return TR.train(panel(spark, sf), SPEC, settings, folder=folder)


def _fitted(position, settings=SMALL):
    """Fit one candidate on every row and score every row with it."""

    def query(spark, sf):
        # Written first: fitting reads the rows several times.
        frame = written(TR.training_rows(panel(spark, sf), SPEC), "training-rows")
        encoder = M.fit_encoder(frame, SPEC)
        candidate = M.candidates(settings.trees, settings.boosting_rounds)[position]
        stages = M.fit_stages(encoder.transform(frame), SPEC, TR.LABEL, candidate, SEED)
        scorer = S.FittedScorer(candidate.label, M.as_pipeline(encoder, stages))
        return scorer.score(frame).select(ID, TR.LABEL, "probability")

    return query


def s6_metric_tables(spark, sf, settings=SMALL):
    folder = new_path(spark, "metrics")
    store.write_tables(store.metric_tables(trained(spark, sf, settings)), folder)
    return store.read_tables(spark, folder, "card")["card"]


def s7_reloaded_model(spark, sf, settings=SMALL):
    folder = new_path(spark, "model")
    store.save_model(trained(spark, sf, settings), folder)
    kept = store.load_model(spark, folder, SPEC)
    return S.score(panel(spark, sf), SPEC, kept.scorer).select(ID, "probability")


def m11_fitted_explained(spark, sf, settings=SMALL):
    t = trained(spark, sf, settings)
    return E.explained(panel(spark, sf), SPEC, t.scorer, t.typical, t.threshold)


def m4a_logistic_balance(spark, sf):
    """The unpenalised intercept balances the class weights: the weighted scores sum to half the rows."""
    scores = written(_fitted(0)(spark, sf), "fitted-scores")
    counts = scores.agg(F.count("*").alias("n"), F.sum(TR.LABEL).alias("yes")).select(F.struct("*")).scalar()
    weight = F.when(F.col(TR.LABEL) == 1, F.col("c.n") / (2 * F.col("c.yes"))).otherwise(
        F.col("c.n") / (2 * (F.col("c.n") - F.col("c.yes")))
    )
    return scores.withColumn("c", counts).agg(
        F.count("*").alias("rows"), F.sum(TR.LABEL).cast("bigint").alias("positives"),
        F.bround(F.sum(weight * F.col("probability")) / (F.count("*") / 2), 3).alias("balance"),
    )


def m5_logistic_folds(spark, sf):
    """All 50 logistic fits of a full run, solved over shared scans: what each trains on, and its balance."""
    frame = TR.numbered(TR.training_rows(panel(spark, sf), SPEC))
    encoded = written(TR.with_folds(M.fit_encoder(frame, SPEC).transform(frame), SPEC, FULL), "encoded")
    fits = N.fit_folds(encoded, TR.LABEL, FULL.folds, FULL.repeats)
    return N.training_balance(encoded, TR.LABEL, fits).withColumn("balance", F.bround("balance", 6))


def m5_held_out_rows(spark, sf, settings=SMALL):
    found = trained(spark, sf, settings).out_of_fold
    return found.select(ID, TR.LABEL, F.col("probability").between(0, 1).alias("in_range"))


def s6_metric_card(spark, sf, settings=SMALL):
    """The card's figures that follow from the panel, read back from disk."""
    return s6_metric_tables(spark, sf, settings).select("rows_total", "employees_scored", "attrition_rate", "models_fitted")


def s7_same_scores(spark, sf, settings=SMALL):
    """Saving and loading a model changes no score."""
    folder, now = new_path(spark, "model"), trained(spark, sf, settings)
    store.save_model(now, folder)
    kept = store.load_model(spark, folder, SPEC)
    before = S.score(panel(spark, sf), SPEC, now.scorer).select(ID, F.col("probability").alias("before"))
    after = S.score(panel(spark, sf), SPEC, kept.scorer).select(ID, "probability")
    return after.join(before, ID).select(ID, (F.col("probability") == F.col("before")).alias("same"))


def m11_fitted_invariants(spark, sf, settings=SMALL):
    found = m11_fitted_explained(spark, sf, settings)
    return found.select(
        ID,
        (F.size("drivers") <= E.TOP_DRIVERS).alias("drivers_fit"),
        (F.size("actions") <= E.TOP_ACTIONS).alias("actions_fit"),
        F.forall("actions", lambda a: a["reduction"] >= E.MIN_REDUCTION).alias("actions_gain"),
    )


def s10_cleared_log(spark, sf):
    path = new_path(spark, "log")
    log.append(_log(spark, sf), path)
    removed = log.clear(spark, path)
    log.append(_log(spark, sf).filter("will_leave = 1"), path)
    return log.read_log(spark, path).agg(F.lit(removed).cast("bigint").alias("removed"), F.count("*").alias("left_after"))


# --- files, log and streams ------------------------------------------------------------
def s3_score_file(spark, sf):
    path = new_path(spark, "upload")
    panel(spark, sf).write.option("header", True).csv(path)
    return _p6(files.score_file(spark, path, SPEC, ACCOUNT_SCORECARD)[0], ID)


def _batch(spark, sf, **options) -> Batch:
    """An upload in account order: one segment comes with an unknown tier, one without ids."""
    c, path = F.col, new_path(spark, "batch")
    upload = panel(spark, sf).orderBy(ID).withColumns(
        {
            "tier": F.when(c("segment") == "BUILDING", "Platinum").otherwise(c("tier")),
            ID: F.when(c("segment") != "MACHINERY", c(ID)),
        }
    )
    upload.write.option("header", True).csv(path)
    return score_batch(spark, path, SPEC, ACCOUNT_SCORECARD, THRESHOLD, created_at=RUN_AT, **options)


def s3_batch_ranked(spark, sf):
    return _batch(spark, sf).ranked


def s3_batch_rejected(spark, sf):
    return _batch(spark, sf).rejected.select("row", ID, F.inline("violations"))


def a7_batch_summary_of_file(spark, sf):
    return _batch(spark, sf).summary


def s9_shared_log(spark, sf):
    """A batch, a stream over the same log, and another batch: every row, by source."""
    path = new_path(spark, "shared-log")
    log.append(_log(spark, sf, "batch"), path)
    _streamed_log(spark, sf, path)
    log.append(_log(spark, sf, "again"), path)
    return log.read_log(spark, path).select("source", "id", "employee_ref", "probability", "will_leave")


def m11_rows_without_own_ids(spark, sf):
    """Explanations where accounts share an id or have none: one per row, told apart by spend."""
    c = F.col
    shared = panel(spark, sf).withColumn(
        ID, F.when(c("segment") == "BUILDING", F.lit(1)).when(c("segment") != "MACHINERY", c(ID)).cast("bigint")
    )
    found = E.explained(shared, SPEC, ACCOUNT_SCORECARD, {}, THRESHOLD)
    return found.groupBy(ID).agg(F.count("*").alias("n"), F.count_if("will_leave").alias("flagged"))


@functools.cache
def _report(spark: SparkSession, sf: str) -> str:
    """The folder of a whole stored report, written once for all queries that read its tables back."""
    folder = new_path(spark, "analysis")
    histograms = {
        "tenure_histogram": ("tenure_years", (0, 2, 3, 4), "{low}-{high}y"),
        "spend_histogram": ("monthly_spend", (5000, 10000, 15000, 20000), "{low}-{high}"),
    }
    write_analysis(panel(spark, sf), SPEC, folder, histograms, sf)
    return folder


def _stored(name: str) -> Query:
    return lambda spark, sf: store.read_tables(spark, _report(spark, sf), name)[name]


def s11_staleness(spark, sf):
    """Whether a stored table is stale in each state of its input, decided by the input's fingerprint."""
    data, folder, found = new_path(spark, "input"), new_path(spark, "report"), []
    record = f"{folder}/input"
    rows = written(panel(spark, sf), "panel")
    rows.write.partitionBy("segment").parquet(data)

    def make() -> None:
        store.write_tables({"kpis": B.kpis(engineer(spark.read.parquet(data), SPEC), SPEC)}, folder)
        files.record_input(spark, data, record)

    def state(name: str) -> None:
        stale = files.outputs_are_stale(spark, data, f"{folder}/kpis", record=record)
        found.append((name, stale, spark.read.parquet(data).count()))

    state("nothing made")
    make()
    state("made")
    rows.filter("tier = 'Entry'").write.mode("append").partitionBy("segment").parquet(data)
    state("added")
    make()
    state("made again")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{data}/segment=BUILDING")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    state("removed")
    return spark.createDataFrame(found, "state string, stale boolean, input_rows long")


def s8_exported_ranking(spark, sf):
    path = new_path(spark, "ranking")
    files.export_ranked(scored(spark, sf), SPEC, THRESHOLD, path)
    text = files.read_delimited(spark, path)
    return text.select(
        ID,
        F.col("probability").cast("double"),
        F.col("percent").cast("double"),
        "risk_band",
        F.col("will_leave").cast("boolean"),
    )


def s9_stored_log(spark, sf):
    path = new_path(spark, "log")
    log.append(_log(spark, sf), path)
    return _log_columns(log.read_log(spark, path))


def _stream_into(spark, sf, entities_of, path: str) -> str:
    source, sink = new_path(spark, "arrivals"), path
    entities_of.write.parquet(source)
    entities = ST.read_entities(spark, source, entities_of.schema, files_per_batch=4)
    ST.score_stream(
        entities, SPEC, ACCOUNT_SCORECARD, THRESHOLD, sink, new_path(spark, "stream-state"), F.lit(RUN_AT), F.col(ID)
    ).awaitTermination()
    return sink


def _streamed_log(spark, sf, path: str | None = None) -> str:
    return _stream_into(spark, sf, panel(spark, sf), path or new_path(spark, "stream-log"))


def r1_streamed_log(spark, sf):
    return _log_columns(log.read_log(spark, _streamed_log(spark, sf)))


def r1_streamed_rejects(spark, sf):
    """A stream in which one segment has an unknown tier: the rows that are turned away, by rule."""
    c = F.col
    dirty = panel(spark, sf).withColumn("tier", F.when(c("segment") == "BUILDING", "Platinum").otherwise(c("tier")))
    sink = _stream_into(spark, sf, dirty, new_path(spark, "stream-log"))
    return log.read_rejected(spark, sink).select(ID, F.inline("violations"))


def r2_streamed_summary(spark, sf):
    """The running totals beside a streamed log, after its first micro-batch has been repeated."""
    sink = _streamed_log(spark, sf)
    first = log.read_log(spark, sink).filter(F.col("run") == f"stream-{0:012d}")
    log.append(written(first.drop("run"), "repeated"), sink, f"stream-{0:012d}")
    return ST.running_summary(spark, sink)


def queries() -> dict[str, Query]:
    return {
        "account_panel": panel,
        "document_panel": document_panel,
        "s2_load_clean": s2_load_clean,
        "p1_trim_strings": lambda s, d: K.trim_strings(dirty_panel(s, d)),
        "p2_coerce_numerics": p2_coerce_numerics,
        "p3_target_flag": p3_target_flag,
        "p4_features_only": lambda s, d: K.drop_unmodelled(panel(s, d), SPEC),
        "p5_model_frame": p5_model_frame,
        "p6_violations": p6_violations,
        "p6_valid_rows": p6_valid_rows,
        "p7_defaults": p7_defaults,
        "p8_contract_columns": lambda s, d: K.contract_columns(panel(s, d), SPEC),
        "p9_form_projection": lambda s, d: K.form_projection(enriched(s, d), SPEC),
        "p10_flagged_rows": lambda s, d: _p6(S.flagged(scored(s, d), THRESHOLD), ID),
        "p11_keep_first": p11_keep_first,
        "p12_quality_checks": lambda s, d: quality_checks(panel(s, d), SPEC),
        "j1_level_rank": j1_level_rank,
        "j2_category_order": j2_category_order,
        "j3_upgrades": j3_upgrades,
        "j5_band_table": j5_band_table,
        "j6_typical_pairs": j6_typical_pairs,
        "f1_f3_derived_numbers": lambda s, d: enriched(s, d).select(
            ID, "career_share", "promotion_gap", "pay_per_level"
        ),
        "f4_tenure_band": lambda s, d: enriched(s, d).select(ID, "tenure_band"),
        "f5_decision": f5_decision,
        "f6_cost_at_risk": f6_cost_at_risk,
        "f7_pay_rises": f7_pay_rises,
        "f9_indian_amounts": _amounts(indian_amount),
        "f10_short_amounts": _amounts(short_amount),
        "f12_headlines": lambda s, d: headlines(enriched(s, d), SPEC),
        "f13_log_rows": lambda s, d: _log_columns(_log(s, d)),
        "a1_kpis": lambda s, d: B.kpis(enriched(s, d), SPEC),
        "a1_document_kpis": lambda s, d: B.kpis(document_panel(s, d), DOCUMENTS),
        "a2_tier_breakdown": a2_tier_breakdown,
        "a3_breakdowns": lambda s, d: B.breakdowns(enriched(s, d), SPEC),
        "a3_document_breakdowns": lambda s, d: B.breakdowns(document_panel(s, d), DOCUMENTS),
        "a4_tenure_histogram": lambda s, d: B.histogram(
            enriched(s, d), SPEC, "tenure_years", (0, 2, 3, 4), "{low}-{high}y"
        ),
        "a4_spend_histogram": lambda s, d: B.histogram(
            enriched(s, d), SPEC, "monthly_spend", (5000, 10000, 15000, 20000)
        ),
        "a4_document_histogram": lambda s, d: B.histogram(
            document_panel(s, d), DOCUMENTS, "n_chars", (0, 500, 1000, 2000, 4000)
        ),
        "a5_risk_segments": a5_risk_segments,
        "a5_document_segments": a5_document_segments,
        "a6_typical_document": lambda s, d: typical_table(document_panel(s, d), DOCUMENTS),
        "a6_typical_account": lambda s, d: typical_table(_kept(s, d), SPEC),
        "a7_batch_summary": lambda s, d: S.batch_summary(scored(s, d), SPEC, THRESHOLD),
        "a8_log_summary": lambda s, d: log.summary(_log(s, d)),
        "t1_roster": lambda s, d: B.roster(panel(s, d), SPEC),
        "t2_ranked_batch": t2_ranked_batch,
        "t3_recent_log": t3_recent_log,
        "a9_confusion": lambda s, d: C.confusion(labelled(s, d), "label", "probability", THRESHOLD),
        "a10_a11_metrics": lambda s, d: C.score_block(
            labelled(s, d), "label", "probability", THRESHOLD, curve(s, d)
        ),
        "w1_cumulative_counts": lambda s, d: curve(s, d).drop("block"),
        "w2_roc_points": _points(C.roc_points),
        "w3_pr_points": _points(C.pr_points),
        "w4_thinned_roc": _thinned(C.roc_points, "roc"),
        "w4_thinned_pr": _thinned(C.pr_points, "pr"),
        "w5_best_threshold": w5_best_threshold,
        "w6_stratified_folds": w6_stratified_folds,
        "m1_one_hot_slots": m1_one_hot_slots,
        "m2_scaling_stats": m2_scaling_stats,
        "m4a_logistic_scores": _fitted(0),
        "m4b_forest_scores": _fitted(1),
        "m4c_boosting_scores": _fitted(2),
        "m5_out_of_fold": lambda s, d: trained(s, d).out_of_fold,
        "m6_model_card": lambda s, d: trained(s, d).card,
        "t6_leaderboard": lambda s, d: trained(s, d).leaderboard,
        "m7_permutation_importance": m7_permutation_importance,
        "t7_top_features": t7_top_features,
        "m8_scored_accounts": lambda s, d: _p6(scored(s, d), ID),
        "m9_drivers": m9_drivers,
        "m10_actions": m10_actions,
        "m11_explained": m11_explained,
        "m11_fitted_explained": m11_fitted_explained,
        "s3_score_file": s3_score_file,
        "s5_stored_breakdowns": _stored("breakdowns"),
        "s5_stored_kpis": _stored("kpis"),
        "s5_stored_segments": _stored("risk_segments"),
        "s5_stored_headlines": _stored("headlines"),
        "s5_stored_roster": _stored("roster"),
        "s5_stored_tenure_histogram": _stored("tenure_histogram"),
        "s5_stored_spend_histogram": _stored("spend_histogram"),
        "s11_staleness": s11_staleness,
        "s6_metric_tables": s6_metric_tables,
        "s7_reloaded_model": s7_reloaded_model,
        "s8_exported_ranking": s8_exported_ranking,
        "s3_batch_ranked": s3_batch_ranked,
        "s3_batch_rejected": s3_batch_rejected,
        "a7_batch_summary_of_file": a7_batch_summary_of_file,
        "s9_shared_log": s9_shared_log,
        "m11_rows_without_own_ids": m11_rows_without_own_ids,
        "m4a_logistic_balance": m4a_logistic_balance,
        "m5_held_out_rows": m5_held_out_rows,
        "m5_logistic_folds": m5_logistic_folds,
        "s6_metric_card": s6_metric_card,
        "s7_same_scores": s7_same_scores,
        "m11_fitted_invariants": m11_fitted_invariants,
        "s10_cleared_log": s10_cleared_log,
        "s9_stored_log": s9_stored_log,
        "r1_streamed_log": r1_streamed_log,
        "r1_streamed_rejects": r1_streamed_rejects,
        "r2_streamed_summary": r2_streamed_summary,
    }


def full_queries() -> dict[str, Query]:
    """The queries that :func:`queries` registers with cut sizes, each with the sizes of a full run.

    They have no SQL twins: the SQL beside the cut queries holds for their sizes."""
    sized = {
        "m5_held_out_rows": m5_held_out_rows,
        "s6_metric_tables": s6_metric_tables,
        "s6_metric_card": s6_metric_card,
        "s7_reloaded_model": s7_reloaded_model,
        "s7_same_scores": s7_same_scores,
        "m11_fitted_explained": m11_fitted_explained,
        "m11_fitted_invariants": m11_fitted_invariants,
    }
    found = {name: functools.partial(query, settings=FULL) for name, query in sized.items()} | {
        "m4b_forest_scores": _fitted(1, FULL),
        "m4c_boosting_scores": _fitted(2, FULL),
        "m5_out_of_fold": lambda s, d: trained(s, d, FULL).out_of_fold,
        "m6_model_card": lambda s, d: trained(s, d, FULL).card,
        "t6_leaderboard": lambda s, d: trained(s, d, FULL).leaderboard,
        "m7_permutation_importance": functools.partial(m7_permutation_importance, repeats=FULL.importance_repeats),
        "t7_top_features": functools.partial(t7_top_features, repeats=FULL.importance_repeats),
        "w6_stratified_folds": functools.partial(w6_stratified_folds, repeats=FULL.repeats),
    }
    return {f"{name}_full": query for name, query in found.items()}
