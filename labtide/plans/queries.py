"""Registry: one query per operator, each over the whole driver tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtide.functions import profiles
from labtide.functions.stats import normal_cdf
from labtide.functions.text import iso_instant
from labtide.operators import (
    detectors, layout, narrative, normalise, points, quality, reports, review, signals, tables, triage, views,
)
from labtide.operators.barrier import settled
from labtide.options import Options
from labtide.plans import adapter
from labtide.schemas import OBSERVATION_COLUMNS
from labtide.session import checkpointed, shared_folder
from labtide.sources import csv, fhir, landing
from labtide.streaming import uploads

KEY = ["patient_id", "code", "derived"]
DEFAULT = Options()
#: eGFR, measured or derived, comes from these.
KIDNEY = ("CREAT", "EGFR")
AS_OF_2022 = Options(as_of=1_672_531_199)
STORED_BEFORE = 1_685_577_600


@cache
def _layout(_application: str, sf_dir: str) -> layout.Layout:
    spark = SparkSession.getActiveSession()
    return layout.measure(normalise.readings(adapter.observations(spark, sf_dir)))


def _plan(spark: SparkSession, sf_dir: str) -> layout.Layout:
    """Series sizes of a table version are measured once per application."""
    return _layout(spark.sparkContext.applicationId, sf_dir)


def _observations(spark, sf_dir, codes=()) -> DataFrame:
    """All results, or those of some codes: the filter reaches the scan and nothing else is shuffled."""
    rows = adapter.observations(spark, sf_dir)
    return rows.where(F.col("code").isin(*codes)) if codes else rows


def _facts(spark, sf_dir, options=DEFAULT, codes=()) -> DataFrame:
    return reports.facts(
        _observations(spark, sf_dir, codes), adapter.demographics(spark, sf_dir), options, _plan(spark, sf_dir)
    )


def _reports(spark, sf_dir, options=DEFAULT, codes=()) -> DataFrame:
    return reports.reports(
        _observations(spark, sf_dir, codes), adapter.demographics(spark, sf_dir), options, _plan(spark, sf_dir)
    )


def _signals(spark, sf_dir) -> DataFrame:
    return signals.explode_signals(_reports(spark, sf_dir))


def _points(spark, sf_dir, codes=()) -> DataFrame:
    return reports.all_points(
        _observations(spark, sf_dir, codes), adapter.demographics(spark, sf_dir), DEFAULT, _plan(spark, sf_dir)
    )


def r(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c.split(".")[-1]) for c in columns]


def long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


# -- sources, codes and units -------------------------------------------------


def biomarker_stats(spark, sf_dir):
    raw = adapter.table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), "value")
    return tables.biomarker_stats(raw).select("code", "n", *r("mean", "min", "max"))


def patient_listing(spark, sf_dir):
    return tables.patient_listing(adapter.observations(spark, sf_dir))


def patient_codes(spark, sf_dir):
    return tables.patient_codes(adapter.observations(spark, sf_dir))


def canonical_codes(spark, sf_dir):
    spelled = F.expr(
        "CASE WHEN code = 'XERR' THEN ' xerr ' WHEN event_id % 3 = 0 THEN lower(code)"
        " WHEN event_id % 3 = 1 THEN CASE code WHEN 'HBA1C' THEN '4548-4' WHEN 'LDL' THEN '18262-6'"
        " WHEN 'TSH' THEN '3016-3' ELSE '38483-4' END ELSE concat(' ', code) END"
    )
    upload = adapter.lab_events(spark, sf_dir).withColumn("code", spelled)
    return normalise.canonical_codes(upload).select("event_id", "patient_id", "code")


def normalise_units(spark, sf_dir):
    rows = normalise.with_canonical_value(normalise.with_analyte(adapter.lab_events(spark, sf_dir)))
    return rows.where("analyte IS NOT NULL").select("event_id", "patient_id", "code", "unit", *r("v"))


def unit_spellings(spark, sf_dir):
    """Units and codes with white space of several scripts around them, and in capitals."""
    around = F.expr("CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '\t' WHEN 2 THEN '\u00a0' WHEN 3 THEN '\r\n' ELSE '\u2003 ' END")
    unit = F.when(F.expr("event_id % 7 = 0"), F.upper("unit")).otherwise(F.col("unit"))
    rows = adapter.lab_events(spark, sf_dir).withColumns(
        {"unit": F.concat(around, unit, around), "code": F.concat(around, F.lower("code"), around)}
    )
    rows = normalise.with_canonical_value(normalise.with_analyte(rows))
    return rows.where("analyte IS NOT NULL").select("event_id", *r("v"))


def unprofiled_units(spark, sf_dir):
    rows = _facts(spark, sf_dir).where("analyte IS NULL")
    return rows.select("patient_id", "code", "unit", *long("n", "unit_unknown"))


def parse_taken_at(spark, sf_dir):
    iso = iso_instant(F.col("t"))
    raw = (
        F.when(F.expr("event_id % 6") == 0, F.substring(iso, 1, 19))
        .when(F.expr("event_id % 6") == 1, F.replace(F.substring(iso, 1, 19), F.lit("T"), F.lit(" ")))
        .when(F.expr("event_id % 6") == 2, F.substring(iso, 1, 10))
        .when(F.expr("event_id % 6") == 3, F.concat(F.lit("  "), F.substring(iso, 1, 19), F.lit(" ")))
        .when(F.expr("event_id % 6") == 4, F.lit("not-a-date"))
        .otherwise(iso)
    )
    rows = adapter.lab_events(spark, sf_dir).select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.unix_timestamp(csv.parse_taken_at(F.col("raw"))).alias("t"))


def csv_rejects(spark, sf_dir):
    defect = lambda k, c, bad: F.when(F.expr(f"event_id % 9 = {k}"), bad).otherwise(c)
    none = F.lit(None).cast("string")
    rows = adapter.lab_events(spark, sf_dir).select(
        "event_id",
        defect(4, F.col("patient_id"), none).alias("patient_id"),
        "code",
        defect(1, defect(2, defect(3, F.col("value").cast("string"), F.lit("NaN")), F.lit("high")), none).alias("value"),
        defect(6, F.col("unit"), none).alias("unit"),
        defect(5, F.substring(iso_instant(F.col("t")), 1, 19), F.lit(" soon ")).alias("taken_at"),
        defect(7, F.col("source"), none).alias("source"),
    )
    return csv.checked_rows(rows).select("event_id", "reject_reason")


def _fhir_texts(spark, sf_dir) -> DataFrame:
    """Every result as the text of a FHIR Observation, with one kind of defect per event_id % 14."""
    k = F.expr("event_id % 14")
    loinc = F.expr(
        "CASE code WHEN 'HBA1C' THEN '4548-4' WHEN 'LDL' THEN '18262-6' WHEN 'TSH' THEN '3016-3'"
        " WHEN 'CREAT' THEN '38483-4' ELSE '9999-9' END"
    )
    system = F.when(k == 2, "http://snomed.info/sct").otherwise(fhir.LOINC)
    coded = F.expr("event_id % 2 = 0")
    quantity = F.struct(
        F.when(k != 9, F.col("value")).alias("value"),
        # the coded unit counts under UCUM, the written one otherwise; the other of the two says something else
        F.when(k != 4, F.when(coded, "as coded").otherwise(F.col("unit"))).alias("unit"),
        F.when(coded, fhir.UCUM).alias("system"),
        F.when(k != 4, F.when(coded, F.col("unit")).otherwise("local-unit")).alias("code"),
    )
    offset = F.concat(F.substring(iso_instant(F.col("t") + 7200), 1, 19), F.lit("+02:00"))
    time = F.when(k == 5, "2023-07").when(k == 6, "2023-07-14T22:10:45").otherwise(offset)
    reference = F.when(k == 7, "Location/ward-2").when(
        F.expr("event_id % 2 = 0"), F.concat(F.lit("Patient/"), "patient_id")
    ).otherwise(F.concat(F.lit("urn:uuid:"), "patient_id"))
    body = F.struct(
        F.lit("Observation").alias("resourceType"),
        F.col("event_id").cast("string").alias("id"),
        F.when(k == 1, "preliminary").when(F.expr("event_id % 3 = 0"), "amended").otherwise("final").alias("status"),
        F.struct(
            F.array(
                F.struct(F.lit("http://snomed.info/sct").alias("system"), F.lit("1").alias("code")),
                F.struct(system.alias("system"), loinc.alias("code")),
            ).alias("coding")
        ).alias("code"),
        F.when(k != 11, F.struct(reference.alias("reference"))).alias("subject"),
        F.when(k != 10, time).alias("effectiveDateTime"),
        F.when(k != 3, quantity).alias("valueQuantity"),
    )
    json = F.when(k == 8, F.replace(F.to_json(body), F.lit('"final"'), F.lit("5"))).otherwise(F.to_json(body))
    json = F.when(k == 8, F.replace(json, F.lit('"amended"'), F.lit("5"))).otherwise(json)
    return adapter.lab_events(spark, sf_dir).select("event_id", json.alias("body"))


def _fhir_resources(spark, sf_dir) -> DataFrame:
    return settled(
        _fhir_texts(spark, sf_dir).select(
            F.lit("events").alias("file"), F.col("event_id").alias("position"), F.try_parse_json("body").alias("resource")
        )
    )


def _fhir_checked(spark, sf_dir):
    checked = fhir.profiled_only(fhir.checked_observations(_fhir_resources(spark, sf_dir)))
    return settled(checked)


def fhir_skip_reasons(spark, sf_dir):
    return _fhir_checked(spark, sf_dir).select(F.col("position").alias("event_id"), "skip_reason")


def fhir_observations(spark, sf_dir):
    kept = _fhir_checked(spark, sf_dir).where("skip_reason IS NULL")
    return kept.select(
        F.col("position").alias("event_id"), "patient_id", "code", *r("value"), "unit", F.unix_timestamp("taken_at").alias("t")
    )


def fhir_patients(spark, sf_dir):
    body = F.to_json(
        F.struct(
            F.lit("Patient").alias("resourceType"),
            F.expr("concat('P', c_custkey)").alias("id"),
            F.expr(
                "CASE c_custkey % 5 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'other'"
                " WHEN 3 THEN 'unknown' ELSE 'robot' END"
            ).alias("gender"),
            F.expr(
                "CASE c_custkey % 4 WHEN 3 THEN '18xx' WHEN 2 THEN concat(1940 + 3 * c_nationkey, '-04-12')"
                " ELSE CAST(1940 + 3 * c_nationkey AS STRING) END"
            ).alias("birthDate"),
        )
    )
    rows = adapter.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("file"), F.col("c_custkey").alias("position"), F.try_parse_json(body).alias("resource")
    )
    return fhir.patients(rows).select("patient_id", "gender", "birth_year")


def skip_histogram(spark, sf_dir):
    return tables.skip_histogram(_fhir_checked(spark, sf_dir).where("skip_reason IS NOT NULL"), "skip_reason")


# -- stored tables --------------------------------------------------------------


def _upload(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Results stored before a date, and a batch that submits every result twice."""
    rows = adapter.lab_events(spark, sf_dir)
    stored = rows.where(F.col("t") < STORED_BEFORE).select(*OBSERVATION_COLUMNS)
    first = rows.select(*OBSERVATION_COLUMNS, F.col("event_id").alias("seq"))
    again = first.withColumn("value", F.lit(-1.0)).withColumn("seq", F.col("seq") + F.lit(1 << 40))
    return stored, first.unionByName(again)


def idempotent_insert(spark, sf_dir):
    stored, batch = _upload(spark, sf_dir)
    return tables.new_results(batch, stored).select(
        "patient_id", "code", F.unix_timestamp("taken_at").alias("t"), *r("value"), "unit"
    )


def upload_summary(spark, sf_dir):
    stored, batch = _upload(spark, sf_dir)
    skipped = adapter.observations(spark, sf_dir).where("unit = 'mg/L'")
    return tables.upload_summary(
        batch, tables.new_results(batch, stored), skipped, adapter.demographics(spark, sf_dir)
    )


def _demographics_upload(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored demographics, and a batch that repeats and then corrects them."""
    stored = adapter.demographics(spark, sf_dir)
    number = F.expr("CAST(substr(patient_id, 2) AS BIGINT)")
    gone = F.lit(None).cast("string")
    first = stored.withColumn("seq", number)
    fixes = stored.withColumn("seq", number + F.lit(1 << 40)).withColumn(
        "gender", F.when(number % 4 == 1, gone).when(number % 4 == 3, "unknown").otherwise(F.col("gender"))
    ).withColumn(
        "birth_year", F.when(number % 4 == 1, F.lit(None)).when(number % 4 == 3, 1950).otherwise(F.col("birth_year"))
    )
    return stored, first.unionByName(fixes)


def upsert_demographics(spark, sf_dir):
    return tables.upsert_demographics(*_demographics_upload(spark, sf_dir)).select("patient_id", "gender", "birth_year")


def dedupe_results(spark, sf_dir):
    rows = normalise.with_canonical_value(normalise.with_analyte(adapter.lab_events(spark, sf_dir)))
    monthly = rows.where("analyte IS NOT NULL AND v IS NOT NULL").withColumn("t", F.expr("t - t % 2592000"))
    return quality.dedupe(monthly).select("patient_id", F.col("analyte").alias("code"), "t", *r("v"))


def plausibility(spark, sf_dir):
    return quality.plausibility(_points(spark, sf_dir).select("patient_id", "code", "v"), _plan(spark, sf_dir))


def series_as_recorded(spark, sf_dir):
    rows = adapter.lab_events(spark, sf_dir)
    return rows.select("patient_id", "code", iso_instant(F.col("t")).alias("taken_at"), *r("value"), "unit", "source")


# -- detectors -------------------------------------------------------------------


def exclusions(spark, sf_dir):
    return _facts(spark, sf_dir).select(*KEY, *long("after_as_of", "unit_unknown"))


def as_of_exclusions(spark, sf_dir):
    rows = _facts(spark, sf_dir, AS_OF_2022)
    return rows.select(*KEY, *long("after_as_of"), (F.col("n") + F.col("unit_unknown")).cast("long").alias("in_range"))


def latest_results(spark, sf_dir):
    rows = settled(_facts(spark, sf_dir).select(*KEY, *long("n"), "latest_t", "previous_t", *r("latest_v", "previous_v")))
    return rows.where("latest_t IS NOT NULL")


def recent_results(spark, sf_dir):
    recent = F.posexplode(F.reverse("recent")).alias("i", "p")
    return (
        _facts(spark, sf_dir).select(*KEY, recent)
        .select(*KEY, (F.col("i") + 1).cast("long").alias("newest_rank"), F.col("p.t").alias("t"), F.col("p.v").alias("v"))
        .withColumn("v", F.round("v", 6))
    )


def baselines(spark, sf_dir):
    rows = _facts(spark, sf_dir).select(
        *KEY, *long("base_n"), "base_from", "base_to", *r("set_point", "prri_low", "prri_high")
    )
    return settled(rows).where("base_n IS NOT NULL")


def rcv_limits(spark, sf_dir):
    rows = detectors.with_rcv(_facts(spark, sf_dir)).select(*KEY, "n", *r("rcv_up", "rcv_down"))
    return settled(rows).where("rcv_up IS NOT NULL AND n >= 2").drop("n")


def rcv_jumps(spark, sf_dir):
    return points.jumps(_points(spark, sf_dir)).withColumn("change", F.round("change", 6))


def change_points(spark, sf_dir):
    rows = _facts(spark, sf_dir).select(
        *KEY, "cp_t", "cp_detected_t", F.round("set_point", 6).alias("before"), F.round("cp_after", 6).alias("after"),
        F.round("cp_change", 6).alias("change"),
    )
    return settled(rows).where("cp_t IS NOT NULL")


def ewma(spark, sf_dir):
    rows = _facts(spark, sf_dir).select(
        *KEY, F.round("ewma_robust", 6).alias("robust"), *r("ewma_value", "ewma_low", "ewma_high")
    )
    return settled(rows).where("ewma_value IS NOT NULL")


def _trend(spark, sf_dir, *columns):
    return settled(_facts(spark, sf_dir).select(*KEY, "trend_done", *columns)).where("trend_done").drop("trend_done")


def mann_kendall(spark, sf_dir):
    return _trend(spark, sf_dir, *long("trend_n"), "mk_s", *r("mk_var", "mk_tau", "mk_z", "mk_p"))


def sen_slope(spark, sf_dir):
    return _trend(spark, sf_dir, "sen_n", *r("sen_slope", "sen_low", "sen_high"))


def trends(spark, sf_dir):
    return _trend(spark, sf_dir, *long("trend_n"), "trend_from", *r("change_per_year", "mk_p"), "direction")


def trends_window(spark, sf_dir):
    """Trends over 90 days, which most series outlast."""
    rows = _reports(spark, sf_dir, Options(window_days=90)).select(
        *KEY, *long("trend_n"), "trend_from", *r("change_per_year", "mk_p"), "direction", "trend_done"
    )
    return settled(rows).where("trend_done").drop("trend_done")


def signals_as_of(spark, sf_dir):
    rows = signals.explode_signals(_reports(spark, sf_dir, AS_OF_2022))
    return rows.select(*KEY, *long("position"), "rule", "severity", "t", *r("value", "threshold"))


def signals_odd_values(spark, sf_dir):
    """The detectors over results of which some are negative, zero or not a number."""
    turn = F.floor(F.unix_micros("taken_at") / 1_000_000) % 23
    odd = F.when(turn == 0, -F.col("value")).when(turn == 1, 0.0).when(turn == 2, float("nan")).otherwise(F.col("value"))
    rows = signals.explode_signals(
        reports.reports(adapter.observations(spark, sf_dir).withColumn("value", odd), adapter.demographics(spark, sf_dir), DEFAULT)
    )
    return rows.select(*KEY, *long("position"), "rule", "severity", "t", *r("value", "threshold"))


def report_fields(spark, sf_dir):
    """Every number of a report that is not a list, one row per series."""
    return _reports(spark, sf_dir).select(
        *KEY, *long("n"), "latest_t", *r("latest_v"), *long("base_n"), "base_from", "base_to",
        *r("set_point", "prri_low", "prri_high"),
        *[F.when(F.col("n") >= 2, F.round(c, 6)).alias(c) for c in ("rcv_up", "rcv_down")],
        *r("ewma_value", "ewma_low", "ewma_high"), "cp_t", "cp_detected_t", *r("cp_after", "cp_change"), "status",
    )


def normal_cdf_values(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "events")
    return rows.select("event_id", F.round(normal_cdf((F.col("value") - 10.0) / 5.0), 6).alias("cdf"))


def threshold_hits(spark, sf_dir):
    limits = F.broadcast(profiles.thresholds(spark).withColumnRenamed("analyte", "code"))
    latest = _facts(spark, sf_dir).select(*KEY, "latest_v")
    met = F.when(F.col("direction") == "above", F.col("latest_v") >= F.col("limit")).otherwise(
        F.col("latest_v") < F.col("limit")
    )
    return settled(latest).join(limits, "code").where(met).select(
        *KEY, "ord", "direction", "severity", F.round("limit", 6).alias("threshold"), "label"
    )


# -- signals, status, derived series -----------------------------------------------


def all_signals(spark, sf_dir):
    rows = _signals(spark, sf_dir)
    return rows.select(*KEY, *long("position"), "rule", "severity", "t", *r("value", "threshold"))


def _rule(name):
    def query(spark, sf_dir):
        rows = _signals(spark, sf_dir).where(F.col("rule") == name)
        return rows.select(*KEY, "severity", "t", *r("value", "threshold"))

    return query


def signal_explanations(spark, sf_dir):
    return _signals(spark, sf_dir).select(*KEY, "position", "rule", "explanation", "source")


def egfr_values(spark, sf_dir):
    rows = _points(spark, sf_dir, KIDNEY).where("derived")
    return rows.select("patient_id", "t", *r("v"))


def egfr_series(spark, sf_dir):
    rows = _facts(spark, sf_dir, codes=KIDNEY).where("derived")
    return rows.select("patient_id", *long("n"), "latest_t", *r("latest_v"))


def egfr_not_derived(spark, sf_dir):
    rows = _facts(spark, sf_dir, codes=KIDNEY).select("patient_id", F.col("creat_note").alias("reason"))
    return rows.where("reason IS NOT NULL AND reason <> 'derived'")


def kdigo_stage(spark, sf_dir):
    rows = _reports(spark, sf_dir, codes=KIDNEY).where("code = 'EGFR'")
    return rows.select("patient_id", *r("latest_v"), F.coalesce("hit_below.label", F.lit("G1-G2")).alias("stage"))


def series_status(spark, sf_dir):
    return _reports(spark, sf_dir).select(*KEY, "status")


def deciding_rule(spark, sf_dir):
    rows = triage.deciding_rules(_reports(spark, sf_dir)).select(*KEY, "rule", "severity")
    return settled(rows).where("rule IS NOT NULL")


def not_assessed(spark, sf_dir):
    return signals.explode_not_assessed(_reports(spark, sf_dir)).select(*KEY, "rule")


def drift_reports(spark, sf_dir):
    """The nested report of every series, ready for ``to_json`` or parquet."""
    return reports.nested(_reports(spark, sf_dir))


# -- reviews and triage ---------------------------------------------------------------


def review_fold(spark, sf_dir):
    folded = review.fold(adapter.review_events(spark, sf_dir))
    return folded.select(*review.SIGNAL_KEY, "state", "decided_at", "reason", "notes")


def _reviewed(spark, sf_dir):
    return review.signal_reviews(_signals(spark, sf_dir), adapter.review_events(spark, sf_dir))


def signal_reviews(spark, sf_dir):
    return _reviewed(spark, sf_dir).select(*KEY, *long("position"), "rule", "t", "state", "notes")


def unreviewed_signals(spark, sf_dir):
    return review.unreviewed(_reviewed(spark, sf_dir)).select(*KEY, *long("position"), "rule", "severity", "t")


def stale_reviews(spark, sf_dir):
    rows = review.stale(adapter.review_events(spark, sf_dir), _signals(spark, sf_dir))
    return rows.select(*review.SIGNAL_KEY, "id", "action")


def review_snapshots(spark, sf_dir):
    return review.snapshot(_reports(spark, sf_dir), DEFAULT.window_days)


def identifier_screen(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.select("doc_id", review.identifier(F.col("text")).alias("found"))


def review_rejects(spark, sf_dir):
    action = F.expr(
        "CASE turn % 5 WHEN 0 THEN 'acknowledge' WHEN 1 THEN 'annotate' WHEN 2 THEN 'dismiss' WHEN 3 THEN 'reopen' END"
    )
    rows = adapter.table(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id", "turn", review.reject_reason(F.lit("prri"), action, F.col("text")).alias("reject_reason")
    )


def _triage(spark, sf_dir):
    return triage.triage(_reports(spark, sf_dir), adapter.review_events(spark, sf_dir))


TRIAGE_COLUMNS = [
    "patient_id", "status", "alerts", "watches", "unreviewed", "top_code", "top_display", "top_rule", "top_severity"
]


def patient_triage(spark, sf_dir):
    return _triage(spark, sf_dir).select(*TRIAGE_COLUMNS)


def triage_ranked(spark, sf_dir):
    listing = tables.patient_listing(adapter.observations(spark, sf_dir))
    ranked = triage.ranked(_triage(spark, sf_dir).join(listing, "patient_id"))
    return ranked.select(*TRIAGE_COLUMNS, "rank", "biomarkers", "observations")


# -- points and text -------------------------------------------------------------------


def point_annotations(spark, sf_dir):
    rows = points.annotations(_points(spark, sf_dir))
    return rows.select(*KEY, *long("idx"), "t", *r("v"), "outside", *r("jump"), "threshold_label", "threshold_severity")


def series_table(spark, sf_dir):
    rows = points.table_rows(points.annotations(_points(spark, sf_dir)), adapter.observations(spark, sf_dir))
    return rows.select(*KEY, "t", *r("v", "recorded_value"), "recorded_unit")


def explain_context(spark, sf_dir):
    return narrative.explain_context(_reports(spark, sf_dir))


def stub_drafts(spark, sf_dir):
    return narrative.stub_drafts(_reports(spark, sf_dir))


def draft_audit(spark, sf_dir):
    """Stub drafts of every series as JSON, some with a wrong status or a missing field."""
    # drafts and their audit both read the reports, which are computed once
    computed = checkpointed(_reports(spark, sf_dir).select(*KEY, "display", "signals", "not_assessed", "status"))
    stub = narrative.stub_drafts(computed)
    status = F.when(F.crc32("patient_id") % 3 == 0, "normal").otherwise(F.col("status"))
    broken = F.crc32("patient_id") % 7 == 0
    draft = F.to_json(
        F.struct("summary", "interpretation", F.when(~broken, F.col("follow_up")).alias("follow_up"), "limitations", status.alias("status"))
    )
    return narrative.draft_audit(stub.select(*KEY, draft.alias("draft")), computed)


# -- files and stored tables, written and read back ------------------------------


def _folder(spark, name) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stored_columns(rows: DataFrame) -> DataFrame:
    return rows.select("patient_id", "code", F.unix_timestamp("taken_at").alias("t"), *r("value"), "unit")


def _csv_rows(spark, sf_dir) -> DataFrame:
    """Every result as upload text; the source holds a line break, quotes and a comma."""
    note = F.concat(F.lit('events, no. "'), F.col("event_id"), F.lit('"\nsecond line'))
    return adapter.lab_events(spark, sf_dir).select(
        "event_id", "patient_id", "code", F.col("value").cast("string").alias("value"), "unit",
        F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss").alias("taken_at"), note.alias("source"),
    )


#: Results of one written document or file, so that writing it stays a small task.
FILE_ROWS = 400_000


def _files(rows: DataFrame, least: int) -> int:
    return max(least, -(-rows.count() // FILE_ROWS))


def _write_csv(rows: DataFrame, path: str, files: int) -> None:
    rows.select(*OBSERVATION_COLUMNS).repartition(files).write.option("header", True).option("escape", '"').csv(path)


def csv_import(spark, sf_dir):
    """Uploads with quoted line breaks, read in blocks."""
    path = _folder(spark, "csv")
    rows = _csv_rows(spark, sf_dir)
    _write_csv(rows, path, _files(rows, 3))
    accepted, _ = csv.read_csv(spark, path)
    return accepted.select("patient_id", "code", F.unix_timestamp("taken_at").alias("t"), *r("value"), "unit", "source")


def _write_bundles(rows: DataFrame, path: str, documents: int) -> None:
    """Bundles of (event_id, body) rows, one document per event_id % documents, one entry a line."""
    number = (F.col("event_id") % documents).alias("document")
    numbers = checkpointed(rows.select(number, "event_id").groupBy("document").agg(F.min("event_id").alias("first")))
    entry = F.concat(
        F.when(F.col("event_id") == F.col("first"), "").otherwise(","), F.lit('{"fullUrl": "urn:{}", "resource": '), "body", F.lit("}")
    )
    entries = rows.select("event_id", number, "body").join(F.broadcast(numbers), "document").select(
        "document", F.col("event_id").alias("at"), entry.alias("value")
    )
    opening = numbers.select("document", F.lit(-1).cast("long").alias("at"), F.lit('{"resourceType": "Bundle", "link": [{"relation": "self"}], "entry": [').alias("value"))
    closing = numbers.select("document", F.lit((1 << 62)).alias("at"), F.lit('], "type": "collection"}').alias("value"))
    every = entries.unionByName(opening).unionByName(closing).repartition(documents, "document").sortWithinPartitions("document", "at")
    every.select("document", "value").write.partitionBy("document").text(path)


def _imported(accepted: DataFrame) -> DataFrame:
    return accepted.select("patient_id", "code", F.unix_timestamp("taken_at").alias("t"), *r("value"), "unit")


def fhir_bundle(spark, sf_dir):
    """Accepted results of Bundles that are read in blocks."""
    path = _folder(spark, "bundles")
    texts = _fhir_texts(spark, sf_dir)
    _write_bundles(texts, path, _files(texts, 2))
    return _imported(fhir.read_fhir(spark, path)[0])


def fhir_ndjson(spark, sf_dir):
    path = _folder(spark, "ndjson")
    _fhir_texts(spark, sf_dir).select("body").write.text(path)
    return _imported(fhir.read_ndjson(spark, path)[0])


def landing_folder(spark, sf_dir):
    """CSV files and a Bundle in one folder, and a CSV file with bad rows, which fails alone: loaded and failed files
    with their results."""
    path, rows = _folder(spark, "landing"), _csv_rows(spark, sf_dir)
    good, texts = rows.where("event_id % 3 = 0"), _fhir_texts(spark, sf_dir).where("event_id % 3 = 2")
    _write_csv(good, f"{path}/good", _files(good, 2))
    _write_csv(rows.where("event_id % 3 = 1").withColumn("value", F.when(F.col("event_id") % 2 == 0, "high").otherwise(F.col("value"))), f"{path}/bad", 1)
    _write_bundles(texts, f"{path}/bundle", _files(texts, 1))
    parts = landing.load(spark, path, csv_files="*.csv", json_files="*.txt", nested=True)
    observations, skipped, _, failed = parts
    count = F.count(F.lit(1)).alias("n")
    return (
        observations.groupBy(F.concat(F.lit("stored from "), F.when(F.col("source") == "fhir", "fhir").otherwise("csv")).alias("kind")).agg(count)
        .unionByName(skipped.groupBy(F.lit("skipped").alias("kind")).agg(count))
        .unionByName(failed.groupBy(F.concat(F.lit("failed: "), "error").alias("kind")).agg(count))
    )


def stored_insert(spark, sf_dir):
    """The store after a first and an overlapping upload; the first value of a key stays."""
    stored, batch = _upload(spark, sf_dir)
    path = _folder(spark, "store")
    tables.append_results(spark, path, stored.withColumn("seq", F.lit(0)))
    tables.append_results(spark, path, batch)
    return _stored_columns(tables.read_results(spark, path))


def upload_commits(spark, sf_dir):
    """What three uploads did: results before a date, every result twice, and the second batch replayed."""
    stored, batch = _upload(spark, sf_dir)
    path = _folder(spark, "store")
    uploads = [(stored.withColumn("seq", F.lit(0)), 0), (batch, 1), (batch, 1)]
    done = [tables.append_results(spark, path, rows, feed="csv", number=number) for rows, number in uploads]
    counts = [(i, c.submitted, c.inserted, c.duplicates, c.replayed) for i, c in enumerate(done)]
    return spark.createDataFrame(counts, "upload int, submitted long, inserted long, duplicates long, replayed boolean")


def concurrent_inserts(spark, sf_dir):
    """Two feeds that write at the same time and share a third of their results."""
    rows = adapter.lab_events(spark, sf_dir).select("event_id", *OBSERVATION_COLUMNS).withColumn("seq", F.lit(0))
    path = _folder(spark, "store")

    def write(rest: int) -> None:
        mine = rows.where(F.col("event_id") % 3 != rest).drop("event_id")
        tables.append_results(spark, path, mine, feed=f"feed-{rest}", number=0)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, (0, 1)))
    return _stored_columns(tables.read_results(spark, path))


def stored_demographics(spark, sf_dir):
    """Demographics of two uploads, read back: the later one corrects, to null as well."""
    stored, fixes = _demographics_upload(spark, sf_dir)
    path = _folder(spark, "people")
    tables.append_demographics(spark, path, stored.withColumn("seq", F.lit(0)))
    tables.append_demographics(spark, path, fixes)
    return tables.read_demographics(spark, path)


def stored_reports(spark, sf_dir):
    """Written reports, read back."""
    path = _folder(spark, "reports")
    views.write_series(_observations(spark, sf_dir), adapter.demographics(spark, sf_dir), path, DEFAULT, _plan(spark, sf_dir))
    return spark.read.parquet(f"{path}/reports").select(
        "patient_id", "code", "derived", "status", F.col("baseline.n").cast("int").alias("base_n"), F.size("signals").alias("n_signals")
    )


def stored_jumps(spark, sf_dir):
    """Written RCV jumps, read back."""
    path = _folder(spark, "reports")
    views.write_series(_observations(spark, sf_dir), adapter.demographics(spark, sf_dir), path, DEFAULT, _plan(spark, sf_dir))
    return spark.read.parquet(f"{path}/jumps").select(*KEY, "from_t", "to_t", *r("change"))


def stream_equals_batch(spark, sf_dir):
    """Status after two micro-batches of uploads, the second with late results and repeats, without demographics."""
    root, rows = _folder(spark, "stream"), _csv_rows(spark, sf_dir)
    store = uploads.Store(f"{root}/store")
    for turn, part in enumerate((rows.where("event_id % 2 = 0"), rows)):
        _write_csv(part, f"{root}/in/{turn}", _files(part, 2))
        uploads.run_csv(spark, f"{root}/in/*", store, f"{root}/checkpoint").awaitTermination()
    return uploads.current_status(spark, store).select(*KEY, "status")


QUERIES = {
    "triage_ranked": triage_ranked,
    "triage": patient_triage,
    "signals": all_signals,
    **{f"signals_{rule}": _rule(rule) for rule in profiles.RULES},
    "signal_explanations": signal_explanations,
    "normal_cdf": normal_cdf_values,
    **{
        f.__name__: f
        for f in (
            biomarker_stats, patient_listing, patient_codes, canonical_codes, normalise_units, unit_spellings, unprofiled_units,
            parse_taken_at, csv_rejects, fhir_skip_reasons, fhir_observations, fhir_patients, skip_histogram,
            idempotent_insert, upload_summary, upsert_demographics, dedupe_results, plausibility,
            series_as_recorded, exclusions, as_of_exclusions, latest_results, recent_results, baselines, rcv_limits,
            rcv_jumps, change_points, ewma, mann_kendall, sen_slope, trends, trends_window, signals_as_of, signals_odd_values, report_fields, threshold_hits, egfr_values, egfr_series,
            egfr_not_derived, kdigo_stage, series_status, deciding_rule, not_assessed, drift_reports, review_fold,
            signal_reviews, unreviewed_signals, stale_reviews, review_snapshots, identifier_screen, review_rejects,
            point_annotations, series_table, explain_context, stub_drafts, draft_audit,
            csv_import, fhir_bundle, fhir_ndjson, landing_folder, stored_insert, upload_commits, concurrent_inserts,
            stored_demographics, stored_reports, stored_jumps, stream_equals_batch,
        )
    },
}
