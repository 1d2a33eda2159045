"""Clinician reviews: constraint checks, the fold of the log, and the join to signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.functions.profiles import REVIEWED, RULES
from labtide.functions.text import stripped

ENGINE = "labtide 0.1"
ACTIONS = ["acknowledge", "annotate", "dismiss", "reopen"]
SIGNAL_KEY = ["patient_id", "code", "rule", "signal_t"]

# Patterns that look like a patient identifier, first match wins.
IDENTIFIERS = [
    ("an email address", r"[\w.+-]+@[\w-]+\.[\w.]+"),
    ("a phone number", r"\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b"),
    ("an ID number", r"\b\d{3}-\d{2}-\d{4}\b|\d{6,}"),
    ("an identifier keyword", r"(?i)\b(mrn|dob|ssn|date of birth|medical record|patient name)\b"),
]


def _might(text: Column) -> list[Column]:
    """Per pattern of IDENTIFIERS, what every text that it matches has; a single cheap pass rules out nearly all texts."""
    digits = F.rlike(text, F.lit(r"(?U)\d{3}"))
    # first letters times rests of the keywords, by the same case rules but without word boundaries
    keyword = F.rlike(text, F.lit("(?iu)[mdsp](?:rn|ob|sn|ate of birth|edical record|atient name)"))
    return [F.contains(text, F.lit("@")), digits, digits, keyword]


def identifier(text: Column) -> Column:
    """What kind of identifier the text looks like it contains, else null."""
    # (?U): letters and digits of every script, as in the patterns' own definition
    return F.coalesce(
        *(F.when(might & F.rlike(text, F.lit("(?U)" + pattern)), what) for (what, pattern), might in zip(IDENTIFIERS, _might(text), strict=True))
    )


def reject_reason(rule: Column, action: Column, reason: Column) -> Column:
    """Why a submitted review is refused; null when it is acceptable."""
    text = stripped(reason)
    blank = reason.isNull() | (text == "")
    size = F.char_length(text)
    found = identifier(text)
    return (
        F.when(rule.isNull() | ~rule.isin(*RULES), "unknown rule")
        .when(action.isNull() | ~action.isin(*ACTIONS), "unknown action")
        .when(blank & (action == "acknowledge"), F.lit(None).cast("string"))
        .when(blank, F.concat(F.lit("say why, to "), action))
        .when((size < 3) | (size > 500), "a reason has between 3 and 500 characters")
        .when(found.isNotNull(), F.concat(F.lit("the reason seems to hold "), found))
    )


def fold(events: DataFrame) -> DataFrame:
    """State of each reviewed signal: the latest decision by id; notes only count."""
    decides = F.col("action") != "annotate"
    last = F.max_by(
        F.when(decides, F.struct("action", "actor", "created_at", "reason")), F.when(decides, F.col("id"))
    )
    folded = events.groupBy(*SIGNAL_KEY).agg(last.alias("last"), F.count_if(~decides).alias("notes"))
    state = (
        F.when(F.col("last.action") == "acknowledge", "acknowledged")
        .when(F.col("last.action") == "dismiss", "dismissed")
        .otherwise("unreviewed")
    )
    decided = F.col("state") != "unreviewed"
    return folded.withColumn("state", state).select(
        *SIGNAL_KEY,
        "state",
        F.when(decided, F.col("last.actor")).alias("decided_by"),
        F.when(decided, F.col("last.created_at")).alias("decided_at"),
        F.when(decided, F.col("last.reason")).alias("reason"),
        "notes",
    )


def signal_reviews(signals: DataFrame, events: DataFrame) -> DataFrame:
    """Every signal with its review state; a new result makes a new, unreviewed signal."""
    folded = fold(events).withColumnRenamed("signal_t", "t")
    joined = signals.join(folded, ["patient_id", "code", "rule", "t"], "left")
    return joined.withColumn("state", F.coalesce("state", F.lit("unreviewed"))).withColumn(
        "notes", F.coalesce("notes", F.lit(0))
    )


def unreviewed(reviewed: DataFrame) -> DataFrame:
    """Watch and alert signals still waiting for a decision."""
    return reviewed.where("sev_rank > 0 AND state = 'unreviewed'")


def stale(submitted: DataFrame, signals: DataFrame) -> DataFrame:
    """Submitted reviews that name a signal the current analysis does not produce."""
    current = signals.select("patient_id", "code", "rule", F.col("t").alias("signal_t")).distinct()
    return submitted.join(current, SIGNAL_KEY, "left_anti")


def snapshot(reports: DataFrame, window_days: int) -> DataFrame:
    """Audit snapshot of every signal as computed: the signal and its context, as JSON."""
    rows = reports.select(
        "patient_id", "code", "derived", "status", "unit", "latest_t", "latest_v", "as_of", "base_n", "base_from",
        "base_to", "set_point", "prri_low", "prri_high", "analyte", F.explode_outer("signals").alias("s"),
    ).where("s IS NOT NULL")
    baseline = F.when(
        F.col("base_n").isNotNull(),
        F.struct(
            F.col("base_n").alias("n"), F.col("base_from").alias("from"), F.col("base_to").alias("to"),
            "set_point", "prri_low", "prri_high", F.lit(0.95).alias("level"),
        ),
    )
    body = F.struct(
        F.struct(*[F.col(f"s.{c}").alias(c) for c in ("rule", "severity", "t", "value", "threshold", "explanation", "source")]).alias("signal"),
        "status",
        "unit",
        F.struct(F.col("latest_t").alias("t"), F.col("latest_v").alias("v")).alias("latest"),
        baseline.alias("baseline"),
        "as_of",
        F.lit(window_days).alias("window_days"),
        F.when(F.col("analyte").isNotNull(), REVIEWED).alias("analyte_reviewed"),
        F.lit(ENGINE).alias("engine"),
    )
    return rows.select(
        "patient_id", "code", "derived", F.col("s.rule").alias("rule"), F.col("s.t").alias("signal_t"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("snapshot"),
    )


def accept(submitted: DataFrame, reports: DataFrame, signals: DataFrame, window_days: int) -> tuple[DataFrame, DataFrame]:
    """Split submitted reviews (signal key, action, reason, actor, created_at, id) into rows to
    append, carrying the server-side snapshot, and rejected rows with ``reject_reason``."""
    checked = submitted.withColumn(
        "reject_reason", reject_reason(F.col("rule"), F.col("action"), F.col("reason"))
    )
    # the derived series answers for its code when a measured one exists too
    snapshots = (
        snapshot(reports, window_days)
        .groupBy(*SIGNAL_KEY)
        .agg(F.max_by("snapshot", "derived").alias("computed"))
    )
    joined = checked.join(snapshots, SIGNAL_KEY, "left").withColumn(
        "reject_reason",
        F.coalesce("reject_reason", F.when(F.col("computed").isNull(), "no such signal in the current analysis")),
    )
    text = stripped("reason")
    accepted = (
        joined.where("reject_reason IS NULL")
        .withColumn("snapshot", F.col("computed"))
        .withColumn("reason", F.when(text != "", text))
        .select("id", *SIGNAL_KEY, "action", "reason", "actor", "snapshot", "created_at")
    )
    return accepted, joined.where("reject_reason IS NOT NULL").drop("computed")


def history(events: DataFrame, patient_id: str, code: str) -> DataFrame:
    """Audit trail of one biomarker, newest first."""
    return events.where((F.col("patient_id") == patient_id) & (F.col("code") == code.upper())).orderBy(F.desc("id"))
