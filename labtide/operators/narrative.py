"""Text made from a report: a sheet of its facts, a draft that restates them, and the audit of other drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.functions.text import display_unit, fixed, iso_date, pct, signed_pct, text, value

DISCLAIMER = "Made from computed results on synthetic data. The results stand as computed; a clinician reviews the wording."
DRAFT_FIELDS = ["summary", "interpretation", "follow_up", "limitations", "status"]


def _fact(name: str, *parts) -> Column:
    """A line ``name = text``; no line where any part is missing."""
    return text(f"{name} = ", *parts)


def _numbered(name: str, column: str, one) -> Column:
    """A line per element of an array, numbered from 1; no line for an empty array."""
    lines = F.transform(column, lambda x, i: text(f"{name} ", (i + 1).cast("string"), " = ", one(x)))
    return F.when(F.size(column) > 0, F.array_join(lines, "\n"))


def _limit(x: Column) -> Column:
    return text(value(x.value), F.when(x.direction == "above", " or more: ").otherwise(" as lower bound: "), x.label, "; ", x.source)


def explain_context(reports: DataFrame, as_of_requested: bool = False) -> DataFrame:
    """One sheet of facts per report, a line each; the patient's id is not among them.

    ``as_of_requested`` says whether the day that the analysis ends on was asked for.
    """
    rows = reports.withColumns({
        "shown": F.coalesce(display_unit(F.col("unit")), F.lit("no unit")), "listed": F.array_sort("thresholds", lambda a, b: a.ord - b.ord),
    })
    between = lambda low, high: text(value(F.col(low)), " to ", value(F.col(high)))
    end = "the requested day" if as_of_requested else "the latest result"
    sheet = [
        F.coalesce(
            _fact("analyte", F.col("display"), "; LOINC ", F.col("loinc"), "; measured in ", F.col("shown")),
            _fact("analyte", F.col("code"), "; without a profile; measured in ", F.col("shown")),
        ),
        _fact("status", "", F.col("status"), ", as computed"),
        F.coalesce(
            _fact("period", F.col("window_days").cast("string"), f" days for trends, up to {end}, ", iso_date(F.col("as_of"))),
            _fact("period", F.col("window_days").cast("string"), f" days for trends, up to {end}"),
        ),
        _fact("latest", value(F.col("latest_v")), " on ", iso_date(F.col("latest_t"))),
        _fact("own level", value(F.col("set_point")), ", from ", F.col("base_n").cast("string"), " results up to ", iso_date(F.col("base_to"))),
        _fact("own interval", between("prri_low", "prri_high"), " for 95 of 100 results"),
        _fact("variation", pct(F.col("cvi")), " within a person, ", pct(F.col("cva")), " of the method"),
        _fact("population", between("pop_low", "pop_high"), "; ", F.col("pop_source")),
        _numbered("limit", "listed", _limit),
        F.when(F.size("signals") == 0, "findings = none; that is no proof of health"),
        _numbered("finding", "signals", lambda s: text(s.severity, " by ", s.rule, ": ", s.explanation, "; ", s.source)),
        _numbered("gap", "not_assessed", lambda s: text(s.rule, ", ", s.reason)),
        F.when(
            F.col("trend_done"),
            _fact("trend", F.col("direction"), ", ", signed_pct(F.col("change_per_year")), " in a year, p ", fixed(F.col("mk_p"), 3)),
        ),
        _fact("history", F.array_join(F.transform("recent", lambda p: text(iso_date(p.t), ": ", value(p.v))), ", ")),
        F.lit("wanted = an account of these findings for the clinician, with severities as given"),
    ]
    return rows.select("patient_id", "code", "derived", F.concat_ws("\n", *sheet).alias("context"))


def stub_drafts(reports: DataFrame) -> DataFrame:
    """A draft without a model: counts, the sentences of the findings, and what was left unjudged."""
    of = lambda severity: F.size(F.filter("signals", lambda s: s.severity == severity)).cast("string")
    told = F.array_join(F.transform(F.filter("signals", lambda s: s.sev_rank > 0), lambda s: s.explanation), " ")
    gaps = F.array_join(F.transform("not_assessed", lambda s: text(s.rule, " (", s.reason, ")")), ", ")
    return reports.select(
        "patient_id", "code", "derived",
        F.concat_ws(
            " ",
            text(F.coalesce("display", "code"), ": ", of("alert"), " alerts, ", of("watch"), " watches, ", of("info"), " notes."),
            F.when(told != "", told),
        ).alias("summary"),
        F.when(told == "", "The results move as this person's results usually do.").otherwise(
            "Before a cause is looked for: does the change exceed what the method and the person vary by, and was the sample sound?"
        ).alias("interpretation"),
        F.when(F.col("status") == "alert", "Confirm with a second sample and check treatment and recent illness.")
        .when(F.col("status") == "watch", "Compare with the next regular sample.")
        .otherwise("Nothing beyond the regular samples follows from these results.").alias("follow_up"),
        F.concat_ws(
            " ", F.lit("Made from results alone: symptoms, medicines and history are unknown here."),
            F.when(gaps != "", text("The rules that could not judge: ", gaps, ".")),
        ).alias("limitations"),
        "status",
    )


def parse_draft(raw: Column) -> Column:
    """Struct of the five required text fields; null unless every one is present as a string."""
    doc = F.try_parse_json(raw)
    fields, ok = [], doc.isNotNull()
    for name in DRAFT_FIELDS:
        field = F.try_variant_get(doc, f"$.{name}", "variant")
        ok = ok & F.coalesce(F.schema_of_variant(field) == "STRING", F.lit(False))
        fields.append(F.try_variant_get(doc, f"$.{name}", "string").alias(name))
    return F.when(ok, F.struct(*fields))


def draft_audit(drafts: DataFrame, reports: DataFrame) -> DataFrame:
    """Model drafts (series key, ``draft`` JSON) with the computed status put in their place."""
    computed = reports.select(
        "patient_id", "code", "derived", F.col("status").alias("computed_status"), "signals", "not_assessed"
    )
    parsed = drafts.withColumn("parsed", parse_draft(F.col("draft")))
    return parsed.join(computed, ["patient_id", "code", "derived"]).select(
        "patient_id",
        "code",
        "derived",
        F.col("parsed").isNotNull().alias("valid"),
        F.col("parsed.summary").alias("summary"),
        F.col("parsed.interpretation").alias("interpretation"),
        F.col("parsed.follow_up").alias("follow_up"),
        F.col("parsed.limitations").alias("limitations"),
        F.when(F.col("parsed").isNotNull(), F.col("computed_status")).alias("status"),
        (F.col("parsed.status") != F.col("computed_status")).alias("status_overridden"),
        "signals",
        "not_assessed",
        F.lit(DISCLAIMER).alias("disclaimer"),
    )
