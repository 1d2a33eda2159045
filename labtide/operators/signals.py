"""From detector facts to ranked, explained signals, skipped rules and a status."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtide.functions.stats import DAYS_PER_YEAR, Z95, Z99, rcv_down, rcv_up
from labtide.functions.text import display_unit, fixed, iso_date, p_value, pct, signed_pct, text, value
from labtide.operators.series import NO_ADULT_RESULTS, NO_DEMOGRAPHICS, SEX_NOT_BINARY

# Where each method comes from.
SOURCES = {
    "prri": "personalised reference interval on the log scale, Clin Chem 2021;67:374",
    "rcv": "log-normal reference change value, Clin Chem 2006;52:1602",
    "shift": "tabular CUSUM with k 0.5 and h 5 (Montgomery, ch. 9), standardised by CVI and CVA",
    "ewma": "EWMA with lambda 0.2 and L 3 (Montgomery, ch. 9), standardised by CVI and CVA",
    "trend": "Mann-Kendall test and Sen slope with its distribution-free interval (Gilbert 1987, ch. 16)",
}

SIGNAL = (
    "struct<neg_rank:int,seq:int,rule:string,severity:string,sev_rank:int,t:bigint,value:double,"
    "threshold:double,explanation:string,source:string>"
)
SIGNAL_COLUMNS = ["seq", "rule", "severity", "sev_rank", "t", "value", "threshold", "explanation", "source"]
EGFR_REASONS = {
    NO_DEMOGRAPHICS: "eGFR needs a recorded sex and birth year",
    SEX_NOT_BINARY: "eGFR (CKD-EPI 2021) needs sex recorded as female or male",
    NO_ADULT_RESULTS: "eGFR (CKD-EPI 2021) is defined for adults of 18 years or more",
}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "alert", 2).when(severity == "watch", 1).when(severity == "info", 0)


def _signal(fires: Column, seq: int, rule: str, severity: Column, value_: Column, limit: Column,
            explanation: Column, source: Column | str) -> Column:
    rank = severity_rank(severity)
    return F.when(
        fires,
        F.struct(
            (-rank).cast("int").alias("neg_rank"),
            F.lit(seq).alias("seq"),
            F.lit(rule).alias("rule"),
            severity.alias("severity"),
            rank.alias("sev_rank"),
            F.col("latest_t").alias("t"),
            value_.alias("value"),
            limit.alias("threshold"),
            explanation.alias("explanation"),
            (F.lit(source) if isinstance(source, str) else source).alias("source"),
        ),
    )


def _name() -> Column:
    return F.coalesce("display", "code")


def prri() -> Column:
    z, size = F.col("prri_z"), F.abs("prri_z")
    above = z > 0
    unit = display_unit(F.col("unit"))
    return _signal(
        size > Z95,
        1,
        "prri",
        F.when(size > Z99, "alert").otherwise("watch"),
        F.col("latest_v"),
        F.when(above, F.col("prri_high")).otherwise(F.col("prri_low")),
        text(
            _name(), " ", value(F.col("latest_v")), " ", unit, " lies ", F.when(above, "above").otherwise("below"),
            " the personal reference interval ", value(F.col("prri_low")), "–", value(F.col("prri_high")), " ", unit,
            ", a 95 % prediction from ", F.col("base_n").cast("string"), " results (", iso_date(F.col("base_from")),
            " to ", iso_date(F.col("base_to")), ") around a set point of ", value(F.col("set_point")), " ", unit,
            " with CVI ", pct(F.col("cvi")), " and CVA ", pct(F.col("cva")), ".",
        ),
        SOURCES["prri"],
    )


def shift() -> Column:
    after, low, high = F.col("cp_after"), F.col("prri_low"), F.col("prri_high")
    unit = display_unit(F.col("unit"))
    return _signal(
        (after > high) | (after < low),
        2,
        "shift",
        F.lit("watch"),
        after,
        F.when(after > high, high).otherwise(low),
        text(
            "Level shift: from ", iso_date(F.col("cp_t")), " on, ", _name(), " averages ", value(after), " ", unit,
            " (", signed_pct(F.col("cp_change")), " against the set point ", value(F.col("set_point")), " ", unit,
            ") and is outside the personal reference interval; the CUSUM limit was crossed on ",
            iso_date(F.col("cp_detected_t")), ".",
        ),
        SOURCES["shift"],
    )


def ewma() -> Column:
    r, w = F.col("ewma_robust"), F.col("ewma_width")
    above = r > w
    unit = display_unit(F.col("unit"))
    return _signal(
        above | (r < -w),
        3,
        "ewma",
        F.lit("watch"),
        F.col("ewma_value"),
        F.when(above, F.col("ewma_high")).otherwise(F.col("ewma_low")),
        text(
            "Smoothed ", _name(), " (EWMA ", value(F.col("ewma_value")), " ", unit, ") has moved ",
            F.when(above, "above").otherwise("below"), " its control limits ", value(F.col("ewma_low")), "–",
            value(F.col("ewma_high")), " ", unit, ": small changes in one direction have added up.",
        ),
        SOURCES["ewma"],
    )


def rcv() -> Column:
    change, sigma = F.col("last_change"), F.col("sigma")
    beyond = lambda z: (change > rcv_up(sigma, z)) | (change < rcv_down(sigma, z))
    unit = display_unit(F.col("unit"))
    return _signal(
        beyond(Z95),
        4,
        "rcv",
        F.when(beyond(Z99), "alert").otherwise("watch"),
        F.col("latest_v"),
        F.when(change > 0, F.col("rcv_up")).otherwise(F.col("rcv_down")),
        text(
            _name(), " moved ", signed_pct(change), " from ", value(F.col("previous_v")), " ", unit, " on ",
            iso_date(F.col("previous_t")), " to ", value(F.col("latest_v")), " ", unit, " on ",
            iso_date(F.col("latest_t")), ", beyond the reference change value of ", signed_pct(F.col("rcv_up")),
            " / ", signed_pct(F.col("rcv_down")), " that analytical and within-subject variation explain.",
        ),
        SOURCES["rcv"],
    )


def _crossed(direction: str) -> Column:
    """Most severe threshold of one side met by the latest result; ties go to the last listed."""
    met = F.filter(
        "thresholds",
        lambda x: (x.direction == direction)
        & ((F.col("latest_v") >= x.value) if direction == "above" else (F.col("latest_v") < x.value)),
    )
    return F.try_element_at(met, F.lit(-1))


def threshold(direction: str) -> Column:
    hit = F.col(f"hit_{direction}")
    return _signal(
        hit.isNotNull(),
        6 if direction == "above" else 7,
        "threshold",
        hit.severity,
        F.col("latest_v"),
        hit.value,
        text(
            _name(), " of ", value(F.col("latest_v")), " ", display_unit(F.col("unit")), " on ",
            iso_date(F.col("latest_t")), ": ", hit.label, ".",
        ),
        hit.source,
    )


def population() -> Column:
    v, low, high = F.col("latest_v"), F.col("pop_low"), F.col("pop_high")
    above = (v > high) & F.col("hit_above").isNull()
    below = (v < low) & F.col("hit_below").isNull()
    unit = display_unit(F.col("unit"))
    return _signal(
        above | below,
        5,
        "population",
        F.lit("info"),
        v,
        F.when(v > high, high).otherwise(low),
        text(
            _name(), " of ", value(v), " ", unit, " is ", F.when(v > high, "above").otherwise("below"),
            " the population reference interval ", value(low), "–", value(high), " ", unit, ".",
        ),
        F.col("pop_source"),
    )


def trend() -> Column:
    yearly, cvi = F.col("change_per_year"), F.col("cvi")
    large = cvi.isNull() | (F.abs(yearly) >= cvi)
    unit = display_unit(F.col("unit"))
    per_year = lambda c: value(F.col(c) * DAYS_PER_YEAR)
    return _signal(
        F.col("direction").isin("rising", "falling") & large,
        8,
        "trend",
        F.lit("watch"),
        F.col("latest_v"),
        cvi,
        text(
            _name(), " is ", F.col("direction"), " by about ", signed_pct(yearly), " a year (Sen slope ",
            per_year("sen_slope"), " ", unit, "/year, 95 % CI ", per_year("sen_low"), " to ", per_year("sen_high"),
            "; Mann–Kendall tau ", fixed(F.col("mk_tau"), 2), ", ", p_value(F.col("mk_p")), "; ",
            F.col("trend_n").cast("string"), " results from ", iso_date(F.col("trend_from")), " on)",
            F.when(cvi.isNull(), "").otherwise(
                text(", which exceeds the within-subject variation of ", pct(F.coalesce(cvi, F.lit(0.0))))
            ),
            ".",
        ),
        SOURCES["trend"],
    )


def _skip(rule: str, seq: int, why: Column | str, applies: Column) -> Column:
    return F.when(
        applies,
        F.struct(
            F.lit(seq).alias("seq"),
            F.lit(rule).alias("rule"),
            (F.lit(why) if isinstance(why, str) else why).alias("reason"),
        ),
    )


def not_assessed(window_days: int) -> Column:
    """Rules that could not run, with the reason, in report order."""
    empty = F.col("n") == 0
    no_profile = F.col("analyte").isNull()
    profiled = ~empty & ~no_profile
    short = profiled & ~F.col("non_positive") & F.col("base_n").isNull()
    nothing = "nothing to assess on or before the as-of date"
    unknown = text("no biological variation or limits are known for code ", F.col("code"))
    few = text(
        "needs ≥ 3 earlier results for a personal set point (has ", (F.col("n") - 1).cast("string"), ")"
    )
    log_scale = "values at or below zero have no log scale"
    skips = []
    for seq, rule in enumerate(("prri", "rcv", "shift", "ewma"), start=1):
        why = (
            F.when(empty, nothing).when(no_profile, unknown).when(F.col("non_positive"), log_scale)
            .when(F.lit(rule == "rcv"), F.lit("needs 2 results")).otherwise(few)
        )
        applies = empty | no_profile | F.col("non_positive")
        applies = applies | ((F.col("n") == 1) if rule == "rcv" else short)
        # with too few results the pair rule is reported after the baseline rules
        order = 5 if rule == "rcv" else seq
        skips.append(_skip(rule, seq, why, applies & (empty | no_profile | F.col("non_positive"))))
        skips.append(_skip(rule, order, why, applies & ~(empty | no_profile | F.col("non_positive"))))
    skips.append(
        _skip(
            "threshold",
            6,
            F.when(empty, nothing).when(no_profile, unknown).otherwise(
                "this analyte has no clinical thresholds"
            ),
            F.col("creat_note").isNull() & (empty | no_profile | (F.size("thresholds") == 0)),
        )
    )
    skips.append(
        _skip(
            "population",
            7,
            F.when(empty, nothing).when(no_profile, unknown).otherwise(
                "this analyte has no single population interval"
            ),
            empty | no_profile | F.col("pop_low").isNull(),
        )
    )
    skips.append(
        _skip(
            "trend",
            8,
            F.when(empty, nothing).otherwise(
                text(
                    f"needs ≥ 4 results in the last {window_days} days (has ", F.col("trend_n").cast("string"), ")"
                )
            ),
            empty | ~F.col("trend_done"),
        )
    )
    note = F.when(
        F.col("creat_note") == "derived", "KDIGO categories are judged on the derived eGFR series"
    )
    for key, why in EGFR_REASONS.items():
        note = note.when(F.col("creat_note") == key, f"no kidney staging: {why}")
    skips.append(_skip("threshold", 9, note, F.col("creat_note").isNotNull()))
    return F.sort_array(F.array_compact(F.array(*skips)))


@cache
def _steps(window_days: int) -> list[dict[str, Column]]:
    ranked = F.array(
        prri(), shift(), ewma(), rcv(), population(), threshold("above"), threshold("below"), trend()
    )
    rank = F.when(F.size("signals") > 0, F.get("signals", F.lit(0)).sev_rank).otherwise(0)
    return [
        {"hit_above": _crossed("above"), "hit_below": _crossed("below")},
        {
            "signals": F.sort_array(F.array_compact(ranked)),
            "not_assessed": not_assessed(window_days),
        },
        {"status_rank": rank},
        {"status": status_name(F.col("status_rank"))},
    ]


def status_name(rank: Column) -> Column:
    return F.when(rank == 2, "alert").when(rank == 1, "watch").otherwise("normal")


def with_signals(facts: DataFrame, window_days: int) -> DataFrame:
    """Signals worst first (stable on emission order), skipped rules, rank and status."""
    for step in _steps(window_days):
        facts = facts.withColumns(step)
    return facts


def explode_signals(reports: DataFrame) -> DataFrame:
    """One row per signal; ``position`` is its place in the report."""
    return _exploded(reports, "signals", SIGNAL_COLUMNS)


def explode_not_assessed(reports: DataFrame) -> DataFrame:
    return _exploded(reports, "not_assessed", ["rule", "reason"])


def _exploded(reports: DataFrame, column: str, fields: list[str]) -> DataFrame:
    # The outer form keeps the optimizer from deriving "size(column) > 0" and copying the
    # whole detector chain into a filter below it; empty arrays are dropped afterwards.
    return (
        reports.select("patient_id", "code", "derived", F.posexplode_outer(column).alias("position", "s"))
        .where("position IS NOT NULL")
        .select("patient_id", "code", "derived", "position", *[F.col(f"s.{f}").alias(f) for f in fields])
    )
