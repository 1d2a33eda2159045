"""Golden clinical scenarios: every case is one series of a single cohort run."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import DAY, SIGMA, START_T, WEEK, demographics, noise, observations, sequential, theil_sen, weekly
from labtide.operators import narrative, normalise, points, reports, signals
from labtide.options import Options


def step(a, na, b, nb, width=0.0, seed=1):
    wave = noise(seed, na + nb, width)
    return [(a if i < na else b) * wave[i] for i in range(na + nb)]


SMALL_SHIFT = 96 * math.exp(1.2 * SIGMA["LDL"])
CASES = {
    "step": ("HBA1C", "%", step(5.3, 26, 6.8, 17, 0.004, 7)),
    "small_shift": ("LDL", "mg/dL", [96.0] * 14 + [SMALL_SHIFT] * 15),
    "creat_noise": ("CREAT", "mg/dL", [0.88 * w for w in noise(17, 40, 0.025)]),
    "sparse": ("HBA1C", "%", [5.2, 5.3]),
    "single": ("HBA1C", "%", [5.2]),
    "tsh_noise": ("TSH", "mIU/L", [1.7 * w for w in noise(29, 40, 0.08)]),
    "ldl_rise": ("LDL", "mg/dL", [(98 + 0.36 * i) * w for i, w in enumerate(noise(23, 44, 0.015))]),
    "creat_up": ("CREAT", "mg/dL", [0.9] * 9 + [1.45, 1.5, 1.47]),
    "tsh_high": ("TSH", "mIU/L", [6.4] * 9),
    "creat_high": ("CREAT", "mg/dL", [1.52] * 9),
    "spike": ("CREAT", "mg/dL", [0.9] * 9 + [1.5]),
    "reverted": ("CREAT", "mg/dL", [0.9] * 9 + [1.5, 0.91, 0.9, 0.92]),
    "diet": ("LDL", "mg/dL", [148.0] * 6 + [148 - 4.5 * i for i in range(1, 13)]),
    "unknown": ("QQQ", "U/L", [30.0 + 2 * i for i in range(12)]),
    "bad_unit": ("LDL", "stone", [90.0] * 4),
    "zero": ("TSH", "mIU/L", [1.6, 0.0, 1.7, 1.6, 1.8, 1.7]),
    "suppressed": ("TSH", "mIU/L", [0.04] * 6),
}


@pytest.fixture(scope="module")
def cohort(spark):
    rows = [r for name, (code, unit, values) in CASES.items() for r in weekly(name, code, values, unit)]
    mixed = weekly("units", "4548-4", [5.1] * 5, "%") + weekly("units", "4548-4", [32.2] * 4, "mmol/mol", 5)
    rows += mixed + weekly("units", "4548-4", [5.1], "mg/dL", 9)
    rows += weekly("nan", "LDL", [90.0, float("inf"), float("nan"), 92.0], "mg/dL")
    return observations(spark, rows)


@pytest.fixture(scope="module")
def run(cohort):
    rows = reports.reports(cohort, None, Options(window_days=365)).collect()
    return {r.patient_id: r for r in rows}


def rules(row):
    return [s.rule for s in row.signals]


def skipped(row):
    return {s.rule: s.reason for s in row.not_assessed}


def test_step_into_the_diabetes_range_alerts(run):
    r = run["step"]
    assert r.status == "alert"
    by_rule = {s.rule: s for s in r.signals}
    assert by_rule["prri"].severity == "alert" and by_rule["threshold"].severity == "alert"
    assert "diabetic limit" in by_rule["threshold"].explanation
    assert abs(r.set_point - 5.3) < 0.05
    assert r.cp_t == START_T + 26 * WEEK and "shift" in by_rule


@pytest.mark.parametrize("window", [45, 120])
def test_the_alert_does_not_depend_on_the_window(cohort, window):
    only = cohort.where("patient_id = 'step'")
    r = reports.reports(only, None, Options(window_days=window)).first()
    assert r.status == "alert" and r.cp_t == START_T + 26 * WEEK


def test_results_after_as_of_are_excluded(cohort):
    only = cohort.where("patient_id = 'creat_noise'")
    at = START_T + 15 * WEEK
    cut = reports.reports(only, None, Options(as_of=at)).first().asDict(True)
    truncated = reports.reports(
        only.where(F.unix_timestamp("taken_at") <= at), None, Options(as_of=at)
    ).first().asDict(True)
    assert cut["after_as_of"] == 24 and cut["n"] == 16 and cut["latest_t"] == at
    truncated["after_as_of"] = 24
    assert cut == truncated
    none = reports.reports(only, None, Options(as_of=START_T - DAY)).first()
    assert none.n == 0 and none.status == "normal" and len(none.not_assessed) == 7


def test_small_shift_is_caught_by_ewma_not_prri(run):
    r = run["small_shift"]
    assert "ewma" in rules(r) and "prri" not in rules(r)
    assert r.cp_t is not None and r.status == "watch"


def test_noise_within_biological_variation_is_normal(run):
    assert run["creat_noise"].status == "normal" and rules(run["creat_noise"]) == []


def test_sparse_history_says_what_it_could_not_assess(run):
    r = run["sparse"]
    assert r.base_n is None and r.status == "normal"
    why = skipped(r)
    assert "≥ 3 earlier results" in why["prri"] and "(has 1)" in why["prri"]
    assert "trend" in why and "rcv" not in why
    assert skipped(run["single"])["rcv"] == "needs 2 results"


def test_noise_is_no_trend_and_a_rise_is(run):
    assert run["tsh_noise"].direction == "flat" and "trend" not in rules(run["tsh_noise"])
    r = run["ldl_rise"]
    assert r.direction == "rising" and r.sen_low > 0
    assert sorted(rules(r)) == ["ewma", "trend"] and r.status == "watch"


def test_every_signal_is_explained_sourced_and_ordered(run):
    for r in run.values():
        for s in r.signals:
            assert len(s.explanation) > 40 and s.source
        ranks = [s.sev_rank for s in r.signals]
        assert ranks == sorted(ranks, reverse=True)
        assert {"normal": 0, "watch": 1, "alert": 2}[r.status] == max([x for x in ranks if x > 0], default=0)
        assert not {s.rule for s in r.signals} & ({n.rule for n in r.not_assessed} - {"threshold"})


def test_units_are_normalised_and_unknown_units_counted(run):
    r = run["units"]
    assert r.unit == "%" and r.unit_unknown == 1 and r.n == 9
    assert all(abs(p.v - 5.1) < 0.05 for p in r.points) and r.status == "normal"
    assert run["bad_unit"].n == 0 and run["bad_unit"].unit_unknown == 4 and len(run["bad_unit"].not_assessed) == 7
    assert run["nan"].n == 2 and run["nan"].unit_unknown == 0


def test_population_context(run):
    assert rules(run["tsh_high"]) == ["threshold"] and run["tsh_high"].status == "watch"
    assert "over its interval" in run["tsh_high"].signals[0].explanation
    assert rules(run["creat_high"]) == ["population"] and run["creat_high"].status == "normal"
    assert "threshold" in skipped(run["creat_high"])
    assert [s.severity for s in run["suppressed"].signals if s.rule == "threshold"] == ["alert"]


def test_spike_alerts_then_reverts(run, cohort):
    assert {"rcv", "prri"} <= set(rules(run["spike"])) and run["spike"].status == "alert"
    after = run["reverted"]
    assert after.cp_t is None and not {"prri", "shift", "rcv"} & set(rules(after))
    jumps = points.jumps(reports.all_points(cohort.where("patient_id = 'reverted'")))
    assert jumps.count() == 2


def test_treatment_shows_as_a_falling_trend_below_the_personal_interval(run):
    r = run["diet"]
    assert r.direction == "falling" and "threshold" not in rules(r)
    assert "below" in next(s.explanation for s in r.signals if s.rule == "prri")


def test_unknown_analyte_runs_only_the_trend(run):
    r = run["unknown"]
    assert rules(r) == ["trend"] and r.unit == "U/L" and len(r.not_assessed) == 6


def test_non_positive_values_have_no_log_scale(run):
    assert {"prri", "rcv", "shift", "ewma"} <= skipped(run["zero"]).keys()


def test_detectors_equal_their_defining_loops(run):
    for name, (code, _unit, values) in CASES.items():
        r = run[name]
        if code not in SIGMA or r.n == 0 or min(values) <= 0:
            continue
        want = sequential(values, SIGMA[code])
        if want is None:
            assert r.base_n is None
            continue
        assert r.base_n == want["base_n"] and math.isclose(r.set_point, want["set_point"], rel_tol=1e-12)
        assert math.isclose(r.ewma_robust, want["robust"], rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r.ewma_value, want["ewma"], rel_tol=1e-9)
        if want["change"] is None:
            assert r.cp_t is None
        else:
            start, alarm = want["change"]
            assert (r.cp_t, r.cp_detected_t) == (START_T + start * WEEK, START_T + alarm * WEEK)
            assert math.isclose(r.cp_after, want["after"], rel_tol=1e-12)


def test_trend_equals_the_double_loop(run):
    for name, (_code, _unit, values) in CASES.items():
        r = run[name]
        if not r.trend_done:
            continue
        t = [START_T + i * WEEK for i in range(len(values))]
        s, slopes = theil_sen(t, values)
        assert r.mk_s == s and r.sen_n == len(slopes)
        mid = len(slopes)
        assert math.isclose(r.sen_slope, (slopes[(mid - 1) // 2] + slopes[mid // 2]) / 2, rel_tol=1e-9, abs_tol=1e-12)


def test_egfr_is_derived_like_any_series(spark):
    rows = weekly("f", "CREAT", [1.15], "mg/dL") + weekly("f", "CREAT", [1.15 * 88.42], "umol/L", 1)
    rows += weekly("f", "CREAT", [2.0], "g/L", 2) + weekly("minor", "CREAT", [0.7] * 5, "mg/dL")
    rows += weekly("other", "CREAT", [0.7] * 5, "mg/dL") + weekly("nobody", "CREAT", [0.7] * 5, "mg/dL")
    people = [("f", "female", 1970), ("minor", "male", 2012), ("other", "other", 1981)]
    out = {(r.patient_id, r.code): r for r in
           reports.reports(observations(spark, rows), demographics(spark, people)).collect()}
    egfr = out[("f", "EGFR")]
    by_hand = 142 * (1.15 / 0.7) ** -1.2 * 0.9938**55 * 1.012
    assert egfr.n == 2 and egfr.derived and math.isclose(egfr.points[0].v, by_hand, rel_tol=1e-9)
    assert abs(egfr.points[0].v - egfr.points[1].v) < 1e-6
    assert "kidney stage G3a" in egfr.signals[0].explanation
    reason = lambda p: skipped(out[(p, "CREAT")])["threshold"]
    assert "derived eGFR" in reason("f") and "adults" in reason("minor")
    assert "female or male" in reason("other") and "birth year" in reason("nobody")
    assert not {("minor", "EGFR"), ("other", "EGFR"), ("nobody", "EGFR")} & out.keys()
    assert [n.rule for n in out[("f", "CREAT")].not_assessed].count("threshold") == 1


def test_order_time_shift_and_scale_do_not_matter(spark):
    rows, shifted, scaled = [], [], []
    for i in range(400):
        wave = noise(3 * i + 50, 5 + i % 23, 0.015 + 0.003 * (i % 37))
        values = [88 * w * (1.25 if j > 9 and i % 4 == 1 else 1) for j, w in enumerate(wave)]
        rows += weekly(f"s{i}", "LDL", values, "mg/dL")
        shifted += weekly(f"s{i}", "LDL", values, "mg/dL", first=57)
        scaled += weekly(f"s{i}", "LDL", [v * 1.5 for v in values], "mg/dL")

    def personal(data):
        df = signals.explode_signals(reports.reports(observations(spark, data)))
        rows_ = df.where("rule IN ('prri', 'rcv', 'shift', 'ewma', 'trend')").collect()
        return sorted((r.patient_id, r.rule, r.severity) for r in rows_)

    base = personal(rows)
    assert len(base) > 100
    assert base == personal(rows[::-1]) == personal(shifted) == personal(scaled)


def test_the_rank_trend_sees_only_the_order_of_values(spark):
    """Any growing function of the values leaves S and its p alone; a falling one turns the sign of S."""
    turns = {"as": lambda v: v, "cube": lambda v: v**3, "root": math.sqrt, "over": lambda v: 1 / v}
    rows = []
    for i in range(300):
        # rounded, so that values repeat within a series
        values = [round(40 * (1 + 0.004 * j * (i % 5 - 2)) * w) / 8 for j, w in enumerate(noise(7 * i + 2, 4 + i % 29, 0.06))]
        for name, turn in turns.items():
            rows += weekly(f"{name}-{i}", "QQQ", [turn(v) for v in values], "U/L")
    out = {r.patient_id: (r.mk_s, r.mk_p) for r in reports.reports(observations(spark, rows), None, Options(window_days=365)).collect() if r.trend_done}
    seen = [i for i in range(300) if f"as-{i}" in out]
    assert len(seen) > 200 and len({out[f"as-{i}"][0] for i in seen}) > 30
    for i in seen:
        s, p = out[f"as-{i}"]
        assert out[f"cube-{i}"] == out[f"root-{i}"] == (s, p)
        assert out[f"over-{i}"][0] == -s and math.isclose(out[f"over-{i}"][1], p, rel_tol=1e-12)


def test_context_and_drafts(run, spark, cohort):
    computed = reports.reports(cohort, None, Options(window_days=365))
    text = {r.patient_id: r.context for r in narrative.explain_context(computed).collect()}
    for needle in (
        "analyte = Hemoglobin A1c; LOINC 4548-4; measured in %",
        "status = alert, as computed",
        "own interval",
        "limit 2 = 6.50 or more: glycation at the diabetic limit",
        "finding 1 = alert by prri:",
        "wanted = ",
    ):
        assert needle in text["step"], text["step"]
    assert "findings = none; that is no proof of health" in text["creat_noise"]
    recent = next(x for x in text["creat_noise"].splitlines() if x.startswith("history"))
    assert recent.count(":") == 12
    assert all(name not in text[name] for name in ("creat_noise", "tsh_high", "ldl_rise"))
    lines = text["tsh_high"].splitlines()
    limits = [x for x in lines if x.startswith("limit ")]
    assert [x.split()[3] for x in limits] == ["4.50", "10.0", "0.45", "0.10"]
    assert "up to the latest result" in text["step"]
    dated = narrative.explain_context(reports.reports(cohort, None, Options(as_of=computed.first().as_of)), as_of_requested=True)
    assert all("up to the requested day" in r.context for r in dated.collect())

    drafts = {r.patient_id: r for r in narrative.stub_drafts(computed).collect()}
    assert drafts["creat_noise"].summary.startswith("Creatinine (serum/plasma): 0 alerts, 0 watches")
    assert "could not judge" in drafts["sparse"].limitations and drafts["step"].status == "alert"


def test_draft_audit_overrides_the_status(spark, cohort):
    computed = reports.reports(cohort.where("patient_id = 'step'"))
    raw = [
        '{"summary":"s","interpretation":"i","follow_up":"f","limitations":"l","status":"normal"}',
        '{"summary":"s","interpretation":"i","follow_up":"f","limitations":"l","status":"alert"}',
        '{"summary":"s"}', "not json",
        '{"summary":5,"interpretation":"i","follow_up":"f","limitations":"l","status":"alert"}',
    ]
    drafts = spark.createDataFrame(
        [("step", "HBA1C", False, d, i) for i, d in enumerate(raw)],
        "patient_id string, code string, derived boolean, draft string, i int",
    )
    out = narrative.draft_audit(drafts.drop("i"), computed).collect()
    assert sorted((r.valid, r.status, r.status_overridden) for r in out if r.valid) == [
        (True, "alert", False), (True, "alert", True)
    ]
    assert sum(not r.valid for r in out) == 3 and all(len(r.signals) >= 3 for r in out)


def test_canonical_codes_and_unit_keys(spark):
    df = spark.createDataFrame([("hba1c ",), ("2160-0",), ("zzz",)], "code string")
    assert [r.code for r in normalise.canonical_codes(df).collect()] == ["HBA1C", "CREAT", "ZZZ"]
    units = spark.createDataFrame(
        [("CREAT", 88.42, u) for u in ("µmol/L", "umol/L", "μmol/L", " UMOL / L ")] + [("TSH", 2.0, "mg/dL")],
        "analyte string, value double, unit string",
    )
    values = [r.v for r in normalise.with_canonical_value(units).collect()]
    assert sorted(v is None for v in values) == [False] * 4 + [True]
    assert all(abs(v - 1.0) < 1e-9 for v in values if v is not None)
