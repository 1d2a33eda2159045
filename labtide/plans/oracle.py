"""Plain SQL statements of every query, for checking results with another engine.

Each string is a chain of CTEs over the driver tables and repeats the adapter's
arithmetic step by step. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import math

# Fixed values, written out here so that a wrong constant in the library shows as a difference.
SQRT2, Z95, Z99 = 1.4142135623730951, 1.959963985, 2.575829304
# erfc by the rational Chebyshev fit, constant term first
ERFC = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]
# code, name, canonical unit, CVI, CVA, population low and high
ANALYTES = [
    ("HBA1C", "Hemoglobin A1c", "%", 0.012, 0.015, 4.0, 5.6),
    ("LDL", "LDL cholesterol", "mg/dL", 0.078, 0.02, None, None),
    ("TSH", "Thyrotropin (TSH)", "m[IU]/L", 0.177, 0.03, 0.45, 4.5),
    ("CREAT", "Creatinine (serum/plasma)", "mg/dL", 0.044, 0.02, 0.59, 1.35),
    ("EGFR", "eGFR (CKD-EPI 2021, creatinine)", "mL/min/{1.73_m2}", 0.053, 0.024, None, None),
]
# spellings of the canonical unit, then units to convert with factor and offset
UNITS = {
    "HBA1C": (["%", "%hb", "%{hb}", "percent"], [("mmol/mol", 0.09148, 2.152)]),
    "LDL": (["mg/dl"], [("mmol/l", 38.67, 0.0)]),
    "TSH": (["m[iu]/l", "miu/l", "uiu/ml", "u[iu]/ml", "mu/l"], []),
    "CREAT": (["mg/dl"], [("umol/l", 1 / 88.42, 0.0)]),
    "EGFR": (["ml/min/{1.73_m2}", "ml/min/1.73m2"], []),
}
LOINC = {
    "HBA1C": ["4548-4", "17856-6"],
    "LDL": ["13457-7", "18262-6", "2089-1"],
    "TSH": ["3016-3", "11580-8"],
    "CREAT": ["2160-0", "38483-4"],
    "EGFR": ["98979-8"],
}
# analyte, place in its list, limit, side, severity, its rank, label
THRESHOLDS = [
    ("HBA1C", 0, 5.7, "above", "watch", 1, "raised glycation, between normal and diabetic"),
    ("HBA1C", 1, 6.5, "above", "alert", 2, "glycation at the diabetic limit"),
    ("LDL", 0, 130.0, "above", "info", 0, "LDL slightly over the desirable level"),
    ("LDL", 1, 160.0, "above", "watch", 1, "LDL clearly raised"),
    ("LDL", 2, 190.0, "above", "alert", 2, "LDL severely raised"),
    ("TSH", 0, 4.5, "above", "watch", 1, "TSH over its interval; look at free T4"),
    ("TSH", 1, 10.0, "above", "alert", 2, "TSH at a level that is usually treated"),
    ("TSH", 2, 0.45, "below", "watch", 1, "TSH under its interval; look at free T4 and T3"),
    ("TSH", 3, 0.1, "below", "alert", 2, "TSH hardly measurable"),
    ("EGFR", 0, 60.0, "below", "watch", 1, "kidney stage G3a"),
    ("EGFR", 1, 45.0, "below", "watch", 1, "kidney stage G3b"),
    ("EGFR", 2, 30.0, "below", "alert", 2, "kidney stage G4"),
    ("EGFR", 3, 15.0, "below", "alert", 2, "kidney stage G5"),
]
BOUNDS = {"HBA1C": (4.0, 15.0), "LDL": (20.0, 400.0), "CREAT": (0.3, 15.0), "TSH": (0.01, 100.0)}
IDENTIFIERS = [
    ("an email address", r"[\w.+-]+@[\w-]+\.[\w.]+"),
    ("a phone number", r"\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b"),
    ("an ID number", r"\b\d{3}-\d{2}-\d{4}\b|\d{6,}"),
    ("an identifier keyword", r"(?i)\b(mrn|dob|ssn|date of birth|medical record|patient name)\b"),
]


def _s(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(_s(x) for x in row) + ")" for row in rows)


_HORNER = _s(ERFC[-1])
for _c in reversed(ERFC[:-1]):
    _HORNER = f"({_s(_c)} + t * {_HORNER})"

CTES: dict[str, str] = {
    "ev": """SELECT event_id, user_id, event_type, value AS raw_value,
        (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) * 30 AS s FROM events""",
    "lab0": """SELECT *, s::DOUBLE / 86400::DOUBLE AS d,
        CASE event_type WHEN 'click' THEN 'HBA1C' WHEN 'view' THEN 'LDL' WHEN 'purchase' THEN 'TSH'
             WHEN 'signup' THEN 'CREAT' ELSE 'XERR' END AS code FROM ev""",
    "lab1": """SELECT *,
        CASE code WHEN 'HBA1C' THEN 5.4::DOUBLE WHEN 'LDL' THEN 118::DOUBLE
             WHEN 'TSH' THEN CASE WHEN user_id % 7 = 0 THEN 4::DOUBLE ELSE 2::DOUBLE END
             WHEN 'CREAT' THEN CASE WHEN user_id % 11 = 0 THEN 1.3::DOUBLE ELSE 0.95::DOUBLE END
             ELSE 50::DOUBLE END
        * CASE user_id % 5 WHEN 0 THEN 1::DOUBLE
             WHEN 1 THEN CASE WHEN d >= 450 THEN 1.3::DOUBLE ELSE 1::DOUBLE END
             WHEN 2 THEN 1::DOUBLE + 0.3::DOUBLE * d / 900::DOUBLE
             WHEN 3 THEN CASE WHEN event_id % 17 = 0 THEN 1.6::DOUBLE ELSE 1::DOUBLE END
             ELSE CASE WHEN d >= 600 THEN 0.7::DOUBLE ELSE 1::DOUBLE END END
        * (1::DOUBLE + 2::DOUBLE * CASE code WHEN 'HBA1C' THEN 0.012::DOUBLE WHEN 'LDL' THEN 0.078::DOUBLE
             WHEN 'TSH' THEN 0.177::DOUBLE WHEN 'CREAT' THEN 0.044::DOUBLE ELSE 0.05::DOUBLE END
           * (((event_id * 7919) % 1000)::DOUBLE / 1000::DOUBLE - 0.5::DOUBLE)) AS cval,
        CASE WHEN event_id % 97 = 0 THEN 'mg/L'
             WHEN code = 'CREAT' AND event_id % 4 = 0 THEN 'umol/L'
             WHEN code = 'HBA1C' AND event_id % 5 = 0 THEN 'mmol/mol'
             WHEN code = 'LDL' AND event_id % 6 = 0 THEN 'mmol/L'
             WHEN code = 'XERR' AND event_id % 10 = 0 THEN 'IU/L'
             WHEN code = 'HBA1C' THEN '%' WHEN code = 'TSH' THEN 'm[IU]/L' WHEN code = 'XERR' THEN 'U/L'
             ELSE 'mg/dL' END AS unit FROM lab0""",
    "obs": """SELECT event_id, user_id, 'P' || user_id AS patient_id, code,
        (cval - CASE WHEN unit = 'mmol/mol' THEN 2.152::DOUBLE ELSE 0::DOUBLE END)
        * CASE unit WHEN 'umol/L' THEN 88.42::DOUBLE WHEN 'mmol/mol' THEN 10.931::DOUBLE
               WHEN 'mmol/L' THEN 0.025860::DOUBLE ELSE 1::DOUBLE END AS value,
        unit, 1640995200 + s AS t FROM lab1""",
    "dem": """SELECT 'P' || c_custkey AS patient_id,
        CASE WHEN c_custkey % 10 <= 4 THEN 'female' WHEN c_custkey % 10 = 8 THEN 'other' ELSE 'male' END AS gender,
        CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE 1940 + 3 * c_nationkey END AS birth_year FROM customer""",
    "analytes(code, display, unit, cvi, cva, sigma, pop_low, pop_high)": "VALUES "
    + _rows(
        (code, name, unit, cvi, cva, math.sqrt(math.log(1 + cvi**2) + math.log(1 + cva**2)), low, high)
        for code, name, unit, cvi, cva, low, high in ANALYTES
    ),
    "unit_map(code, ukey, factor, off)": "VALUES "
    + _rows((c, *u) for c, (same, others) in UNITS.items() for u in [*((k, 1.0, 0.0) for k in same), *others]),
    "codes(lookup_key, analyte)": "VALUES " + _rows((k, c) for c, loinc in LOINC.items() for k in [c, *loinc]),
    "thr(code, ord, lim, direction, severity, rank, label)": "VALUES " + _rows(THRESHOLDS),
    # canonical value per reading; unprofiled codes keep theirs
    "norm": """SELECT o.*, a.code IS NOT NULL AS profiled,
        CASE WHEN a.code IS NULL THEN o.value ELSE o.value * u.factor + u.off END AS v
        FROM obs o LEFT JOIN analytes a ON a.code = o.code
        LEFT JOIN unit_map u ON u.code = o.code
          AND u.ukey = replace(replace(replace(lower(trim(o.unit)), ' ', ''), 'µ', 'u'), 'μ', 'u')""",
    "egfr_rows": """SELECT n.patient_id, n.t,
        142::DOUBLE * pow(least(v / k, 1::DOUBLE), alpha) * pow(greatest(v / k, 1::DOUBLE), -1.2::DOUBLE)
          * pow(0.9938::DOUBLE, age::DOUBLE) * CASE WHEN gender = 'female' THEN 1.012::DOUBLE ELSE 1::DOUBLE END AS v
        FROM (SELECT n.*, d.gender, year(make_timestamp(n.t * 1000000)) - d.birth_year AS age,
                CASE WHEN gender = 'female' THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS k,
                CASE WHEN gender = 'female' THEN -0.241::DOUBLE ELSE -0.302::DOUBLE END AS alpha
              FROM norm n JOIN dem d USING (patient_id)
              WHERE n.code = 'CREAT' AND d.gender IN ('female', 'male') AND d.birth_year IS NOT NULL) n
        WHERE n.v > 0 AND n.age >= 18""",
    "allr": """SELECT patient_id, code, false AS derived, profiled, t, v, unit FROM norm
        UNION ALL SELECT patient_id, 'EGFR', true, true, t, v, 'mL/min/{1.73_m2}' FROM egfr_rows""",
    "ser": """SELECT patient_id, code, derived, any_value(profiled) AS profiled, max(t) AS as_of,
        arg_max(unit, t) AS last_unit, count(*) AS total FROM allr GROUP BY ALL""",
    "pts": """SELECT r.patient_id, r.code, r.derived, r.profiled, r.t, r.v, s.as_of,
        row_number() OVER w - 1 AS idx, count(*) OVER p AS n, max(CASE WHEN r.v <= 0 THEN 1 ELSE 0 END) OVER p AS bad,
        lag(r.v) OVER w AS pv, lag(r.t) OVER w AS pt
        FROM allr r JOIN ser s USING (patient_id, code, derived)
        WHERE r.v IS NOT NULL AND (r.profiled OR r.unit = s.last_unit)
        WINDOW w AS (PARTITION BY r.patient_id, r.code, r.derived ORDER BY r.t),
               p AS (PARTITION BY r.patient_id, r.code, r.derived)""",
    "lp": """SELECT p.*, a.sigma, a.cvi, a.cva, ln(p.v) AS lv,
        exp({z} * {r2} * a.sigma) - 1 AS rcv_up, exp(-{z} * {r2} * a.sigma) - 1 AS rcv_down
        FROM pts p JOIN analytes a USING (code) WHERE bad = 0""".format(z=_s(Z95), r2=_s(SQRT2)),
    "lm": """SELECT *, sum(lv) OVER (PARTITION BY patient_id, code, derived ORDER BY t
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / idx AS mean_before FROM lp""",
    "bn": f"""SELECT patient_id, code, derived, any_value(n) AS n, any_value(sigma) AS sigma,
        least(coalesce(min(idx) FILTER (idx BETWEEN 3 AND 9 AND idx < n - 1
                AND abs((lv - mean_before) / (sigma * sqrt(1 + 1 / idx::DOUBLE))) > {_s(Z95)}), 10), any_value(n) - 1) AS base_n
        FROM lm GROUP BY ALL HAVING any_value(n) > 3""",
    "base": f"""SELECT *, exp(mean) AS set_point, exp(mean - {_s(Z95)} * ps) AS prri_low,
        exp(mean + {_s(Z95)} * ps) AS prri_high FROM (
          SELECT b.patient_id, b.code, b.derived, b.n, b.sigma, b.base_n,
            avg(p.lv) FILTER (p.idx < b.base_n) AS mean, b.sigma * sqrt(1 + 1 / b.base_n::DOUBLE) AS ps,
            min(p.t) AS base_from, max(p.t) FILTER (p.idx < b.base_n) AS base_to
          FROM bn b JOIN lp p USING (patient_id, code, derived) GROUP BY ALL)""",
    "latest": """SELECT patient_id, code, derived, profiled, as_of, n, bad, t AS latest_t, v AS latest_v,
        pt AS previous_t, pv AS previous_v FROM pts WHERE idx = n - 1""",
    "cz": """SELECT p.*, b.base_n, b.mean, b.set_point, (p.lv - b.mean) / b.sigma AS z,
        greatest(least((p.lv - b.mean) / b.sigma, 4), -4) AS zc
        FROM lp p JOIN base b USING (patient_id, code, derived) WHERE p.idx >= b.base_n""",
    "cs": """SELECT *, sum(zc - 0.5::DOUBLE) OVER w AS sh, sum(-zc - 0.5::DOUBLE) OVER w AS sl FROM cz
        WINDOW w AS (PARTITION BY patient_id, code, derived ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    "ch": """SELECT *, sh - least(0, min(sh) OVER w) AS hi, sl - least(0, min(sl) OVER w) AS lo FROM cs
        WINDOW w AS (PARTITION BY patient_id, code, derived ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    "cl": """SELECT *, max(CASE WHEN hi = 0 THEN idx END) OVER w AS zh, max(CASE WHEN lo = 0 THEN idx END) OVER w AS zl
        FROM ch WINDOW w AS (PARTITION BY patient_id, code, derived ORDER BY t ROWS UNBOUNDED PRECEDING)""",
    "alarm": """SELECT patient_id, code, derived, any_value(set_point) AS before, min(idx) AS alarm_idx, min(t) AS detected_t,
        arg_min(coalesce(CASE WHEN hi > 5 THEN zh ELSE zl END + 1, base_n), idx) AS start_idx
        FROM cl WHERE hi > 5 OR lo > 5 GROUP BY ALL""",
    "cp": """SELECT a.patient_id, a.code, a.derived, min(p.t) AS cp_t, any_value(a.detected_t) AS cp_detected_t,
        any_value(a.before) AS before, exp(avg(p.lv)) AS after
        FROM alarm a JOIN lp p USING (patient_id, code, derived) WHERE p.idx >= a.start_idx GROUP BY ALL""",
    "ew": """SELECT *, exp(mean + level * sigma) AS ewma_value, exp(mean - width * sigma) AS ewma_low,
        exp(mean + width * sigma) AS ewma_high FROM (
          SELECT patient_id, code, derived, any_value(mean) AS mean, any_value(sigma) AS sigma,
            sum(0.2::DOUBLE * pow(0.8::DOUBLE, n - 1 - idx) * zc) AS robust,
            sum(0.2::DOUBLE * pow(0.8::DOUBLE, n - 1 - idx) * z) AS level,
            3 * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * count(*)))) AS width
          FROM cz GROUP BY patient_id, code, derived)""",
    "win": "SELECT *, t::DOUBLE / 86400 AS x FROM pts WHERE t >= as_of - 1095 * 86400",
    "wn": """SELECT patient_id, code, derived, count(*) AS trend_n, min(t) AS trend_from, median(v) AS med FROM win GROUP BY ALL""",
    "ties": """SELECT patient_id, code, derived, sum(c * (c - 1) * (2 * c + 5))::DOUBLE AS ties FROM
        (SELECT patient_id, code, derived, v, count(*)::DOUBLE AS c FROM win GROUP BY ALL) GROUP BY ALL""",
    "prs": """SELECT a.patient_id, a.code, a.derived, sign(b.v - a.v) AS sg,
        CASE WHEN b.t > a.t THEN (b.v - a.v) / ((b.t - a.t)::DOUBLE / 86400) END AS slope
        FROM win a JOIN win b ON a.patient_id = b.patient_id AND a.code = b.code AND a.derived = b.derived AND a.idx < b.idx""",
    "sen": """SELECT patient_id, code, derived, sum(sg)::BIGINT AS mk_s, count(slope) AS sen_n, median(slope) AS sen_slope,
        list(slope ORDER BY slope) AS slopes FROM prs GROUP BY ALL""",
    "mk": """SELECT w.*, s.mk_s, s.sen_n, s.sen_slope, s.slopes,
        (trend_n::DOUBLE * (trend_n - 1) * (2 * trend_n + 5) - ties) / 18 AS mk_var,
        mk_s / (trend_n::DOUBLE * (trend_n - 1) / 2) AS mk_tau
        FROM wn w JOIN ties USING (patient_id, code, derived) JOIN sen s USING (patient_id, code, derived)
        WHERE trend_n >= 4 AND sen_n > 0""",
    "mkz": f"""SELECT *, CASE WHEN mk_s = 0 OR mk_var <= 0 THEN 0 ELSE (mk_s - sign(mk_s)) / sqrt(mk_var) END AS mk_z,
        list_extract(slopes, greatest(least(round((sen_n - {_s(Z95)} * sqrt(greatest(mk_var, 0))) / 2), sen_n), 1)::BIGINT) AS sen_low,
        list_extract(slopes, greatest(least(round((sen_n + {_s(Z95)} * sqrt(greatest(mk_var, 0))) / 2 + 1), sen_n), 1)::BIGINT) AS sen_high,
        CASE WHEN abs(med) > 2.220446049250313e-16 THEN sen_slope * 365.25 / med ELSE 0 END AS change_per_year FROM mk""",
    "mkp": f"""SELECT *, greatest(least(t * exp(-x * x + {_HORNER}), 1), 0) AS mk_p FROM
        (SELECT *, abs(mk_z) / {_s(SQRT2)} AS x, 1 / (1 + 0.5 * abs(mk_z) / {_s(SQRT2)}) AS t FROM mkz)""",
    "tr": """SELECT *, CASE WHEN mk_p < 0.05 AND mk_s > 0 THEN 'rising' WHEN mk_p < 0.05 AND mk_s < 0 THEN 'falling'
        ELSE 'flat' END AS direction FROM mkp""",
    "hits": """SELECT l.patient_id, l.code, l.derived, l.latest_t, l.latest_v, t.ord, t.lim, t.direction, t.severity, t.rank, t.label
        FROM latest l JOIN thr t ON t.code = l.code
        WHERE CASE WHEN t.direction = 'above' THEN l.latest_v >= t.lim ELSE l.latest_v < t.lim END""",
    "top_hits": """SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY patient_id, code, derived, direction
        ORDER BY rank DESC, ord DESC) = 1""",
    "prri_z": """SELECT l.*, b.prri_low, b.prri_high, (ln(l.latest_v) - b.mean) / b.ps AS z
        FROM latest l JOIN base b USING (patient_id, code, derived)""",
    "pairs_last": f"""SELECT l.*, a.sigma, l.latest_v / l.previous_v - 1 AS change,
        exp({_s(Z95)} * {_s(SQRT2)} * a.sigma) - 1 AS up95, exp(-{_s(Z95)} * {_s(SQRT2)} * a.sigma) - 1 AS dn95,
        exp({_s(Z99)} * {_s(SQRT2)} * a.sigma) - 1 AS up99, exp(-{_s(Z99)} * {_s(SQRT2)} * a.sigma) - 1 AS dn99
        FROM latest l JOIN analytes a USING (code) WHERE l.bad = 0 AND l.n > 1""",
    "sig": f"""SELECT patient_id, code, derived, 1 AS seq, 'prri' AS rule,
          CASE WHEN abs(z) > {_s(Z99)} THEN 'alert' ELSE 'watch' END AS severity, latest_t AS t, latest_v AS value,
          CASE WHEN z > 0 THEN prri_high ELSE prri_low END AS threshold FROM prri_z WHERE abs(z) > {_s(Z95)}
        UNION ALL SELECT l.patient_id, l.code, l.derived, 2, 'shift', 'watch', l.latest_t, c.after,
          CASE WHEN c.after > b.prri_high THEN b.prri_high ELSE b.prri_low END
          FROM cp c JOIN base b USING (patient_id, code, derived) JOIN latest l USING (patient_id, code, derived)
          WHERE c.after > b.prri_high OR c.after < b.prri_low
        UNION ALL SELECT l.patient_id, l.code, l.derived, 3, 'ewma', 'watch', l.latest_t, e.ewma_value,
          CASE WHEN e.robust > e.width THEN e.ewma_high ELSE e.ewma_low END
          FROM ew e JOIN latest l USING (patient_id, code, derived) WHERE abs(e.robust) > e.width
        UNION ALL SELECT patient_id, code, derived, 4, 'rcv',
          CASE WHEN change > up99 OR change < dn99 THEN 'alert' ELSE 'watch' END, latest_t, latest_v,
          CASE WHEN change > 0 THEN up95 ELSE dn95 END FROM pairs_last WHERE change > up95 OR change < dn95
        UNION ALL SELECT l.patient_id, l.code, l.derived, 5, 'population', 'info', l.latest_t, l.latest_v,
          CASE WHEN l.latest_v > a.pop_high THEN a.pop_high ELSE a.pop_low END
          FROM latest l JOIN analytes a USING (code) LEFT JOIN top_hits h ON h.patient_id = l.patient_id AND h.code = l.code
            AND h.derived = l.derived AND h.direction = CASE WHEN l.latest_v > a.pop_high THEN 'above' ELSE 'below' END
          WHERE (l.latest_v > a.pop_high OR l.latest_v < a.pop_low) AND h.code IS NULL
        UNION ALL SELECT patient_id, code, derived, CASE direction WHEN 'above' THEN 6 ELSE 7 END, 'threshold', severity,
          latest_t, latest_v, lim FROM top_hits
        UNION ALL SELECT l.patient_id, l.code, l.derived, 8, 'trend', 'watch', l.latest_t, l.latest_v, a.cvi
          FROM tr JOIN latest l USING (patient_id, code, derived) LEFT JOIN analytes a ON a.code = l.code
          WHERE tr.direction <> 'flat' AND (a.cvi IS NULL OR abs(tr.change_per_year) >= a.cvi)""",
    "signals": """SELECT *, row_number() OVER (PARTITION BY patient_id, code, derived ORDER BY sev_rank DESC, seq) - 1 AS position
        FROM (SELECT *, CASE severity WHEN 'alert' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS sev_rank FROM sig)""",
    "status": """SELECT s.patient_id, s.code, s.derived, coalesce(max(g.sev_rank), 0) AS status_rank
        FROM ser s LEFT JOIN signals g USING (patient_id, code, derived) GROUP BY ALL""",
    "revs": """SELECT e.*, h.pos AS id, h.action,
        CASE WHEN h.action = 'acknowledge' THEN NULL ELSE h.action || ' after chart review' END AS reason,
        e.signal_t + h.pos AS created_at, r.rule FROM
        (SELECT user_id, patient_id, code, max(t) AS signal_t FROM obs GROUP BY ALL) e
        CROSS JOIN (VALUES ('prri'), ('rcv'), ('shift'), ('ewma'), ('trend'), ('threshold'), ('population')) r(rule)
        JOIN (VALUES (0, 1, 'acknowledge'), (1, 1, 'annotate'), (2, 1, 'dismiss'), (2, 2, 'reopen'),
                     (3, 1, 'dismiss'), (3, 2, 'annotate'), (3, 3, 'acknowledge')) h(m, pos, action)
          ON h.m = e.user_id % 4""",
    "folded": """SELECT patient_id, code, rule, signal_t,
        CASE arg_max(action, id) FILTER (action <> 'annotate') WHEN 'acknowledge' THEN 'acknowledged'
             WHEN 'dismiss' THEN 'dismissed' ELSE 'unreviewed' END AS state,
        arg_max(created_at, id) FILTER (action <> 'annotate') AS last_at,
        arg_max(coalesce(reason, ''), id) FILTER (action <> 'annotate') AS last_reason,
        count(*) FILTER (action = 'annotate') AS notes FROM revs GROUP BY ALL""",
    "reviewed": """SELECT g.*, coalesce(f.state, 'unreviewed') AS state, coalesce(f.notes, 0) AS notes
        FROM signals g LEFT JOIN folded f ON f.patient_id = g.patient_id AND f.code = g.code AND f.rule = g.rule AND f.signal_t = g.t""",
    "open_sig": """SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY sev_rank DESC, derived, code, position) AS k
        FROM reviewed WHERE sev_rank > 0 AND state = 'unreviewed'""",
    "tri": """SELECT s.patient_id, max(status_rank) AS status_rank, count(*) FILTER (status_rank = 2) AS alerts,
        count(*) FILTER (status_rank = 1) AS watches FROM status s GROUP BY ALL""",
    "triage": """SELECT t.patient_id, CASE t.status_rank WHEN 2 THEN 'alert' WHEN 1 THEN 'watch' ELSE 'normal' END AS status,
        t.alerts, t.watches, coalesce(c.u, 0) AS unreviewed, o.code AS top_code, coalesce(a.display, o.code) AS top_display,
        o.rule AS top_rule, o.severity AS top_severity
        FROM tri t LEFT JOIN (SELECT patient_id, count(*) AS u FROM open_sig GROUP BY ALL) c USING (patient_id)
        LEFT JOIN (SELECT * FROM open_sig WHERE k = 1) o ON o.patient_id = t.patient_id
        LEFT JOIN analytes a ON a.code = o.code""",
    "cnote": """SELECT s.patient_id, CASE WHEN d.birth_year IS NULL THEN 'no_demographics'
        WHEN d.gender IS NULL OR d.gender NOT IN ('female', 'male') THEN 'sex_not_binary'
        WHEN e.patient_id IS NULL THEN 'no_adult_results' END AS reason
        FROM ser s LEFT JOIN dem d USING (patient_id)
        LEFT JOIN (SELECT DISTINCT patient_id FROM egfr_rows) e ON e.patient_id = s.patient_id WHERE s.code = 'CREAT'""",
    # one flag per reason a rule can be skipped
    "sflag": """SELECT s.patient_id, s.code, s.derived, s.profiled, coalesce(p.n, 0) AS n, coalesce(p.bad, 0) AS bad,
        a.pop_low IS NULL AS no_pop, NOT EXISTS (SELECT 1 FROM thr WHERE thr.code = s.code) AS no_thr,
        tr.patient_id IS NULL AS no_trend
        FROM ser s LEFT JOIN latest p USING (patient_id, code, derived) LEFT JOIN analytes a ON a.code = s.code
        LEFT JOIN tr ON tr.patient_id = s.patient_id AND tr.code = s.code AND tr.derived = s.derived""",
    "skips": """SELECT patient_id, code, derived, rule FROM sflag, (VALUES ('prri'), ('rcv'), ('shift'), ('ewma'), ('trend'),
          ('threshold'), ('population')) r(rule)
        WHERE n = 0 OR CASE rule WHEN 'trend' THEN no_trend
          WHEN 'rcv' THEN NOT profiled OR bad = 1 OR n = 1
          WHEN 'threshold' THEN NOT profiled OR no_thr
          WHEN 'population' THEN NOT profiled OR no_pop
          ELSE NOT profiled OR bad = 1 OR n <= 3 END""",
    "annot": """SELECT p.patient_id, p.code, p.derived, p.idx, p.t, p.v,
        coalesce(p.v < b.prri_low OR p.v > b.prri_high, false) AS outside,
        CASE WHEN l.pv IS NOT NULL AND (l.v / l.pv - 1 > l.rcv_up OR l.v / l.pv - 1 < l.rcv_down) THEN l.v / l.pv - 1 END AS jump,
        h.label AS threshold_label, h.severity AS threshold_severity
        FROM pts p LEFT JOIN base b USING (patient_id, code, derived)
        LEFT JOIN lp l ON l.patient_id = p.patient_id AND l.code = p.code AND l.derived = p.derived AND l.idx = p.idx
        LEFT JOIN (SELECT q.patient_id, q.code, q.derived, q.idx, t.label, t.severity FROM pts q JOIN thr t ON t.code = q.code
            WHERE CASE WHEN t.direction = 'above' THEN q.v >= t.lim ELSE q.v < t.lim END
            QUALIFY row_number() OVER (PARTITION BY q.patient_id, q.code, q.derived, q.idx ORDER BY t.rank DESC, t.ord DESC) = 1) h
          ON h.patient_id = p.patient_id AND h.code = p.code AND h.derived = p.derived AND h.idx = p.idx""",
    # the same results as FHIR resources, one defect per event_id % 14
    "fhir": """SELECT event_id, patient_id, value, unit, t, CASE code WHEN 'HBA1C' THEN '4548-4' WHEN 'LDL' THEN '18262-6'
          WHEN 'TSH' THEN '3016-3' WHEN 'CREAT' THEN '38483-4' ELSE '9999-9' END AS loinc,
        CASE event_id % 14 WHEN 1 THEN 'status preliminary is not final/amended/corrected' WHEN 2 THEN 'no LOINC coding'
          WHEN 3 THEN 'no valueQuantity (coded and component results are not imported)'
          WHEN 4 THEN 'valueQuantity without a unit' WHEN 5 THEN 'effectiveDateTime 2023-07 is not a full date or a date-time with offset'
          WHEN 6 THEN 'effectiveDateTime 2023-07-14T22:10:45 is not a full date or a date-time with offset'
          WHEN 7 THEN 'subject Location/ward-2 is not a Patient' WHEN 8 THEN 'not a valid Observation'
          WHEN 9 THEN 'valueQuantity without a value' WHEN 10 THEN 'no effectiveDateTime' WHEN 11 THEN 'no subject reference'
          ELSE CASE WHEN code = 'XERR' THEN 'no analyte profile for LOINC 9999-9' END END AS reason FROM obs""",
    # upload spellings of the same results
    "upl": """SELECT event_id, user_id, code AS short_code, CASE
          WHEN code = 'XERR' THEN ' xerr ' WHEN event_id % 3 = 0 THEN lower(code)
          WHEN event_id % 3 = 1 THEN (CASE code WHEN 'HBA1C' THEN '4548-4' WHEN 'LDL' THEN '18262-6' WHEN 'TSH' THEN '3016-3' ELSE '38483-4' END)
          ELSE ' ' || code END AS code, patient_id, value, unit, t FROM obs""",
}


def sql(select: str) -> str:
    """All CTEs in front of one SELECT; unused ones cost nothing."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in CTES.items()) + "\n" + select


def iso(t: str) -> str:
    return f"strftime(make_timestamp({t} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


KEY = "patient_id, code, derived"


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in columns)


def signal(rule: str) -> str:
    return sql(
        f"SELECT {KEY}, severity, t, {r('value', 'threshold')} FROM signals WHERE rule = '{rule}'"
    )


def _re2(pattern: str) -> str:
    """The same pattern with Unicode letters and digits spelled out, for an engine whose
    classes and word boundaries are ASCII."""
    word = r"\p{L}\p{M}\p{N}_"
    pattern = pattern.replace("(?i)", "").replace(r"\b\d", rf"(?:^|[^{word}])\d").replace(r"\b(", rf"(?:^|[^{word}])(")
    return pattern.replace(r"\b", rf"(?:$|[^{word}])").replace(r"\w", word).replace(r"\d", r"\p{Nd}")


_IDENTIFIER_CASE = " ".join(
    f"WHEN regexp_matches(text, {_s(_re2(p))}{', ' + _s('i') if p.startswith('(?i)') else ''}) THEN {_s(what)}"
    for what, p in IDENTIFIERS
)
_BOUND_CASE = lambda i: "CASE code " + " ".join(f"WHEN '{c}' THEN {_s(b[i])}" for c, b in BOUNDS.items()) + " END"

STORED = sql("SELECT patient_id, code, t, round(value, 6) AS value, unit FROM obs")
IMPORTED = sql(
    "SELECT patient_id, coalesce(c.analyte, f.loinc) AS code, t, round(value, 6) AS value, unit FROM fhir f"
    " LEFT JOIN codes c ON c.lookup_key = f.loinc WHERE reason IS NULL"
)

QUERIES: dict[str, str] = {
    "biomarker_stats": """SELECT event_type AS code, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min,
        round(max(value), 6) AS max FROM events GROUP BY event_type""",
    "patient_listing": sql(
        "SELECT patient_id, count(DISTINCT code) AS biomarkers, count(*) AS observations FROM obs GROUP BY ALL"
    ),
    "patient_codes": sql("SELECT DISTINCT patient_id, code FROM obs"),
    "canonical_codes": sql(
        "SELECT event_id, patient_id, coalesce(c.analyte, upper(trim(u.code))) AS code FROM upl u"
        " LEFT JOIN codes c ON c.lookup_key = upper(trim(u.code))"
    ),
    "normalise_units": sql(f"SELECT event_id, patient_id, code, unit, {r('v')} FROM norm WHERE profiled"),
    "unprofiled_units": sql(
        f"SELECT patient_id, code, last_unit AS unit, count(p.t) AS n, any_value(total) - count(p.t) AS unit_unknown"
        f" FROM ser s LEFT JOIN pts p USING ({KEY}) WHERE NOT s.profiled GROUP BY ALL"
    ),
    "exclusions": sql(
        f"SELECT s.patient_id, s.code, s.derived, 0::BIGINT AS after_as_of, any_value(total) - count(p.t) AS unit_unknown"
        f" FROM ser s LEFT JOIN pts p USING ({KEY}) GROUP BY ALL"
    ),
    "as_of_exclusions": sql(
        "SELECT patient_id, code, derived, count(*) FILTER (t > 1672531199) AS after_as_of,"
        " count(*) FILTER (t <= 1672531199) AS in_range FROM allr GROUP BY ALL"
    ),
    "latest_results": sql(
        f"SELECT {KEY}, n, latest_t, previous_t, {r('latest_v', 'previous_v')} FROM latest"
    ),
    "recent_results": sql(
        f"SELECT {KEY}, n - idx AS newest_rank, t, {r('v')} FROM pts WHERE n - idx <= 12"
    ),
    "baselines": sql(
        f"SELECT {KEY}, base_n, base_from, base_to, {r('set_point', 'prri_low', 'prri_high')} FROM base"
    ),
    "rcv_limits": sql(f"SELECT DISTINCT {KEY}, {r('rcv_up', 'rcv_down')} FROM lp WHERE n >= 2"),
    "unit_spellings": sql(f"SELECT event_id, {r('v')} FROM norm WHERE profiled"),
    "rcv_jumps": sql(
        f"SELECT {KEY}, pt AS from_t, t AS to_t, round(v / pv - 1, 6) AS change FROM lp"
        " WHERE pv IS NOT NULL AND (v / pv - 1 > rcv_up OR v / pv - 1 < rcv_down)"
    ),
    "change_points": sql(
        f"SELECT {KEY}, cp_t, cp_detected_t, round(before, 6) AS before, round(after, 6) AS after,"
        " round(after / before - 1, 6) AS change FROM cp"
    ),
    "ewma": sql(f"SELECT {KEY}, {r('robust', 'ewma_value', 'ewma_low', 'ewma_high')} FROM ew"),
    "mann_kendall": sql(f"SELECT {KEY}, trend_n, mk_s, {r('mk_var', 'mk_tau', 'mk_z', 'mk_p')} FROM tr"),
    "sen_slope": sql(f"SELECT {KEY}, sen_n, {r('sen_slope', 'sen_low', 'sen_high')} FROM tr"),
    "trends": sql(f"SELECT {KEY}, trend_n, trend_from, {r('change_per_year', 'mk_p')}, direction FROM tr"),
    "normal_cdf": f"""SELECT event_id, round(CASE WHEN x <= 0 THEN r ELSE 2 - r END * 0.5, 6) AS cdf FROM (
        SELECT event_id, x, t * exp(-x * x + {_HORNER}) AS r FROM (
          SELECT event_id, ((value - 10) / 5) / {_s(SQRT2)} AS x, 1 / (1 + 0.5 * abs((value - 10) / 5) / {_s(SQRT2)}) AS t FROM events))""",
    "threshold_hits": sql(f"SELECT {KEY}, ord, direction, severity, round(lim, 6) AS threshold, label FROM hits"),
    "signals": sql(f"SELECT {KEY}, position, rule, severity, t, {r('value', 'threshold')} FROM signals"),
    "signals_as_of": sql(f"SELECT {KEY}, position, rule, severity, t, {r('value', 'threshold')} FROM signals").replace(
        "AS t FROM lab1", "AS t FROM lab1 WHERE 1640995200 + s <= 1672531199"
    ),
    "signals_odd_values": sql(f"SELECT {KEY}, position, rule, severity, t, {r('value', 'threshold')} FROM signals").replace(
        "FROM obs o LEFT JOIN analytes",
        "FROM (SELECT * REPLACE (CASE t % 23 WHEN 0 THEN -value WHEN 1 THEN 0 ELSE value END AS value) FROM obs WHERE t % 23 <> 2) o"
        " LEFT JOIN analytes",
    ),
    "trends_window": sql(f"SELECT {KEY}, trend_n, trend_from, {r('change_per_year', 'mk_p')}, direction FROM tr").replace(
        "as_of - 1095 * 86400", "as_of - 90 * 86400"
    ),
    "report_fields": sql(
        f"SELECT {KEY}, coalesce(l.n, 0) AS n, latest_t, {r('latest_v')}, base_n, base_from, base_to,"
        f" {r('set_point', 'prri_low', 'prri_high', 'rcv_up', 'rcv_down', 'ewma_value', 'ewma_low', 'ewma_high')},"
        " cp_t, cp_detected_t, round(cp.after, 6) AS cp_after, round(cp.after / cp.before - 1, 6) AS cp_change,"
        " CASE status_rank WHEN 2 THEN 'alert' WHEN 1 THEN 'watch' ELSE 'normal' END AS status"
        f" FROM ser LEFT JOIN latest l USING ({KEY}) LEFT JOIN base USING ({KEY}) LEFT JOIN (SELECT DISTINCT {KEY}, rcv_up, rcv_down FROM lp"
        f" WHERE n >= 2) USING ({KEY}) LEFT JOIN ew USING ({KEY}) LEFT JOIN cp USING ({KEY}) LEFT JOIN status USING ({KEY})"
    ),
    "signals_prri": signal("prri"),
    "signals_rcv": signal("rcv"),
    "signals_shift": signal("shift"),
    "signals_ewma": signal("ewma"),
    "signals_trend": signal("trend"),
    "signals_threshold": signal("threshold"),
    "signals_population": signal("population"),
    "egfr_values": sql(f"SELECT patient_id, t, {r('v')} FROM egfr_rows"),
    "egfr_series": sql(
        "SELECT patient_id, count(*) AS n, max(t) AS latest_t, round(arg_max(v, t), 6) AS latest_v FROM egfr_rows GROUP BY ALL"
    ),
    "egfr_not_derived": sql("SELECT patient_id, reason FROM cnote WHERE reason IS NOT NULL"),
    "kdigo_stage": sql(
        "SELECT l.patient_id, round(l.latest_v, 6) AS latest_v, coalesce(h.label, 'G1-G2') AS stage FROM latest l"
        " LEFT JOIN top_hits h ON h.patient_id = l.patient_id AND h.code = l.code AND h.derived = l.derived"
        " WHERE l.code = 'EGFR'"
    ),
    "series_status": sql(
        f"SELECT {KEY}, CASE status_rank WHEN 2 THEN 'alert' WHEN 1 THEN 'watch' ELSE 'normal' END AS status FROM status"
    ),
    "deciding_rule": sql(f"SELECT {KEY}, rule, severity FROM signals WHERE position = 0 AND sev_rank > 0"),
    "not_assessed": sql(f"SELECT {KEY}, rule FROM skips"),
    "review_fold": sql(
        "SELECT patient_id, code, rule, signal_t, state, CASE WHEN state <> 'unreviewed' THEN last_at END AS decided_at,"
        " CASE WHEN state <> 'unreviewed' THEN nullif(last_reason, '') END AS reason, notes FROM folded"
    ),
    "signal_reviews": sql(f"SELECT {KEY}, position, rule, t, state, notes FROM reviewed"),
    "unreviewed_signals": sql(
        f"SELECT {KEY}, position, rule, severity, t FROM reviewed WHERE sev_rank > 0 AND state = 'unreviewed'"
    ),
    "stale_reviews": sql(
        "SELECT v.patient_id, v.code, v.rule, v.signal_t, v.id, v.action FROM revs v WHERE NOT EXISTS (SELECT 1 FROM signals g"
        " WHERE g.patient_id = v.patient_id AND g.code = v.code AND g.rule = v.rule AND g.t = v.signal_t)"
    ),
    "triage": sql("SELECT * FROM triage"),
    "triage_ranked": sql(
        "SELECT t.*, row_number() OVER (ORDER BY CASE top_severity WHEN 'alert' THEN 2 WHEN 'watch' THEN 1 WHEN 'info' THEN 0 END"
        " DESC NULLS LAST, unreviewed DESC, CASE status WHEN 'alert' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END DESC, alerts DESC,"
        " watches DESC, t.patient_id) AS rank, l.biomarkers, l.observations FROM triage t JOIN (SELECT patient_id, count(DISTINCT code) AS biomarkers,"
        " count(*) AS observations FROM obs GROUP BY ALL) l USING (patient_id)"
    ),
    "point_annotations": sql(
        f"SELECT {KEY}, idx, t, {r('v')}, outside, {r('jump')}, threshold_label, threshold_severity FROM annot"
    ),
    "series_table": sql(
        f"SELECT a.patient_id, a.code, a.derived, a.t, {r('a.v')}, round(o.value, 6) AS recorded_value, o.unit AS recorded_unit"
        " FROM annot a LEFT JOIN obs o ON o.patient_id = a.patient_id AND o.t = a.t"
        " AND o.code = CASE WHEN a.derived THEN 'CREAT' ELSE a.code END"
    ),
    "series_as_recorded": sql(f"SELECT patient_id, code, {iso('t')} AS taken_at, {r('value')}, unit, 'events' AS source FROM obs"),
    "idempotent_insert": sql(
        "SELECT patient_id, code, t, round(value, 6) AS value, unit FROM obs"
        " WHERE t >= 1685577600"
    ),
    "upsert_demographics": sql(
        "SELECT patient_id, CASE WHEN c % 4 = 1 THEN NULL WHEN c % 4 = 3 THEN 'unknown' ELSE gender END AS gender,"
        " CASE WHEN c % 4 = 1 THEN NULL WHEN c % 4 = 3 THEN 1950 ELSE birth_year END AS birth_year"
        " FROM (SELECT d.*, CAST(substr(patient_id, 2) AS BIGINT) AS c FROM dem d)"
    ),
    "upload_summary": sql(
        "SELECT count(*) FILTER (t >= 1685577600) AS inserted,"
        " 2 * count(*) - count(*) FILTER (t >= 1685577600) AS duplicates,"
        " count(*) FILTER (unit = 'mg/L') AS skipped, count(DISTINCT patient_id) AS patients,"
        " string_agg(DISTINCT code, ',' ORDER BY code) AS biomarkers,"
        " (SELECT count(*) FROM customer) AS demographics FROM obs"
    ),
    "dedupe_results": sql(
        "SELECT patient_id, code, t - t % 2592000 AS t, round(min(v), 6) AS v FROM norm WHERE profiled AND v IS NOT NULL GROUP BY ALL"
    ),
    "plausibility": sql(
        f"""SELECT patient_id, code, n, CASE WHEN n < 4 THEN 'fewer than 4 results'
          WHEN lo < {_BOUND_CASE(0)} OR hi > {_BOUND_CASE(1)} THEN 'value outside ' || CAST({_BOUND_CASE(0)} AS VARCHAR) || '-' || CAST({_BOUND_CASE(1)} AS VARCHAR)
          WHEN dist < 3 THEN 'fewer than 3 distinct values'
          WHEN code = 'CREAT' AND hi / lo > 3 THEN 'creatinine range > 3x'
          WHEN code = 'CREAT' AND em >= 60 AND med > 1.5 THEN 'creatinine inconsistent with eGFR' END AS reason FROM (
          SELECT p.patient_id, p.code, count(*) AS n, min(p.v) AS lo, max(p.v) AS hi, count(DISTINCT round(p.v, 3)) AS dist,
            median(p.v) AS med, any_value(e.em) AS em FROM pts p
          LEFT JOIN (SELECT patient_id, median(v) AS em FROM pts WHERE code = 'EGFR' GROUP BY ALL) e USING (patient_id)
          WHERE p.code IN ('HBA1C', 'LDL', 'CREAT', 'TSH') GROUP BY ALL)"""
    ),
    "identifier_screen": f"SELECT doc_id, CASE {_IDENTIFIER_CASE} END AS found FROM documents",
    "review_rejects": f"""SELECT conv_id, turn, CASE WHEN action IS NULL THEN 'unknown action'
        WHEN (text IS NULL OR trim(text) = '') AND action = 'acknowledge' THEN NULL
        WHEN text IS NULL OR trim(text) = '' THEN 'say why, to ' || action
        WHEN length(trim(text)) NOT BETWEEN 3 AND 500 THEN 'a reason has between 3 and 500 characters'
        ELSE 'the reason seems to hold ' || (CASE {_IDENTIFIER_CASE} END) END AS reject_reason
        FROM (SELECT *, CASE turn % 5 WHEN 0 THEN 'acknowledge' WHEN 1 THEN 'annotate' WHEN 2 THEN 'dismiss' WHEN 3 THEN 'reopen' END
              AS action FROM conversations)""",
    "parse_taken_at": sql(
        "SELECT event_id, CASE WHEN event_id % 6 IN (4, 5) THEN NULL WHEN event_id % 6 = 2 THEN t - t % 86400 ELSE t END AS t FROM obs"
    ),
    "csv_rejects": sql(
        "SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'missing or null value' WHEN 2 THEN 'value is not a number'"
        " WHEN 3 THEN 'non-finite value' WHEN 4 THEN 'missing or null patient_id' WHEN 5 THEN 'invalid taken_at: soon'"
        " WHEN 6 THEN 'missing or null unit' WHEN 7 THEN 'missing or null source' END AS reject_reason FROM obs"
    ),
    "fhir_skip_reasons": sql("SELECT event_id, reason AS skip_reason FROM fhir"),
    "fhir_observations": sql(
        "SELECT event_id, patient_id, coalesce(c.analyte, f.loinc) AS code, round(value, 6) AS value, unit, t FROM fhir f"
        " LEFT JOIN codes c ON c.lookup_key = f.loinc WHERE reason IS NULL"
    ),
    "fhir_patients": """SELECT 'P' || c_custkey AS patient_id,
        CASE c_custkey % 5 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'other' WHEN 3 THEN 'unknown' END AS gender,
        CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 1940 + 3 * c_nationkey END AS birth_year FROM customer""",
    "skip_histogram": sql("SELECT reason, count(*) AS n FROM fhir WHERE reason IS NOT NULL GROUP BY reason"),
    "csv_import": sql(
        "SELECT patient_id, code, t, round(value, 6) AS value, unit,"
        " 'events, no. \"' || event_id || '\"' || chr(10) || 'second line' AS source FROM obs"
    ),
    "fhir_bundle": IMPORTED,
    "fhir_ndjson": IMPORTED,
    "landing_folder": sql(
        "SELECT 'stored from csv' AS kind, count(*) AS n FROM obs WHERE event_id % 3 = 0"
        " UNION ALL SELECT 'stored from fhir', count(*) FROM fhir WHERE event_id % 3 = 2 AND reason IS NULL"
        " UNION ALL SELECT 'skipped', count(*) FROM fhir WHERE event_id % 3 = 2 AND reason IS NOT NULL"
        " UNION ALL SELECT 'failed: value is not a number', 1"
    ),
    "stored_insert": STORED,
    "upload_commits": sql(
        "SELECT 0::INTEGER AS upload, count(*) AS submitted, count(*) AS inserted, 0::BIGINT AS duplicates, false AS replayed"
        " FROM obs WHERE t < 1685577600"
        " UNION ALL SELECT 1, 2 * count(*), count(*) FILTER (t >= 1685577600), 2 * count(*) - count(*) FILTER (t >= 1685577600), false FROM obs"
        " UNION ALL SELECT 2, 2 * count(*), 0, 2 * count(*), true FROM obs"
    ),
    "concurrent_inserts": STORED,
    "stored_jumps": sql(
        f"SELECT {KEY}, pt AS from_t, t AS to_t, round(v / pv - 1, 6) AS change FROM lp"
        " WHERE pv IS NOT NULL AND (v / pv - 1 > rcv_up OR v / pv - 1 < rcv_down)"
    ),
    "stored_reports": sql(
        f"SELECT {KEY}, CASE status_rank WHEN 2 THEN 'alert' WHEN 1 THEN 'watch' ELSE 'normal' END AS status,"
        f" base_n::INTEGER AS base_n, coalesce(g.n, 0)::INTEGER AS n_signals FROM status LEFT JOIN base USING ({KEY})"
        f" LEFT JOIN (SELECT {KEY}, count(*) AS n FROM signals GROUP BY ALL) g USING ({KEY})"
    ),
    "stream_equals_batch": sql(
        f"SELECT {KEY}, CASE status_rank WHEN 2 THEN 'alert' WHEN 1 THEN 'watch' ELSE 'normal' END AS status FROM status WHERE NOT derived"
    ),
}
QUERIES["stored_demographics"] = QUERIES["upsert_demographics"]
