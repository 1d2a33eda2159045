"""Analyte profiles as small literal DataFrames (a few dozen rows, always broadcast)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Analyte identity, units, biological variation and limits.
# ---------------------------------------------------------------------------
REVIEWED = "2026-10-06"
CVA_NOTE = "no local figure: a typical current analyser is taken"
ADA = "ADA Standards of Care in Diabetes, section 2"
ATP3 = "NCEP ATP III, Circulation 2002;106:3143"
AHA = "AHA/ACC cholesterol guideline 2018, Circulation 2019;139:e1082"
ATA_HYPO = "ATA/AACE hypothyroidism guideline, Thyroid 2012;22:1200"
ATA_HYPER = "ATA hyperthyroidism guideline, Thyroid 2016;26:1343"
KDIGO = "KDIGO 2024 CKD guideline, Kidney Int 2024;105(4S):S117"

ANALYTES = [
    {
        "code": "HBA1C",
        "loinc": ["4548-4", "17856-6"],
        "display": "Hemoglobin A1c",
        "unit": "%",
        "aliases": ["%", "% hb", "%{hb}", "percent"],
        "conversions": [("mmol/mol", 0.09148, 2.152)],
        "cvi": 0.012,
        "cva": 0.015,
        "cvi_source": "HbA1c biological variation meta-analysis, Adv Lab Med 2020 (CVI 1.2 %)",
        "cva_source": CVA_NOTE,
        "population": (4.0, 5.6, ADA),
        "thresholds": [
            (5.7, "above", "watch", "raised glycation, between normal and diabetic", ADA),
            (6.5, "above", "alert", "glycation at the diabetic limit", ADA),
        ],
    },
    {
        "code": "LDL",
        "loinc": ["13457-7", "18262-6", "2089-1"],
        "display": "LDL cholesterol",
        "unit": "mg/dL",
        "aliases": ["mg/dl"],
        "conversions": [("mmol/l", 38.67, 0.0)],
        "cvi": 0.078,
        "cva": 0.02,
        "cvi_source": "EFLM biological variation database, LDL cholesterol (CVI 7.8 %)",
        "cva_source": CVA_NOTE,
        "population": None,
        "thresholds": [
            (130.0, "above", "info", "LDL slightly over the desirable level", ATP3),
            (160.0, "above", "watch", "LDL clearly raised", ATP3),
            (190.0, "above", "alert", "LDL severely raised", AHA),
        ],
    },
    {
        "code": "TSH",
        "loinc": ["3016-3", "11580-8"],
        "display": "Thyrotropin (TSH)",
        "unit": "m[IU]/L",
        "aliases": ["miu/l", "m[iu]/l", "uiu/ml", "µiu/ml", "u[iu]/ml", "mu/l"],
        "conversions": [],
        "cvi": 0.177,
        "cva": 0.03,
        "cvi_source": "EuBIVAS thyroid markers, Clin Chem Lab Med 2022;60:523 (CVI 17.7 %)",
        "cva_source": CVA_NOTE,
        "population": (0.45, 4.5, "subclinical thyroid disease review, JAMA 2004;291:228"),
        "thresholds": [
            (4.5, "above", "watch", "TSH over its interval; look at free T4", ATA_HYPO),
            (10.0, "above", "alert", "TSH at a level that is usually treated", ATA_HYPO),
            (0.45, "below", "watch", "TSH under its interval; look at free T4 and T3", ATA_HYPER),
            (0.1, "below", "alert", "TSH hardly measurable", ATA_HYPER),
        ],
    },
    {
        "code": "CREAT",
        "loinc": ["2160-0", "38483-4"],
        "display": "Creatinine (serum/plasma)",
        "unit": "mg/dL",
        "aliases": ["mg/dl"],
        "conversions": [("umol/l", 1.0 / 88.42, 0.0)],
        "cvi": 0.044,
        "cva": 0.02,
        "cvi_source": "EuBIVAS creatinine, Clin Chem 2017;63:1527 (CVI 4.4 %)",
        "cva_source": CVA_NOTE,
        "population": (0.59, 1.35, "adult female and male interval, Mayo Clinic Laboratories; staging is on the eGFR"),
        "thresholds": [],
    },
    {
        "code": "EGFR",
        "loinc": ["98979-8"],
        "display": "eGFR (CKD-EPI 2021, creatinine)",
        "unit": "mL/min/{1.73_m2}",
        "aliases": ["mL/min/1.73m2", "mL/min/1.73 m2", "mL/min/{1.73_m2}"],
        "conversions": [],
        "cvi": 0.053,
        "cva": 0.024,
        "cvi_source": "from creatinine: its CVI times the exponent 1.2 of the equation",
        "cva_source": "from creatinine: its CVA times the exponent 1.2 of the equation",
        "population": None,
        "thresholds": [
            (60.0, "below", "watch", "kidney stage G3a", KDIGO),
            (45.0, "below", "watch", "kidney stage G3b", KDIGO),
            (30.0, "below", "alert", "kidney stage G4", KDIGO),
            (15.0, "below", "alert", "kidney stage G5", KDIGO),
        ],
    },
]

SEVERITY_RANK = {"info": 0, "watch": 1, "alert": 2}
RULES = ["prri", "rcv", "shift", "ewma", "trend", "threshold", "population"]
EGFR_METHOD = "CKD-EPI 2021 creatinine equation (N Engl J Med 2021;385:1737); age = result year - birth year; adults only"


def unit_key(unit: str) -> str:
    """Spelling-insensitive form of a unit; ``normalise.unit_key_col`` is the Column form."""
    return unit.strip().lower().replace(" ", "").replace("µ", "u").replace("μ", "u")


def sigma_log(analyte: dict) -> float:
    return math.sqrt(math.log(1 + analyte["cvi"] ** 2) + math.log(1 + analyte["cva"] ** 2))


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "\\'") + "'"


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    body = ", ".join(f"({', '.join(row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def analytes(spark: SparkSession) -> DataFrame:
    """One row per profiled analyte, thresholds nested and ordered mildest to most severe."""
    rows = []
    for a in ANALYTES:
        low, high, source = a["population"] or (None, None, None)
        ordered = sorted(enumerate(a["thresholds"]), key=lambda p: (SEVERITY_RANK[p[1][2]], p[0]))
        thresholds = ", ".join(
            f"named_struct('ord', {i}, 'value', {_lit(v)}, 'direction', {_lit(d)}, 'severity', {_lit(s)},"
            f" 'sev_rank', {SEVERITY_RANK[s]}, 'label', {_lit(label)}, 'source', {_lit(src)})"
            for i, (v, d, s, label, src) in ordered
        )
        empty = (
            "slice(array(named_struct('ord', 0, 'value', 0D, 'direction', '', 'severity', '', 'sev_rank', 0,"
            " 'label', '', 'source', '')), 1, 0)"
        )
        rows.append(
            (
                _lit(a["code"]), _lit(a["loinc"][0]), _lit(a["display"]), _lit(a["unit"]),
                _lit(a["cvi"]), _lit(a["cva"]), _lit(sigma_log(a)), _lit(a["cvi_source"]), _lit(a["cva_source"]),
                "CAST(NULL AS DOUBLE)" if low is None else _lit(low),
                "CAST(NULL AS DOUBLE)" if high is None else _lit(high),
                "CAST(NULL AS STRING)" if source is None else _lit(source),
                f"array({thresholds})" if thresholds else empty,
            )
        )
    return _values(
        spark,
        rows,
        "analyte, loinc, display, canonical_unit, cvi, cva, sigma, cvi_source, cva_source,"
        " pop_low, pop_high, pop_source, thresholds",
    )


def analyte_codes(spark: SparkSession) -> DataFrame:
    """Every accepted spelling of an analyte code (short code or LOINC) to its short code."""
    rows = [(_lit(k), _lit(a["code"])) for a in ANALYTES for k in [a["code"], *a["loinc"]]]
    return _values(spark, rows, "lookup_key, analyte")


def unit_conversions(spark: SparkSession) -> DataFrame:
    """(analyte, unit_key) to factor and offset; accepted spellings of the unit itself are 1 and 0."""
    rows: dict[tuple[str, str], tuple[float, float]] = {}
    for a in ANALYTES:
        for u in [a["unit"], *a["aliases"]]:
            rows.setdefault((a["code"], unit_key(u)), (1.0, 0.0))
        for u, factor, offset in a["conversions"]:
            rows.setdefault((a["code"], unit_key(u)), (factor, offset))
    return _values(
        spark,
        [(_lit(c), _lit(k), _lit(f), _lit(o)) for (c, k), (f, o) in rows.items()],
        "analyte, unit_key, factor, offset",
    )


def thresholds(spark: SparkSession) -> DataFrame:
    """Long form of the clinical thresholds, one row per limit."""
    rows = [
        (_lit(a["code"]), str(i), _lit(v), _lit(d), _lit(s), str(SEVERITY_RANK[s]), _lit(label), _lit(src))
        for a in ANALYTES
        for i, (v, d, s, label, src) in enumerate(a["thresholds"])
    ]
    return _values(spark, rows, "analyte, ord, limit, direction, severity, sev_rank, label, source")
