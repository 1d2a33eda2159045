"""FHIR R4: Bundles, single Observations and newline-delimited resources as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtide.functions.text import stripped
from labtide.operators.barrier import settled
from labtide.operators.normalise import with_analyte
from labtide.schemas import OBSERVATION_COLUMNS
from labtide.session import checkpointed
from labtide.sources import bundles
from labtide.sources.records import with_files

# Code systems and accepted states.
LOINC = "http://loinc.org"
UCUM = "http://unitsofmeasure.org"
ACCEPTED_STATUS = ["final", "amended", "corrected"]
GENDERS = ["female", "male", "other", "unknown"]

# Skip reasons, in the order they are checked.
BAD_SHAPE = "not a valid Observation"
BAD_STATUS = ("status ", " is not final/amended/corrected")
NO_CODE = "no LOINC coding"
NO_QUANTITY = "no valueQuantity (coded and component results are not imported)"
NO_VALUE = "valueQuantity without a value"
NO_UNIT = "valueQuantity without a unit"
NO_TIME = "no effectiveDateTime"
BAD_TIME = ("effectiveDateTime ", " is not a full date or a date-time with offset")
NO_SUBJECT = "no subject reference"
BAD_SUBJECT = ("subject ", " is not a Patient")
NO_PROFILE = ("no analyte profile for LOINC ", "")


def _around(parts: tuple[str, str], value: str) -> Column:
    return F.concat(F.lit(parts[0]), F.col(value), F.lit(parts[1]))


def _get(path: str, kind: str = "string", root: str = "resource") -> Column:
    return F.try_variant_get(F.col(root), f"$.{path}", kind)


def _kind(v: Column) -> Column:
    """JSON kind of a variant, null when the field is absent."""
    return F.schema_of_variant(v)


def _text(path: str, root: str = "resource") -> Column:
    """The field when it is a JSON string, else null (numbers are not turned into text)."""
    return F.when(_kind(_get(path, "variant", root)) == "STRING", _get(path, "string", root))


def _is(path: str, *kinds: str, required: bool = False) -> Column:
    """Whether a field has one of the kinds (prefix match); absent or null passes unless required."""
    kind = _kind(_get(path, "variant"))
    ok = F.lit(False)
    for k in kinds:
        ok = ok | kind.startswith(k)
    ok = F.coalesce(ok, F.lit(False))
    return ok if required else (kind.isNull() | (kind == "VOID") | ok)


def document_errors(skeletons: DataFrame, entries: DataFrame) -> DataFrame:
    """file and error of every document that is no Bundle or Observation; both frames are from `bundles.load`."""
    root = F.try_parse_json("value")
    kind = F.when(_kind(F.try_variant_get(root, "$.resourceType", "variant")) == "STRING",
                  F.try_variant_get(root, "$.resourceType", "string"))
    entry = _kind(F.try_variant_get(root, "$.entry", "variant"))
    closed = F.rlike(F.btrim("value", F.lit(" \t\r\n")), F.lit(r"[}\]]$"))  # the parser stops at the root's end
    bad_entries = entries.where(F.try_parse_json("value").isNull()).select("file").distinct().withColumn("bad_entry", F.lit(True))
    error = (
        F.when(~F.col("sound") | root.isNull() | F.col("bad_entry") | ~closed, "invalid JSON")
        .when(kind.isNull(), "missing resourceType")
        .when(~kind.isin("Bundle", "Observation"), F.concat(F.lit("expected a Bundle or an Observation, got "), kind))
        .when((kind == "Bundle") & entry.isNotNull() & ~entry.startswith("ARRAY"), "invalid Bundle")
    )
    return skeletons.join(bad_entries, "file", "left").select("file", error.alias("error")).where("error IS NOT NULL")


def resources(skeletons: DataFrame, entries: DataFrame, errors: DataFrame) -> DataFrame:
    """Resources of valid documents: (file, position, resource as variant)."""
    root = skeletons.join(errors.select("file"), "file", "left_anti").withColumn("root", F.try_parse_json("value"))
    kind = F.try_variant_get("root", "$.resourceType", "string")
    single = root.where(kind == "Observation").select("file", F.lit(0).cast("long").alias("position"), F.col("root").alias("resource"))
    whole = checkpointed(root.where(kind == "Bundle").select("file"))
    bundled = with_files(entries, whole, "left_semi").select(
        "file", "position", F.try_variant_get(F.try_parse_json("value"), "$.resource", "variant").alias("resource")
    )
    return single.unionByName(bundled.where(F.col("resource").isNotNull() & (F.schema_of_variant("resource") != "VOID")))


def ndjson_resources(spark: SparkSession, path: str) -> DataFrame:
    """Bulk export: one resource per line; files split across tasks."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parsed_lines(lines)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Resources of (file, value) lines, each parsed once."""
    return settled(
        lines.where(stripped("value") != "").select(
            "file",
            F.monotonically_increasing_id().alias("position"),
            F.try_parse_json("value").alias("resource"),
        )
    )


def patients(rows: DataFrame) -> DataFrame:
    """Demographics of Patient resources: id, legal gender, birth year in 1900..2100."""
    year = F.when(
        F.rlike(F.substring(_text("birthDate"), 1, 4), F.lit(r"^[+]?\d+$")) & (F.char_length(_text("birthDate")) >= 4),
        F.substring(_text("birthDate"), 1, 4).try_cast("int"),
    )
    gender = _text("gender")
    return rows.where((_text("resourceType") == "Patient") & _text("id").isNotNull()).select(
        _text("id").alias("patient_id"),
        F.when(gender.isin(*GENDERS), gender).alias("gender"),
        F.when(year.between(1900, 2100), year).alias("birth_year"),
        F.struct("file", F.lit(0).cast("long").alias("start"), F.col("position").cast("long").alias("row")).alias("seq"),
    )


def _shape_ok() -> Column:
    """Every field that is read has the JSON kind the standard gives it."""
    text_or_absent = [
        "id", "effectiveDateTime", "effectiveInstant", "subject.reference", "valueQuantity.unit",
        "valueQuantity.system", "valueQuantity.code",
    ]
    ok = _is("status", "STRING", required=True) & _is("code", "OBJECT", required=True)
    ok = ok & _is("subject", "OBJECT") & _is("valueQuantity", "OBJECT")
    ok = ok & _is("valueQuantity.value", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    for path in text_or_absent:
        ok = ok & _is(path, "STRING")
    coding = _get("code.coding", "variant")
    kinds = F.transform(
        F.try_variant_get(coding, "$", "array<variant>"),
        lambda c: _kind(c).startswith("OBJECT")
        & _optional_text(c, "system")
        & _optional_text(c, "code"),
    )
    coding_ok = coding.isNull() | (_kind(coding).startswith("ARRAY") & ~F.array_contains(kinds, False))
    return ok & F.coalesce(coding_ok, F.lit(False))


def _optional_text(v: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return kind.isNull() | kind.isin("VOID", "STRING")


def parse_fhir_time(raw: Column) -> Column:
    """Full date, or RFC 3339 date-time with its offset, as UTC; null for partial or offset-less times."""
    instant = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    day = r"^\d{4}-\d{1,2}-\d{1,2}$"
    ok = F.rlike(raw, F.lit(instant)) | F.rlike(raw, F.lit(day))
    return F.when(ok, F.upper(raw).try_cast("timestamp"))


def patient_reference(reference: Column) -> Column:
    """Patient id behind ``Patient/<id>`` or ``urn:uuid:<id>``, else null."""
    return F.nullif(F.regexp_extract(reference, "^(?:Patient/|urn:uuid:)([^/]+)$", 1), F.lit(""))


def checked_observations(rows: DataFrame) -> DataFrame:
    """Observation resources with their fields and ``skip_reason`` (null when imported)."""
    coding = F.filter(
        F.try_variant_get(F.col("resource"), "$.code.coding", "array<variant>"),
        lambda c: F.try_variant_get(c, "$.system", "string") == LOINC,
    )
    system = _get("valueQuantity.system")
    code, unit = _get("valueQuantity.code"), _get("valueQuantity.unit")
    picked = rows.where(_text("resourceType") == "Observation").select(
        "file",
        "position",
        F.coalesce(
            F.concat(F.lit("Observation/"), _text("id")), F.concat(F.lit("entry["), F.col("position").cast("string"), F.lit("]"))
        ).alias("resource_label"),
        _shape_ok().alias("shape_ok"),
        _get("status").alias("status"),
        F.try_variant_get(F.get(coding, F.lit(0)), "$.code", "string").alias("code"),
        F.coalesce(_kind(_get("valueQuantity", "variant")) != "VOID", F.lit(False)).alias("has_quantity"),
        _get("valueQuantity.value", "double").alias("value"),
        F.when(system == UCUM, F.coalesce(code, unit)).otherwise(F.coalesce(unit, code)).alias("unit"),
        F.coalesce(_get("effectiveDateTime"), _get("effectiveInstant")).alias("raw_time"),
        _get("subject.reference").alias("reference"),
    )
    taken_at = parse_fhir_time(F.col("raw_time"))
    patient = patient_reference(F.col("reference"))
    reason = (
        F.when(~F.col("shape_ok"), BAD_SHAPE)
        .when(~F.col("status").isin(*ACCEPTED_STATUS), _around(BAD_STATUS, "status"))
        .when(F.col("code").isNull(), NO_CODE)
        .when(~F.col("has_quantity"), NO_QUANTITY)
        .when(~F.coalesce(F.abs("value") < float("inf"), F.lit(False)), NO_VALUE)
        .when(F.col("unit").isNull() | (stripped("unit") == ""), NO_UNIT)
        .when(F.col("raw_time").isNull(), NO_TIME)
        .when(taken_at.isNull(), _around(BAD_TIME, "raw_time"))
        .when(F.col("reference").isNull(), NO_SUBJECT)
        .when(patient.isNull(), _around(BAD_SUBJECT, "reference"))
    )
    return picked.select(
        "file",
        "position",
        "resource_label",
        patient.alias("patient_id"),
        "code",
        "value",
        "unit",
        taken_at.alias("taken_at"),
        F.lit("fhir").alias("source"),
        reason.alias("skip_reason"),
    )


def profiled_only(checked: DataFrame) -> DataFrame:
    """Map codes to analytes; accepted results without an analyte profile are skipped and say so."""
    no_profile = F.col("skip_reason").isNull() & F.col("analyte").isNull()
    return (
        with_analyte(checked)
        .withColumn(
            "skip_reason",
            F.when(no_profile, _around(NO_PROFILE, "code")).otherwise(F.col("skip_reason")),
        )
        .withColumn("code", F.coalesce("analyte", "code"))
        .drop("analyte")
    )


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations to store, skipped resources with a reason, and demographics."""
    checked = profiled_only(checked_observations(rows))
    seq = F.struct("file", F.lit(0).cast("long").alias("start"), F.col("position").cast("long").alias("row"))
    accepted = checked.where("skip_reason IS NULL").select(*OBSERVATION_COLUMNS, seq.alias("seq"))
    skipped = checked.where("skip_reason IS NOT NULL").select(
        F.col("resource_label").alias("resource"), F.col("skip_reason").alias("reason")
    )
    return accepted, skipped, patients(rows)


def read_fhir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import JSON documents; a document that is neither Bundle nor Observation is an error."""
    skeletons, entries = bundles.load(spark.read, path)
    errors = checkpointed(document_errors(skeletons, entries))
    bad = errors.orderBy("file").first()
    if bad is not None:
        raise ValueError(f"{bad['file']}: {bad['error']}")
    return split(settled(resources(skeletons, entries, errors)))


def read_ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return split(ndjson_resources(spark, path))
