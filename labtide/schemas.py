"""Declared schemas: nothing is inferred from the data."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(),
        "int": T.IntegerType(), "timestamp": T.TimestampType(),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


OBSERVATION_COLUMNS = ["patient_id", "code", "value", "unit", "taken_at", "source"]
OBSERVATIONS = _struct("patient_id:string code:string value:double unit:string taken_at:timestamp source:string")
CSV_TEXT = _struct(" ".join(f"{c}:string" for c in OBSERVATION_COLUMNS))
CSV_RAGGED = T.StructType([*CSV_TEXT.fields, T.StructField("ragged", T.StringType())])
DEMOGRAPHICS = _struct("patient_id:string gender:string birth_year:int")
REVIEW_EVENTS = _struct(
    "id:long patient_id:string code:string rule:string signal_t:long action:string"
    " reason:string actor:string snapshot:string created_at:long"
)
