"""Functions for SQL users: ``register`` makes the library's column functions callable by name.

Those that Spark can express stay expressions (SQL functions with a body that Catalyst inlines); only compatibility
forms need Python."""

from pyspark.sql import SparkSession

from ..operators.hygiene import LEET, _compatible
from ..operators.text import SHAPES, TYPES


def register(spark: SparkSession) -> list[str]:
    """Registers caselake_mask, caselake_type, caselake_leet and caselake_nfkc for this session."""
    mask = "t"
    for _, token, pattern in SHAPES:
        mask = f"regexp_replace({mask}, r'{pattern}', '{token}')"
    kind = "CASE " + " ".join(f"WHEN t RLIKE r'{p}' THEN '{n}'" for n, p in TYPES) + " ELSE 'unknown' END"
    bodies = {"caselake_mask": mask, "caselake_type": kind, "caselake_leet": f"translate(t, '{LEET[0]}', '{LEET[1]}')"}
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {body}")
    spark.udf.register("caselake_nfkc", _compatible)
    return [*bodies, "caselake_nfkc"]
