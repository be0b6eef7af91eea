"""Metadata JSON of a stored row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.urls import INFORMATION, POLICY, REFERENCE, UNKNOWN

# Fixed value: how an absent metadata value is shown.
ABSENT = "N/A"


def build_metadata(
    doc_type: Column, refnum1: Column, refnum2: Column, source_path: Column, ingest_ms: Column
) -> Column:
    """JSON whose keys depend on the type; absent keys are left out."""
    with_refnums = doc_type.isin(POLICY, UNKNOWN)
    return F.to_json(
        F.struct(
            ingest_ms.cast("bigint").alias("timestamp"),
            F.when(with_refnums, refnum1).alias("refnum1"),
            F.when(with_refnums, refnum2).alias("refnum2"),
            F.when(doc_type.isin(REFERENCE, INFORMATION), INFORMATION).alias("doctype"),
            F.when(doc_type == UNKNOWN, UNKNOWN).alias("documentType"),
            source_path.alias("sourcePath"),
        )
    )


def no_metadata() -> Column:
    return F.lit("{}")


def metadata_value(metadata: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(metadata, f"$.{key}"), F.lit(ABSENT))
