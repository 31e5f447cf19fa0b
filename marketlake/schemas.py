"""Explicit schemas of the stored datasets and decoded messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

__all__ = ["COMMAND", "EOD", "JOB_STATUS", "MANIFEST", "PUBLICATION", "SECTOR_FEATURES", "SIGNAL_HISTORY", "conform"]

_SIMPLE = {
    "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField(n, _SIMPLE[t] if isinstance(t, str) else t) for n, t in fields.items()]
    )


EOD = _struct(
    exchange="string", code="string", date="date", ad_open="double", ad_high="double", ad_low="double",
    ad_close="double", nm_volume="double",
)

CONTRIBUTOR = _struct(
    symbol="string", weight="double", **{"return": "double"}, contribution="double",
    contribution_share="double", above_ma20="boolean",
)

SECTOR_FEATURES = _struct(
    date="date", sector_code="string", sector_level="bigint", sector_index="double", sector_return="double",
    ma20="double", relative_strength="double", volume_ratio="double", breadth_above_ma20="double",
    coverage_ratio="double", top_3_contribution_share="double", contributors=T.ArrayType(CONTRIBUTOR),
    contributors_json="string",
)

SIGNAL_HISTORY = _struct(
    symbol_key="string", exchange="string", strategy="string", timeframe="string", signal_date="date",
    signal="string", signal_price="double", score="int", reason_codes="array<string>",
    generated_at="timestamp", last_recalculated_at="timestamp", revision="int",
    actual_price_t5="double", actual_return_t5="double", actual_price_t10="double",
    actual_return_t10="double", actual_price_t15="double", actual_return_t15="double",
    actual_price_t20="double", actual_return_t20="double", actual_updated_at="timestamp",
)

COMMAND = _struct(
    jobDefinitionId="string", executionId="string", parentExecutionId="string", source="string",
    symbolKey="string", exchange="string", timeframe="string", strategy="string",
    indicatorSource="string", indicators="array<string>", sectorCode="string", sectorLevel="int",
    sectorCodes="array<string>", focusSectorCodes="array<string>", predictionHorizons="array<int>",
    evaluationDate="string", metadata="map<string,string>",
)

JOB_STATUS = _struct(
    jobDefinitionId="string", executionId="string", parentExecutionId="string", symbolKey="string",
    status="string", startedAt="timestamp", finishedAt="timestamp", errorMessage="string",
    recordsProcessed="int", durationMs="bigint", metaJson="map<string,string>", newOffset="string",
)

_COLUMN = _struct(name="string", type="string", nullable="boolean")
_INPUT = _struct(dataset="string", partition="map<string,string>", dataVersion="string")

MANIFEST = _struct(
    version="int", dataset="string", partition="map<string,string>", status="string", path="string",
    dataVersion="string", objectCount="bigint", totalBytes="bigint", rowCount="bigint",
    columnCount="bigint", columns=T.ArrayType(_COLUMN), schemaVersion="int", schemaHash="string",
    generatedAt="string", minTimestamp="string", maxTimestamp="string", inputs=T.ArrayType(_INPUT),
    sourceExecutionId="string",
)
#: Manifests as this library records them: with the number that orders publications.
PUBLICATION = T.StructType([*MANIFEST.fields, T.StructField("publication", T.LongType())])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive change: columns the frame lacks are appended as null, the order is the schema's."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
