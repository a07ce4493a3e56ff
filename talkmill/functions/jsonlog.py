"""JSON log lines and JSON payload columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.schemas import LOG_LINE


def parse_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add one column per log field and ``malformed`` for lines that are not a JSON object."""
    schema = T.StructType([*LOG_LINE.fields, T.StructField("_broken", T.StringType())])
    parsed = lines.withColumn(
        "_log", F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    )
    fields = {name: F.col(f"_log.{name}") for name in LOG_LINE.names}
    return parsed.withColumns(
        {**fields, "malformed": F.col("_log").isNull() | F.col("_log._broken").isNotNull()}
    ).drop("_log")


def format_log(*fields: str) -> Column:
    """A log line as JSON; absent (null) fields are left out."""
    return F.to_json(F.struct(*[F.col(name) for name in fields]), {"ignoreNullFields": "true"})


def payload_value(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path)
