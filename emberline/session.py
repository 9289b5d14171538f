"""Session settings that the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The JVM compiles no method of more than 8,000 bytes of bytecode, it only interprets it. Long scoring projections fused into
#: one method exceed that; unfused, Spark splits their expressions over many short methods.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """``builder`` with the settings above; they change no result, only its speed."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
