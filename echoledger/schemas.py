"""Table layouts, creation and conformance checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Column names and types of the two tables, the queue and the index.
CACHE_STORE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("prompt_hash", T.StringType(), False),
        T.StructField("prompt_text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("response_json", T.StringType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("hit_count", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_hit_at", T.TimestampType()),
    ]
)
USAGE_LOG = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("cost_saved_usd", T.DoubleType()),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
INDEX_COLUMNS = ("id", "prompt_hash", "prompt_text", "embedding", "response_json", "model", "cost_usd")
PENDING = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("prompt_hash", T.StringType(), False),
        T.StructField("prompt_text", T.StringType(), False),
        T.StructField("embedding_json", T.StringType(), False),
        T.StructField("response_json", T.StringType(), False),
        T.StructField("model", T.StringType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("enqueued_at", T.TimestampType()),
    ]
)
REQUEST_LOG = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
# Columns the usage table gains so that hits can be joined to what served them.
USAGE_LINKS = (
    T.StructField("request_id", T.StringType()),
    T.StructField("prompt_hash", T.StringType()),
    T.StructField("matched_hash", T.StringType()),
    T.StructField("tier", T.StringType()),
)


def create_table(spark: SparkSession, name: str, schema: T.StructType, location: str | None = None,
                 partition_by: tuple[str, ...] = ()) -> None:
    """Create once; a second call leaves the table as it is."""
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" + ("" if f.nullable else " NOT NULL") for f in schema
    )
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{parts}{where}")


def schema_report(df: DataFrame, want: T.StructType) -> DataFrame:
    """One row per expected column: what it is, what it should be, whether it fits."""
    got = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(f.name, got.get(f.name), f.dataType.simpleString()) for f in want]
    report = df.sparkSession.createDataFrame(rows, "column_name string, got string, want string")
    return report.withColumn("ok", F.coalesce(F.col("got") == F.col("want"), F.lit(False)))


def column_fill_report(df: DataFrame, want: T.StructType) -> DataFrame:
    """Conformance plus row and null counts per column, in one pass over the table."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    present = [f for f in want if f.name in types]
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(f.name).isNull()).alias(f"null_{f.name}") for f in present],
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(types.get(f.name)).alias("got"),
            F.lit(f.dataType.simpleString()).alias("want"),
            F.lit(types.get(f.name) == f.dataType.simpleString()).alias("ok"),
            F.col("n_rows"),
            (F.col(f"null_{f.name}") if f.name in types else F.col("n_rows")).alias("n_null"),
        )
        for f in want
    ]
    return counts.select(F.inline(F.array(*entries)))


def missing_tables(spark: SparkSession, expected: list[str], database: str = "default") -> DataFrame:
    """Expected table names that the catalog does not hold."""
    want = spark.createDataFrame([(n,) for n in expected], "table_name string")
    have = spark.sql(f"SHOW TABLES IN {database}").select(F.col("tableName").alias("table_name"))
    return want.join(have, "table_name", "left_anti")
