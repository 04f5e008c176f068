"""The unified thread record."""

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("model", T.StringType())])
CONTEXT = T.StructType([
    T.StructField("files", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("snippet", T.StringType())]))),
    T.StructField("diffs", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("patch", T.StringType())]))),
])
META = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("source", "project", "created_at", "updated_at", "model", "file_path", "prompt")),
    T.StructField("tokens", T.LongType()), T.StructField("recognition_confidence", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())),
])
THREAD = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("thread_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("context", CONTEXT), T.StructField("meta", META)])
SCHEMA_VERSION = "1.0.0"
MESSAGES_DDL = "array<struct<role:string,content:string,timestamp:string,model:string>>"
CONTEXT_DDL = "struct<files:array<struct<path:string,snippet:string>>,diffs:array<struct<path:string,patch:string>>>"
