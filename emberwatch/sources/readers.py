"""Sources (S1-S6), batch and streaming, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.text import strip

# Nested failure record; codes are text because senders write them either way.
FAILURE = (
    "event_id bigint, ts timestamp_ntz, model string, "
    "slo struct<error_information:struct<error_code:string,error_class:string,llm_provider:string>,"
    "error_str:string,model:string>, "
    "exc struct<status_code:string,llm_provider:string,cls:string,text:string>"
)

# S3: array of process states; the restart counter may sit on either level.
PROCESSES = (
    "array<struct<name:string,restart_time:bigint,monit:struct<memory:bigint>,"
    "pm2_env:struct<status:string,restart_time:bigint>>>"
)

# Fixed value: a KEY=VALUE line.
_ENV_LINE = r"^([^#=]+)=(.*)"


def snippets_from_files(spark: SparkSession, path: str, language: str = "auto", glob: str = "*.py") -> DataFrame:
    """One snippet per file, whole."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("snippet_id"), F.col("value").alias("code"), F.lit(language).alias("language")
    )


def snippets_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Snippets as JSON rows; a missing language is detected."""
    rows = spark.read.schema("snippet_id string, code string, language string").json(path)
    return rows.withColumn("language", F.coalesce("language", F.lit("auto")))


def stream_snippets(spark: SparkSession, path: str) -> DataFrame:
    """S1 as a stream of JSON files."""
    rows = spark.readStream.schema("snippet_id string, code string, language string").json(path)
    return rows.withColumn("language", F.coalesce("language", F.lit("auto")))


def failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure records as JSON rows."""
    return spark.read.schema(FAILURE).json(path)


def stream_failures(spark: SparkSession, path: str) -> DataFrame:
    """S2 as a stream of JSON files."""
    return spark.readStream.schema(FAILURE).json(path)


def process_snapshots(polls: DataFrame, payload: str = "payload", counter: str = "top") -> DataFrame:
    """S3: one row per process of each poll, with the defaults of missing fields.

    ``counter`` says which restart counter is read: ``top`` (the monitor) or ``env`` (the status report).
    """
    processes = F.from_json(payload, PROCESSES)
    restarts = F.col("p.restart_time") if counter == "top" else F.col("p.pm2_env.restart_time")
    rest = [c for c in polls.columns if c != payload]
    return polls.select(*rest, F.explode(processes).alias("p")).select(
        *rest,
        F.coalesce("p.name", F.lit("?")).alias("name"),
        F.coalesce(restarts, F.lit(0)).alias("restarts"),
        F.coalesce("p.monit.memory", F.lit(0)).alias("mem_bytes"),
        F.coalesce("p.pm2_env.status", F.lit("?")).alias("status"),
    )


def health_status(payload: Column) -> Column:
    """Status of a health answer; ``unknown`` if it names none, NULL if there was no (readable) answer."""
    answer = F.from_json(payload, "db string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(payload.isNotNull() & answer["_bad"].isNull(), F.coalesce(answer["db"], F.lit("unknown")))


def env_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Key and value of each KEY=VALUE line; other lines are dropped."""
    trimmed = strip(F.col(text))
    hits = lines.filter(F.rlike(trimmed, F.lit(_ENV_LINE)))
    return hits.withColumn("key", strip(F.regexp_extract(trimmed, _ENV_LINE, 1))).withColumn(
        "value", strip(F.regexp_extract(trimmed, _ENV_LINE, 2))
    )


def env_settings(pairs: DataFrame, order: str = "line", keep: str = "first_nonempty") -> DataFrame:
    """One value per path and key: the first that is not empty, or (``last``) the last.

    Aggregates instead of ranking, so a key repeated on very many lines is combined before the shuffle.
    """
    if keep == "last":
        value = F.max_by("value", order)
    else:
        value = F.coalesce(F.min_by("value", F.when(F.col("value") != "", F.col(order))), F.lit(""))
    return pairs.groupBy("path", "key").agg(value.alias("value"))


def override_settings(settings: DataFrame, process_env: DataFrame) -> DataFrame:
    """A non-empty value of the process (``key, env_value``) wins over the file's."""
    joined = settings.join(process_env, "key", "left")
    return joined.withColumn("value", F.coalesce(F.nullif(F.col("env_value"), F.lit("")), "value")).drop("env_value")


def catalog(models: DataFrame) -> DataFrame:
    """The model catalog; an entry needs a name and a base."""
    return models.filter((F.col("model_name") != "") & (F.col("api_base") != ""))


def aliases(raw: DataFrame) -> DataFrame:
    """Alias targets given as text or as an object with ``model`` (JSON text either way)."""
    as_object = F.get_json_object("target", "$.model")
    target = F.when(F.startswith(F.col("target"), F.lit("{")), F.coalesce(as_object, F.lit(""))).otherwise(F.col("target"))
    return raw.withColumn("target", target)


def numbered_document_lines(documents: DataFrame, lines: Column) -> DataFrame:
    """Lines of documents as ``path, line, value`` rows for S5."""
    return documents.select(F.col("doc_id").alias("path"), F.posexplode(lines).alias("line", "value"))

