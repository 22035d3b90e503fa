"""Sources (S1-S9): declared schemas, no inference over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = "prompt string, response string, is_safe boolean"
# flags arrive as booleans or as the string "True"; JSON booleans read as strings keep both
PAIRED = (
    "prompt string, response_0 string, response_1 string, "
    "is_response_0_safe string, is_response_1_safe string"
)
INSTRUCTION = "instruction string, input string, output string"


def read_examples(
    spark: SparkSession, path: str | list[str], schema: str = EXAMPLE, parts: int | None = None
) -> DataFrame:
    """Line-delimited JSON, plain or gzip.

    A gzip file is one task; ``parts`` spreads its rows for the work after it.
    """
    df = spark.read.schema(schema).json(path)
    return df.repartition(parts) if parts else df


def read_score_arrays(
    spark: SparkSession, path: str, columns: dict[str, str], keys: dict[str, str] | None = None, lines: bool = False
) -> DataFrame:
    """S3: JSON documents of index-aligned arrays as rows (keys..., pool_id, columns...).

    ``columns`` maps each field to its element type. A pool may be one document
    or, with ``lines``, many blocks of one line each, told apart by ``keys``, so
    that large pools are read in parallel. Arrays of unequal length are an
    error, as an index would not name one row.
    """
    keys = keys or {}
    fields = [*(f"`{k}` {t}" for k, t in keys.items()), *(f"`{c}` array<{t}>" for c, t in columns.items())]
    doc = spark.read.schema(", ".join(fields)).option("multiLine", not lines).json(path)
    sizes = F.array(*[F.size(c) for c in columns])
    same = F.array_max(sizes) == F.array_min(sizes)
    zipped = F.when(same, F.arrays_zip(*columns)).otherwise(
        F.raise_error(F.lit("score arrays differ in length"))
    )
    return doc.select(*keys, F.posexplode(zipped).alias("pool_id", "_r")).select(
        *keys, F.col("pool_id").cast("bigint").alias("pool_id"), "_r.*"
    )


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """S3: a JSON array of examples; the list position becomes ``pool_id``."""
    text = spark.read.option("wholetext", True).text(path)
    rows = F.from_json("value", f"array<struct<{EXAMPLE.replace(' string', ':string').replace(' boolean', ':boolean')}>>")
    return text.select(F.posexplode(rows).alias("pool_id", "_r")).select(
        F.col("pool_id").cast("bigint").alias("pool_id"), "_r.*"
    )


def read_csv(
    spark: SparkSession, path: str, schema: str, where: Column | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header; quoted fields may span lines unless ``multi_line`` is off, which lets large files be split."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return df.where(where) if where is not None else df


def read_categorised_csv(spark: SparkSession, glob: str) -> DataFrame:
    """Headerless CSV, the category being the name of the file; blank lines dropped.

    A category may also be a folder of that name, as a parallel writer leaves it.
    """
    raw = spark.read.schema("prompt string").option("escape", '"').csv(glob)
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv(?:/[^/]*)?$", 1).alias("category"),
        F.trim("prompt").alias("prompt"),
    ).where(F.coalesce(F.col("prompt"), F.lit("")) != "")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet; name the columns to read only those."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_embeddings(spark: SparkSession, path: str, ids: list[str], vec: str) -> DataFrame:
    """An embedding column as a vector for Spark ML."""
    from pyspark.ml.functions import array_to_vector

    df = spark.read.parquet(path)
    return df.select(*ids, array_to_vector(F.col(vec).cast("array<double>")).alias(vec))


def parse_model_name(df: DataFrame, model: str = "model") -> DataFrame:
    """Split ``<arm>_s<seed>`` exactly; other names get no arm."""
    pattern = r"^(.*)_s(\d+)$"
    ok = F.col(model).rlike(pattern)
    return df.withColumn("arm", F.when(ok, F.regexp_extract(model, pattern, 1))).withColumn(
        "seed", F.when(ok, F.regexp_extract(model, pattern, 2).cast("int"))
    )


def harm_prompts(**sets: DataFrame) -> DataFrame:
    """Several prompt sets, each (category, prompt), as one (set, category, prompt) table."""
    out = None
    for name, df in sets.items():
        part = df.select(F.lit(name).alias("set"), "category", "prompt")
        out = part if out is None else out.unionByName(part)
    return out
