"""Conversation files and study tables as sources."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.functions.names import dyad_id, flag, id_in_name, number_of_id, round_label, round_number
from parley.schema import CSV_TURNS
from parley.sources.scratch import file_system_of, settings

# Headers of the preference table.
PREFERENCE_NAMES = {"女性ID": "female_id", "男性ID": "male_id", "女性の交換意欲": "want_female", "男性の交換意欲": "want_male"}


#: Tasks for each core that list folders; by default Spark takes one for each folder, up to 10,000.
LISTING_TASKS = 8
#: What opening a file is taken to cost, in bytes read: some 500 small files make a task, by default 32.
OPEN_COST = 256 * 1024


def listing(spark: SparkSession):
    """Settings for a reader of many folders."""
    return settings(spark, spark__sql__sources__parallelPartitionDiscovery__parallelism=str(LISTING_TASKS * spark.sparkContext.defaultParallelism))


def small_files(spark: SparkSession):
    """Settings for a job that reads many small files."""
    return settings(spark, spark__sql__files__openCostInBytes=str(OPEN_COST))


def header_columns(spark: SparkSession, data_dir: str) -> int:
    """Columns of the widest header among the folder's files, or more: of any line with the names that a header must have."""
    with listing(spark):
        lines = spark.read.text(data_dir, pathGlobFilter="*.csv")
    lines = lines.where(F.lower("value").contains("text") & F.lower("value").contains("speaker"))
    with small_files(spark):
        return lines.agg(F.max(F.regexp_count("value", F.lit(",")) + 1)).first()[0] or 1


def _file_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """file_path, turn, header, names (normalised) and cells v of each row below a file's header, and whether the file is corrupt.

    A file is corrupt if a row has more cells than the header, or bytes that are no UTF-8.
    """
    width = header_columns(spark, data_dir) + 1  # one more shows rows that are longer than every header
    cells = ", ".join(f"c{k} string" for k in range(width))
    with listing(spark):
        rows = spark.read.schema(cells).csv(
            data_dir, pathGlobFilter="*.csv", multiLine=True, lineSep="\n", escape='"', mode="PERMISSIVE",
            maxColumns=max(20480, width + 1)
        )
    rows = rows.select(
        F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("at"),
        F.array(*(F.rtrim(F.col(f"c{k}"), F.lit("\r")) for k in range(width))).alias("v")
    )
    order, whole = Window.partitionBy("file_path").orderBy("at"), Window.partitionBy("file_path")
    rows = rows.withColumns({"header": F.first("v").over(order), "turn": (F.row_number().over(order) - 2).cast("long")})
    used = lambda v: F.coalesce(F.array_max(F.transform(v, lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0))
    wrong = (used(F.col("v")) > used(F.col("header"))) | F.exists("v", lambda x: x.contains("\ufffd"))
    rows = rows.withColumn("corrupt", F.max(F.coalesce(wrong, F.lit(False))).over(whole)).where("turn >= 0")
    return rows.withColumn("names", F.transform("header", lambda x: F.lower(F.regexp_replace(x, r"(?U)^[\s\uFEFF]+|\s+$", ""))))


@contextmanager
def file_rows(spark: SparkSession, data_dir: str, scratch_dir: str) -> Iterator[DataFrame]:
    """The files' rows for several readers: listed and parsed once, into a table under scratch_dir that goes when the block ends."""
    path = f"{scratch_dir.rstrip('/')}/_rows-{uuid.uuid4().hex}"
    files, at = file_system_of(spark, path)
    rows = _file_rows(spark, data_dir)
    try:
        with small_files(spark):
            rows.write.parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        files.delete(at, True)


def corrupt_files(spark: SparkSession, data_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """file_path of each file that read_conversations leaves out as corrupt; `rows`: those of file_rows, if at hand."""
    rows = _file_rows(spark, data_dir) if rows is None else rows
    return rows.where("corrupt").select("file_path").distinct()


def warn_of_corrupt_files(spark: SparkSession, data_dir: str, rows: DataFrame | None = None) -> None:
    if some := [r[0] for r in corrupt_files(spark, data_dir, rows).limit(20).collect()]:
        warnings.warn(f"corrupt files are left out: {', '.join(some)}{' and more' if len(some) == 20 else ''}", stacklevel=2)


def read_conversations(
    spark: SparkSession, data_dir: str, schema: str | StructType = CSV_TURNS, rows: DataFrame | None = None
) -> DataFrame:
    """All *.csv directly under a folder: file_path, file_basename, turn, ids, round and the file's columns.

    Columns go by each file's own header, of any width; those that a file lacks are null, and so are values of
    another type.  A file is read by one task, so its lines keep their order, and a turn's number is its row's
    place.  Files without text or speaker give no rows, and neither do corrupt ones.  `rows`: those of file_rows, if
    at hand.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = _file_rows(spark, data_dir) if rows is None else rows
    rows = rows.where("not corrupt").where(F.array_contains("names", "text") & F.array_contains("names", "speaker"))
    picked = [F.get("v", F.nullif(F.array_position("names", f.name), F.lit(0)).cast("int") - 1).try_cast(f.dataType).alias(f.name) for f in wanted]
    base = F.element_at(F.split("file_path", "/"), -1)
    f, m, k = id_in_name(base, "F"), id_in_name(base, "M"), round_number(base)
    ids = [f.alias("female_id"), m.alias("male_id"), dyad_id(f, m).alias("dyad_id"), k.alias("round_num"), round_label(k).alias("round_label")]
    return rows.select("file_path", base.alias("file_basename"), "turn", *ids, *picked)


def of_round(conversations: DataFrame, round_number: int | None = None) -> DataFrame:
    if round_number not in (1, 2, None):
        raise ValueError(f"round {round_number!r}; 1, 2 or None")
    return conversations if round_number is None else conversations.where(F.col("round_num") == round_number)


def conversation_files(conversations: DataFrame, round_number: int | None = None) -> DataFrame:
    return of_round(conversations, round_number).select("file_basename").distinct().orderBy("file_basename")


def single_conversation(conversations: DataFrame, name: str) -> DataFrame:
    """One conversation by path or file name; no rows if there is none."""
    return conversations.where((F.col("file_path") == name) | (F.col("file_basename") == F.element_at(F.split(F.lit(name), "/"), -1)))


def normal_preferences(raw: DataFrame) -> DataFrame:
    """female_id, male_id, want_female, want_male with English names, numbers and booleans."""
    named = raw.withColumnsRenamed({k: v for k, v in PREFERENCE_NAMES.items() if k in raw.columns})
    if missing := [c for c in PREFERENCE_NAMES.values() if c not in named.columns]:
        raise KeyError(f"columns missing: {missing}")
    return named.select(
        *(number_of_id(F.col(c)).alias(c) for c in ("female_id", "male_id")),
        *(flag(F.col(c)).alias(c) for c in ("want_female", "want_male"))
    )


def read_preferences(spark: SparkSession, path: str | None) -> DataFrame:
    if not path:
        raise ValueError("no preference table was named")
    return normal_preferences(spark.read.csv(path, header=True))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A result table: Parquet, or CSV with a header."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
