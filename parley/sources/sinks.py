"""Result tables on disk, each rounded for reading and in full for further work; conversations as files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.scratch import file_system_of


def save(df: DataFrame, out_dir: str, name: str, digits: int = 6, order: tuple[str, ...] = ()) -> bool:
    """<name> as CSV with rounded numbers, <name>_full as Parquet; an empty table is not written.

    The table is computed once, for the Parquet files, from which the CSV files come.  Both keep one file per
    task; `order` sorts them for readers, nulls first.
    """
    spark, full = df.sparkSession, f"{out_dir}/{name}_full"
    ordered = lambda x: x.orderBy(*(F.col(c).asc_nulls_first() for c in order)) if order else x
    fresh = f"{out_dir}/_{name}_new"
    ordered(df).write.mode("overwrite").parquet(fresh)
    files, at = file_system_of(spark, fresh)
    if spark.read.schema(df.schema).parquet(fresh).isEmpty():
        files.delete(at, True)
        return False
    target = file_system_of(spark, full)[1]
    files.delete(target, True)
    if not files.rename(at, target):
        raise OSError(f"can't rename {fresh} to {full}")
    back = ordered(spark.read.schema(df.schema).parquet(full))
    text = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    text = [F.when(F.col(c).isNotNull(), x).alias(c) if t == "double" else x for (c, t), x in zip(df.dtypes, text, strict=True)]
    back.select(*text).write.mode("overwrite").csv(f"{out_dir}/{name}", header=True)
    return True


def write_conversations(turns: DataFrame, folder: str) -> None:
    """A CSV file for each conversation, in folders under `folder`: its turns in order, with a header; a null text is empty.

    turns: conv_id (a number), turn and what the files hold.  Paths have conv_id=<number> before a / or a dot.  On a
    local disk workers write the files themselves, many to a folder: through Hadoop each would start a process
    to set permissions, and have a folder of its own for readers to list.
    """
    options = {"escape": '"', "quoteAll": True}
    names = [c for c in turns.columns if c not in ("conv_id", "turn")]
    dealt = turns.repartition("conv_id")
    files, at = file_system_of(turns.sparkSession, folder)
    if files.getScheme() != "file":
        dealt.sortWithinPartitions("conv_id", "turn").drop("turn").write.partitionBy("conv_id").csv(folder, header=True, **options)
        return
    files.mkdirs(file_system_of(turns.sparkSession, f"{folder}/0")[1])  # there is one to read, even without turns
    path, header = at.toUri().getPath(), ",".join(f'"{c}"' for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = f"{path}/{TaskContext.get().partitionId()}"
        os.makedirs(here, exist_ok=True)
        name, out, written = None, None, 0

        def ended() -> None:  # a file has its name once it is whole, so a task may be repeated
            out.close()
            os.replace(out.name, f"{here}/{name}")

        for batch in batches:
            for k, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if name != (this := f"conv_id={'__HIVE_DEFAULT_PARTITION__' if k is None else k}.csv"):
                    if out:
                        ended()
                    name, written = this, written + 1
                    out = open(f"{here}/.{name}-{TaskContext.get().taskAttemptId()}", "w", encoding="utf-8", newline="")  # noqa: SIM115
                    out.write(header + "\n")
                out.write(line + "\n")
        if out:
            ended()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])

    lines = dealt.select("conv_id", "turn", F.to_csv(F.struct(*names), options).alias("line"))
    lines.sortWithinPartitions("conv_id", "turn").drop("turn").mapInArrow(run, "files long").agg(F.sum("files")).collect()
