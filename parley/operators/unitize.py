"""Repair of timed transcripts into clean turns that don't overlap.

Neighbouring segments of one speaker are merged; at each instant the segment that started last owns the
floor; neighbours are merged again.  Segments meet the elementary intervals in buckets of time, so the
join grows with the transcript and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.names import speaker as normal_speaker
from parley.functions.text import bracket_counts, clean_or_raw, without_brackets

#: Seconds of a bucket in which segments and instants meet, at least; and buckets for each segment of a conversation, at most.
BUCKET = 30.0
BUCKETS_A_SEGMENT = 4


def cleaned(rows: DataFrame, bracket_mode: str = "unwrap", strip_tags: bool = True, drop_blank: bool = False) -> DataFrame:
    """Normal speakers, and text_clean without brackets; a blank one falls back to the text unless dropped."""
    raw = F.coalesce("text", F.lit(""))
    clean = without_brackets(raw, bracket_mode) if strip_tags else raw
    return rows.withColumns(
        {"speaker": normal_speaker(F.col("speaker"), wide=False), "text_clean": clean if drop_blank else clean_or_raw(clean, raw)}
    )


def merged_neighbours(segments: DataFrame, gap: float = 0.0) -> DataFrame:
    """conv_id, turn, speaker, start, end, text: runs of one speaker whose gaps are at most `gap`, overlaps included."""
    order = Window.partitionBy("conv_id").orderBy("start", "end", "turn")
    rows = segments.where(F.col("end") > F.col("start"))
    rows = rows.withColumn("turned", F.coalesce((F.lag("speaker").over(order) != F.col("speaker")).cast("long"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("turned").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("conv_id", "run").orderBy("start", "end", "turn")
    reach = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("apart", F.coalesce((F.col("start") - reach > gap).cast("long"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("apart").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_sort(F.collect_list(F.struct("start", "end", "turn", F.col("text"))))
    out = rows.groupBy("conv_id", "run", "part").agg(
        F.min("turn").alias("turn"), F.first("speaker").alias("speaker"), F.min("start").alias("start"),
        F.max("end").alias("end"), texts.alias("texts")
    )
    whole = F.array_join(F.filter(F.transform("texts", lambda x: x["text"]), lambda t: t != ""), " ")
    return out.select("conv_id", "turn", "speaker", "start", "end", whole.alias("text"))


def owned_intervals(segments: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, start, end, text, lo, hi: the stretches in which each segment owns the floor."""
    bucket = lambda c: F.floor(c / F.col("width"))
    whole = Window.partitionBy("conv_id")
    # A time far off makes buckets wider, not more.
    span = (F.max("end").over(whole) - F.min("start").over(whole)) / (BUCKETS_A_SEGMENT * F.count("*").over(whole))
    placed = segments.withColumn("width", F.greatest(F.lit(BUCKET), span))
    points = placed.select("conv_id", "width", F.explode(F.array("start", "end")).alias("lo")).distinct()
    steps = points.withColumn("hi", F.lead("lo").over(Window.partitionBy("conv_id").orderBy("lo"))).where("hi is not null")
    steps = steps.withColumn("bucket", bucket(F.col("lo"))).drop("width")
    spread = placed.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    met = spread.join(steps, ["conv_id", "bucket"]).where((F.col("start") <= F.col("lo")) & (F.col("end") >= F.col("hi")))
    best = Window.partitionBy("conv_id", "lo").orderBy(F.desc("start"), F.desc("end"), F.desc("turn"))
    owners = met.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    order = Window.partitionBy("conv_id").orderBy("lo")
    before = F.lag(F.struct("turn", "hi")).over(order)
    fresh = F.coalesce((before["turn"] != F.col("turn")) | (before["hi"] != F.col("lo")), F.lit(True))
    owners = owners.withColumn("fresh", fresh.cast("long")).withColumn("piece", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = ["conv_id", "turn", "speaker", "start", "end", "text"]
    return owners.groupBy(*same, "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("piece")


def shared_text(pieces: Column, text: Column, end: Column) -> Column:
    """Fold of a segment's pieces in time order: each takes its share of what is left of the text, by time.

    The last piece takes all that is left only if it reaches the segment's end; else the rest is dropped.
    """
    strip = r"(?U)^\s+|\s+$"
    start = F.struct(text.alias("rest"), F.array().cast("array<struct<lo:double,hi:double,text:string>>").alias("out"))

    def step(state: Column, p: Column) -> Column:
        rest = state["rest"]
        k = F.bround(F.length(rest) * (p["hi"] - p["lo"]) / (end - p["lo"])).cast("int")
        own = F.regexp_replace(rest.substr(F.lit(1), k), strip, "")
        return F.struct(
            F.regexp_replace(rest.substr(k + 1, F.length(rest)), strip, "").alias("rest"),
            F.array_append(state["out"], F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), own.alias("text"))).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def without_overlaps(segments: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, start, end, text: pieces that don't overlap, with their shares of the text."""
    same = ["conv_id", "turn", "speaker", "start", "end", "text"]
    rows = owned_intervals(segments).groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("pieces"))
    rows = rows.select("conv_id", "turn", "speaker", F.inline(shared_text(F.col("pieces"), F.col("text"), F.col("end"))))
    return rows.select("conv_id", "turn", "speaker", F.col("lo").alias("start"), F.col("hi").alias("end"), "text")


def unitized(rows: DataFrame, mode: str = "approx", merge_gap: float = 0.0, bracket_mode: str = "unwrap", strip_tags: bool = True) -> DataFrame:
    """Turns from rows (conv_id, turn, speaker, text, start, end); `off`, or no times, only cleans the text.

    Conversations without any times keep their rows; turns of the others are numbered anew, in time order.
    """
    if not {"text", "speaker"} <= set(rows.columns):
        return rows
    clean = cleaned(rows, bracket_mode, strip_tags)
    if mode == "off" or not {"start", "end"} <= set(rows.columns):
        return clean
    parts = clean.select(
        "conv_id", "turn", "speaker", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"),
        F.col("text_clean").alias("text")
    )
    parts = parts.withColumn("timed", F.count(F.col("start") + F.col("end")).over(Window.partitionBy("conv_id")) > 0)
    whole = merged_neighbours(without_overlaps(merged_neighbours(parts.where("timed"), merge_gap)), merge_gap)
    order = Window.partitionBy("conv_id").orderBy("start", "end", "turn")  # a segment's pieces have its number: count anew
    whole = whole.withColumn("turn", (F.row_number().over(order) - 1).cast("long"))
    return whole.unionByName(parts.where("not timed").drop("timed"))


def report(rows: DataFrame, done: DataFrame) -> DataFrame:
    """conv_id, rows before and after, brackets kept and deleted, rows without a length."""
    kept, deleted = bracket_counts(F.coalesce("text", F.lit("")))
    one = rows.groupBy("conv_id").agg(
        F.count("*").alias("rows_in"), F.sum(kept).alias("brackets_kept"), F.sum(deleted).alias("brackets_deleted"),
        F.count_if(~F.coalesce(F.col("end") > F.col("start"), F.lit(False))).alias("rows_without_length")
    )
    return one.join(
        done.groupBy("conv_id").agg(F.count("*").alias("rows_out")), "conv_id", "left"
    ).withColumn("rows_out", F.coalesce("rows_out", F.lit(0)))
