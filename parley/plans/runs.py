"""Whole studies: from conversation files to result tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.dictionary import Dictionary
from parley.functions.names import speaker
from parley.functions.text import clean_or_raw
from parley.operators import features, responsiveness, rolling, similarity, unitize
from parley.schema import CATEGORIES, EPS, MICRO_CATEGORIES, MIN_TURN_WORDS, ROLLING_WINDOW, WINDOW_MINUTES, ZERO_TOL
from parley.sources.sinks import save
from parley.sources.transcripts import file_rows, of_round, read_conversations, warn_of_corrupt_files

GENDERS = ("female", "male")
META = ("file_basename", "female_id", "male_id", "dyad_id", "round_num", "round_label")


@dataclass(frozen=True)
class Options:
    """How turns are scored; the defaults are those of the published measures."""

    policy: str = "bilateral_only"
    eps: float = EPS
    zero_tol: float = ZERO_TOL
    unitize: bool = False
    merge_gap: float = 0.0
    strip_tags: bool = True
    bracket_mode: str = "unwrap"
    micro: bool = False
    rolling: bool = False
    window: int = ROLLING_WINDOW
    include_current: bool = True
    min_window_tokens: int = 0


def as_turns(conversations: DataFrame) -> DataFrame:
    """File rows as turns: the file is the conversation; text_clean is preferred; speakers are normalised."""
    text = clean_or_raw(F.col("text_clean"), F.col("text")) if "text_clean" in conversations.columns else F.col("text")
    times = [c for c in ("start", "end") if c in conversations.columns]
    return conversations.select(F.col("file_path").alias("conv_id"), "turn", speaker(F.col("speaker")).alias("speaker"), text.alias("text"), *times)


def meta_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("file_path").alias("conv_id"), *META).distinct()


def lsm_tables(
    conversations: DataFrame, dictionary: Dictionary, categories: Sequence[str] = CATEGORIES, minutes: float | None = None,
    dictionary_name: str | None = None
) -> dict[str, DataFrame]:
    """lsm_results and, with a width, lsm_temporal: a wide record for each conversation (and window)."""
    own = dictionary.only(categories)
    counts = features.turn_counts(as_turns(conversations), own, own.labels).drop("text")
    meta = meta_of(conversations)
    timed = as_turns(conversations).groupBy("conv_id").agg((F.count("start") > 0).alias("has_timestamps"))
    constant = {"categories_order": F.lit("|".join(own.labels)), "dic_filename": F.lit(dictionary_name)}
    named = {"total_1": "female_total_words", "total_2": "male_total_words", "conv_id": "file_path"}
    static = similarity.conversation_similarity(counts, GENDERS, own.labels).where("total_1 > 0 OR total_2 > 0")
    out = {"lsm_results": static.join(meta, "conv_id", "left").join(timed, "conv_id", "left").withColumns(constant).withColumnsRenamed(named)}
    if minutes is not None and minutes > 0:
        temporal = similarity.temporal_similarity(counts, GENDERS, own.labels, minutes)
        out["lsm_temporal"] = temporal.join(meta, "conv_id", "left").withColumns(
            constant | {"window_size_sec": F.lit(round(minutes * 60))}
        ).withColumnsRenamed(named)
    return out


def levels(counts: DataFrame, pairs: DataFrame, categories: Sequence[str], policy: str, prefix: str = "") -> dict[str, DataFrame]:
    """individual and dyad tables, long."""
    own = responsiveness.individuals(pairs, categories)
    spine = responsiveness.individual_spine(counts, own, categories)
    dyad = responsiveness.dyads(counts, own, categories, policy)
    return {
        "individual": similarity.as_long(
            spine, ["conv_id", F.col("speaker").alias("speaker_gender")], categories, "rlsm", f"{prefix}individual_rlsm"
        ),
        "dyad": similarity.as_long(dyad, ["conv_id"], categories, "dyad", f"{prefix}dyad_rlsm").withColumn("na_policy", F.lit(policy)),
        "final": dyad.select("conv_id", F.col("dyad_final").alias(f"{prefix}dyad_final_rlsm")),
    }


def rolling_tables(counts: DataFrame, categories: Sequence[str], o: Options) -> dict[str, DataFrame]:
    """The rolling tables; aggregates use every window, pair rows and their number only large enough ones."""
    rates = rolling.rolling_rates(rolling.long_turns(counts, MIN_TURN_WORDS), categories, o.window, o.include_current)
    every = rolling.rolling_pairs(rates, categories, 0, o.eps, o.zero_tol)
    shown = rolling.rolling_pairs(rates, categories, o.min_window_tokens, o.eps, o.zero_tol)
    parameters = {"window_size_param": F.lit(o.window), "include_current": F.lit(o.include_current), "min_window_tokens": F.lit(o.min_window_tokens)}
    level = levels(counts, every, categories, o.policy, "rw_")
    whole = responsiveness.overall(responsiveness.individuals(every, categories), categories)
    both = whole.groupBy("conv_id").agg(*(F.max(F.when(F.col("speaker") == s, F.col("overall"))).alias(f"rw_{s}_overall_rlsm") for s in GENDERS))
    one = level["final"].join(both, "conv_id", "left").join(rolling.scored_pairs(shown, categories), "conv_id", "left")
    one = one.withColumns({"n_pair_turns": F.coalesce("n_pair_turns", F.lit(0).cast("long")), "na_policy": F.lit(o.policy)} | parameters)
    keys = [
        "conv_id", F.col("pair_number").alias("pair_index"), "leader", "responder",
        F.col("lead_win_size").alias("leader_window_size"), F.col("resp_win_size").alias("responder_window_size"),
        F.col("lead_win_total").alias("leader_window_total_words"), F.col("resp_win_total").alias("responder_window_total_words"),
        "leader_window_ok", "responder_window_ok"
    ]
    rows = similarity.as_long(shown, keys, categories, "rlsm", "rw_rlsm")
    return {
        "rw_rlsm_conversations": one,
        "rw_pairs_rlsm": rows.withColumns({k: v for k, v in parameters.items() if k != "min_window_tokens"}),
        "rw_individual_category_rlsm": level["individual"].withColumns(parameters),
        "rw_dyad_category_rlsm": level["dyad"].withColumns(parameters),
    }


def rlsm_tables(
    conversations: DataFrame, dictionary: Dictionary, o: Options = Options(), categories: Sequence[str] = CATEGORIES
) -> dict[str, DataFrame]:
    """All tables of the directional measure, by file name without its ending.

    The counted turns have several readers and are kept in memory and on disk; call unpersist() on the
    `_turns` entry when done.
    """
    own = dictionary.only([*categories, *(MICRO_CATEGORIES if o.micro else ())])
    main, micro = [c for c in own.labels if c in categories], [c for c in own.labels if c in MICRO_CATEGORIES]
    rows = as_turns(conversations)
    reports = None
    if o.unitize:
        before = rows
        rows = unitize.unitized(rows, "approx", o.merge_gap, o.bracket_mode, o.strip_tags)
        reports = unitize.report(before, rows)
    counts = features.turn_counts(rows, own, [*main, *micro]).drop("text").repartition("conv_id").persist(StorageLevel.MEMORY_AND_DISK)
    errors = responsiveness.validation_errors(counts, GENDERS)
    good = counts.join(errors.select("conv_id"), "conv_id", "left_anti")
    meta = meta_of(conversations)
    pairs = responsiveness.exchanges(responsiveness.with_rates(good, main), main, o.eps, o.zero_tol)
    level = levels(good, pairs, main, o.policy)
    out = {
        "rlsm_conversations": responsiveness.summary(good, pairs, GENDERS, main, o.policy),
        "pairs_rlsm": responsiveness.pairs_long(pairs, main),
        "individual_category_rlsm": level["individual"],
        "dyad_category_rlsm": level["dyad"],
    }
    if micro:
        small = responsiveness.exchanges(responsiveness.with_rates(good, micro), micro, o.eps, o.zero_tol)
        level = levels(good, small, micro, o.policy)
        out |= {
            "pairs_micro_rlsm": responsiveness.pairs_long(small, micro), "individual_micro_rlsm": level["individual"],
            "dyad_micro_rlsm": level["dyad"]
        }
    if o.rolling:
        out |= rolling_tables(good, main, o)
        if micro:
            out |= {
                k.replace("category", "micro") if "category" in k else k.replace("rlsm", "micro_rlsm"): v for k,
                v in rolling_tables(good, micro, o).items()
            }
    out = {k: v.join(meta, "conv_id", "left").withColumnRenamed("conv_id", "file_path") for k, v in out.items()}
    out["rlsm_errors"] = errors.withColumnRenamed("conv_id", "file_path")
    if reports is not None:
        out["unitize_reports"] = reports.withColumnRenamed("conv_id", "file_path")
    return out | {"_turns": counts}


def run_lsm(
    spark: SparkSession, data_dir: str, dictionary_path: str, results_dir: str, round_number: int | None = None,
    temporal: bool = False, minutes: float = WINDOW_MINUTES, categories: Sequence[str] = CATEGORIES
) -> list[str]:
    """Reads, scores and writes static (and temporal) similarity; returns the names written."""
    with file_rows(spark, data_dir, results_dir) as rows:
        warn_of_corrupt_files(spark, data_dir, rows)
        conversations = of_round(read_conversations(spark, data_dir, rows=rows), round_number)
        tables = lsm_tables(
            conversations, Dictionary.read(spark, dictionary_path), categories, minutes if temporal else None,
            dictionary_path.rsplit("/", 1)[-1]
        )
        ending = {1: "_1st", 2: "_2nd", None: ""}[round_number]
        return [k for k, v in tables.items() if save(v, results_dir, k + ending, order=("female_id", "male_id", "file_path"))]


def run_rlsm(
    spark: SparkSession, data_dir: str, dictionary_path: str, results_dir: str, options: Options = Options(),
    categories: Sequence[str] = CATEGORIES
) -> list[str]:
    """Reads, scores and writes all tables of the directional measure; returns the names written."""
    with file_rows(spark, data_dir, results_dir) as rows:
        warn_of_corrupt_files(spark, data_dir, rows)
        tables = rlsm_tables(read_conversations(spark, data_dir, rows=rows), Dictionary.read(spark, dictionary_path), options, categories)
        turns = tables.pop("_turns")
        order = {"rlsm_conversations": ("female_id", "male_id", "file_path"), "rlsm_errors": ("file_path",)}
        written = [k for k, v in tables.items() if save(v, results_dir, k, order=order.get(k, ()))]
        turns.unpersist()
        return written
