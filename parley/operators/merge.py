"""Study-level tables: rounds in one long table, and static with rolling results."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.names import dyad_id, flag, number_of_id
from parley.functions.scoring import talk_ratio

# Keys and parameters of result tables.
KEYS = ("dyad_id", "female_id", "male_id", "round_num")
PARAMETERS = ("window_size_param", "include_current", "min_window_tokens", "na_policy")
RENAMED = (
    "categories_order", "dic_filename", "female_total_words", "male_total_words", "total_words", "file_path", "file_basename",
    "has_timestamps", "spacy_model", "f_talk_ratio"
)
PREFERRED_WINDOW = 8


def with_ids(df: DataFrame) -> DataFrame:
    """female_id and male_id as numbers, and dyad_id where it is missing."""
    df = df.withColumns({"female_id": number_of_id(F.col("female_id")), "male_id": number_of_id(F.col("male_id"))})
    made = dyad_id(F.col("female_id"), F.col("male_id"))
    return df.withColumn("dyad_id", F.coalesce(F.col("dyad_id"), made) if "dyad_id" in df.columns else made)


def standard_round(df: DataFrame, round_num: int, categories: Sequence[str]) -> DataFrame:
    """One round's results with lsm_ names, ids, round_num and derived columns, in a fixed order."""
    df = with_ids(df)
    df = df.withColumnsRenamed({c: f"lsm_{c}" for c in RENAMED if c in df.columns})
    df = df.drop("round_label", "round_num").withColumn("round_num", F.lit(round_num))
    have = set(df.columns)
    if "lsm_total_words" not in have and {"lsm_female_total_words", "lsm_male_total_words"} <= have:
        df = df.withColumn("lsm_total_words", F.coalesce("lsm_female_total_words", F.lit(0)) + F.coalesce("lsm_male_total_words", F.lit(0)))
    if "lsm_f_talk_ratio" not in have and "lsm_female_total_words" in have:
        df = df.withColumn("lsm_f_talk_ratio", talk_ratio(F.col("lsm_female_total_words"), F.col("lsm_total_words")))
    own = [f"lsm_{c}" for c in categories if f"lsm_{c}" in have]
    if "lsm_n_active_cats" not in have and own:
        df = df.withColumn("lsm_n_active_cats", sum((F.col(c).isNotNull().cast("long") for c in own), F.lit(0).cast("long")))
    df = df.drop("lsm_file_path", "lsm_file_basename")
    named = sorted(c for c in df.columns if c.startswith("lsm_"))
    return df.select(*KEYS, *named, *(c for c in df.columns if c not in KEYS and c not in named))


def repeated_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def rounds_long(first: DataFrame, second: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Both rounds' results below each other; raises if a key is there twice."""
    out = standard_round(first, 1, categories).unionByName(standard_round(second, 2, categories), allowMissingColumns=True)
    if again := repeated_keys(out).limit(5).collect():
        raise ValueError(f"repeated keys: {again}")
    return out


def join_keys(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """The longest known key that both sides have."""
    both = set(left) & set(right)
    for keys in (KEYS, KEYS[1:], KEYS[1:3]):
        if both.issuperset(keys):
            return list(keys)
    raise ValueError("no common keys; at least female_id and male_id are needed")


def frequent_parameters(rw: DataFrame) -> DataFrame:
    """The combination of parameters that most rows have; ties go to the least combination."""
    return rw.groupBy(*PARAMETERS).count().orderBy(F.desc("count"), *PARAMETERS).limit(1)


def with_parameters(
    rw: DataFrame, window: int | None = None, include_current: bool | None = None, min_tokens: int | None = None,
    policy: str | None = None
) -> DataFrame:
    wanted = {"window_size_param": window, "include_current": include_current, "min_window_tokens": min_tokens, "na_policy": policy}
    for name, value in wanted.items():
        if value is not None and name in rw.columns:
            rw = rw.where((flag(F.col(name)) if name == "include_current" else F.col(name)) == F.lit(value))
    return rw


def representatives(rw: DataFrame, keys: Sequence[str], prefer: int | None = None, order: Sequence[str] = PARAMETERS) -> DataFrame:
    """One row for each key: current included, window nearest the preferred one (none last), most tokens, most pairs."""
    have = rw.columns
    nearest = F.abs(F.col("window_size_param") - (PREFERRED_WINDOW if prefer is None else prefer)) if "window_size_param" in have else F.lit(0)
    current = F.coalesce(flag(F.col("include_current")), F.lit(False)) if "include_current" in have else F.lit(False)
    least = F.coalesce(F.col("min_window_tokens"), F.lit(-1)) if "min_window_tokens" in have else F.lit(-1)
    pairs = F.coalesce(F.col("n_pair_turns"), F.lit(-1)) if "n_pair_turns" in have else F.lit(-1)
    best = Window.partitionBy(*keys).orderBy(
        current.desc(), nearest.asc_nulls_last(), least.desc(), pairs.desc(), *(F.col(c) for c in order if c in have)
    )
    return rw.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").drop("__nth")


def prefixed(rw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All but keys with an rw_ prefix, without path columns."""
    out = rw.withColumnsRenamed({c: f"rw_{c}" for c in rw.columns if c not in keys and not c.startswith("rw_")})
    return out.drop("rw_file_path", "rw_file_basename", "rw_round_label")


def static_with_rolling(static: DataFrame, rw: DataFrame, prefer: int | None = None, **parameters) -> DataFrame:
    """static left-joined with one rolling row for each key; null keys match null keys.

    Without a filter, or with one that nothing fits, the most frequent parameters are taken.
    """
    static, rw = with_ids(static), with_ids(rw)
    keys = join_keys(static.columns, rw.columns)
    given = {k: v for k, v in parameters.items() if v is not None}
    some = with_parameters(rw, **given) if given else rw
    if set(PARAMETERS) <= set(rw.columns) and (not given or not some.limit(1).count()):
        if given:
            warnings.warn("no rolling row has the wanted parameters; the most frequent ones are taken", stacklevel=2)
        mode = F.broadcast(frequent_parameters(rw).drop("count"))  # one row
        some = rw.alias("r").join(mode.alias("m"), [F.col(f"r.{p}").eqNullSafe(F.col(f"m.{p}")) for p in PARAMETERS], "left_semi")
    one = prefixed(representatives(some, keys, prefer), keys)
    clash = [c for c in one.columns if c in static.columns and c not in keys]
    one = one.drop(*clash).withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return static.join(one, on, "left").drop(*(f"__{k}" for k in keys))
