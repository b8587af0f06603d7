"""Directional similarity between turns: pairs, individuals, dyads and their records.

All levels come from one wide table of turns dealt out by conversation, so pairs, means and records
share its shuffle; only long outputs unfold categories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.scoring import imputed, mean, rate, responsiveness
from parley.operators.features import count_name
from parley.operators.similarity import as_long
from parley.schema import EPS, ZERO_TOL

POLICIES = ("bilateral_only", "nanmean")


def with_rates(counts: DataFrame, categories: Sequence[str]) -> DataFrame:
    """n_<category> columns become rate_<category>, in percent of the turn's words."""
    rates = [rate(F.col(count_name(c)), F.col("total")).alias(f"rate_{c}") for c in categories]
    return counts.select("conv_id", "turn", "speaker", "total", *rates)


def exchanges(rates: DataFrame, categories: Sequence[str], eps: float = EPS, zero_tol: float = ZERO_TOL, keep: Sequence[str] = ()) -> DataFrame:
    """conv_id, pair_index, pair_number, leader, responder, rlsm_<category>, lead_<category>, resp_<category>.

    A pair is a turn and the next of the same conversation, if the speaker changes.  pair_index is the
    leader's place from 0 among the conversation's turns; pair_number counts changes from 1.  `keep`
    names columns that come along as lead_<name> and resp_<name>.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    carried = [f"rate_{c}" for c in categories] + list(keep)
    rows = rates.withColumns({"before": F.lag(F.struct("speaker", *carried)).over(order), "place": F.row_number().over(order)})
    changed = F.col("before").isNotNull() & (F.col("before.speaker") != F.col("speaker"))
    rows = rows.withColumn("pair_number", F.sum(changed.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(changed)
    value = [responsiveness(F.col(f"before.rate_{c}"), F.col(f"rate_{c}"), eps, zero_tol).alias(f"rlsm_{c}") for c in categories]
    both = [x for c in categories for x in (F.col(f"before.rate_{c}").alias(f"lead_{c}"), F.col(f"rate_{c}").alias(f"resp_{c}"))]
    more = [x for k in keep for x in (F.col(f"before.{k}").alias(f"lead_{k}"), F.col(k).alias(f"resp_{k}"))]
    return rows.select(
        "conv_id", (F.col("place") - 2).cast("long").alias("pair_index"), "pair_number", F.col("before.speaker").alias("leader"),
        F.col("speaker").alias("responder"), *value, *both, *more
    )


def individuals(pairs: DataFrame, categories: Sequence[str]) -> DataFrame:
    """conv_id, speaker, rlsm_<category>: means over the pairs in which a speaker responds."""
    return pairs.groupBy("conv_id", F.col("responder").alias("speaker")).agg(*(F.avg(f"rlsm_{c}").alias(f"rlsm_{c}") for c in categories))


def first_two(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, nth: the first two distinct speakers, in the order in which they appear."""
    first = turns.groupBy("conv_id", "speaker").agg(F.min("turn").alias("first"))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "speaker")))
    return ranked.where("nth <= 2").select("conv_id", "speaker", "nth")


def individual_spine(turns: DataFrame, own: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Both speakers of each conversation that has two, with or without scores."""
    two = first_two(turns).withColumn("speakers", F.count("*").over(Window.partitionBy("conv_id")))
    return two.where("speakers = 2").join(own, ["conv_id", "speaker"], "left").select("conv_id", "speaker", "nth", *(f"rlsm_{c}" for c in categories))


def policy_mean(value: Column, policy: str) -> Column:
    """An aggregate over the two speakers: bilateral_only needs both, nanmean takes either."""
    if policy not in POLICIES:
        raise ValueError(f"na_policy {policy!r}; one of {POLICIES}")
    return F.when(F.count(value) == 2, F.avg(value)) if policy == "bilateral_only" else F.avg(value)


def dyads(turns: DataFrame, own: DataFrame, categories: Sequence[str], policy: str = "bilateral_only") -> DataFrame:
    """conv_id, dyad_<category>, dyad_final for every conversation; missing where it has one speaker only."""
    spine = individual_spine(turns, own, categories)
    found = spine.groupBy("conv_id").agg(*(policy_mean(F.col(f"rlsm_{c}"), policy).alias(f"dyad_{c}") for c in categories))
    every = turns.select("conv_id").distinct().join(found, "conv_id", "left")
    return every.withColumn("dyad_final", mean([F.col(f"dyad_{c}") for c in categories]))


def overall(own: DataFrame, categories: Sequence[str]) -> DataFrame:
    """conv_id, speaker, overall: unweighted mean over categories."""
    return own.select("conv_id", "speaker", mean([F.col(f"rlsm_{c}") for c in categories]).alias("overall"))


def pair_cases(pairs: DataFrame, categories: Sequence[str], zero_tol: float = ZERO_TOL) -> DataFrame:
    """conv_id, category and how many pairs there are: total, valid, both_zero, leader_zero, responder_zero, coverage."""
    sums = []
    for c in categories:
        a, b = F.abs(F.col(f"lead_{c}")) <= zero_tol, F.abs(F.col(f"resp_{c}")) <= zero_tol
        sums.append(F.struct(
            F.lit(c).alias("category"), F.count("*").alias("pairs_total"), F.count_if(~a & ~b).alias("pairs_valid"),
            F.count_if(a & b).alias("pairs_both_zero"), F.count_if(a & ~b).alias("pairs_leader_zero"), F.count_if(~a & b).alias("pairs_responder_zero"),
        ))
    rows = pairs.groupBy("conv_id").agg(F.array(*sums).alias("rows")).select("conv_id", F.inline("rows"))
    return rows.withColumn("coverage_ratio", F.col("pairs_valid") / F.when(F.col("pairs_total") > 0, F.col("pairs_total")))


def validation_errors(counts: DataFrame, speakers: tuple[str, str]) -> DataFrame:
    """conv_id, error for conversations whose speakers aren't exactly these two, or one of whom says no word."""
    names = F.array_sort(F.collect_set("speaker"))
    totals = [F.coalesce(F.sum(F.when(F.col("speaker") == s, F.col("total"))), F.lit(0)) for s in speakers]
    rows = counts.groupBy("conv_id").agg(names.alias("speakers"), *(t.alias(f"t{k}") for k, t in enumerate(totals)))
    wrong = F.col("speakers") != F.array(*map(F.lit, sorted(speakers)))
    error = F.when(wrong, F.concat(F.lit("speakers: "), F.array_join("speakers", ","))).when(
        (F.col("t0") == 0) | (F.col("t1") == 0), F.lit("no words of one speaker")
    )
    return rows.select("conv_id", error.alias("error")).where("error is not null")


def summary(turns: DataFrame, pairs: DataFrame, speakers: tuple[str, str], categories: Sequence[str], policy: str = "bilateral_only") -> DataFrame:
    """One wide record for each conversation: totals, finals, individual, dyad and coverage columns, and imputed values with flags."""
    own = individuals(pairs, categories)
    totals = turns.groupBy("conv_id").agg(
        *(F.coalesce(F.sum(F.when(F.col("speaker") == s, F.col("total"))), F.lit(0)).alias(f"{s}_total_words") for s in speakers)
    )
    pivoted = own.groupBy("conv_id").agg(
        *(F.max(F.when(F.col("speaker") == s, F.col(f"rlsm_{c}"))).alias(f"{s}_rlsm_{c}") for s in speakers for c in categories)
    )
    dyad = dyads(turns, own, categories, policy).withColumnsRenamed(
        {f"dyad_{c}": f"dyad_rlsm_{c}" for c in categories} | {"dyad_final": "dyad_final_rlsm"}
    )
    cases = pair_cases(pairs, categories).groupBy("conv_id").agg(
        F.max("pairs_total").alias("n_pair_turns"),
        *(F.max(F.when(F.col("category") == c, F.col(x))).alias(f"rlsm_{c}_{x}") for c in categories for x in ("pairs_total", "pairs_valid", "pairs_both_zero", "pairs_leader_zero", "pairs_responder_zero", "coverage_ratio")),
    )
    wide = totals.join(dyad, "conv_id").join(pivoted, "conv_id", "left").join(cases, "conv_id", "left")
    counts = [
        "n_pair_turns",
        *(f"rlsm_{c}_{x}" for c in categories for x in ("pairs_total", "pairs_valid", "pairs_both_zero", "pairs_leader_zero", "pairs_responder_zero"))
    ]
    wide = wide.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in counts} | {"na_policy": F.lit(policy)})
    wide = wide.withColumns({f"{s}_overall_rlsm": mean([F.col(f"{s}_rlsm_{c}") for c in categories]) for s in speakers})
    more: dict[str, Column] = {}
    for c in categories:
        for who in (*speakers, "dyad"):
            value = F.col(f"{who}_rlsm_{c}")
            need = (F.col(f"rlsm_{c}_pairs_valid") == 0) | value.isNull()
            more[f"{who}_rlsm_{c}_imputed"], more[f"{who}_rlsm_{c}_was_imputed"] = imputed(value, need)
    for name in (*(f"{s}_overall_rlsm" for s in speakers), "dyad_final_rlsm"):
        more[f"{name}_imputed"], more[f"{name}_was_imputed"] = imputed(F.col(name), F.col(name).isNull())
    return wide.withColumns(more)


def pairs_long(pairs: DataFrame, categories: Sequence[str]) -> DataFrame:
    return as_long(pairs, ["conv_id", "pair_index", "leader", "responder"], categories, "rlsm", "rlsm")
