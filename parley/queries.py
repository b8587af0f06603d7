"""The registered queries: each applies one operator of the engine to whole tables, and its DuckDB oracle.

Speakers are `assistant` and everyone else (`user`); times, file names, spellings and brackets that the
tables lack are derived from their columns by the same rule in both engines.  Numbers are rounded to six
places.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import names, scoring, text
from parley.functions.dictionary import SAMPLE
from parley.operators import features, merge, responsiveness, rolling, similarity, tokenise, unitize
from parley.plans.runs import levels, run_lsm, run_rlsm
from parley.schema import CATEGORIES, MICRO_CATEGORIES
from parley.sources.scratch import file_system_of, shared_dir
from parley.sources.sinks import write_conversations
from parley.sources.transcripts import read_conversations

SPEAKERS = ("user", "assistant")
CATS = list(CATEGORIES)
SHORT_TURN = 40
WINDOW_MINUTES = 1.0
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_MINUTES = 360.0
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# ---- inputs -------------------------------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.select("conv_id", "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("speaker"), "text")
    start = F.col("turn") * 20.0 + F.col("conv_id") % 5
    return rows.withColumns({"start": start, "end": start + 5 + F.length("text") % 40})


def counts(spark: SparkSession, sf_dir: str, categories=CATS) -> DataFrame:
    """Turns with counts instead of texts, which no shuffle then carries."""
    return features.turn_counts(turns(spark, sf_dir), SAMPLE, categories).drop("text")


def dealt(spark: SparkSession, sf_dir: str, categories=CATS) -> DataFrame:
    """Counted turns dealt out by conversation: neighbours, windows and means then share one shuffle."""
    return counts(spark, sf_dir, categories).repartition("conv_id")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def pairs_of(c: DataFrame, categories=CATS) -> DataFrame:
    return responsiveness.exchanges(responsiveness.with_rates(c, categories), categories)


def sql_pattern(category: str) -> str:
    own = [p for p, cs in SAMPLE.entries if category in cs]
    return "|".join(".*".join(map(re.escape, p.split("*"))) for p in own)


TURNS = """turns AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS speaker, text,
  turn * 20.0::DOUBLE + conv_id % 5 AS t0, turn * 20.0::DOUBLE + conv_id % 5 + 5 + length(text) % 40 AS t1 FROM conversations)"""


def sql_counts(categories=CATS) -> str:
    """turns, and counts(conv_id, turn, speaker, t0, category, total, n)."""
    each = " UNION ALL ".join(
        f"SELECT conv_id, turn, speaker, t0, '{c}' AS category, len(toks) AS total, len(list_filter(toks, lambda x: regexp_full_match(x, '{sql_pattern(c)}'))) AS n FROM toks" for c in categories
    )
    return rf"""WITH {TURNS}, toks AS (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS toks FROM turns), counts AS ({each}),
  cats AS (SELECT unnest({list(categories)!r}) AS category)"""


LSM = """sums AS (SELECT conv_id, category, sum(CASE WHEN speaker = 'user' THEN n ELSE 0 END) AS n1, sum(CASE WHEN speaker = 'assistant' THEN n ELSE 0 END) AS n2,
   sum(CASE WHEN speaker = 'user' THEN total ELSE 0 END) AS t1, sum(CASE WHEN speaker = 'assistant' THEN total ELSE 0 END) AS t2 FROM counts GROUP BY ALL),
 lsm AS (SELECT conv_id, category, t1, t2, CASE WHEN t1 > 0 AND t2 > 0 AND n1 + n2 > 0 THEN 1 - abs(n1 / t1 - n2 / t2) / (n1 / t1 + n2 / t2) END AS lsm FROM sums)"""


def sql_wide(value: str, prefix: str, categories=CATS) -> str:
    return ", ".join(f"round(max(CASE WHEN category = '{c}' THEN {value} END), 6) AS {prefix}_{c}" for c in categories)


# ---- tokens and rates ---------------------------------------------------------------------------


@query(
    sql_counts() + " SELECT conv_id, turn, speaker, category, n, total, round(CASE WHEN total > 0 THEN n / total * 100 ELSE 0 END, 6) AS rate FROM counts"
)
def turn_rates(spark, sf_dir):
    return rounded(features.long_counts(counts(spark, sf_dir), ["conv_id", "turn", "speaker"], CATS))


_DOC_TOKENS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents"
_MATCHES = " UNION ALL ".join(f"SELECT word, '{c}' AS category FROM words WHERE regexp_full_match(word, '{sql_pattern(c)}')" for c in CATS)


@query(
    f"WITH tok AS ({_DOC_TOKENS}), words AS (SELECT DISTINCT word FROM tok), m AS ({_MATCHES}) SELECT doc_id, category, count(*) AS n FROM tok JOIN m USING (word) GROUP BY ALL"
)
def token_category_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", features.tokens(F.col("text")).alias("tokens"))
    return features.token_counts(docs, ["doc_id"], SAMPLE, CATS)


@query(f"WITH tok AS ({_DOC_TOKENS}), words AS (SELECT DISTINCT word FROM tok), m AS ({_MATCHES}) SELECT DISTINCT word, category FROM m")
def lemma_category_match(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return features.match_tokens(docs.select(F.explode(features.tokens(F.col("text"))).alias("word")), SAMPLE, CATS)


_DOC_COUNTS = ", ".join(f"len(list_filter(toks, lambda x: regexp_full_match(x, '{sql_pattern(c)}'))) AS n_{c}" for c in CATS)


@query(
    rf"SELECT doc_id, len(toks) AS total, {_DOC_COUNTS} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS toks FROM documents)"
)
def document_category_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return features.turn_counts(docs, SAMPLE, CATS).drop("text")


def _blank_tokeniser():
    """A tokeniser of the user's own: words between blanks, without marks, as a model might give them."""
    return lambda t: [{"text": w, "lemma": w.strip(".,!?").lower(), "pos": "PUNCT" if not w.strip(".,!?") else "X"} for w in t.split()]


_OWN = ", ".join(f"len(list_filter(toks, lambda x: regexp_full_match(x, '{sql_pattern(c)}'))) AS n_{c}" for c in CATS)


@query(
    f"SELECT conv_id, category, sum(n)::BIGINT AS n FROM (UNPIVOT (SELECT conv_id, {_OWN} FROM (SELECT conv_id, list_transform(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: trim(x, '.,!?') <> ''), lambda x: lower(trim(x, '.,!?'))) AS toks FROM conversations)) ON COLUMNS('n_.*') INTO NAME category VALUE n) WHERE n > 0 GROUP BY ALL".replace(
        "SELECT conv_id, category,", "SELECT conv_id, substr(category, 3) AS category,"
    )
)
def own_tokeniser_counts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = tokenise.words_of(tokenise.tokeniser(_blank_tokeniser)(F.col("text")))
    return features.token_counts(rows.select("conv_id", words.alias("tokens")), ["conv_id"], SAMPLE, CATS, fold_case=False)


@query(f"WITH {TURNS} SELECT conv_id, speaker, text, t0 AS start, t1 AS \"end\" FROM turns")
def csv_conversations(spark, sf_dir):
    """The turns, written as conversation files with headers and read again by the files' own columns."""
    folder = f"{shared_dir(spark).rstrip('/')}/conversations-{uuid.uuid4().hex}"
    files, at = file_system_of(spark, folder)
    turns(spark, sf_dir).select("end", "speaker", "conv_id", "text", "start").write.csv(folder, header=True, escape='"', quoteAll=True)
    files.deleteOnExit(at)
    return read_conversations(
        spark, folder, "conv_id long, speaker string, text string, start double, end double"
    ).select("conv_id", "speaker", "text", "start", "end")


# ---- static similarity --------------------------------------------------------------------------


@query(
    sql_counts() + f", {LSM} SELECT conv_id, max(t1)::BIGINT AS user_total_words, max(t2)::BIGINT AS assistant_total_words, round(avg(lsm), 6) AS lsm_mean, round(stddev_pop(lsm), 6) AS lsm_std, count(lsm) AS lsm_n_active_cats, {sql_wide('lsm', 'lsm')} FROM lsm GROUP BY conv_id"
)
def lsm_conversation(spark, sf_dir):
    out = similarity.conversation_similarity(counts(spark, sf_dir), SPEAKERS, CATS)
    return rounded(out.withColumnsRenamed({"total_1": "user_total_words", "total_2": "assistant_total_words"}))


@query(sql_counts() + f", {LSM} SELECT conv_id, category, round(lsm, 6) AS lsm FROM lsm WHERE lsm IS NOT NULL")
def lsm_category(spark, sf_dir):
    out = similarity.conversation_similarity(counts(spark, sf_dir), SPEAKERS, CATS)
    return rounded(similarity.as_long(out, ["conv_id"], CATS, "lsm", "lsm").where("lsm is not null"))


_WINDOW_TEXTS = f"""WITH {TURNS}, rec AS (SELECT conv_id, CAST(floor(t0 / 60.0) AS BIGINT) AS window_index, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (speaker = 'user'), '') AS a,
 coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (speaker = 'assistant'), '') AS b FROM turns GROUP BY ALL),
 tok AS (SELECT conv_id, window_index, regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}]+') AS ta, regexp_extract_all(lower(b), '[\\p{{L}}\\p{{N}}]+') AS tb FROM rec)""".replace("\\\\", "\\")
_WINDOW_EACH = " UNION ALL ".join(
    f"SELECT conv_id, window_index, '{c}' AS category, len(ta) AS t1, len(tb) AS t2, len(list_filter(ta, lambda x: regexp_full_match(x, '{sql_pattern(c)}'))) AS n1, len(list_filter(tb, lambda x: regexp_full_match(x, '{sql_pattern(c)}'))) AS n2 FROM tok" for c in CATS
)


@query(
    f"{_WINDOW_TEXTS}, e AS ({_WINDOW_EACH}), s AS (SELECT *, CASE WHEN t1 > 0 AND t2 > 0 AND n1 + n2 > 0 THEN 1 - abs(n1 / t1 - n2 / t2) / (n1 / t1 + n2 / t2) END AS lsm FROM e) SELECT conv_id, window_index, max(t1)::BIGINT AS user_word_count, max(t2)::BIGINT AS assistant_word_count, count(lsm) AS n_scores, round(avg(lsm), 6) AS lsm_mean, {sql_wide('lsm', 'lsm')} FROM s GROUP BY conv_id, window_index"
)
def lsm_window_records(spark, sf_dir):
    """Records of two texts for each minute of a conversation, scored as a map."""
    rows = turns(spark, sf_dir).withColumn("window_index", scoring.window_index(F.col("start"), 60))
    said = [
        F.coalesce(
            text.joined(F.when(F.col("speaker") == s, F.col("text")), F.col("turn"), skip_null=True), F.lit("")
        ).alias(f"{s}_text") for s in SPEAKERS
    ]
    records = rows.groupBy("conv_id", "window_index").agg(*said)
    out = similarity.text_pair_similarity(records, SAMPLE, CATS, ("user_text", "assistant_text"))
    scores = [F.col("lsm_scores")[c].alias(f"lsm_{c}") for c in CATS]
    return rounded(
        out.select(
            "conv_id", "window_index", "user_word_count", "assistant_word_count",
            F.size("lsm_scores").cast("long").alias("n_scores"), "lsm_mean", *scores
        )
    )


_TEMPORAL = """placed AS (SELECT *, CAST(floor(t0 / {w}) AS BIGINT) AS window_index FROM counts),
 spine AS (SELECT conv_id, unnest(range(0, max(window_index) + 1)) AS window_index FROM placed GROUP BY conv_id),
 sums AS (SELECT conv_id, window_index, category, coalesce(sum(CASE WHEN speaker = 'user' THEN n END), 0) AS n1, coalesce(sum(CASE WHEN speaker = 'assistant' THEN n END), 0) AS n2,
   coalesce(sum(CASE WHEN speaker = 'user' THEN total END), 0) AS t1, coalesce(sum(CASE WHEN speaker = 'assistant' THEN total END), 0) AS t2
   FROM (SELECT * FROM spine CROSS JOIN cats) LEFT JOIN placed USING (conv_id, window_index, category) GROUP BY ALL),
 lsm AS (SELECT *, CASE WHEN t1 > 0 AND t2 > 0 AND n1 + n2 > 0 THEN 1 - abs(n1 / t1 - n2 / t2) / (n1 / t1 + n2 / t2) END AS lsm FROM sums)"""


@query(
    sql_counts() + ", " + _TEMPORAL.format(w=60.0) + " SELECT conv_id, window_index, max(t1)::BIGINT AS total_1, max(t2)::BIGINT AS total_2, round(avg(lsm), 6) AS lsm_mean, round(window_index * 60.0::DOUBLE, 6) AS start_sec, round((window_index + 1) * 60.0::DOUBLE, 6) AS end_sec FROM lsm GROUP BY conv_id, window_index"
)
def lsm_temporal_dense(spark, sf_dir):
    out = similarity.temporal_similarity(counts(spark, sf_dir), SPEAKERS, CATS, WINDOW_MINUTES)
    return rounded(out.select("conv_id", "window_index", "total_1", "total_2", "lsm_mean", "start_sec", "end_sec"))


@query(
    f"WITH {TURNS} SELECT conv_id, CAST(floor(t0 / 60.0) AS BIGINT) AS window_index, CAST(floor(t0 / 60.0) * 60.0 AS DOUBLE) AS start_sec, CAST((floor(t0 / 60.0) + 1) * 60.0 AS DOUBLE) AS end_sec, count(*) AS n_turns FROM turns GROUP BY ALL"
)
def lsm_temporal_sparse(spark, sf_dir):
    return similarity.sparse_windows(turns(spark, sf_dir), WINDOW_MINUTES)


_EVENTS = f"""WITH counts AS (SELECT user_id // 2 AS conv_id, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS t0, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS speaker,
  c.category, 1 AS total, CASE WHEN event_type = c.category THEN 1 ELSE 0 END AS n FROM events CROSS JOIN (SELECT unnest({list(EVENT_TYPES)!r}) AS category) c), cats AS (SELECT unnest({list(EVENT_TYPES)!r}) AS category)"""


@query(
    _EVENTS + ", " + _TEMPORAL.format(w=EVENT_MINUTES * 60) + f" SELECT conv_id, window_index, max(t1)::BIGINT AS total_1, max(t2)::BIGINT AS total_2, round(avg(lsm), 6) AS lsm_mean, round(stddev_pop(lsm), 6) AS lsm_std, count(lsm) AS lsm_n_active_cats, {sql_wide('lsm', 'lsm', EVENT_TYPES)} FROM lsm GROUP BY conv_id, window_index"
)
def lsm_events_window(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000000.0
    rows = similarity.label_events(
        events, time, "event_type", F.when(F.col("user_id") % 2 == 0, "user").otherwise("assistant"), EVENT_TYPES,
        {"conv_id": F.expr("user_id div 2")}
    )
    return rounded(similarity.temporal_similarity(rows, SPEAKERS, EVENT_TYPES, EVENT_MINUTES).drop("start_sec", "end_sec"))


# ---- responsiveness -----------------------------------------------------------------------------


def sql_pairs(source: str = "counts", categories=CATS) -> str:
    """prev, pairs(conv_id, pair_index, leader, responder, category, rlsm, a, b), indiv, spk, spine, from a table with n and total."""
    return f"""rates AS (SELECT conv_id, turn, speaker, category, CASE WHEN total > 0 THEN n / total * 100 ELSE 0 END AS rate FROM {source}),
 prev AS (SELECT *, lag(speaker) OVER w AS ps, lag(rate) OVER w AS pr, row_number() OVER w AS place FROM rates WINDOW w AS (PARTITION BY conv_id, category ORDER BY turn)),
 pairs AS (SELECT conv_id, place - 2 AS pair_index, ps AS leader, speaker AS responder, category, pr AS a, rate AS b, CASE WHEN abs(pr) > 0 THEN 1 - abs(pr - rate) / (pr + rate + 0.0001) END AS rlsm FROM prev WHERE ps <> speaker),
 {SPINE}"""


SPINE = """indiv AS (SELECT conv_id, responder AS speaker, category, avg(rlsm) AS rlsm FROM pairs GROUP BY ALL),
 spk AS (SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), speaker) AS nth, count(*) OVER (PARTITION BY conv_id) AS k FROM turns GROUP BY conv_id, speaker),
 spine AS (SELECT s.conv_id, s.speaker, c.category, i.rlsm FROM spk s CROSS JOIN cats c LEFT JOIN indiv i ON i.conv_id = s.conv_id AND i.speaker = s.speaker AND i.category = c.category WHERE s.nth <= 2 AND s.k >= 2),
 dyad AS (SELECT conv_id, category, CASE WHEN count(rlsm) = 2 THEN avg(rlsm) END AS bilateral, avg(rlsm) AS either FROM spine GROUP BY ALL),
 convs AS (SELECT DISTINCT conv_id FROM turns)"""


@query(sql_counts() + f", {sql_pairs()} SELECT conv_id, pair_index, leader, responder, category, round(rlsm, 6) AS rlsm FROM pairs")
def rlsm_pairs(spark, sf_dir):
    return rounded(responsiveness.pairs_long(pairs_of(dealt(spark, sf_dir)), CATS))


@query(sql_counts() + f""", {sql_pairs()} SELECT conv_id, category, count(*) AS pairs_total, count(*) FILTER (a > 0 AND b > 0) AS pairs_valid, count(*) FILTER (a = 0 AND b = 0) AS pairs_both_zero,
 count(*) FILTER (a = 0 AND b > 0) AS pairs_leader_zero, count(*) FILTER (a > 0 AND b = 0) AS pairs_responder_zero, round(count(*) FILTER (a > 0 AND b > 0) / count(*), 6) AS coverage_ratio FROM pairs GROUP BY ALL""")
def rlsm_pair_cases(spark, sf_dir):
    return rounded(responsiveness.pair_cases(pairs_of(dealt(spark, sf_dir)), CATS))


@query(sql_counts() + f", {sql_pairs()} SELECT conv_id, speaker, category, round(rlsm, 6) AS rlsm FROM spine")
def rlsm_individual(spark, sf_dir):
    c = dealt(spark, sf_dir)
    spine = responsiveness.individual_spine(c, responsiveness.individuals(pairs_of(c), CATS), CATS)
    return rounded(similarity.as_long(spine, ["conv_id", "speaker"], CATS, "rlsm", "rlsm"))


def _dyads(spark, sf_dir, policy, categories=CATS):
    c = dealt(spark, sf_dir, categories)
    return responsiveness.dyads(c, responsiveness.individuals(pairs_of(c, categories), categories), categories, policy)


@query(
    sql_counts() + f", {sql_pairs()} SELECT conv_id, category, round(bilateral, 6) AS dyad FROM convs CROSS JOIN cats LEFT JOIN dyad USING (conv_id, category)"
)
def rlsm_dyad_bilateral(spark, sf_dir):
    return rounded(similarity.as_long(_dyads(spark, sf_dir, "bilateral_only"), ["conv_id"], CATS, "dyad", "dyad"))


@query(
    sql_counts() + f", {sql_pairs()} SELECT conv_id, category, round(either, 6) AS dyad FROM convs CROSS JOIN cats LEFT JOIN dyad USING (conv_id, category)"
)
def rlsm_dyad_nanmean(spark, sf_dir):
    return rounded(similarity.as_long(_dyads(spark, sf_dir, "nanmean"), ["conv_id"], CATS, "dyad", "dyad"))


@query(sql_counts() + f""", {sql_pairs()}, fin AS (SELECT conv_id, avg(bilateral) AS f FROM dyad GROUP BY conv_id),
 ov AS (SELECT conv_id, avg(rlsm) FILTER (speaker = 'user') AS u, avg(rlsm) FILTER (speaker = 'assistant') AS a FROM spine GROUP BY conv_id)
 SELECT conv_id, round(f, 6) AS dyad_final, round(u, 6) AS user_overall, round(a, 6) AS assistant_overall FROM convs LEFT JOIN fin USING (conv_id) LEFT JOIN ov USING (conv_id)""")
def rlsm_final(spark, sf_dir):
    c = dealt(spark, sf_dir)
    own = responsiveness.individuals(pairs_of(c), CATS)
    whole = responsiveness.overall(responsiveness.individual_spine(c, own, CATS), CATS)
    both = whole.groupBy("conv_id").agg(*(F.max(F.when(F.col("speaker") == s, F.col("overall"))).alias(f"{s}_overall") for s in SPEAKERS))
    return rounded(responsiveness.dyads(c, own, CATS).select("conv_id", "dyad_final").join(both, "conv_id", "left"))


def _sql_summary() -> str:
    counts_ = ("pairs_total", "pairs_valid", "pairs_both_zero", "pairs_leader_zero", "pairs_responder_zero")
    out = ["conv_id", "ut AS user_total_words", "at_ AS assistant_total_words", "coalesce(np, 0) AS n_pair_turns", "'bilateral_only' AS na_policy"]
    agg, src = [], []
    for c in CATS:
        src += [f"max(CASE WHEN category = '{c}' THEN {x} END) AS {x}_{c}" for x in counts_]
        out += [f"coalesce({x}_{c}, 0) AS rlsm_{c}_{x}" for x in counts_] + [
            f"round(pairs_valid_{c} / pairs_total_{c}, 6) AS rlsm_{c}_coverage_ratio"
        ]
        for who in ("user", "assistant", "dyad"):
            agg.append(f"max(CASE WHEN category = '{c}' THEN {who[0]} END) AS {who}_{c}")
            need = f"coalesce(pairs_valid_{c}, 0) = 0 OR {who}_{c} IS NULL"
            out += [
                f"round({who}_{c}, 6) AS {who}_rlsm_{c}",
                f"round(CASE WHEN {need} THEN 0.5 ELSE {who}_{c} END, 6)::DOUBLE AS {who}_rlsm_{c}_imputed",
                f"({need})::INT AS {who}_rlsm_{c}_was_imputed"
            ]
    for name, of in (("user_overall_rlsm", "uo"), ("assistant_overall_rlsm", "ao"), ("dyad_final_rlsm", "do_")):
        out += [f"round({of}, 6) AS {name}", f"round(coalesce({of}, 0.5), 6)::DOUBLE AS {name}_imputed", f"({of} IS NULL)::INT AS {name}_was_imputed"]
    return f""", {sql_pairs()},
 totals AS (SELECT conv_id, coalesce(sum(total) FILTER (speaker = 'user'), 0)::BIGINT AS ut, coalesce(sum(total) FILTER (speaker = 'assistant'), 0)::BIGINT AS at_ FROM counts WHERE category = 'ppron' GROUP BY conv_id),
 cases AS (SELECT conv_id, category, count(*) AS pairs_total, count(*) FILTER (a > 0 AND b > 0) AS pairs_valid, count(*) FILTER (a = 0 AND b = 0) AS pairs_both_zero, count(*) FILTER (a = 0 AND b > 0) AS pairs_leader_zero, count(*) FILTER (a > 0 AND b = 0) AS pairs_responder_zero FROM pairs GROUP BY ALL),
 cw AS (SELECT conv_id, max(pairs_total) AS np, {', '.join(src)} FROM cases GROUP BY conv_id),
 vals AS (SELECT conv_id, category, max(i.rlsm) FILTER (i.speaker = 'user') AS u, max(i.rlsm) FILTER (i.speaker = 'assistant') AS a, max(d.bilateral) AS d FROM convs CROSS JOIN cats LEFT JOIN indiv i USING (conv_id, category) LEFT JOIN dyad d USING (conv_id, category) GROUP BY ALL),
 vw AS (SELECT conv_id, avg(u) AS uo, avg(a) AS ao, avg(d) AS do_, {', '.join(agg)} FROM vals GROUP BY conv_id)
 SELECT {', '.join(out)} FROM totals LEFT JOIN cw USING (conv_id) LEFT JOIN vw USING (conv_id)"""


@query(sql_counts() + _sql_summary())
def rlsm_summary_imputed(spark, sf_dir):
    c = dealt(spark, sf_dir)
    return rounded(responsiveness.summary(c, pairs_of(c), SPEAKERS, CATS))


@query(
    sql_counts(MICRO_CATEGORIES) + f", {sql_pairs()} SELECT conv_id, category, round(bilateral, 6) AS dyad FROM convs CROSS JOIN cats LEFT JOIN dyad USING (conv_id, category)"
)
def rlsm_micro(spark, sf_dir):
    return rounded(similarity.as_long(_dyads(spark, sf_dir, "bilateral_only", MICRO_CATEGORIES), ["conv_id"], MICRO_CATEGORIES, "dyad", "dyad"))


@query(sql_counts(MICRO_CATEGORIES) + f", {sql_pairs()} SELECT conv_id, pair_index, leader, responder, category, round(rlsm, 6) AS rlsm FROM pairs")
def rlsm_micro_pairs(spark, sf_dir):
    return rounded(responsiveness.pairs_long(pairs_of(dealt(spark, sf_dir, MICRO_CATEGORIES), MICRO_CATEGORIES), MICRO_CATEGORIES))


@query(sql_counts(MICRO_CATEGORIES) + f", {sql_pairs()} SELECT conv_id, speaker, category, round(rlsm, 6) AS rlsm FROM spine")
def rlsm_micro_individual(spark, sf_dir):
    c = dealt(spark, sf_dir, MICRO_CATEGORIES)
    spine = responsiveness.individual_spine(c, responsiveness.individuals(pairs_of(c, MICRO_CATEGORIES), MICRO_CATEGORIES), MICRO_CATEGORIES)
    return rounded(similarity.as_long(spine, ["conv_id", "speaker"], MICRO_CATEGORIES, "rlsm", "rlsm"))


@query(rf"""WITH {TURNS} SELECT conv_id, CASE WHEN count(DISTINCT speaker) < 2 THEN 'speakers: ' || min(speaker) ELSE 'no words of one speaker' END AS error
 FROM (SELECT *, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS total FROM turns) GROUP BY conv_id
 HAVING count(DISTINCT speaker) < 2 OR coalesce(sum(total) FILTER (speaker = 'user'), 0) = 0 OR coalesce(sum(total) FILTER (speaker = 'assistant'), 0) = 0""")
def rlsm_validation_errors(spark, sf_dir):
    return responsiveness.validation_errors(counts(spark, sf_dir, ["ppron"]), SPEAKERS)


# ---- rolling ------------------------------------------------------------------------------------


def sql_rolling(include: bool = True, least: int = 3, min_tokens: int = 0) -> str:
    """rolled(conv_id, turn, speaker, category, n, total, size) and the pairs over it."""
    frame = "ROWS BETWEEN 7 PRECEDING AND CURRENT ROW" if include else "ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING"
    ok = f"AND pt >= {min_tokens} AND total >= {min_tokens}" if min_tokens else ""
    return f"""long AS (SELECT * FROM counts WHERE total >= {least}),
 rolled AS (SELECT conv_id, turn, speaker, category, coalesce(sum(n) OVER w, 0)::BIGINT AS n, coalesce(sum(total) OVER w, 0)::BIGINT AS total, count(*) OVER w AS size FROM long WINDOW w AS (PARTITION BY conv_id, speaker, category ORDER BY turn {frame})),
 rates AS (SELECT *, CASE WHEN total > 0 THEN n / total * 100 ELSE 0 END AS rate FROM rolled),
 prev AS (SELECT *, lag(speaker) OVER w AS ps, lag(rate) OVER w AS pr, lag(total) OVER w AS pt, lag(size) OVER w AS psz FROM rates WINDOW w AS (PARTITION BY conv_id, category ORDER BY turn)),
 pairs AS (SELECT conv_id, turn, ps AS leader, speaker AS responder, category, pt, total, psz, size, row_number() OVER (PARTITION BY conv_id, category ORDER BY turn) AS pair_index, CASE WHEN abs(pr) > 0 {ok} THEN 1 - abs(pr - rate) / (pr + rate + 0.0001) END AS rlsm FROM prev WHERE ps <> speaker),
 {SPINE}"""


def _rolling(spark, sf_dir, include=True, least=3, categories=CATS):
    return rolling.rolling_rates(rolling.long_turns(dealt(spark, sf_dir, categories), least), categories, include_current=include)


def _rates_long(rates: DataFrame) -> DataFrame:
    return rounded(similarity.as_long(rates, ["conv_id", "turn", "speaker", "win_size", "win_total"], CATS, "rate", "rate"))


@query(
    sql_counts() + f", {sql_rolling()} SELECT conv_id, turn, speaker, size AS win_size, total AS win_total, category, round(rate, 6) AS rate FROM rates"
)
def rw_turns_include(spark, sf_dir):
    return _rates_long(_rolling(spark, sf_dir))


@query(
    sql_counts() + f", {sql_rolling(False)} SELECT conv_id, turn, speaker, size AS win_size, total AS win_total, category, round(rate, 6) AS rate FROM rates"
)
def rw_turns_exclude(spark, sf_dir):
    return _rates_long(_rolling(spark, sf_dir, False))


@query(
    sql_counts() + f", {sql_rolling(min_tokens=60)} SELECT conv_id, pair_index, leader, responder, category, psz AS leader_window_size, size AS responder_window_size, pt AS leader_window_total_words, total AS responder_window_total_words, round(rlsm, 6) AS rw_rlsm FROM pairs"
)
def rw_pairs_min_tokens(spark, sf_dir):
    pairs = rolling.rolling_pairs(_rolling(spark, sf_dir), CATS, min_tokens=60)
    pairs = pairs.withColumnsRenamed(
        {
            "lead_win_size": "leader_window_size", "resp_win_size": "responder_window_size",
            "lead_win_total": "leader_window_total_words", "resp_win_total": "responder_window_total_words"
        }
    )
    keys = [
        "conv_id", F.col("pair_number").alias("pair_index"), "leader", "responder", "leader_window_size", "responder_window_size",
        "leader_window_total_words", "responder_window_total_words"
    ]
    return rounded(similarity.as_long(pairs, keys, CATS, "rlsm", "rw_rlsm"))


def _rw_levels(spark, sf_dir, name):
    c = dealt(spark, sf_dir)
    rates = rolling.rolling_rates(rolling.long_turns(c), CATS)
    return rounded(levels(c, rolling.rolling_pairs(rates, CATS), CATS, "nanmean", "rw_")[name])


@query(sql_counts() + f", {sql_rolling()} SELECT conv_id, speaker AS speaker_gender, category, round(rlsm, 6) AS rw_individual_rlsm FROM spine")
def rw_individual(spark, sf_dir):
    return _rw_levels(spark, sf_dir, "individual")


@query(
    sql_counts() + f", {sql_rolling()} SELECT conv_id, category, round(either, 6) AS rw_dyad_rlsm, 'nanmean' AS na_policy FROM convs CROSS JOIN cats LEFT JOIN dyad USING (conv_id, category)"
)
def rw_dyad(spark, sf_dir):
    return _rw_levels(spark, sf_dir, "dyad")


def _rw_final(spark, sf_dir, least=3):
    c = dealt(spark, sf_dir)
    pairs = rolling.rolling_pairs(rolling.rolling_rates(rolling.long_turns(c, least), CATS), CATS)
    out = responsiveness.dyads(c, responsiveness.individuals(pairs, CATS), CATS).select("conv_id", F.col("dyad_final").alias("rw_dyad_final_rlsm"))
    return rounded(
        out.join(rolling.scored_pairs(pairs, CATS), "conv_id", "left").withColumn("n_pair_turns", F.coalesce("n_pair_turns", F.lit(0).cast("long")))
    )


_RW_FINAL = """ SELECT conv_id, round(f, 6) AS rw_dyad_final_rlsm, coalesce(k, 0) AS n_pair_turns FROM convs LEFT JOIN (SELECT conv_id, avg(bilateral) AS f FROM dyad GROUP BY conv_id) USING (conv_id)
 LEFT JOIN (SELECT conv_id, count(DISTINCT pair_index) FILTER (rlsm IS NOT NULL) AS k FROM pairs GROUP BY conv_id) USING (conv_id)"""


@query(sql_counts() + f", {sql_rolling()}" + _RW_FINAL)
def rw_final(spark, sf_dir):
    return _rw_final(spark, sf_dir)


@query(sql_counts() + f", {sql_rolling(least=SHORT_TURN)}" + _RW_FINAL)
def rw_short_turn_filter(spark, sf_dir):
    return _rw_final(spark, sf_dir, SHORT_TURN)


# ---- spellings ----------------------------------------------------------------------------------

_SPELT = "CASE conv_id % 7 WHEN 0 THEN 'F' WHEN 1 THEN ' female ' WHEN 2 THEN 'Woman' WHEN 3 THEN 'MAN' WHEN 4 THEN '' WHEN 5 THEN '男性' ELSE role END"


@query(f"""SELECT conv_id, turn, CASE WHEN x IN ('f', 'female', 'woman', 'girl', '女性') THEN 'female' WHEN x IN ('m', 'male', 'man', 'boy', '男性') THEN 'male' WHEN x = '' THEN 'unknown' ELSE x END AS speaker,
 CASE WHEN x IN ('f', 'female', 'woman', 'girl') THEN 'female' WHEN x IN ('m', 'male', 'man', 'boy') THEN 'male' ELSE x END AS plain, CASE WHEN lower(raw) IN ('female', 'male') THEN lower(raw) END AS strict
 FROM (SELECT conv_id, turn, {_SPELT} AS raw, lower(trim({_SPELT})) AS x FROM conversations)""")
def speaker_normalise(spark, sf_dir):
    raw = F.expr(_SPELT)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(
        "conv_id", "turn", names.speaker(raw).alias("speaker"), names.speaker(raw, wide=False).alias("plain"),
        names.speaker_strict(raw).alias("strict")
    )


_NAME = "printf({}, conv_id % 90, conv_id % 3 + 1, conv_id % 400, conv_id % 301)"
_FORM = "'%02d_%d_1_A_F%03d_M%03d_concat.csv'"


def _named(spark, sf_dir):
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    return convs.select("conv_id", F.expr(_NAME.format(_FORM)).alias("name"))


@query(f"""SELECT conv_id, name, f AS female_id, m AS male_id, printf('F%03d_M%03d', f, m) AS dyad_id FROM (SELECT conv_id, name, regexp_extract(name, 'F0*([0-9]+)', 1)::BIGINT AS f, regexp_extract(name, 'M0*([0-9]+)', 1)::BIGINT AS m
 FROM (SELECT DISTINCT conv_id, {_NAME.format(_FORM)} AS name FROM conversations))""")
def filename_ids(spark, sf_dir):
    rows = _named(spark, sf_dir)
    f, m = names.id_in_name(F.col("name"), "F"), names.id_in_name(F.col("name"), "M")
    return rows.select("conv_id", "name", f.alias("female_id"), m.alias("male_id"), names.dyad_id(f, m).alias("dyad_id"))


_ROUND_NAME = "CASE conv_id % 4 WHEN 0 THEN printf('talk round_%d F%03d.csv', conv_id % 2 + 1, conv_id) WHEN 1 THEN printf('F%03d second talk.csv', conv_id) WHEN 2 THEN printf('round1_F%03d.csv', conv_id) ELSE printf('%02d_%d_1_A_F%03d.csv', conv_id % 90, conv_id % 3 + 1, conv_id) END"


@query(f"""SELECT conv_id, name, k AS round_num, CASE k WHEN 1 THEN '1st_round' WHEN 2 THEN '2nd_round' END AS round_label FROM (SELECT conv_id, name, coalesce(CASE WHEN fld IN ('1', '2') THEN fld::INT END, nullif(regexp_extract(lower(name), 'round[_\\- ]*([12])\\b', 1), '')::INT,
 CASE WHEN regexp_matches(lower(name), '\\b1st\\b|\\bfirst\\b') THEN 1 WHEN regexp_matches(lower(name), '\\b2nd\\b|\\bsecond\\b') THEN 2 END) AS k
 FROM (SELECT conv_id, name, regexp_extract(name, '^[^_]*_([0-9]+)(?:_|\\.|$)', 1) AS fld FROM (SELECT DISTINCT conv_id, {_ROUND_NAME} AS name FROM conversations)))""".replace("\\\\", "\\"))
def filename_round(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().select("conv_id", F.expr(_ROUND_NAME).alias("name"))
    k = names.round_number(F.col("name"))
    return rows.select("conv_id", "name", k.alias("round_num"), names.round_label(k).alias("round_label"))


_BRACKETED = "CASE turn % 4 WHEN 0 THEN concat('[laugh] ', text) WHEN 1 THEN concat('[', text, '] yes【笑】') WHEN 2 THEN concat('［ Music ］', text, ' [') ELSE text END"
_TAGS = "|".join(map(re.escape, text.DROP_WORDS))


def _sql_brackets(drop_all: bool, out: str = _BRACKETED) -> str:
    for left, right in text.BRACKETS:
        if drop_all:
            out = f"regexp_replace({out}, '{left}.*?{right}', '', 'g')"
        else:
            out = rf"regexp_replace({out}, '(?i){left}\s*(?:{_TAGS})\s*{right}', '', 'g')"
            out = rf"regexp_replace({out}, '{left}(.*?){right}', '\1', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[\[\]［］【】]', '', 'g'), '\s+', ' ', 'g'))"


def _bracketed(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.expr(_BRACKETED).alias("text"))


@query(f"SELECT conv_id, turn, {_sql_brackets(False)} AS text_clean FROM conversations")
def bracket_unwrap(spark, sf_dir):
    return _bracketed(spark, sf_dir).select("conv_id", "turn", text.without_brackets(F.col("text")).alias("text_clean"))


@query(f"SELECT conv_id, turn, {_sql_brackets(True)} AS text_clean FROM conversations")
def bracket_drop_all(spark, sf_dir):
    return _bracketed(spark, sf_dir).select("conv_id", "turn", text.without_brackets(F.col("text"), "drop_all").alias("text_clean"))


_BLANKS = "CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE concat(text, ' x') END"


@query(f"SELECT conv_id, turn, coalesce(CASE WHEN trim({_BLANKS}) <> '' THEN {_BLANKS} END, text) AS chosen FROM conversations")
def text_clean_fallback(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", text.clean_or_raw(F.expr(_BLANKS), F.col("text")).alias("chosen"))


@query(f"WITH {TURNS} SELECT conv_id, speaker, string_agg(text, ' ' ORDER BY turn) AS text FROM turns GROUP BY ALL")
def speaker_texts(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("conv_id", "speaker").agg(text.joined(F.col("text"), F.col("turn")).alias("text"))


_WANT = "CASE (doc_id + {k}) % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'maybe' WHEN 3 THEN 'T' WHEN 4 THEN CAST({c} AS VARCHAR(9)) ELSE NULL END"
_WANT_F, _WANT_M = _WANT.format(k=0, c="quality"), _WANT.format(k=1, c="toxic")


def _sql_flag(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ('true', '1', 't', 'y', 'yes') THEN true WHEN lower(trim({x})) IN ('false', '0', 'f', 'n', 'no') THEN false END"


@query(f"SELECT doc_id AS female_id, doc_id + 1 AS male_id, {_sql_flag(_WANT_F)} AS want_female, {_sql_flag(_WANT_M)} AS want_male FROM labels")
def preferences_normalise(spark, sf_dir):
    from parley.sources.transcripts import normal_preferences

    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return normal_preferences(
        rows.select(
            F.concat(F.lit("F"), "doc_id").alias("女性ID"), (F.col("doc_id") + 1).cast("string").alias("男性ID"),
            F.expr(_WANT_F).alias("女性の交換意欲"), F.expr(_WANT_M).alias("男性の交換意欲")
        )
    )


# ---- study tables -------------------------------------------------------------------------------


def _round_results(spark, sf_dir):
    out = similarity.conversation_similarity(counts(spark, sf_dir), SPEAKERS, CATS)
    return out.select(
        F.col("conv_id").alias("female_id"), (F.col("conv_id") + 1).alias("male_id"),
        F.col("total_1").alias("female_total_words"), F.col("total_2").alias("male_total_words"), "lsm_mean",
        *(f"lsm_{c}" for c in CATS)
    )


_LONG = sql_counts() + f""", {LSM}, one AS (SELECT conv_id AS female_id, conv_id + 1 AS male_id, max(t1)::BIGINT AS lsm_female_total_words, max(t2)::BIGINT AS lsm_male_total_words, round(avg(lsm), 6) AS lsm_mean, count(lsm) AS lsm_n_active_cats, {sql_wide('lsm', 'lsm')} FROM lsm GROUP BY conv_id),
 full_ AS (SELECT printf('F%03d_M%03d', female_id, male_id) AS dyad_id, *, lsm_female_total_words + lsm_male_total_words AS lsm_total_words, round(CASE WHEN lsm_female_total_words + lsm_male_total_words > 0 THEN lsm_female_total_words / (lsm_female_total_words + lsm_male_total_words) END, 6) AS lsm_f_talk_ratio FROM one)"""


@query(_LONG + " SELECT *, 1 AS round_num FROM full_ UNION ALL SELECT *, 2 AS round_num FROM full_")
def lsm_long_union(spark, sf_dir):
    one = _round_results(spark, sf_dir)
    return rounded(merge.rounds_long(one, one, CATS))


@query(_LONG + " SELECT dyad_id, lsm_total_words, lsm_f_talk_ratio FROM full_")
def lsm_talk_ratio(spark, sf_dir):
    return rounded(merge.standard_round(_round_results(spark, sf_dir), 1, CATS).select("dyad_id", "lsm_total_words", "lsm_f_talk_ratio"))


def _rolling_results(spark, sf_dir):
    """Three runs of the rolling operator, one with other parameters for most conversations."""
    c = dealt(spark, sf_dir)
    out = None
    for window, include, tokens in ((8, True, 0), (4, True, 0), (8, False, 5)):
        rates = rolling.rolling_rates(rolling.long_turns(c), CATS, window, include)
        pairs = rolling.rolling_pairs(rates, CATS, tokens)
        one = rolling.scored_pairs(pairs, CATS).select(
            F.col("conv_id").alias("female_id"), (F.col("conv_id") + 1).alias("male_id"), F.lit(1).alias("round_num"), "n_pair_turns",
            F.lit(window).alias("window_size_param"), F.lit(str(include).lower()).alias("include_current"), F.lit(tokens).alias("min_window_tokens"), F.lit("bilateral_only").alias("na_policy"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def _sql_rolling_results() -> str:
    parts, ctes = [], []
    for k, (window, include, tokens) in enumerate(((8, True, 0), (4, True, 0), (8, False, 5))):
        frame = f"ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW" if include else f"ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING"
        ctes.append(f"""r{k} AS (SELECT conv_id, turn, speaker, category, coalesce(sum(n) OVER w, 0)::BIGINT AS n, coalesce(sum(total) OVER w, 0)::BIGINT AS total FROM counts WHERE total >= 3 WINDOW w AS (PARTITION BY conv_id, speaker, category ORDER BY turn {frame})),
 q{k} AS (SELECT *, lag(speaker) OVER w AS ps, lag(n) OVER w AS pn, lag(total) OVER w AS pt FROM r{k} WINDOW w AS (PARTITION BY conv_id, category ORDER BY turn)),
 s{k} AS (SELECT conv_id, count(DISTINCT turn) FILTER (pn > 0 AND pt >= {tokens} AND total >= {tokens}) AS n_pair_turns FROM q{k} WHERE ps <> speaker GROUP BY conv_id)""")
        parts.append(
            f"SELECT conv_id AS female_id, conv_id + 1 AS male_id, 1 AS round_num, n_pair_turns, {window} AS window_size_param, '{str(include).lower()}' AS include_current, {tokens} AS min_window_tokens, 'bilateral_only' AS na_policy FROM s{k}"
        )
    return sql_counts() + ", " + ", ".join(ctes) + f", rw AS ({' UNION ALL '.join(parts)})"


@query(
    _sql_rolling_results() + " SELECT window_size_param, include_current, min_window_tokens, na_policy, count(*) AS \"count\" FROM rw GROUP BY ALL ORDER BY count(*) DESC, 1, 2, 3, 4 LIMIT 1"
)
def rw_param_mode(spark, sf_dir):
    return merge.frequent_parameters(_rolling_results(spark, sf_dir))


_DEDUP = """ SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY female_id, male_id, round_num ORDER BY include_current = 'true' DESC, abs(window_size_param - 8), min_window_tokens DESC, n_pair_turns DESC) AS nth FROM rw) WHERE nth = 1"""


@query(_sql_rolling_results() + _DEDUP)
def rw_dedup(spark, sf_dir):
    return merge.representatives(_rolling_results(spark, sf_dir), ["female_id", "male_id", "round_num"])


_NO_WINDOW = "CASE WHEN female_id % 3 = 0 AND window_size_param = 4 OR female_id % 5 = 0 THEN NULL ELSE window_size_param END"


@query(_sql_rolling_results() + f""" SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY female_id, male_id, round_num ORDER BY include_current = 'true' DESC, abs(window_size_param - 8) NULLS LAST, min_window_tokens DESC, n_pair_turns DESC) AS nth
 FROM (SELECT * REPLACE ({_NO_WINDOW} AS window_size_param, CASE window_size_param WHEN 4 THEN 1 ELSE min_window_tokens END AS min_window_tokens) FROM rw)) WHERE nth = 1""")
def rw_dedup_without_windows(spark, sf_dir):
    """Rows whose window is unknown come after all others."""
    rows = _rolling_results(spark, sf_dir)
    tokens = F.when(F.col("window_size_param") == 4, 1).otherwise(F.col("min_window_tokens"))
    return merge.representatives(
        rows.withColumns({"window_size_param": F.expr(_NO_WINDOW), "min_window_tokens": tokens}),
        ["female_id", "male_id", "round_num"]
    )


@query(_sql_rolling_results() + f""", mode AS (SELECT window_size_param, include_current, min_window_tokens, na_policy, count(*) AS k FROM rw GROUP BY ALL ORDER BY k DESC, 1, 2, 3, 4 LIMIT 1),
 picked AS (SELECT rw.* FROM rw JOIN mode USING (window_size_param, include_current, min_window_tokens, na_policy)), {sql_pairs()}
 SELECT printf('F%03d_M%03d', c.conv_id, c.conv_id + 1) AS dyad_id, c.conv_id AS female_id, c.conv_id + 1 AS male_id, 1 AS round_num, round(f, 6) AS dyad_final_rlsm, picked.n_pair_turns AS rw_n_pair_turns, picked.window_size_param AS rw_window_size_param, picked.include_current AS rw_include_current, picked.min_window_tokens AS rw_min_window_tokens, picked.na_policy AS rw_na_policy
 FROM convs c LEFT JOIN (SELECT conv_id, avg(bilateral) AS f FROM dyad GROUP BY conv_id) d ON d.conv_id = c.conv_id LEFT JOIN picked ON picked.female_id = c.conv_id""")
def rlsm_rw_merge(spark, sf_dir):
    static = _dyads(spark, sf_dir, "bilateral_only").select(
        F.col("conv_id").alias("female_id"), (F.col("conv_id") + 1).alias("male_id"), F.lit(1).alias("round_num"),
        F.col("dyad_final").alias("dyad_final_rlsm")
    )
    out = merge.static_with_rolling(static, _rolling_results(spark, sf_dir))
    return rounded(
        out.select("dyad_id", "female_id", "male_id", "round_num", "dyad_final_rlsm", *(f"rw_{c}" for c in ("n_pair_turns", *merge.PARAMETERS)))
    )


# ---- studies from files to result tables ---------------------------------------------------------


def _study(spark, sf_dir) -> str:
    """A shared folder with a conversation file for each conversation (data/*) and the dictionary (sample.dic)."""
    folder = f"{shared_dir(spark).rstrip('/')}/study-{uuid.uuid4().hex}"
    files, at = file_system_of(spark, folder)
    files.deleteOnExit(at)
    speaker = F.when(F.col("speaker") == "user", "Woman").otherwise("man").alias("speaker")
    write_conversations(turns(spark, sf_dir).select("conv_id", "turn", speaker, "text", "start", "end"), f"{folder}/data")
    ids = {c: k for k, c in enumerate(SAMPLE.labels, 1)}
    lines = ["%", *(f"{k} {c}" for c, k in ids.items()), "%", *(" ".join([p, *(str(ids[c]) for c in cs)]) for p, cs in SAMPLE.entries)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{folder}/sample.dic")
    return folder


def _study_results(spark, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/results/{name}_full")
    return rows.withColumn("conv_id", F.regexp_extract("file_path", r"conv_id=(\d+)[/.]", 1).cast("long"))


@query(
    sql_counts() + f", {LSM} SELECT conv_id, max(t1)::BIGINT AS female_total_words, max(t2)::BIGINT AS male_total_words, round(avg(lsm), 6) AS lsm_mean, true AS has_timestamps FROM lsm GROUP BY conv_id HAVING max(t1) > 0 OR max(t2) > 0"
)
def study_lsm(spark, sf_dir):
    """A whole study of static similarity: files in, result tables out."""
    folder = _study(spark, sf_dir)
    run_lsm(spark, f"{folder}/data/*", f"{folder}/sample.dic", f"{folder}/results")
    return rounded(
        _study_results(spark, folder, "lsm_results").select("conv_id", "female_total_words", "male_total_words", "lsm_mean", "has_timestamps")
    )


@query(sql_counts() + f""", {sql_pairs()}, fin AS (SELECT conv_id, avg(bilateral) AS f FROM dyad GROUP BY conv_id),
 said AS (SELECT conv_id, sum(total) FILTER (speaker = 'user') AS u, sum(total) FILTER (speaker = 'assistant') AS a FROM counts WHERE category = 'ppron' GROUP BY conv_id)
 SELECT conv_id, u::BIGINT AS female_total_words, a::BIGINT AS male_total_words, round(f, 6) AS dyad_final_rlsm FROM said LEFT JOIN fin USING (conv_id) WHERE u > 0 AND a > 0""")
def study_rlsm(spark, sf_dir):
    """A whole study of directional similarity: conversations that fail validation have no row."""
    folder = _study(spark, sf_dir)
    run_rlsm(spark, f"{folder}/data/*", f"{folder}/sample.dic", f"{folder}/results")
    return rounded(_study_results(spark, folder, "rlsm_conversations").select("conv_id", "female_total_words", "male_total_words", "dyad_final_rlsm"))


# ---- unitize ------------------------------------------------------------------------------------

_MERGED = """s0 AS (SELECT conv_id, turn, speaker, t0, t1, text FROM turns WHERE t1 > t0),
 s1 AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS turned FROM s0 WINDOW w AS (PARTITION BY conv_id ORDER BY t0, t1, turn)),
 s2 AS (SELECT *, sum(turned) OVER (PARTITION BY conv_id ORDER BY t0, t1, turn ROWS UNBOUNDED PRECEDING) AS run FROM s1),
 s3 AS (SELECT *, CASE WHEN t0 - max(t1) OVER (PARTITION BY conv_id, run ORDER BY t0, t1, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 10 THEN 1 ELSE 0 END AS apart FROM s2),
 s4 AS (SELECT *, sum(apart) OVER (PARTITION BY conv_id, run ORDER BY t0, t1, turn ROWS UNBOUNDED PRECEDING) AS part FROM s3),
 m AS (SELECT conv_id, min(turn) AS turn, min(speaker) AS speaker, min(t0) AS t0, max(t1) AS t1, string_agg(text, ' ' ORDER BY t0, t1, turn) AS text FROM s4 GROUP BY conv_id, run, part)"""


@query(f"WITH {TURNS}, {_MERGED} SELECT conv_id, turn, speaker, t0 AS start, t1 AS \"end\", text FROM m")
def unitize_same_speaker_merge(spark, sf_dir):
    return unitize.merged_neighbours(turns(spark, sf_dir), 10.0)


@query(f"""WITH {TURNS}, {_MERGED}, pts AS (SELECT conv_id, t0 AS lo FROM m UNION SELECT conv_id, t1 FROM m),
 el AS (SELECT conv_id, lo, lead(lo) OVER (PARTITION BY conv_id ORDER BY lo) AS hi FROM pts),
 own AS (SELECT * FROM (SELECT el.conv_id, el.lo, el.hi, m.turn, m.speaker, row_number() OVER (PARTITION BY el.conv_id, el.lo ORDER BY m.t0 DESC, m.t1 DESC, m.turn DESC) AS nth FROM el JOIN m ON m.conv_id = el.conv_id AND m.t0 <= el.lo AND m.t1 >= el.hi WHERE el.hi IS NOT NULL) WHERE nth = 1),
 fl AS (SELECT *, CASE WHEN lag(turn) OVER w = turn AND lag(hi) OVER w = lo THEN 0 ELSE 1 END AS fresh FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY lo)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS piece FROM fl)
 SELECT conv_id, turn, speaker, min(lo) AS start, max(hi) AS "end" FROM g GROUP BY conv_id, turn, speaker, piece""")
def unitize_overlap(spark, sf_dir):
    out = unitize.without_overlaps(unitize.merged_neighbours(turns(spark, sf_dir), 10.0))
    return out.select("conv_id", "turn", "speaker", "start", "end")


_CLEAN = _sql_brackets(False, "text")
_RUNS = """{p}1 AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS turned FROM {p}0 WINDOW w AS (PARTITION BY conv_id ORDER BY t0, t1, turn)),
 {p}2 AS (SELECT *, sum(turned) OVER (PARTITION BY conv_id ORDER BY t0, t1, turn ROWS UNBOUNDED PRECEDING) AS run FROM {p}1),
 {p}3 AS (SELECT *, CASE WHEN t0 - max(t1) OVER (PARTITION BY conv_id, run ORDER BY t0, t1, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 10 THEN 1 ELSE 0 END AS apart FROM {p}2),
 {p}4 AS (SELECT *, sum(apart) OVER (PARTITION BY conv_id, run ORDER BY t0, t1, turn ROWS UNBOUNDED PRECEDING) AS part FROM {p}3),
 {p}m AS (SELECT conv_id, min(turn) AS turn, min(speaker) AS speaker, min(t0) AS t0, max(t1) AS t1, coalesce(string_agg(text, ' ' ORDER BY t0, t1, turn) FILTER (text <> ''), '') AS text FROM {p}4 GROUP BY conv_id, run, part)"""


@query(f"""WITH RECURSIVE {TURNS}, a0 AS (SELECT conv_id, turn, speaker, t0, t1, coalesce(nullif({_CLEAN}, ''), text) AS text FROM turns WHERE t1 > t0), {_RUNS.format(p="a")},
 pts AS (SELECT conv_id, t0 AS lo FROM am UNION SELECT conv_id, t1 FROM am),
 el AS (SELECT conv_id, lo, lead(lo) OVER (PARTITION BY conv_id ORDER BY lo) AS hi FROM pts),
 own AS (SELECT * FROM (SELECT el.conv_id, el.lo, el.hi, am.turn, row_number() OVER (PARTITION BY el.conv_id, el.lo ORDER BY am.t0 DESC, am.t1 DESC, am.turn DESC) AS nth FROM el JOIN am ON am.conv_id = el.conv_id AND am.t0 <= el.lo AND am.t1 >= el.hi WHERE el.hi IS NOT NULL) WHERE nth = 1),
 fl AS (SELECT *, CASE WHEN lag(turn) OVER w = turn AND lag(hi) OVER w = lo THEN 0 ELSE 1 END AS fresh FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY lo)),
 gr AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS piece FROM fl),
 pc AS (SELECT conv_id, turn, min(lo) AS lo, max(hi) AS hi, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(lo)) AS k FROM gr GROUP BY conv_id, turn, piece),
 fold AS (SELECT conv_id, turn, 0::BIGINT AS k, '' AS own, text AS rest, t1, speaker, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi FROM am
  UNION ALL SELECT f.conv_id, f.turn, p.k, trim(substr(f.rest, 1, round_even(length(f.rest) * (p.hi - p.lo) / (f.t1 - p.lo), 0)::INT)), trim(substr(f.rest, round_even(length(f.rest) * (p.hi - p.lo) / (f.t1 - p.lo), 0)::INT + 1)), f.t1, f.speaker, p.lo, p.hi
  FROM fold f JOIN pc p ON p.conv_id = f.conv_id AND p.turn = f.turn AND p.k = f.k + 1),
 b0 AS (SELECT conv_id, turn, speaker, lo AS t0, hi AS t1, own AS text FROM fold WHERE k > 0), {_RUNS.format(p="b")}
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t0, t1, turn) - 1 AS turn, speaker, t0 AS start, t1 AS "end", text FROM bm""")
def unitize_turns(spark, sf_dir):
    """The whole repair, with texts shared out."""
    return unitize.unitized(turns(spark, sf_dir), merge_gap=10.0)
