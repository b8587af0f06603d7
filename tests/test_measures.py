"""Literal cases of the measures over tiny tables."""

import pytest
from pyspark.sql import functions as F

from parley.functions.dictionary import Dictionary
from parley.functions.scoring import responsiveness, similarity, window_index
from parley.operators import features, rolling, unitize
from parley.operators import responsiveness as R
from parley.operators import similarity as S


def rates(spark, rows, cats):
    """rows: (turn, speaker, rate, ...)"""
    return spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, speaker string, " + ", ".join(f"rate_{c} double" for c in cats))


def counts(spark, rows, cats=("c1",)):
    """rows: (turn, speaker, total, n, ...)"""
    return spark.createDataFrame(
        [(1, *r) for r in rows], "conv_id long, turn long, speaker string, total long, " + ", ".join(f"n_{c} long" for c in cats)
    )


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((10, 100), (20, 200), 1.0), ((0, 100), (10, 100), 0.0), ((4, 100), (6, 100), 0.8), ((0, 100), (0, 200), None), ((3, 0), (1, 10), None)]
)
def test_static_similarity(spark, a, b, want):
    for x, y in ((a, b), (b, a)):
        got = one(spark, similarity(F.lit(x[0]), F.lit(x[1]), F.lit(y[0]), F.lit(y[1])))
        assert got == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(0.0, 0.0, None), (0.0, 5.0, None), (10.0, 0.0, 1 - 10 / 10.0001), (3.0, 3.0, 1.0), (None, 3.0, None), (3.0, None, 1 - 3 / 3.0001)]
)
def test_one_exchange(spark, a, b, want):
    got = one(spark, responsiveness(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert got == (pytest.approx(want, abs=1e-6) if want is not None else None)


def test_window_index(spark):
    got = spark.createDataFrame([(0.0,), (149.9,), (150.0,), (301.0,), (None,)], "t double").select(window_index(F.col("t"), 150)).collect()
    assert [r[0] for r in got] == [0, 0, 1, 2, 0]


def test_sparse_and_dense_windows(spark):
    rows = [(1, t, "f" if t % 2 else "m", x) for t, x in enumerate((0.0, 10.0, 149.9, 150.0, 299.9, 300.0, 700.0))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, speaker string, start double")
    got = {r.window_index: r.n_turns for r in S.sparse_windows(turns, 2.5).collect()}
    assert got == {0: 3, 1: 2, 2: 1, 4: 1}
    assert S.sparse_windows(turns, 0).count() == 0
    assert S.sparse_windows(turns.drop("start"), 1).count() == 0
    counted = turns.withColumns({"total": F.lit(2).cast("long"), "n_c1": F.lit(1).cast("long")})
    dense = {r.window_index: (r.total_1, r.total_2, r.lsm_c1) for r in S.temporal_similarity(counted, ("f", "m"), ["c1"], 2.5).collect()}
    assert dense == {0: (2, 4, 1.0), 1: (2, 2, 1.0), 2: (2, 0, None), 3: (0, 0, None), 4: (0, 2, None)}


def test_hierarchy_and_policies(spark):
    cats = ["ppron", "ipron"]
    r = rates(spark, [(0, "A", 10.0, 0.0), (1, "B", 10.0, 5.0), (2, "A", 0.0, 5.0)], cats)
    pairs = R.exchanges(r, cats)
    own = {x.speaker: x for x in R.individuals(pairs, cats).collect()}
    assert own["B"].rlsm_ppron == pytest.approx(1.0) and own["B"].rlsm_ipron is None
    assert own["A"].rlsm_ppron == pytest.approx(9.9999e-6, abs=1e-9) and own["A"].rlsm_ipron == pytest.approx(1.0)
    own = R.individuals(pairs, cats)
    both = R.dyads(r, own, cats, "bilateral_only").first()
    assert both.dyad_ppron == pytest.approx(0.500005, abs=1e-7) and both.dyad_ipron is None and both.dyad_final == pytest.approx(0.500005, abs=1e-7)
    either = R.dyads(r, own, cats, "nanmean").first()
    assert either.dyad_ipron == pytest.approx(1.0) and either.dyad_final == pytest.approx(0.7500025, abs=1e-6)
    with pytest.raises(ValueError):
        R.dyads(r, own, cats, "other")


def test_only_changes_make_pairs_and_single_speakers_have_none(spark):
    r = rates(spark, [(0, "A", 1.0), (1, "A", 2.0), (2, "B", 3.0), (3, "A", 4.0)], ["c"])
    assert [(p.pair_index, p.leader, p.responder) for p in R.exchanges(r, ["c"]).orderBy("pair_index").collect()] == [(1, "A", "B"), (2, "B", "A")]
    alone = rates(spark, [(0, "A", 1.0), (1, "A", 2.0)], ["c"])
    pairs = R.exchanges(alone, ["c"])
    assert pairs.count() == 0
    own = R.individuals(pairs, ["c"])
    assert R.individual_spine(alone, own, ["c"]).count() == 0
    assert R.dyads(alone, own, ["c"]).first().dyad_final is None


def test_published_example(spark):
    values = [60.0, 25.0, 46.6666666667, 42.8571428571, 75.0]
    r = rates(spark, [(k, "AB"[k % 2], v) for k, v in enumerate(values)], ["c"])
    pairs = R.exchanges(r, ["c"])
    assert [p.rlsm_c for p in pairs.orderBy("pair_index").collect()] == pytest.approx([0.58823578, 0.69767484, 0.95744686, 0.72727296], abs=1e-7)
    assert R.dyads(r, R.individuals(pairs, ["c"]), ["c"]).first().dyad_final == pytest.approx(0.74265761, abs=1e-7)


def test_rolling(spark):
    c = counts(spark, [(0, "f", 100, 10), (1, "m", 100, 30), (2, "f", 100, 50), (3, "m", 100, 40)])
    one_turn = rolling.rolling_pairs(rolling.rolling_rates(c, ["c1"], 1), ["c1"])
    static = R.exchanges(R.with_rates(c, ["c1"]), ["c1"])
    want = [0.50000125, 0.75000031, 0.88888901]
    for pairs in (one_turn, static):
        assert [p.rlsm_c1 for p in pairs.orderBy("pair_number").collect()] == pytest.approx(want, abs=1e-7)
    c = counts(spark, [(0, "f", 100, 10), (1, "m", 100, 30), (2, "f", 100, 90)])
    two = rolling.rolling_pairs(rolling.rolling_rates(c, ["c1"], 2), ["c1"]).orderBy("pair_number").collect()
    assert two[1].rlsm_c1 == pytest.approx(0.75000031, abs=1e-7)
    before = rolling.rolling_pairs(rolling.rolling_rates(c, ["c1"], 2, include_current=False), ["c1"]).orderBy("pair_number").collect()
    assert before[1].rlsm_c1 is None
    c = counts(spark, [(0, "f", 10, 1), (1, "m", 10, 1), (2, "m", 10, 1)])
    for include in (True, False):
        assert rolling.rolling_pairs(rolling.rolling_rates(c, ["c1"], 8, include), ["c1"]).count() == 1


def test_short_turns_leave_the_rolling_measure_only(spark):
    c = counts(spark, [(k, "fm"[k % 2], n, 1) for k, n in enumerate((1, 2, 3, 3))])
    assert R.exchanges(R.with_rates(c, ["c1"]), ["c1"]).count() == 3
    assert rolling.rolling_pairs(rolling.rolling_rates(rolling.long_turns(c), ["c1"]), ["c1"]).count() == 1


def test_min_window_tokens(spark):
    c = counts(spark, [(0, "f", 5, 1), (1, "m", 50, 1), (2, "f", 50, 1)])
    pairs = rolling.rolling_pairs(rolling.rolling_rates(c, ["c1"], 1), ["c1"], min_tokens=10).orderBy("pair_number").collect()
    assert pairs[0].rlsm_c1 is None and not pairs[0].leader_window_ok and pairs[1].rlsm_c1 is not None


def test_validation(spark):
    rows = [(1, 0, "f", 3), (1, 1, "m", 2), (2, 0, "f", 3), (3, 0, "f", 3), (3, 1, "m", 0), (4, 0, "f", 1), (4, 1, "x", 1)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, speaker string, total long")
    assert {r.conv_id for r in R.validation_errors(c, ("f", "m")).collect()} == {2, 3, 4}


DIC = """# comment
ignored
%
1 ppron
2\tipron # inline
3 other
%
私* 1
自分 1
何か 2
both 1 2 9
*end 2
mid*dle 1
a.b 2
x%y 1
lost 9
"""


def test_dictionary(spark):
    d = Dictionary.parse(DIC).only(["ppron", "ipron"])
    words = ["私", "私たち", "自分", "何か", "both", "weekend", "midxdle", "a.b", "axb", "x%y", "none", "BOTH", None]
    got = {}
    for r in features.match_tokens(spark.createDataFrame([(w,) for w in words], "word string"), d, ["ppron", "ipron"]).collect():
        got.setdefault(r.word, set()).add(r.category)
    assert got == {
        "私": {"ppron"}, "私たち": {"ppron"}, "自分": {"ppron"}, "何か": {"ipron"}, "both": {"ppron", "ipron"}, "weekend": {"ipron"},
        "midxdle": {"ppron"}, "a.b": {"ipron"}, "x%y": {"ppron"}
    }
    with pytest.raises(RuntimeError):
        d.only(["absent"])


def test_counting_in_place_equals_the_token_join(spark):
    d = Dictionary.of({"ppron": ["i", "th*", "*ou", "don't", "other-wise", "i t", "*'t"], "ipron": ["it", "o*r", "o*h*r", "a*a"]})
    rows = [(1, 0, "f", "I think it is over, YOU thou; other-wise it's 12i don't a aa"), (1, 1, "m", None), (1, 2, "f", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, speaker string, text string")
    wide = features.turn_counts(turns, d, ["ppron", "ipron"])
    long = {(r.turn, r.category): r.n for r in features.long_counts(wide, ["turn"], ["ppron", "ipron"]).collect()}
    tokens = turns.select("turn", features.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    joined = {(r.turn, r.category): r.n for r in features.token_counts(tokens, ["turn"], d, ["ppron", "ipron"]).collect()}
    assert {k: v for k, v in long.items() if v} == joined == {(0, "ppron"): 4, (0, "ipron"): 5}
    assert [r.total for r in wide.orderBy("turn").collect()] == [16, 0, 0]


def test_any_number_of_patterns_and_any_characters(spark):
    """Both ways of counting equal a plain match, for patterns with any characters and more than 20,000 of them."""
    import random
    import re

    r = random.Random(3)
    odd = ["", "*", "a*", "*b", "a*b", "a*c*b", "**", "x.y", "x.*y", "[z]", "[*]", "a$", "^*", "d'", "*'*", "i|j", "\\*", "é*", "*ß"]
    d = Dictionary.of({"ppron": odd + [f"w{k}" for k in range(15_000)], "ipron": [f"{r.choice('abc')}*{k}" for k in range(9_000)]})
    tokens = [
        "".join(r.choice("abcxyzé.$^['|\\]ij0123") for _ in range(r.randrange(1, 7))) for _ in range(80)
    ] + ["w77", "w99999", "b12", "", "\\", "aß", None]
    plain = {c: [re.compile(".*".join(map(re.escape, p.split("*"))), re.S) for p, cs in d.entries if c in cs] for c in ("ppron", "ipron")}
    want = {c: sum(any(p.fullmatch(t) for p in ps) for t in tokens if t is not None) for c, ps in plain.items()}
    df = spark.createDataFrame([(1, tokens)], "doc_id int, tokens array<string>")
    got = {x.category: x.n for x in features.token_counts(df, ["doc_id"], d, ["ppron", "ipron"], fold_case=False).collect()}
    words = df.select(F.explode("tokens").alias("word"))
    joined = features.match_tokens(words, d, ["ppron", "ipron"], fold_case=False).join(words, "word").groupBy("category").count().collect()
    assert got == want == {x.category: x["count"] for x in joined}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("[え] それで", "え それで"), ("[笑] はい", "はい"), ("今日は[たぶん]大丈夫", "今日はたぶん大丈夫"), ("[] 空のかっこ", "空のかっこ"), ("a　 b［ LAUGH ］", "a b"), (None, None)]
)
def test_brackets(spark, raw, want):
    from parley.functions.text import without_brackets

    assert one(spark, without_brackets(F.lit(raw).cast("string"))) == want


def segments(spark, rows):
    return spark.createDataFrame(
        [(1, k, *r) for k, r in enumerate(rows)], "conv_id long, turn long, speaker string, start double, end double, text string"
    )


def owners(spark, rows, gap=0.0):
    df = segments(spark, [(s, a, b, "x" * 10) for s, a, b in rows])
    return [(r.speaker, r.start, r.end) for r in unitize.unitized(df, merge_gap=gap).orderBy("start").collect()]


def test_unitize(spark):
    got = unitize.unitized(segments(spark, [("f", 0.0, 1.0, "A"), ("f", 1.0, 2.0, "B")])).collect()
    assert [(r.start, r.end, r.text) for r in got] == [(0.0, 2.0, "A B")]
    rows = [("f", 1.71, 3.08), ("m", 2.24, 3.17), ("m", 3.99, 5.08), ("f", 5.33, 6.66), ("m", 7.63, 14.23), ("f", 8.48, 8.77)]
    want = [("female", 1.71, 2.24), ("male", 2.24, 5.08), ("female", 5.33, 6.66), ("male", 7.63, 8.48), ("female", 8.48, 8.77), ("male", 8.77, 14.23)]
    assert owners(spark, rows, 10.0) == want
    assert owners(spark, [("f", 0.0, 10.0), ("m", 5.0, 15.0)]) == [("female", 0, 5), ("male", 5, 15)]
    assert owners(spark, [("f", 0.0, 10.0), ("m", 5.0, 15.0), ("f", 12.0, 20.0)]) == [("female", 0, 5), ("male", 5, 12), ("female", 12, 20)]
    assert owners(spark, [("f", 0.0, 20.0), ("m", 5.0, 10.0), ("f", 8.0, 12.0)]) == [("female", 0, 5), ("male", 5, 8), ("female", 8, 20)]
    assert owners(spark, [("f", 3.0, 3.0), ("m", None, 2.0)]) == []


def test_a_time_far_off_makes_no_more_rows(spark):
    far = 3e11  # ten thousand years: as many buckets of the least width would be ten thousand million rows
    got = owners(spark, [("f", 0.0, 10.0), ("m", 5.0, 15.0), ("f", 12.0, far), ("m", 100.0, 130.0)])
    assert got == [("female", 0, 5), ("male", 5, 12), ("female", 12, 100), ("male", 100, 130), ("female", 130, far)]


def test_overlap_shares_text_by_time(spark):
    df = segments(spark, [("f", 0.0, 10.0, "abcdefghij"), ("m", 4.0, 6.0, "XY")])
    got = [(r.speaker, r.text) for r in unitize.unitized(df).orderBy("start").collect()]
    assert got == [("female", "abcd"), ("male", "XY"), ("female", "efghij")]


def test_own_tokeniser(spark):
    from parley.operators.tokenise import tokeniser, words_of

    def factory():
        return lambda text: [
            {"text": w, "lemma": w.rstrip("s") if w != "is" else "", "pos": "SYM" if w == "+" else "X", "is_punct": w == "."} for w in text.split()
        ]

    df = spark.createDataFrame([(1, "Dogs is . + cats"), (2, None)], "conv_id long, text string")
    df = df.withColumn("tokens", words_of(tokeniser(factory)(F.col("text"))))
    assert {r.conv_id: r.tokens for r in df.collect()} == {1: ["Dog", "is", "cat"], 2: []}
    d = Dictionary.of({"ppron": ["Dog"], "ipron": ["c*"]})
    got = features.token_counts(df, ["conv_id"], d, ["ppron", "ipron"], fold_case=False).collect()
    assert {(r.conv_id, r.category, r.n) for r in got} == {(1, "ppron", 1), (1, "ipron", 1)}


def test_own_tokens_are_python_objects_for_a_bounded_number_of_texts_only(spark):
    from parley.operators.tokenise import tokeniser

    def factory():
        import tracemalloc

        tracemalloc.start()

        def tokens(text):
            used = str(tracemalloc.get_traced_memory()[0])
            if text == "last":
                tracemalloc.stop()
            return [{"text": w, "lemma": used} for w in text.split()]

        return tokens

    texts = [None, "", *(f"first{k} " + f"word{k} " * 60 for k in range(4000)), "last"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").coalesce(1)
    got = df.select("k", tokeniser(factory)(F.col("text")).alias("t")).orderBy("k").collect()
    assert [[x.text for x in r.t] for r in got] == [(t or "").split() for t in texts]
    assert {(x.pos, x.is_space, x.is_punct) for r in got for x in r.t} == {(None, False, False)}
    assert max(int(x.lemma) for r in got for x in r.t) < 40e6
