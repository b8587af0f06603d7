"""The pipeline: contracts of its stages, and run() against a plain version on a small table."""

import collections
import random

import corpus_pipeline
from tests.llm.test_text_operators import brute_components, check_packing, plain_spans

from parley.llm import languageid, ngramjoin, qualityclassifier


def test_stages(spark, docs, empty):
    labels_dir = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "secrets", "packing"]
    plain = docs.drop("score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, plain, labels_dir)
        assert out.columns == plain.columns, name
        assert stage(spark, empty.drop("score"), labels_dir).count() == 0


CASES = [
    (1, "the river and the garden of the morning were in the house of the people that we have seen", "en"),
    (1, "the river and the garden of the morning were in the house of the people that we have seen", "en"),
    (2, None, None), (3, "", "en"), (4, "12 34 !!", "en"), (None, "a letter to the people of the town and the garden of the house, with no id", "en"),
    (6, "der Fluss und der Garten des Morgens, password: hunter22x und das Haus der Leute in der Stadt " * 40, None),
    (7, "der Fluss und der Garten des Morgens, password: hunter22x und das Haus der Leute in der Stadt " * 40 + "heute", "de"),
]


def test_each_stage_takes_nulls_repeats_ties_and_clashing_names(spark, tmp_path):
    extra = "score double, label string, hub long, sha string, rows int, piece string"
    docs = spark.createDataFrame(
        [(*c[:2], c[2], "s", len(c[1] or ""), 0.5, "x", 9, "y", 3, "z") for c in CASES],
        f"doc_id long, text string, lang string, source string, n_chars int, {extra}"
    )
    spark.createDataFrame(
        [(1, 1, 0), (6, 1, 0), (6, 0, 0), (None, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int"
    ).write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        kept[name] = sorted((str(r.doc_id), getattr(r, "text", None)) for r in out.collect())
        assert name == "packing" or out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    spoken = [c for c in CASES if c[0] not in (2, 3, 4)]
    assert {k for k, _ in kept["language_id"]} <= {str(c[0]) for c in spoken} and len(kept["language_id"]) >= 4
    assert len(kept["quality"]) == len(CASES)  # too few labels: every score is the share of label 1, which is kept
    want = sorted((str(k), t) for k, t, _ in dict((str(c[0]), c) for c in CASES if c[0] != 7).values())
    assert kept["near_duplicates"] == want  # one of the rows that repeat, and 7 goes as a near copy of 6
    assert [k for k, _ in kept["secrets"]] == sorted(str(c[0]) for c in CASES) and not any("hunter22x" in (t or "") for _, t in kept["secrets"])
    assert sorted({k for k, _ in kept["packing"]}) == sorted({str(c[0]) for c in CASES}) and len(kept["packing"]) == len(CASES)


def test_one_of_each_chain_of_near_copies_stays(spark, chains):
    rows = [(k, t, "en", "s", len(t)) for k, t in chains]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    want = set()
    for k in range(0, len(chains), 3):
        want |= {d for d, (_, c) in brute_components(chains[k : k + 3], percent=80, width=5).items() if c == d}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(want)


def test_near_copies_in_several_parts_of_a_hub_keep_one_of_each_component(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for g in range(24):
        texts = [[f"g{g}w{i}" for i in range(r.choice((8, 9, 10, 14, 24)))]]
        for k in range(8):
            words = list(r.choice(texts))
            texts.append(words[1:] if k % 3 == 0 else [*words, f"m{g}x{k}"])
        rows += [" ".join(t) for t in texts]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    want = sorted(k for k, (_, c) in brute_components(rows, percent=80, width=5).items() if k == c)
    monkeypatch.setattr(ngramjoin, "GROUP", 2)  # parts of two members: most groups have several
    found, further = [], ngramjoin.further_links

    def counted(*given):
        found.append(further(*given))
        assert found[0].count() > 0
        return found[0]

    monkeypatch.setattr(ngramjoin, "further_links", counted)
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert found and 24 < len(want) < len(rows) // 2


def test_run_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    spoken = {r.doc_id for r in languageid.predict(docs, languageid.train(docs)).collect() if r.lang_pred != "und" and r.score >= 0.5}
    left = docs.where(docs.doc_id.isin(list(spoken)))
    good = {r.doc_id for r in qualityclassifier.score(left, qualityclassifier.train(left, labels)).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    kept = {k for k, (_, c) in brute_components(texts.items(), percent=80, width=5).items() if k == c}

    def masked(text):
        out, end = [], 0
        for s in plain_spans(text):
            a, b = map(int, s.split(":")[1:])
            if a >= end:
                out += [text[end:a], "[secret]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    rows = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == collections.Counter(kept)
    check_packing(rows, [(k, masked(texts[k])) for k in sorted(kept)])
