"""Names, study tables, whole runs, streaming, and the oracle of every registered query."""

import duckdb
import pytest
from pyspark.sql import functions as F

from parley import queries
from parley.functions import names
from parley.operators import merge
from parley.plans import runs
from parley.plans.cli import main, parser
from parley.queries import ORACLES, QUERIES
from parley.schema import CATEGORIES
from parley.sources import sinks, transcripts

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIC = "%\n" + "\n".join(f"{k} {c}" for k, c in enumerate(CATEGORIES, 1)) + "\n%\ni 1\nyou 1\nit 2\nof 3\nis 4\nhere 5\nand 6\nno* 7\n"


def comparable(rows):
    return sorted(tuple((v is None, f"{v:.5f}" if isinstance(v, float) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.execute(ORACLES[name])
    theirs = [d[0] for d in want.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert comparable(df.select(*columns).collect()) == comparable([[r[i] for i in at] for r in want.fetchall()])


def test_names(spark):
    rows = [("01_2_1_A_F007_M012_concat.csv",), ("f3 m004 round1_x.csv",), ("talk Round 2.csv",), ("x first.csv",), ("none.csv",)]
    df = spark.createDataFrame(rows, "n string")
    got = df.select(names.id_in_name(F.col("n"), "F"), names.id_in_name(F.col("n"), "M", False), names.round_number(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(7, 12, 2), (3, None, None), (None, None, 2), (None, None, 1), (None, None, None)]


def test_rounds_long_and_repeated_keys(spark):
    one = spark.createDataFrame(
        [("F001", "M002", 10, 30, 0.5)],
        "female_id string, male_id string, female_total_words long, male_total_words long, lsm_ppron double"
    )
    out = merge.rounds_long(one, one, CATEGORIES).orderBy("round_num").collect()
    assert [(r.dyad_id, r.round_num, r.lsm_f_talk_ratio, r.lsm_n_active_cats) for r in out] == [("F001_M002", 1, 0.25, 1), ("F001_M002", 2, 0.25, 1)]
    with pytest.raises(ValueError):
        merge.rounds_long(one.union(one), one, CATEGORIES)


def test_static_with_rolling(spark):
    static = spark.createDataFrame([(1, 2, 1, 0.5), (3, None, 1, 0.7)], "female_id long, male_id long, round_num int, dyad_final_rlsm double")
    rw = spark.createDataFrame(
        [
            (1, 2, 1, 5, 8, "True", 0, "nanmean"), (1, 2, 1, 9, 4, "True", 0, "nanmean"),
            (3, None, 1, 2, 8, "True", 0, "nanmean"), (3, None, 1, 2, 4, "0", 0, "nanmean")
        ],
        "female_id long, male_id long, round_num int, n_pair_turns int, window_size_param int, include_current string, min_window_tokens int, na_policy string",
    )
    got = {r.female_id: r for r in merge.static_with_rolling(static, rw).collect()}
    assert len(got) == 2 and got[1].rw_window_size_param == 8 and got[3].rw_n_pair_turns == 2
    got = {r.female_id: r for r in merge.static_with_rolling(static, rw, window=4, include_current=True).collect()}
    assert got[1].rw_n_pair_turns == 9 and got[3].rw_n_pair_turns is None
    with pytest.warns(UserWarning):
        merge.static_with_rolling(static, rw, window=99)
    with pytest.raises(ValueError):
        merge.join_keys(["a"], ["b"])


def test_a_row_without_a_window_comes_last(spark):
    rows = [(1, None, "True", 0, 9), (1, 20, "True", 0, 1), (2, None, "True", 0, 1), (2, None, "True", 5, 1)]
    rw = spark.createDataFrame(rows, "female_id long, window_size_param int, include_current string, min_window_tokens int, n_pair_turns int")
    got = {r.female_id: (r.window_size_param, r.min_window_tokens) for r in merge.representatives(rw, ["female_id"]).collect()}
    assert got == {1: (20, 0), 2: (None, 5)}


def write_conversations(folder):
    talk = "speaker,text,start,end\r\nFemale,\"I say it, and you know\",0.0,3.0\nmale,of course it is no news,2.5,6.0\nF,you and I are here [laugh],6.0,9.5\nman,\"is it \"\"here\"\" and now\nor of no use\",10,14\n"
    (folder / "01_1_1_A_F001_M001_concat.csv").write_text(talk)
    (folder / "01_2_1_A_F001_M001_concat.csv").write_text(talk.replace("course", "you"))
    (folder / "02_1_1_A_F002_M002_concat.csv").write_text("text,speaker\nonly one speaker here,female\n")
    (folder / "notes.csv").write_text("a,b\n1,2\n")


def test_reading_conversations(spark, tmp_path):
    write_conversations(tmp_path)
    got = transcripts.read_conversations(spark, str(tmp_path))
    rows = got.orderBy("file_basename", "turn").collect()
    assert len(rows) == 9
    assert rows[3].text == 'is it "here" and now\nor of no use' and rows[3].start == 10.0 and rows[8].start is None
    assert [r.file_basename[:4] for r in transcripts.conversation_files(got, 2).collect()] == ["01_2"]
    assert transcripts.single_conversation(got, "/other/02_1_1_A_F002_M002_concat.csv").count() == 1
    with pytest.raises(ValueError):
        transcripts.of_round(got, 3)


def test_wide_and_corrupt_files(spark, tmp_path):
    write_conversations(tmp_path)
    wide = [f"x{k}" for k in range(90)]
    (tmp_path / "03_1_1_A_F003_M003_concat.csv").write_text(
        ",".join([*wide, "text", "speaker"]) + "\n" + ",".join([*map(str, range(90)), "far right", "female"]) + "\n"
    )
    (tmp_path / "04_1_1_A_F004_M004_concat.csv").write_text("speaker,text\nfemale,fine\nmale,one,cell,too,many\n")
    (tmp_path / "05_1_1_A_F005_M005_concat.csv").write_bytes(b"speaker,text\nfemale,caf\xe9\n")
    (tmp_path / "06_1_1_A_F006_M006_concat.csv").write_text("")
    rows = transcripts.read_conversations(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and [(r.text, r.speaker) for r in rows if r.female_id == 3] == [("far right", "female")]
    assert sorted(r[0][-29:-27] for r in transcripts.corrupt_files(spark, str(tmp_path)).collect()) == ["04", "05"]
    with pytest.warns(UserWarning, match="04_1_1"):
        transcripts.warn_of_corrupt_files(spark, str(tmp_path))


def test_an_empty_table_is_not_written(spark, tmp_path):
    from parley.sources.sinks import save

    df = spark.createDataFrame([(2, 1.5), (None, 0.25), (1, None)], "k long, v double")
    assert save(df, str(tmp_path), "t", order=("k",)) and not save(df.where("false"), str(tmp_path), "t")
    assert {p.name for p in tmp_path.iterdir()} == {"t", "t_full"} and spark.read.parquet(f"{tmp_path}/t_full").count() == 3
    assert [
        tuple(r) for r in spark.read.csv(f"{tmp_path}/t", header=True).orderBy("k").collect()
    ] == [(None, "0.250000"), ("1", None), ("2", "1.500000")]
    assert save(df.where("k = 1"), str(tmp_path), "t") and spark.read.parquet(f"{tmp_path}/t_full").count() == 1


def test_preferences(spark, tmp_path):
    (tmp_path / "p.csv").write_text("女性ID,男性ID,女性の交換意欲,男性の交換意欲\nF001,M02,Yes,0\nx,3,maybe,T\n")
    got = transcripts.read_preferences(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in got] == [(1, 2, True, False), (None, 3, None, True)]
    with pytest.raises(KeyError):
        transcripts.normal_preferences(spark.range(1))
    with pytest.raises(ValueError):
        transcripts.read_preferences(spark, None)


def test_whole_runs(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    write_conversations(data)
    (tmp_path / "d.dic").write_text(DIC)
    args = ["--data", str(data), "--dic", str(tmp_path / "d.dic"), "--results", str(out)]
    assert main(["lsm", *args, "--round", "1", "--temporal"], spark) == ["lsm_results", "lsm_temporal"]
    first = spark.read.csv(f"{out}/lsm_results_1st", header=True).collect()
    assert len(first) == 2 and {r.round_label for r in first} == {"1st_round"} and (out / "lsm_results_1st_full").exists()
    written = main(["rlsm", *args, "--rw", "--unitize", "approx", "--merge_gap", "1"], spark)
    assert {
        "rlsm_conversations", "pairs_rlsm", "individual_category_rlsm", "dyad_category_rlsm", "rw_rlsm_conversations",
        "rw_pairs_rlsm", "rw_individual_category_rlsm", "rw_dyad_category_rlsm", "rlsm_errors", "unitize_reports"
    } == set(written)
    one = spark.read.parquet(f"{out}/rlsm_conversations_full").collect()
    assert len(one) == 2 and all(r.dyad_id == "F001_M001" for r in one)
    assert main(
        ["merge-rlsm", "--rlsm", f"{out}/rlsm_conversations", "--rw", f"{out}/rw_rlsm_conversations", "--out", str(out)], spark
    ) == ["rlsm_merged"]
    assert not any(x.startswith("rw_") for x in main(["rlsm", *args], spark))


def test_command_defaults():
    a = parser().parse_args(["rlsm", "--data", "d", "--dic", "x", "--results", "r"])
    assert (a.na_policy, a.eps, a.rw_window_size, a.rw_include_current, a.rw) == ("bilateral_only", 1e-4, 8, True, False)
    assert parser().parse_args(["lsm", "--data", "d", "--dic", "x", "--results", "r"]).window == 5.0


def test_streaming(spark, tmp_path):
    from parley.functions.dictionary import Dictionary
    from parley.streaming.windows import streamed_similarity

    rows = [(1, "2024-01-01 00:00:10", "f", "i and it"), (1, "2024-01-01 00:01:00", "m", "i or it"), (1, "2024-01-01 02:00:00", "f", "late")]
    df = spark.createDataFrame(rows, "conv_id long, ts string, speaker string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streamed_similarity(stream, Dictionary.of({"p": ["i"], "c": ["and", "it"]}), ("f", "m"), ["p", "c"])
    q = out.writeStream.format("memory").queryName("scores").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scores").collect()
    assert [(r.total_1, r.total_2, r.lsm_p) for r in got] == [(3, 3, 1.0)]


def test_studies_list_and_parse_many_files_once_in_few_tasks(spark, tmp_path, monkeypatch):
    for k in range(80):
        (tmp_path / "data" / f"d{k}").mkdir(parents=True)
        (tmp_path / "data" / f"d{k}" / f"F{k:03d}_M{k:03d}.csv").write_text("speaker,text\n" + "Woman,I am the one\nman,you are the other\n" * 5)
    (tmp_path / "a.dic").write_text("%\n1 ppron\n2 article\n%\ni 1\nyou 1\nthe 2\n")
    parsed, parse = [], transcripts._file_rows
    monkeypatch.setattr(transcripts, "_file_rows", lambda *a: parsed.append(1) or parse(*a))
    monkeypatch.setattr(transcripts, "LISTING_TASKS", 2, raising=False)
    for study, table in ((runs.run_lsm, "lsm_results"), (runs.run_rlsm, "rlsm_conversations")):
        parsed.clear()
        spark.sparkContext.setJobGroup(table, "a study")
        study(spark, f"{tmp_path}/data/*", str(tmp_path / "a.dic"), str(tmp_path / table))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs = spark.sparkContext.statusTracker()
        stages = [s for j in jobs.getJobIdsForGroup(table) for s in jobs.getJobInfo(j).stageIds]
        assert len(parsed) == 1 and max(x.numTasks for x in map(jobs.getStageInfo, stages) if x) < 80
        assert spark.read.parquet(f"{tmp_path}/{table}/{table}_full").count() == 80
        assert not list((tmp_path / table).glob("_rows*"))


def test_a_study_writes_many_files_to_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_dir", lambda spark: str(tmp_path))
    folder = queries._study(spark, DATA)
    files = list((tmp_path / folder.rsplit("/", 1)[-1]).glob("data/*/*.csv"))
    assert len(files) == spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
    assert len({f.parent for f in files}) <= 4 < len(files)  # 4 shuffle partitions


def test_conversation_files_equal_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    rows = [
        (7, 1, " a ", None, 1.0), (7, 0, None, 'say "x", \\ ok\\', 1e-9), (7, 2, "", "", 1e12), (8, 0, "u", "a\r\nb\rc\n\n", 3.0),
        (None, 0, "u", "\ufeff日本 \U0001f600", 3.0), (9, 5, "u", "\ttab  ", float("nan")), (9, 4, "m", "first", None)
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, speaker string, text string, start double").repartition(3)
    place = sinks.file_system_of
    got = {}
    for scheme in ("file", "other"):
        fs = type("FileSystem", (), {"getScheme": lambda self, s=scheme: s, "mkdirs": lambda self, at: place(spark, at.toString())[0].mkdirs(at)})()
        monkeypatch.setattr(sinks, "file_system_of", lambda spark, path, fs=fs: (fs, place(spark, path)[1]))
        sinks.write_conversations(turns, str(tmp_path / scheme))
        files = [f for f in (tmp_path / scheme).rglob("*.csv") if not f.name.startswith(".")]
        got[scheme] = {(f.stem if scheme == "file" else f.parent.name): f.read_bytes() for f in files}
        assert len(files) == len(got[scheme]) == 4
    assert got["file"] == got["other"]
    again = transcripts.read_conversations(spark, f"{tmp_path}/file/*").where("file_path like '%conv_id=9.csv'").orderBy("turn").collect()
    assert [(r.turn, r.speaker, r.text) for r in again] == [(0, "m", "first"), (1, "u", "tab")]
    sinks.write_conversations(turns.where("false"), str(tmp_path / "none"))
    assert transcripts.read_conversations(spark, f"{tmp_path}/none/*").count() == 0
