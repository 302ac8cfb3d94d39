"""Readers, writers and the stream over files."""

import json

import pytest

from faultline.sources import readers, writers
from faultline.streaming import index as stream


@pytest.fixture
def write(tmp_path):
    def put(name, *lines):
        (tmp_path / name).write_text("\n".join(lines))
        return str(tmp_path / name)

    return put


def test_repairing_reader(spark, write):
    good = '{"func": "int f(){}", "target": 1}'
    assert readers.repairing_jsonl(spark, write("a", good, good)).count() == 2
    assert readers.repairing_jsonl(spark, write("b", *[good] * 10), limit=3).count() == 3
    rows = readers.repairing_jsonl(spark, write("c", '"func": "void f(){}", "target": 0}', "", "{bad", "  ")).collect()
    assert [(r.func, r.target) for r in rows] == [("void f(){}", 0)]


def test_rejects_and_rows_are_all_lines(spark, write, tmp_path):
    lines = ['{"func": "a", "target": 1}', '"func": "b"}', "", "  ", "no", "[1, 2]", '{"func": 3', "4", '{"func": "c"} and more']
    path = write("r.jsonl", "\n".join(lines))
    rejects = readers.repairing_rejects(spark, path).collect()
    assert readers.repairing_jsonl(spark, path).count() + len(rejects) == len(lines)
    assert sorted((r.value, r.reason) for r in rejects) == sorted([("", "blank"), ("  ", "blank"), ("no", "not JSON"), ("[1, 2]", "not JSON"), ('{"func": 3', "not JSON"), ("4", "not JSON"), ('{"func": "c"} and more', "not JSON")])
    assert {r.file.rsplit("/", 1)[1] for r in rejects} == {"r.jsonl"}
    assert readers.catalogue_jsonl(spark, path).count() + readers.catalogue_rejects(spark, path).count() == len(lines)
    assert readers.catalogue_rejects(spark, path + ".missing").count() == 0
    folder = tmp_path / "templates"
    folder.mkdir()
    for name, body in (("a.json", '{"id": "x"}'), ("b.json", "{broken"), ("c.json", " \n")):
        (folder / name).write_text(body)
    assert {(r.file.rsplit("/", 1)[1], r.reason) for r in readers.template_rejects(spark, str(folder)).collect()} == {("b.json", "not JSON"), ("c.json", "blank")}


def test_batch_reader(spark, write):
    path = write("a", '{"func": "a", "target": 1}', "", '{"code": "b", "label": "0"}', '{"func": " "}', '{"func": "c"}')
    rows = readers.batch_jsonl(spark, path).orderBy("line_no").collect()
    assert [(r.line_no, r.code, r.label) for r in rows] == [(0, "a", 1), (2, "b", 0), (4, "c", -1)]
    assert readers.batch_jsonl(spark, path, limit=2).count() == 1


def test_lines_are_numbered_across_files_and_blocks(spark, tmp_path):
    (tmp_path / "many").mkdir()
    want = []
    for name, n in (("a", 3), ("b", 4000), ("c", 0), ("d", 700)):
        own = [f"{name}{i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / "many" / name).write_text("".join(line + "\n" for line in own))
        want += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = {r.line_no: r.value for r in readers.numbered_lines(spark, str(tmp_path / "many")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(want))


def test_training_reader_fails_on_bad_lines(spark, write):
    assert readers.training_jsonl(spark, write("a", '{"func": "a", "target": 1, "idx": 7}')).first().idx == 7
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        readers.training_jsonl(spark, write("b", "{oops")).collect()


def test_other_readers(spark, write, tmp_path):
    assert readers.json_array(spark, write("a", '[{"func": "a"}, {"func": "b"}]')).count() == 2
    assert sorted(r.idx for r in readers.split_ids(spark, write("b", "3", "1", "3")).collect()) == [1, 3]
    assert [(r.word, r.vector) for r in readers.word_vectors(spark, write("c", "2 2", "cat 1 2.5", "dog 0 -1")).collect()] == [("cat", [1.0, 2.5]), ("dog", [0.0, -1.0])]
    assert readers.inline(spark, "int x;").first().code == "int x;"
    assert readers.source_file(spark, write("d.c", "int y;", "")).first().code.startswith("int y;")
    assert readers.catalogue_jsonl(spark, str(tmp_path / "none")).count() == 0
    rows = readers.catalogue_jsonl(spark, write("e", '{"exploit_id": "x", "tags": ["t"]}', "bad")).collect()
    assert [(r.exploit_id, r.timeout_sec, r.language, r.expected_signals) for r in rows] == [("x", 30, "c", [])]


def test_template_folder(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "b.json").write_text(json.dumps({"exploit_id": "one", "expected_signals": ["SEGV"], "timeout_sec": 5}))
    (folder / "a.json").write_text(json.dumps([{"exploit_id": "two"}, {"exploit_id": "three"}]))
    (folder / "c.json").write_text("{bad")
    (folder / "d.txt").write_text("{}")
    rows = readers.template_catalogue(spark, str(folder)).collect()
    (tmp_path / "more").write_text('{"exploit_id": "four"}')
    assert readers.catalogue(spark, str(folder), str(tmp_path / "more")).count() == 4
    assert [r.exploit_id for r in rows] == ["two", "three", "one"] and rows[2].expected_signals == ["SEGV"] and rows[2].timeout_sec == 5


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train", 1), (2, "b", "test", 0)], "idx long, func string, split string, prediction int")
    writers.splits(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/split=train")).first().func == "a"
    writers.predictions_tsv(df, str(tmp_path / "p"))
    assert sorted(spark.read.text(str(tmp_path / "p")).toPandas()["value"]) == ["1\t1", "2\t0"]
    writers.index(df, str(tmp_path / "i"))
    writers.index(df, str(tmp_path / "i"), "append")
    assert readers.vector_index(spark, str(tmp_path / "i")).count() == 4
    writers.rebuild_index([df, df, df], str(tmp_path / "i"))
    assert readers.vector_index(spark, str(tmp_path / "i")).count() == 6
    writers.results_json(df, str(tmp_path / "r"))
    writers.metrics_json(df.groupBy().count(), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["count"] == 2
    writers.text(df, "func", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_index_grows_from_a_stream(spark, tmp_path):
    new = spark.createDataFrame([(i, [float(i + 1), 1.0], i % 2) for i in range(6)], "vec_id long, embedding array<double>, label int")
    new.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    stream.append_index(rows, str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination()
    new.withColumn("vec_id", new.vec_id + 6).write.mode("append").parquet(str(tmp_path / "in"))
    stream.append_index(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "c1")).awaitTermination()
    grown = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r.vec_id for r in grown.collect()) == list(range(12))
    stream.score_stream(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), grown, str(tmp_path / "scores"), str(tmp_path / "c2"), k=3).awaitTermination()
    scored = spark.read.parquet(str(tmp_path / "scores"))
    assert scored.count() == 12 and scored.filter("faiss_score between 0 and 1").count() == 12


def test_command_line(spark, tmp_path):
    from faultline import cli

    samples = spark.createDataFrame([(1, "int f(char *argv) { system(argv); }", 0.9, [1.0, 0.0])], "sample_id long, code string, cls_prob double, embedding array<double>")
    samples.write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(9, [1.0, 0.1], 1, "exec")], "vec_id long, embedding array<double>, label int, vuln_type string").write.parquet(str(tmp_path / "v"))
    cli.main(["index", "--vectors", str(tmp_path / "v"), "--path", str(tmp_path / "i")])
    cli.main(["scan", "--samples", str(tmp_path / "s"), "--index", str(tmp_path / "i"), "--out", str(tmp_path / "o"), "--report"])
    got = json.loads(spark.read.text(str(tmp_path / "o/json")).first().value)
    assert got["vuln_type"] == "exec" and got["verdict"] == "SUGGESTIVE" and "system" in got["taint_context"]
    spark.createDataFrame([(1, 1, 0.9, 1.0), (0, 1, 0.2, 3.0), (0, 0, 0.1, 2.0)], "prediction int, label int, score double, seconds double").write.parquet(str(tmp_path / "p"))
    cli.main(["evaluate", "--predictions", str(tmp_path / "p"), "--out", str(tmp_path / "m")])
    m = spark.read.json(str(tmp_path / "m")).first()
    assert (m.recall, m.auc, m.median_time) == (0.5, 1.0, 2.0)
    assert (m.total, m.true_positives, m.fp_reduction, m.mode) == (3, 1, 0.0, "full")


def test_command_line_inputs(spark, tmp_path):
    from faultline import cli

    def verdicts(*more):
        out = str(tmp_path / f"o{len(list(tmp_path.iterdir()))}")
        cli.main(["scan", "--out", out, *more])
        return out, {r.sample_id: r for r in spark.read.parquet(f"{out}/results").collect()}

    lines = ['{"func": "int a(char *argv) { gets(argv); }", "target": 1, "idx": 7}', "", '{"code": "int b;", "label": 0}', '{"func": " "}', '{"code": "int c;"}']
    (tmp_path / "d.jsonl").write_text("\n".join(lines) + "\n")
    out, got = verdicts("--jsonl", str(tmp_path / "d.jsonl"))
    assert set(got) == {0, 2, 4} and {r.verdict for r in got.values()} == {"SUGGESTIVE"} and "gets" in got[0].taint_context
    batch = {r["index"]: r for r in spark.read.json(f"{out}/batch").collect()}
    assert {i: r.label for i, r in batch.items()} == {0: 1, 2: 0, 4: -1} and batch[2].result.verdict == "SUGGESTIVE"
    assert set(verdicts("--jsonl", str(tmp_path / "d.jsonl"), "--limit", "3")[1]) == {0, 2}
    spark.createDataFrame([(0, 0.9), (2, 0.1)], "sample_id long, cls_prob double").write.parquet(str(tmp_path / "p"))
    _, got = verdicts("--jsonl", str(tmp_path / "d.jsonl"), "--scores", str(tmp_path / "p"))
    assert {i: r.verdict for i, r in got.items()} == {0: "SUGGESTIVE", 2: "SAFE", 4: "SUGGESTIVE"}
    (tmp_path / "a.c").write_text("int main(void) { return 0; }")
    assert len(verdicts("--file", str(tmp_path / "a.c"))[1]) == 1
    assert set(verdicts("--code", "int x;", "--mode", "dry-run")[1]) == {0}
    with pytest.raises(SystemExit):
        cli.main(["scan", "--code", "int x;", "--file", "a.c", "--out", "o"])
