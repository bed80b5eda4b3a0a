"""Sinks, document readers, model runs, streams and the command line, end to end on small data."""

import json
import random

import pytest
from pyspark.sql import functions as F

from duoscope import backends, cli
from duoscope.operators import audit
from duoscope.sinks import files, report
from duoscope.sources import results
from duoscope.specs.dialects import load_dialect
from duoscope.streaming import incremental
from tests.conftest import DATA


def pairs(spark):
    return spark.read.parquet(f"{DATA}/generated_pairs.parquet")


def test_audit_documents_round_trip(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/audit_pairs.parquet")
    keys = ["model", "benchmark", "dialect"]
    summary = audit.confusion(rows, keys)
    docs = files.audit_documents(summary, rows.select(*keys, "id", "original_prompt", "original_correct", "transformed_correct", "error"), keys, "20250101_000000")
    for r in docs.collect():
        (tmp_path / r["model_dir"]).mkdir(exist_ok=True)
        (tmp_path / r["model_dir"] / r["file_name"]).write_text(files.indent(r["document"]))
    (tmp_path / "broken.json").write_text('{"benchmark": 1')
    back = results.audits(spark, str(tmp_path))
    assert back.count() == summary.count() and back.where("benchmark_type <> 'numerical'").count() == 0
    assert results.audit_rows(spark, str(tmp_path)).count() == rows.count()
    assert results.latest_audits(spark, str(tmp_path)).count() == summary.count()
    assert results.latest_audits(spark, str(tmp_path), ["nobody"]).count() == 0
    folder = next(p for p in tmp_path.iterdir() if p.is_dir())
    (tmp_path / "archive").mkdir()
    older = sorted(folder.iterdir())[0]
    (tmp_path / "archive" / older.name).write_text(older.read_text())
    assert results.latest_audits(spark, str(tmp_path), [folder.name]).count() == len(list(folder.iterdir()))


def test_pair_documents(spark, tmp_path):
    p = pairs(spark)
    summary = p.groupBy("benchmark", "dialect").agg(F.count("*").alias("total_samples"))
    docs = files.generation_documents(summary, p.drop("loaded_at", "created_at"), p.limit(0).select("benchmark", "dialect", "id"), "x")
    for r in docs.collect():
        (tmp_path / r["file_name"]).write_text(r["document"])
    assert results.pairs(spark, str(tmp_path)).count() == p.count()
    assert results.generation_file(spark, str(tmp_path), "gsm8k", "aave") == "gsm8k_aave_x.json"
    assert results.generation_file(spark, str(tmp_path), "none", "aave") is None


def test_partitioned_sinks(spark, tmp_path):
    files.write_pairs(pairs(spark), str(tmp_path / "p"))
    files.write_pairs(pairs(spark).where("benchmark = 'gsm8k'"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == pairs(spark).count()
    files.save_documents(spark.createDataFrame([("a.json", "{}")], "file_name string, document string"), str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first()["value"] == "{}"


def test_report(spark):
    page = report.html(spark.read.parquet(f"{DATA}/audits.parquet"), "A <title>")
    assert "A &lt;title&gt;" in page and "Largest gaps" in page
    assert "<h1>" in report.html(spark.read.parquet(f"{DATA}/audits.parquet").limit(0))


def test_chart_data(spark):
    from duoscope.plans import audits as plans

    newest, rows = plans._latest(spark, DATA), plans._features(spark, DATA)
    models = [r["model"] for r in newest.select("model").distinct().orderBy("model").collect()]
    made = {k: v.count() for k, v in report.charts(newest, rows, models[0], models[1]).items()}
    assert len(made) == 14 and min(made.values()) > 0
    assert made["features_in_ranges"] == 4 and made["features_in_ranges_by_model"] == 4 * rows.select("model").distinct().count()
    empty = report.charts(newest.limit(0), rows.limit(0), "x", "y")
    assert all(v.count() <= 4 for v in empty.values())


def failing():
    class Failing:
        def ask(self, prompt, system=None):
            raise TimeoutError("no")

    return lambda: Failing()


def test_generate(spark):
    samples = spark.createDataFrame([("1", "He is cold.", "b"), ("2", "", "b"), ("3", None, "b")], "id string, question string, benchmark string")
    good, failed, counts = backends.generate(samples, load_dialect("hiberno_english"), backends.make_client("echo"), parallel=2)
    assert counts.first()["total_samples"] == 3 and good.count() + failed.count() == counts.first()["successful_transforms"]
    _, _, none = backends.generate(samples, load_dialect("aave"), failing())
    assert none.first()["transform_errors"] == 3


def test_invalid_rewrites_are_asked_for_again(spark):
    class Third:
        """Gives an invalid rewrite twice, then a valid one."""

        def __init__(self, path):
            self.path = path

        def ask(self, prompt, system=None):
            with open(self.path, "a+") as f:
                f.write("x")
                f.seek(0)
                return "" if len(f.read()) % 3 else "He does be cold out there."

    import tempfile

    path = tempfile.mktemp()
    samples = spark.createDataFrame([("1", "He is cold out there.")], "id string, original string")
    make = lambda: Third(path)
    got = backends.rewrite_all(samples, load_dialect("hiberno_english"), make, attempts=1, parallel=1).collect()
    assert len(got) == 1 and got[0]["transformed"] == "He does be cold out there." and len(open(path).read()) == 3
    got = backends.rewrite_all(samples, load_dialect("hiberno_english"), make, attempts=1, parallel=1, rounds=2).collect()
    assert got[0]["transformed"] is None and got[0]["error"]


def test_run_audit(spark):
    graded, summary = backends.run_audit(pairs(spark).limit(30), "echo", backends.make_client("echo"))
    assert graded.count() == 30 and summary.agg(F.sum("total_pairs")).first()[0] == 30
    _, failed = backends.run_audit(pairs(spark).limit(5), "x", failing())
    assert failed.agg(F.sum("errors")).first()[0] == 5
    with pytest.raises(ValueError):
        backends.make_client("nope")
    assert backends.health(backends.make_client("echo")) and not backends.health(failing())


def test_keep_latest(spark, tmp_path):
    write = incremental.keep_latest(str(tmp_path / "t"), ["k"], ["v"])
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    write(make([("a", 1), ("b", 5)]), 0)
    write(make([("a", 3), ("b", 2)]), 1)
    write(make([("a", 3), ("b", 2)]), 1)
    write(make([("c", 1)]), 2)
    assert {(r["k"], r["v"]) for r in incremental.read_latest(spark, str(tmp_path / "t")).collect()} == {("a", 3), ("b", 5), ("c", 1)}
    # only touched buckets are written again
    write(make([("a", 9)]), 3)
    assert len(list((tmp_path / "t" / "version=3").glob("_bucket=*"))) == 1
    rng = random.Random(4)
    want = {"a": 9, "b": 5, "c": 1}
    for epoch in range(4, 8):
        rows = [(f"k{rng.randint(0, 300)}", rng.randint(0, 10**6)) for _ in range(200)]
        write(make(rows), epoch)
        for k, v in rows:
            want[k] = max(v, want.get(k, -1))
    assert {r["k"]: r["v"] for r in incremental.read_latest(spark, str(tmp_path / "t")).collect()} == want


def test_stream_of_files(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/audit_pairs.parquet").select("audit_key", "id", "error", "asked_at", "model").withColumn("asked_at", F.col("asked_at").cast("timestamp"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.first_deliveries(incremental.arriving(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1), ["audit_key"], "asked_at", "3650 days")
    q = stream.writeStream.format("memory").queryName("first_ones").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_ones").count() == rows.select("audit_key").distinct().count()


def test_cli(spark, tmp_path):
    items = spark.read.parquet(f"{DATA}/eval_items.parquet").select("id", "question", "benchmark").where("benchmark = 'gsm8k'")
    items.write.parquet(str(tmp_path / "items"))
    assert cli.main(["generate", "--input", str(tmp_path / "items"), "--output", str(tmp_path / "g"), "--dialect", "hiberno_english", "--end", "5", "--quiet"]) == 0
    pairs(spark).limit(20).write.parquet(str(tmp_path / "pairs"))
    assert cli.main(["audit", "--input", str(tmp_path / "pairs"), "--output", str(tmp_path / "a"), "--quiet"]) == 0
    one = spark.read.parquet(f"{DATA}/audit_pairs.parquet").where("benchmark = 'gsm8k' and dialect = 'aave' and model = 'tern-mini'")
    one.write.parquet(str(tmp_path / "s1"))
    assert cli.main(["combine", str(tmp_path / "s1"), str(tmp_path / "s1"), "--output", str(tmp_path / "m")]) == 0
    assert spark.read.parquet(str(tmp_path / "m" / "pairs")).count() == one.select("id").distinct().count()
    assert cli.main(["report", "--input", f"{DATA}/audits.parquet", "--output", str(tmp_path / "r.html")]) == 0
    assert json.dumps((tmp_path / "r.html").read_text())
    made = pairs(spark).where("benchmark = 'gsm8k' and dialect = 'aave'").limit(30)
    made.write.parquet(str(tmp_path / "g1"))
    assert cli.main(["combine", str(tmp_path / "g1"), str(tmp_path / "g1"), "--mode", "generation", "--output", str(tmp_path / "gm")]) == 0
    assert spark.read.parquet(str(tmp_path / "gm" / "pairs")).count() == made.select("id").distinct().count()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "audit_a.json").write_text('{"model": "m", "benchmark": "b", "dialect": "d", "pairs": [{"id": "1", "error": "x"}, {"id": "2"}]}')
    assert cli.main(["cleanup", "--input", str(tmp_path / "docs")]) == 0 and (tmp_path / "docs" / "audit_a.json").exists()


def test_readers_with_a_policy(spark, tmp_path):
    def put(folder, name, benchmark, accuracy):
        (tmp_path / folder).mkdir(exist_ok=True)
        doc = {"benchmark": benchmark, "dialect": "aave", "model": folder, "total_pairs": 4, "original_accuracy": accuracy}
        (tmp_path / folder / name).write_text(json.dumps(doc))

    put("gemma2_9b", "audit_gsm8k_aave_gemma2_9b_20250101_000000.json", "gsm8k", 0.1)
    put("gemma2_9b", "audit_gsm8k_aave_gemma2_9b_20250201_000000.json", "gsm8k", 0.2)
    put("gemma2_9b", "audit_mmlu_aave_gemma2_9b_20250101_000000.json", "mmlu", 0.3)
    put("gemma2_9b", "audit_mmlu_aave_gemma2_9b_combined.json", "mmlu", 0.4)
    put("elsewhere", "audit_gsm8k_aave_elsewhere_20250301_000000.json", "gsm8k", 0.5)
    path = str(tmp_path)
    seen = lambda df: sorted((r["folder"], r["benchmark"], r["original_accuracy"]) for r in df.collect())
    assert seen(results.all_models(spark, path)) == [("gemma2_9b", "gsm8k", 0.2), ("gemma2_9b", "mmlu", 0.4)]
    assert seen(results.audit_table(spark, path)) == [("gemma2_9b", "gsm8k", 0.1), ("gemma2_9b", "mmlu", 0.4)]
    assert len(seen(results.archived_audits(spark, path))) == 3
    put("gen", "arc_aave_2.json", "x", 0), put("gen", "arc_aave_1.json", "x", 0)
    assert results.generation_file(spark, path, "arc_challenge", "aave") == "arc_aave_1.json"
    assert results.generation_file(spark, path, "boolq", "aave") is None


def test_completion_server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _say(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self._say({"models": [{"name": "b"}, {"name": "a"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self._say({"response": f"{asked['system']}: {asked['prompt']}"})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert backends.make_client("completion", url=url, model="a")().ask("hello", "you") == "you: hello"
    assert backends.list_models(url) == ["a", "b"]
    server.shutdown()
    server.server_close()
    assert backends.list_models(url, timeout=1) == []
