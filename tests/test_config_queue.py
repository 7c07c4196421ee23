"""Settings over defaults; a queue that is saved, recovered and set aside."""

import json

from pyspark.sql import functions as F

from docmill.sources import settings
from docmill.sources import task_queue as Q


def test_settings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    own = {"own": {"video": {"compression_crf": 30, "location_dictionary": {"x": "y"}}, "tools": "none", "new": 1, "app": None}, "deep": {"a": {"b": {"c": {"d": {"e": 1}}}}}}
    for name, value in own.items():
        (tmp_path / f"a/{name}.json").write_text(json.dumps(value))
    for name, text in (("open", "{"), ("list", "[1]"), ("blank", " ")):
        (tmp_path / f"a/{name}.json").write_text(text)
    got = {r.owner: json.loads(r.s) for r in settings.read(spark, f"file://{tmp_path}/a").selectExpr("owner", "to_json(settings) AS s").collect()}
    assert got["open"] == got["list"] == got["blank"] == settings.DEFAULTS
    video = settings.DEFAULTS["video"] | {"compression_crf": 30, "location_dictionary": {"x": "y"}}
    assert got["own"] == settings.DEFAULTS | {"video": video, "tools": "none", "new": 1, "app": None}
    base = {"a": {"b": {"c": {"d": {"f": 2}, "g": 3}}}}
    made = settings.effective(spark.createDataFrame([("deep", json.dumps(own["deep"]))], "owner string, settings string"), base).selectExpr("to_json(settings)").first()[0]
    assert json.loads(made) == {"a": {"b": {"c": {"d": {"e": 1}, "g": 3}}}}  # four levels are merged, the fifth is replaced
    values = spark.createDataFrame([(k, json.dumps({"n": v})) for k, v in enumerate((1, "7", "x", None, 2.5, -3, True, {}))], "owner long, settings string")
    rows = settings.effective(values, {}).select("owner", settings.whole(F.col("settings"), "$.n", 5, 2).alias("n"))
    assert [r.n for r in rows.orderBy("owner").collect()] == [2, 7, 5, 5, 5, 2, 5, 5]


def test_queue(spark, tmp_path):
    path = f"file://{tmp_path}/queue"
    assert Q.load(spark, path).collect() == []
    make = lambda *rows: spark.createDataFrame(list(rows), "task_id string, status string, progress int").selectExpr("task_id", "'s' AS source", "'TO_PDF' AS operation", "'o' AS output_root", "status", "progress", "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS updated_at")
    Q.save(make(("a", "running", 100), ("b", "success", 100), ("c", None, None)), path)
    assert {(r.task_id, r.status, r.progress) for r in Q.load(spark, path).collect()} == {("a", "running", 100), ("b", "success", 100), ("c", "waiting", 0)}
    got = {r.task_id: r for r in Q.load(spark, path, recover=True).collect()}
    assert (got["a"].status, got["a"].progress, got["a"].message) == ("interrupted", 99, Q.INTERRUPTED) and got["b"].message is None
    assert {r.task_id: r.status for r in Q.load(spark, path).collect()} == {"a": "interrupted", "b": "success", "c": "waiting"}
    version = Q.save(make(("d", "waiting", 0)), path)
    (tmp_path / "queue" / version / "part-bad.json").write_text('{"schema_version": 1, "task_id": \n')
    assert Q.load(spark, path).collect() == []
    assert any(p.name.startswith("corrupt-") for p in (tmp_path / "queue").iterdir())
    assert {r.task_id for r in Q.load(spark, path).collect()} == {"a", "b", "c"}


def test_fields_of_settings_are_read_once_a_level(spark):
    rows = settings.effective(spark.createDataFrame([("a", '{"app": {"theme": "dark"}}')], "owner string, settings string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SchemaOfVariant.schemaOfVariant(") <= 2 * settings.DEPTH + 1
    assert rows.select(settings.text(F.col("settings"), "$.app.theme")).first()[0] == "dark"
