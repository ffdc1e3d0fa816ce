import pytest
from pyspark.sql import functions as F

from tallyflow import sources
from tallyflow.sources import flows


def test_csv_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,n,label\n1.5,2,"A"\n2.5,3,b\n')
    path = str(tmp_path / "a.csv")
    assert dict(sources.read_flows(spark, path).dtypes) == {"x": "double", "n": "int", "label": "string"}
    typed = sources.read_flows(spark, path, schema="x double, n bigint, label string")
    assert typed.first()["label"] == "A" and dict(typed.dtypes)["n"] == "bigint"
    assert sources.read_flows(spark, path, quote=None).first()["label"] == '"A"'
    (tmp_path / "b.csv").write_text("1,2,WWW\n3,4,MAIL\n")
    named = sources.read_flows(spark, str(tmp_path / "b.csv"), names=["1", "2", "class"])
    assert named.columns == ["1", "2", "class"] and named.agg(F.sum("1")).first()[0] == 4.0
    names = flows.numbered_flow_names()
    assert len(names) == 249 and names[-1] == "class" and "188" not in names
    with pytest.raises(ValueError):
        sources.read_flows(spark, path, schema="x double", names=["x"])


def test_trace_is_appended(spark, tmp_path):
    path = str(tmp_path / "trace")
    for i in (1, 2):
        sources.write_trace(spark.createDataFrame([(i, 0.5 / i)], "Iteration int, LogLoss double"), path)
    assert sorted(map(tuple, sources.read_trace(spark, path).collect())) == [(1, 0.5), (2, 0.25)]
    sources.write_best(spark.createDataFrame([("trees", 5.0)], "parameter string, value double"), str(tmp_path / "best"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "best"), header=True).first()["value"] == "5.0"


def test_work_folder_follows_the_session(spark):
    folder = sources.work_path(spark, "t").rsplit("/", 1)[0]
    assert folder in spark.sparkContext.getCheckpointDir() or spark.sparkContext.getCheckpointDir().find(folder.split(":")[-1]) >= 0
    df = sources.durable(spark.range(5))
    assert df.count() == 5
