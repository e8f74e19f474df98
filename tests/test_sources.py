import pytest
from pyspark.sql import functions as F

from crivo.operators import leakage as L
from crivo.operators.selection import learning_curve, loss_history
from crivo.sources import corpus as S

HEADER = "portal,url,label,processed_text\n"


@pytest.fixture
def paths(tmp_path):
    rows = {
        "train": 'a.com,http://a/1,1,"two\nlines, ""quoted"""\n,http://a/2,0,plain\n',
        "dev": "b.com,,0,\n",
        "test": "b.com,http://b/1,1,x\n",
    }
    out = {}
    for s, body in rows.items():
        p = tmp_path / f"{s}.csv"
        p.write_text(HEADER + body)
        out[s] = str(p)
    return out


def test_read_corpus(spark, paths):
    rows = S.read_corpus(spark, paths).orderBy("doc_id").collect()
    assert [r.split for r in rows] == ["train", "train", "dev", "test"]
    assert rows[0].text == 'two\nlines, "quoted"' and rows[0].label == 1
    assert rows[1].source == S.EMPTY_SOURCE
    assert rows[2].url == "" and rows[2].text == ""
    assert len({r.doc_id for r in rows}) == 4


def test_contracts(spark, paths, tmp_path):
    with pytest.raises(ValueError):
        S.read_corpus(spark, {"train": paths["train"]})
    bad = tmp_path / "bad.csv"
    bad.write_text("url,label\nx,1\n")
    with pytest.raises(ValueError):
        S.read_split(spark, str(bad), "train")
    assert S.read_optional(spark, str(tmp_path / "none.csv"), S.RAW_SCHEMA).count() == 0


def test_footer_rewrite_is_versioned_and_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "x Redação ICL Com informações da BBC"), (2, "y")], "doc_id int, text string")
    base = str(tmp_path / "t")
    cleaned = L.clean_footer(df)
    path = S.write_version(cleaned.drop("changed"), cleaned.where("changed"), base, 1)
    again = L.clean_footer(spark.read.parquet(path))
    assert spark.read.parquet(path).orderBy("doc_id").first().text == "x"
    assert S.write_version(again.drop("changed"), again.where("changed"), base, 2) is None


def test_training_state(spark, tmp_path):
    p = tmp_path / "state.json"
    p.write_text(
        '{"best_model_checkpoint": "c-2", "log_history": [{"epoch": 0.5, "loss": 0.9},'
        ' {"epoch": 1.0, "eval_loss": 0.5, "eval_f1": 0.75}, {"epoch": 2.0, "eval_loss": 0.4, "eval_f1": 0.80},'
        ' {"epoch": 3.0, "eval_loss": 0.4, "eval_f1": 0.80}]}'
    )
    log = S.read_training_state(spark, str(p))
    assert log.first().best_model_checkpoint == "c-2"
    assert [(r.epoch, r.best) for r in learning_curve(log).orderBy("epoch").collect()] == [(1.0, 0), (2.0, 1), (3.0, 0)]
    assert loss_history(log).count() == 1


def test_partitioned_sink(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 3, "a").otherwise("b").alias("set_name"))
    S.write_table(df, str(tmp_path / "s"), partition_by=["set_name"])
    assert spark.read.parquet(str(tmp_path / "s")).where("set_name = 'a'").count() == 3
