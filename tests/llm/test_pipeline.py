"""The stages together, the registration, and their independence from the rest."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    for n in range(1, 14):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_stages_work_on_what_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    named = dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.written(named["quality_rules"](spark, docs, SF), "t")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert good.columns == columns and 0 < good.count() < before
    bad = good.join(labels.where("quality = 0"), "doc_id").count()
    assert bad <= 0.1 * labels.where("quality = 0").count()
    single = corpus_pipeline.written(named["near_dedup"](spark, good, SF), "t")
    assert single.columns == columns and single.count() <= good.count()
    assert single.groupBy("text").count().where("count > 1").count() == 0
    cut = corpus_pipeline.written(named["substring_dedup"](spark, single, SF), "t")
    assert cut.columns == columns and cut.where(F.length("text") != F.col("n_chars")).count() == 0
    clean = corpus_pipeline.written(named["decontamination"](spark, cut, SF), "t")
    assert clean.columns == columns and 0 < clean.count() <= cut.count()
    last = corpus_pipeline.written(named["segmentation"](spark, clean, SF), "t")
    assert last.where("rank = 0").count() == clean.count() and last.where("NOT round_trip").count() == 0
    assert last.where("size(ids) <> n_pieces").count() == 0


def test_rest_imports_without_this_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("rollcall", "__spark_entry__.py"):
        os.symlink(f"{root}/{name}", tmp_path / name)
    code = ("import sys; sys.modules['rollcall.llm'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                          env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
