"""Engines from model files: one load in each worker process over many tasks, and none where there is no file."""

import glob
import os
import warnings

import pytest

from maskwork.operators.entities import run_model
from maskwork.operators.models import model_loader
from maskwork.operators.screens import read_lines

FOLDER = "/tmp/maskwork-model-loads"


def build(path):
    """An engine that notes in which process it was made, and tags every text with what the file says."""
    with open(path) as f:
        word = f.read()
    folder = f"{FOLDER}-{word}"
    os.makedirs(folder, exist_ok=True)
    n = len(glob.glob(f"{folder}/{os.getpid()}-*"))
    open(f"{folder}/{os.getpid()}-{n}", "w").close()
    return lambda texts: [[{"index": 1, "entity": "B-PERSON", "word": word, "score": 1.0, "start": os.getpid() % 1000, "end": 9}] for _ in texts]


def test_one_load_in_each_worker(spark, tmp_path):
    word = f"w{os.getpid()}"
    (tmp_path / "model.bin").write_text(word)
    docs = spark.range(60).selectExpr("id", "'x' AS text")
    for _ in range(2):
        load = model_loader(spark, str(tmp_path / "model.bin"), build)
        got = run_model(docs.repartition(20), load, "id").collect()
        assert len(got) == 60 and {r["word"] for r in got} == {word}
    made = [os.path.basename(f).split("-")[0] for f in glob.glob(f"{FOLDER}-{word}/*")]
    assert 1 <= len(made) <= 8 and len(made) == len(set(made)), made  # at least 40 tasks ran
    (tmp_path / "model.bin").write_text(word + "b")  # another file under the same path is another engine
    got = run_model(docs, model_loader(spark, str(tmp_path / "model.bin"), build), "id").collect()
    assert {r["word"] for r in got} == {word + "b"}


def test_no_file_no_rows(spark):
    docs = spark.range(3).selectExpr("id", "'x' AS text")
    with pytest.warns(UserWarning, match="no model"):
        load = model_loader(spark, "/nowhere/model.bin", build)
    assert load is None and run_model(docs, load, "id").count() == 0
    images = spark.createDataFrame([(1, 1, 1, bytearray(b"\x00\x00\x00"))], "id int, width int, height int, data binary")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert read_lines(images, load, "id").count() == 0
