"""A stream of pictures: stopped between batches, broken within one, and started again, each file is there once."""

import json
import os

import numpy as np
import pytest

from maskwork.operators import images as I
from maskwork.streaming.pictures import redact_picture_stream


def test_stream_survives(spark, tmp_path):
    here, out, checkpoint, flag = (str(tmp_path / x) for x in ("in", "out", "checkpoint", "broken"))
    os.makedirs(here)

    def put(name, shade):
        with open(f"{here}/{name}.png", "wb") as f:
            f.write(I.encode_png(np.full((40, 200, 3), shade, np.uint8)))

    def load():
        def read(image):
            if image[0, 0, 0] == 77 and os.path.exists(flag):
                raise RuntimeError("broken off")
            return [{"text": f"mail a{image[0, 0, 0]}@b.org", "score": 0.9, "x0": 10, "y0": 10, "x1": 190, "y1": 30}] if image.shape[1] > image.shape[0] else []

        return read

    def run():
        query = redact_picture_stream(spark, here, out, checkpoint, load, categories=["custom"], custom_terms=["a77@b.org", "a100@b.org"], files_per_batch=1)
        query.awaitTermination(120)
        return query

    put("a", 100)
    open(flag, "w").close()
    run()
    put("b", 77)
    with pytest.raises(Exception, match="broken off"):
        run()
    assert spark.read.parquet(out).count() == 1
    os.remove(flag)
    with open(f"{here}/c.png", "wb") as f:
        f.write(b"no picture")
    run()
    run()  # there is nothing more to do
    rows = {os.path.basename(r["path"]): r for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == ["a.png", "b.png", "c.png"] and spark.read.parquet(out).count() == 3
    assert [json.loads(rows[n]["report"])["count"] for n in sorted(rows)] == [1, 1, 0] and rows["c.png"]["png"] is None
    image = I.decode_png(bytes(rows["b.png"]["png"]))
    assert not image[20, 90:180].any() and (image[20, 10:60] == 77).all() and len(os.listdir(out)) >= 3
