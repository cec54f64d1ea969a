"""Layers on disk."""

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from pixelweave.sources import slides


def test_a_layer_of_a_slide_is_one_file_a_band(spark, tmp_path):
    path = str(tmp_path / "layers")
    rows = [(s, y, x, n) for s in range(3) for n in ("cap", "vessel") for y in (0, 7, 300, 1023) for x in range(5)] + [(2, 3000, 9, "cap")]
    m = spark.createDataFrame(rows, "slide int, y int, x int, layer string")
    slides.write_layer(m.repartition(16), path)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    first = files()
    n = Counter(str(Path(f).parent.relative_to(path)) for f in first)
    assert set(n) == {f"slide={s}/layer={k}" for s in range(3) for k in ("cap", "vessel")}
    assert n.pop("slide=2/layer=cap") <= 2 and set(n.values()) == {1}
    assert sorted(map(tuple, slides.read_layer(spark, path).select("slide", "y", "x", "layer").collect())) == sorted(rows)
    # One layer of one slide again: the files of the others stay.
    slides.write_layer(m.where("slide = 1 AND layer = 'cap'").withColumn("x", F.col("x") + 100), path)
    assert {f for f in first if "slide=1/layer=cap" not in f} == first.keys() & files().keys()
    assert sorted(r.x for r in slides.read_layer(spark, path, slide=1, layer="cap").where("y = 0").collect()) == [100, 101, 102, 103, 104]
    assert slides.read_layer(spark, path).count() == len(rows)
