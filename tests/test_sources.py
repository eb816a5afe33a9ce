import json
import struct
import zlib
from datetime import datetime

from pyspark.sql import functions as F

from figurant import __main__, schemas
from figurant.operators import spatial
from figurant.plans import models, views
from figurant.sources import readers, writers
from figurant.streaming import files


def png(width, height, gray):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + bytes(gray[y * width : (y + 1) * width]) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_and_pixels(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(png(3, 2, [0, 10, 20, 30, 40, 250]))
    (tmp_path / "bad.png").write_bytes(b"no image")
    f = readers.images(spark, str(tmp_path))
    got = {r.fig_id: r for r in f.collect()}
    assert (got["one"].width, got["one"].height, got["one"].error) == (3, 2, None) and got["bad"].error and got["bad"].width is None
    p = {(r.y, r.x): r.v for r in readers.gray_pixels(f).collect()}
    assert len(p) == 6 and p[(1, 2)] == 250 and p[(0, 0)] == 0
    assert readers.with_scale(f.where("error is null")).first().scaling_factor == 512.0


def test_dictionaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("NaOH\n\nK2CO3 Et3N\n")
    path = str(tmp_path / "a.txt")
    assert [r.value for r in readers.species_dictionary(spark, path).orderBy("position").collect()] == ["NaOH", "K2CO3 Et3N"]
    assert [r.value for r in readers.superatom_dictionary(spark, path).orderBy("position").collect()] == ["NaOH", "K2CO3", "Et3N"]


def test_json_export(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, "CC", 0, 1, 2, 3, ["a"]), (1, 1, None, 4, 5, 6, 7, [])], "fig_id long, panel_id int, smiles string, t int, l int, b int, r int, labels array<string>")
    out = writers.diagrams_json(d)
    assert json.loads(out.first().json) == [{"panel": [4, 5, 6, 7], "labels": []}, {"smiles": "CC", "panel": [0, 1, 2, 3], "labels": ["a"]}]
    writers.save_graphs(out, str(tmp_path / "o"))
    assert len(list((tmp_path / "o" / "fig_id=1").glob("*.txt"))) == 1


def test_models_keep_failed_rows(spark):
    class Half:
        def predict(self, batch):
            if (batch.panel_id > 1).any():
                raise RuntimeError("cannot")
            return batch.assign(smiles="C")

    rows = spark.createDataFrame([("f", 1, b""), ("f", 2, b"")], models.CONTRACTS["structure_recogniser"][0]).repartition(2, "panel_id")
    got = {r.panel_id: (r.smiles, r.error) for r in models.applied(rows, "structure_recogniser", Half).collect()}
    failed = (None, "RuntimeError: cannot")
    assert got == {1: ("C", None), 2: failed} or got == {1: failed, 2: failed}


def test_stream_equals_batch(spark, tmp_path):
    p = views.panels(spark, "/root/testdata/sf0.001").select("fig_id", "panel_id", "t", "l", "b", "r")
    p.repartition(3, "fig_id").write.parquet(str(tmp_path / "in"))
    args = (str(tmp_path / "in"), p.schema, spatial.drop_contained, str(tmp_path / "out"), str(tmp_path / "check"), 1)
    files.process(spark, *args).awaitTermination()
    files.process(spark, *args).awaitTermination()  # nothing is new
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spatial.drop_contained(p).collect()))


def test_session_groups(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    e = spark.createDataFrame([("a", t(0)), ("a", t(4)), ("a", t(20)), ("b", t(1))], "k string, ts timestamp")
    got = sorted((r.k, r.n) for r in files.session_groups(e, "ts", "k", "5 minutes", "1 hour").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_command(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    p = views.panels(spark, "/root/testdata/sf0.001").where(F.col("fig_id") < 40)
    p.write.parquet(str(tmp_path / "p"))
    __main__.main(["--panels", str(tmp_path / "p"), "--output-dir", str(tmp_path / "o")])
    done = spark.read.text(str(tmp_path / "o"))
    assert done.count() == p.where("role = 'arrow'").select("fig_id").distinct().count()
    assert all(set(json.loads(r.value)) == {"adjacency", "nodes", "is_incomplete"} for r in done.collect())


def test_command_gives_conditions_to_the_nearest_arrow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    rows = [
        ("f", 7, 100, 200, 110, 300, "arrow", 1.0, 0.0, 100.0),
        ("f", 1, 80, 50, 130, 150, "diagram", None, None, None),
        ("f", 2, 80, 350, 130, 450, "diagram", None, None, None),
        ("f", 3, 85, 220, 95, 280, "conditions", None, None, None),
    ]
    schema = "fig_id string, panel_id int, t int, l int, b int, r int, role string, dir_x double, dir_y double, long_side double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "p"))
    __main__.main(["--panels", str(tmp_path / "p"), "--output-dir", str(tmp_path / "o")])
    (done,) = spark.read.text(str(tmp_path / "o")).collect()
    assert "C:3" in json.loads(done.value)["nodes"]


def test_schemas(spark):
    of = lambda ddl: spark.createDataFrame([], ddl).schema
    assert of(schemas.CONDITIONS)["yield"].dataType.elementType.names == ["value_num", "value_text", "units"]
    for ddl in (schemas.FIGURES, schemas.PANELS, schemas.DETECTIONS, schemas.CLASS_SCORES, schemas.LABELS, schemas.STEPS, schemas.OCR_TREE, schemas.GRAPH):
        assert len(of(ddl)) > 1
