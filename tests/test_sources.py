import json

from pyspark.sql import functions as F

from meristem import sources, streaming


def test_gtf(spark, tmp_path):
    f = tmp_path / "g.gtf"
    f.write_text('#!x\nchr1\tsrc\tgene\t5\t9\t.\t+\t.\tgene_id "E1"; gene_name "AB"; gene_type "rna";\nchr1\tsrc\texon\t5\t6\t.\t+\t.\tgene_id "E1";\nchr2\tsrc\tgene\t1\t2\t.\t-\t.\tgene_id "E2";\n')
    got = sources.read_gtf(spark, str(f)).orderBy("start").collect()
    assert [(r.chr, r.start, r.gene_name, r.gene_id) for r in got] == [("chr2", 1, None, "E2"), ("chr1", 5, "AB", "E1")]


def test_homology_last_wins(spark):
    rows = spark.createDataFrame([(1, "mouse, laboratory", "Ab", 0), (1, "human", "AB", 1), (1, "human", "AB2", 2), (2, "human", "C", 3)], "key int, species string, symbol string, n int")
    assert {(r.key, r.mouse, r.human) for r in sources.homology(rows, "n").collect()} == {(1, "Ab", "AB2"), (2, None, "C")}


def test_structure_tree(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text(json.dumps({"msg": [{"id": 1, "st_level": 0, "name": "root", "children": [{"id": 2, "st_level": 1, "name": "a", "children": []}]}]}))
    assert {(r.id, r.parent, r.level) for r in sources.read_structure_tree(spark, str(f)).collect()} == {(1, None, 0), (2, 1, 1)}


def test_ply_and_pixels(spark, tmp_path):
    f = tmp_path / "p.ply"
    f.write_text("ply\nformat ascii 1.0\nelement vertex 2\nend_header\n1.0 2.0 3.5\n-1 0 2e1 255 0 0\n")
    p = sources.read_ply(spark, str(f))
    assert {(r.x, r.y, r.z) for r in p.collect()} == {(1.0, 2.0, 3.5), (-1.0, 0.0, 20.0)}
    assert sources.image_pixels(p, 2.0).where("x = 1").first()["pixel_y"] == 4


def test_metadata_upsert(spark):
    t = sources.with_metadata(sources.with_metadata(spark.range(1), "lib", {"a": "1"}), "lib", {"a": "2", "b": "3"})
    assert t.first()["metadata"] == {"lib.a": "2", "lib.b": "3"}


def test_stream_equals_table(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = streaming.to_memory(streaming.windowed_counts(stream), "win", str(tmp_path / "cp"))
    want = streaming.windowed_counts(e)
    assert got.exceptAll(want.withColumn("total", F.col("total"))).select("start", "event_type", "n").exceptAll(want.select("start", "event_type", "n")).isEmpty() and got.count() == want.count()
