import json
import zipfile

from pyspark.sql import functions as F

from curata.sources import archives, documents, headers
from curata.sources import manifests as src
from curata.streaming import dedup as stream


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("path,label,generator,source,extra\n./a\\b.png,1,,x,9\n/abs/c.png,0,g,,8\n")
    rows = src.read_manifest(spark, str(tmp_path / "m.csv"), src.MANIFEST, root="data").collect()
    assert [(r["path"], r["label"], r["generator"], r["source"]) for r in rows] == [("data/a/b.png", 1, "", "x"), ("/abs/c.png", 0, "g", "")]
    src.write_manifest(spark.createDataFrame(rows), str(tmp_path / "out"), src.MANIFEST)
    assert src.read_manifest(spark, str(tmp_path / "out"), src.MANIFEST).count() == 2


def test_splits_files_and_lines(spark, tmp_path):
    for s in ("train", "test"):
        (tmp_path / f"c_{s}.csv").write_text(f"path,orig,label,generator,source,long\n{s},o,0,,s,5\n")
    assert {r["split"] for r in src.read_splits(spark, str(tmp_path / "c")).collect()} == {"train", "test"}
    (tmp_path / "drop.txt").write_text("a\n\n b \n")
    assert [r["path"] for r in src.read_lines(spark, str(tmp_path / "drop.txt")).collect()] == ["a", "b"]
    (tmp_path / "pics/real").mkdir(parents=True)
    for n in ("a.PNG", ".b.png", "c.txt"):
        (tmp_path / "pics/real" / n).write_bytes(b"x")
    found = src.folder_label(src.read_files(spark, str(tmp_path / "pics")), "pics", ["real"]).collect()
    assert [(r["folder"], r["label"], r["length"]) for r in found] == [("real", 0, 1)]


def test_results_and_scores(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"model": "m", "conditions": {"clean": {"auroc": 0.9}}}))
    assert documents.read_results(spark, str(tmp_path / "r.json")).collect()[0]["value"] == 0.9
    wide = spark.createDataFrame([("p", 0.5, 0.25)], "path string, score_clean double, `score_blur_s0.5` double")
    assert {(r["cond"], r["score"]) for r in src.long_scores(wide, ["path"]).collect()} == {("clean", 0.5), ("blur_s0.5", 0.25)}
    assert "| n/a |" in src.markdown(spark.createDataFrame([(None,)], "x double"))


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.png", b"one")
        z.writestr("x/2.txt", b"two")
    rows = archives.read_zip(spark, str(tmp_path / "a.zip"), suffixes=(".png",))
    assert [(r["member"], bytes(r["content"])) for r in rows.collect()] == [("x/1.png", b"one")]
    hit, missing = archives.wanted(rows, spark.createDataFrame([("x/1.png",), ("y",)], "path string"))
    assert hit.count() == 1 and missing.collect()[0]["path"] == "y"


def test_stream_continues(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    rows.where("v != 'c'").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: stream.ingest(spark, str(tmp_path / "in"), rows.schema, "id", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    assert headers._header(png) == ("PNG", 7, 9) and headers._header(None) == (None, None, None)
    assert headers._header(b"GIF89a\x05\0\x06\0") == ("GIF", 5, 6) and headers._header(b"\xff\xd8\xff") == ("JPEG", None, None)


def test_score_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("label,score\n1,0.5\n0,\n")
    assert [tuple(r) for r in src.read_scores(spark, str(tmp_path / "s.csv")).select("label", "score", "model").collect()] == [(1, 0.5, ""), (0, None, "")]


def test_folders_of_files(spark, tmp_path):
    for name in ("real/x/1.png", "real/2.jpg", "real/3.png", "gan/4.png", "gan/.hidden.png", "gan/5.txt"):
        (tmp_path / "set" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / name).write_bytes(b"\xff\xd8\xff" + name.encode())
    files = src.read_files(spark, str(tmp_path / "set"))
    got = src.folder_sample(files, str(tmp_path / "set"), ["real"], 2, 0)
    assert sorted((r["folder"], r["label"]) for r in got.collect()) == [("gan", 1), ("real", 0), ("real", 0)]
    grouped = src.group_label(files, {"gan": 1, "x": 0}).select("group", "label").collect()
    assert sorted(map(tuple, grouped)) == [("gan", 1), ("x", 0)]
    rows = spark.createDataFrame([("a", bytearray(b"\xff\xd8\xff1234567890")), ("b", bytearray(b"RIFF1234WEBPxx")), ("c", bytearray(b"\x89PNG"))], "stem string, content binary")
    assert [r["name"] for r in src.original_names(rows).orderBy("stem").collect()] == ["a.jpg", "b.webp", "c.png"]
    (tmp_path / "m" / "A").mkdir(parents=True)
    (tmp_path / "m" / "A" / "metadata.csv").write_text("image_path,target\nx.png,0\n")
    meta = src.read_metadata(spark, str(tmp_path / "m" / "*" / "metadata.csv")).first()
    assert meta["image_path"].endswith("/m/A/x.png") and (meta["target"], meta["category"]) == ("0", "")


def test_manifests_in_order_and_sinks(spark, tmp_path):
    for name, text in (("a", "path,orig,label,long\np,o,1,9\n"), ("b", "path,orig,label,long\nq,o,0,8\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    rows = src.read_manifests(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["path"], r["src_ord"]) for r in rows.collect()) == [("p", 0), ("q", 1)]
    src.write_splits(rows.withColumn("split", F.lit("train")), str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).where("split = 'train'").count() == 2
    src.write_scores(spark.createDataFrame([("p", "clean", 0.5)], "path string, cond string, score double"), str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).first()["cond"] == "clean"
    src.write_json(rows.select("path"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    src.write_lines(rows.union(rows), "orig", str(tmp_path / "lines"))
    assert [r["path"] for r in src.read_lines(spark, str(tmp_path / "lines")).collect()] == ["o"]
    many = spark.range(400).select(F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("orig"), (F.col("id") >= 200).cast("int").alias("label"))
    src.write_manifest(many, str(tmp_path / "many"))
    labels = [r["label"] for r in src.read_manifest(spark, str(tmp_path / "many")).collect()]
    assert labels != sorted(labels) and sum(labels) == 200
    assert src.console(spark.createDataFrame([("a", 0.5), ("bcd", None)], "k string, v double"), 1) == "k    v\na    0.5\nbcd  n/a"


def test_columns_of_images(spark):
    rows = spark.createDataFrame([((bytearray(b"1"), "n"),)], "Image struct<bytes: binary, path: string>")
    assert rows.select(src.image_bytes(rows).alias("c")).first()["c"] == b"1"
    rows = spark.createDataFrame([([bytearray(b"2")],)], "images array<binary>")
    assert rows.select(src.image_bytes(rows).alias("c")).first()["c"] == b"2"


def test_extracted_members_are_skipped(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{k}.png", b"x" * k)
    members = archives.read_zip(spark, str(tmp_path / "z.zip"), (".png",))
    done = members.where("member = '1.png'")
    assert sorted(r["member"] for r in archives.not_yet(members, done).collect()) == ["0.png", "2.png"]
