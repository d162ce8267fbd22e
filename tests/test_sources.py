import json
import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from blockloom.sources import files
from blockloom.sources.named import Sources


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "a" / "one.json").write_text(json.dumps([{"id": 1, "text": "x"}, {"id": 2, "text": "y"}]))
    (tmp_path / "b" / "two.jsonl").write_text('{"id": 3, "text": "z", "more": 1}\n{"id": 4, "text": "w"}\n')
    (tmp_path / "b" / "c" / "three.csv").write_text("id,text\n5,v\n")
    (tmp_path / "b" / "note.txt").write_text("ignored")
    return tmp_path


def test_formats(spark, tree):
    assert rows(files.read_file(spark, str(tree / "a/one.json"))) == [(1, "x"), (2, "y")]
    assert rows(files.read_file(spark, str(tree / "b/two.jsonl")).select("id")) == [(3,), (4,)]
    assert rows(files.read_file(spark, str(tree / "b/c/three.csv"))) == [(5, "v")]
    upper = tree / "UP.JSON"
    upper.write_text('{"id": 9}')
    assert rows(files.read_file(spark, str(upper))) == [(9,)]


def test_unknown_format_and_missing_file(spark, tree):
    with pytest.raises(ValueError):
        files.read_file(spark, str(tree / "b/note.txt"))
    with pytest.raises(FileNotFoundError):
        files.read_file(spark, str(tree / "gone.csv"))
    with pytest.raises(FileNotFoundError):
        files.read_tree(spark, str(tree / "gone"))


def test_tree_takes_the_first_files_columns(spark, tree):
    got = files.read_tree(spark, str(tree))
    assert got.columns == ["id", "text"]
    assert [r[0] for r in rows(got.select(F.col("id").cast("long")))] == [1, 2, 3, 4, 5]
    (tree / "z.jsonl").write_text('{"id": 6}\n')
    assert files.read_tree(spark, str(tree)).count() == 6
    (tree / "b" / "c" / "three.csv").write_text("id\n5\n")
    with pytest.raises(ValueError):
        files.read_tree(spark, str(tree), strict=True)


def test_source_kinds(spark, tree):
    assert files.read_source(spark, "local", str(tree)).count() == 5
    assert files.read_source(spark, "custom", lambda s: s.range(3)).count() == 3
    with pytest.raises(ValueError):
        files.read_source(spark, "ftp", "x")


def test_inventory_and_sidecars(spark, tree):
    (tree / "a" / "one.json.metadata").write_text(
        json.dumps({"created_at": "2020-01-01T00:00:00", "storage_class": "archive"})
    )
    joined = files.with_sidecars(files.inventory(spark, str(tree)), files.read_sidecars(spark, str(tree)))
    got = {r["name"]: r for r in joined.collect()}
    assert set(got) == {"one.json", "two.jsonl", "three.csv", "note.txt"}
    assert got["one.json"]["storage_class"] == "archive" and got["one.json"]["created_at"].year == 2020
    assert got["note.txt"]["storage_class"] == "local" and got["note.txt"]["size"] == len("ignored")


def test_directory_hash_follows_content(spark, tree):
    def hashes():
        return {os.path.basename(r["dir"]): r["hash"] for r in files.directory_hash(spark, str(tree)).collect()}

    before = hashes()
    assert hashes() == before and len(set(before.values())) == len(before)
    (tree / "b" / "c" / "three.csv").write_text("id,text\n5,changed\n")
    after = hashes()
    assert {k for k in before if before[k] != after[k]} == {"c"}


def test_directory_hash_reads_files_in_blocks(spark, tmp_path):
    """Every byte and its place count, whatever the blocks; no task reads a file of several blocks whole."""
    rng = random.Random(5)
    content = bytearray(rng.randbytes(300_000))
    variants = {"same": content, "more": content + b"\n", "bom": b"\xef\xbb\xbf" + content, "zeros": bytes(1000), "fewer": bytes(999)}
    lines = bytes(content).split(b"\n")
    variants["swapped"] = b"\n".join([*lines[:-2], lines[-1], lines[-2]])
    variants["cr"] = bytes(content).replace(b"\r", b"\n")
    variants |= {"feed": b"\n", "feeds": b"\n\n", "late": b"a\n\n", "early": b"\na\n", "packed": b"no gzip"}
    for name, body in {**variants, "again": content}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / ("part.gz" if name == "packed" else "part.bin")).write_bytes(body)

    def hashes():
        return {os.path.basename(r["dir"]): r["hash"] for r in files.directory_hash(spark, str(tmp_path)).collect()}

    whole = hashes()
    assert whole["again"] == whole["same"] and len(whole) == len(variants) + 1 and len(set(whole.values())) == len(variants)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert hashes() == whole
        assert files._runs(spark, str(tmp_path / "same")).rdd.getNumPartitions() >= 15
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_zones(spark):
    df = spark.createDataFrame([("x/raw/sensors/a",), ("raw/external/b",), ("x/models/artifacts/c",)], "path string")
    assert files.in_zone(df, "raw").count() == 2 and files.in_zone(df, "raw", "sensors").count() == 1
    for zone in (("junk", None), ("raw", "features")):
        with pytest.raises(ValueError):
            files.in_zone(df, *zone)


def test_table_sizes(spark, tree):
    got = dict((r[0], r[1:]) for r in rows(files.table_sizes(files.inventory(spark, str(tree)))))
    assert got["note"] == (7, 1)


def test_named_sources(spark):
    known = Sources()
    known.register("numbers", lambda s, n=3: s.range(n), lambda df: df["id"] < 5)
    assert known.fetch("numbers", spark, n=4).count() == 4
    with pytest.raises(ValueError):
        known.fetch("numbers", spark, n=9)
    with pytest.raises(ValueError):
        known.fetch("letters", spark)
    known.as_views(spark)
    assert spark.sql("select count(*) from numbers").first()[0] == 3


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,key\na,1\n")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "key int, name string, more double")
    assert [tuple(r) for r in got.collect()] == [(1, "a", None)]
    (tmp_path / "b.CSV").write_text("key,name\n2,b\n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.csv").write_text("more,name,key\n5,c,3\n6,d,4\n")
    for schema in (None, "key int, name string"):
        got = files.read_tree(spark, str(tmp_path), schema, strict=True)
        assert sorted(r["name"] + str(r["key"]) for r in got.collect()) == ["a1", "b2", "c3", "d4"]
    (tmp_path / "d.csv").write_text("name\ne\n")
    got = files.read_tree(spark, str(tmp_path), "key int, name string")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")]
    with pytest.raises(ValueError, match="key"):
        files.read_tree(spark, str(tmp_path), "key int, name string", strict=True)


def test_strict_trees_check_every_record(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key":1,"name":"a"}\n\n{"name":null,"key":2,"more":[]}\n')
    (tmp_path / "b.json").write_text('[{"key":3,"name":"c"},\n {"key":4,"name":"d"}]')
    (tmp_path / "c.json").write_text('{"key":5,\n"name":"e"}')
    schema = "key int, name string"
    assert files.read_tree(spark, str(tmp_path), schema, strict=True).count() == 5
    for name, text in (("d.jsonl", '{"key":6}'), ("d.jsonl", "[1]"), ("d.jsonl", '{"key":'), ("e.json", '[{"key":6,"name":"f"},{"name":"g"}]'), ("e.json", "3")):
        folder = tmp_path.parent / f"{tmp_path.name}-{name}-{len(text)}"
        folder.mkdir()
        (folder / name).write_text(text)
        (folder / "a.jsonl").write_text('{"key":1,"name":"a"}\n')
        with pytest.raises(ValueError):
            files.read_tree(spark, str(folder), schema, strict=True)
        files.read_tree(spark, str(folder), schema)


def test_tree_reads_suffixes_of_any_case(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,key\na,1\n")
    (tmp_path / "b.CSV").write_text("name,key\nb,2\n")
    got = files.read_tree(spark, str(tmp_path), "key int, name string")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b")]
