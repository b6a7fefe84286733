import json
import os
import struct

import pytest

from arbordoc.sources import pack as pk
from arbordoc.sources import trees as src
from arbordoc.streaming import ingest
from trees import frame, listing, paragraph, tree

TINY = tree([paragraph("first"), listing("a", "b")], [[[0], [2]]])


def big(n=300):
    return tree([paragraph(f"block {k} " + os.urandom(400).hex()) for k in range(n)], [[[k * 10], [k * 10 + 10]] for k in range(n // 10)])


def test_layout():
    data = pk.pack(json.loads(json.dumps(TINY)))
    assert data[:12] == bytes([0x89, 0x53, 0x44, 0x54, 0x0D, 0x0A, 0x1A, 0x0A, 1, 1, 2, 0])
    assert struct.unpack_from("<I", data, 12)[0] == 8 + 8 * 2
    opened = pk.Pack.of_bytes(data)
    assert opened.tree() == TINY and opened.block_count() == 2 and opened._starts == [0, 2]
    assert opened.block([1, 0, 0]) == {"text": "a"} and opened.block([1, 9]) is None and opened.block("x") is None and opened.block([]) is None
    assert opened.blocks(1, 0) == [] and len(opened.blocks(-5, 99)) == 2 and len(opened.page_blocks(0)) == 2 and opened.page_blocks(3) == []


def test_bounded_reads():
    data = pk.pack(big())
    reads = []

    def read(offset, length):
        reads.append((offset, length))
        return data[offset : offset + length]

    opened = pk.Pack(len(data), read)
    assert reads == [(0, 65536)] and len(data) > 65536
    for ask in (opened.metadata, opened.metadata, opened.catalog, lambda: opened.block([250]), lambda: opened.page_blocks(20), lambda: opened.tree()):
        before = len(reads)
        ask()
        assert len(reads) - before <= 1
    assert not any(length == len(data) for _, length in reads)


def test_oversized_empty_destructive():
    t = tree([paragraph("x"), paragraph("y" * 70_000), paragraph("z")])
    opened = pk.Pack.of_bytes(pk.pack(t))
    assert opened._starts == [0, 1, 2, 3] and opened.tree() == t
    empty = tree([])
    assert pk.Pack.of_bytes(pk.pack(empty)).tree() == empty
    spent = json.loads(json.dumps(TINY))
    pk.pack(spent, destructive=True)
    assert spent["content"] == [None, None]


@pytest.mark.parametrize("at, value", [(0, b"\0"), (8, b"\2"), (12, b"\0\0\0\0"), (12, b"\xff\xff\xff\0"), (24, b"\1\0\0\0"), (16, b"\xff\xff\xff\xff")])
def test_corruption(at, value):
    data = bytearray(pk.pack(json.loads(json.dumps(TINY))))
    data[at : at + len(value)] = value
    with pytest.raises((pk.PackError, Exception)):
        pk.Pack.of_bytes(bytes(data)).tree()
    with pytest.raises(pk.PackError):
        pk.Pack.of_bytes(b"short")


@pytest.mark.parametrize("path", ["schemaVersion", "metadata", "catalog", "content"])
def test_validation(path):
    with pytest.raises(TypeError, match=path):
        pk.pack({k: v for k, v in TINY.items() if k != path})


def test_columns_and_source(spark, tmp_path):
    df = frame(spark, {"a": TINY, "b": big(120), "c": {"content": []}})
    packed = pk.pack_trees(df).cache()
    assert packed.where("doc_id = 'c'").first().error.startswith("TypeError")
    back = {r.doc_id: json.loads(r.tree) for r in pk.unpack_trees(packed.where("error IS NULL")).collect()}
    assert back["a"] == TINY
    bad = pk.unpack_trees(spark.createDataFrame([("x", bytearray(b"junk")), ("y", None)], "doc_id string, pack binary")).collect()
    assert bad[0].error and bad[0].tree is None and bad[1].tree is None
    pk.register(spark)
    folder = str(tmp_path / "packs")
    df.where("doc_id <> 'c'").write.format("treepack").mode("append").option("path", folder).save()
    blocks = spark.read.format("treepack").option("path", folder).load()
    assert blocks.count() == 122
    some = blocks.where("doc_id = 'b' AND block_index >= 100 AND block_index < 103").orderBy("block_index").collect()
    assert [r.block_index for r in some] == [100, 101, 102] and json.loads(some[0].block)["content"][0]["text"].startswith("block 100 ")
    meta = spark.read.format("treepack").option("path", folder).option("section", "metadata").load().orderBy("doc_id").collect()
    assert [(m.doc_id, m.block_count) for m in meta] == [("a", 2), ("b", 120)]
    assert pk.read_packs(spark, folder).count() == 2
    for _ in range(2):
        ingest.write_tables(ingest.arriving_packs(spark, folder), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 2


def test_writes_appear_whole(spark, tmp_path):
    pk.register(spark)
    folder = "file://" + str(tmp_path / "packs")
    df = frame(spark, {f"d{k}": tree([paragraph(f"text {k}")]) for k in range(30)}).repartition(4)
    write = lambda d, mode: d.write.format("treepack").mode(mode).option("path", folder).save()
    write(df, "append")
    read = lambda **o: spark.read.format("treepack").options(path=folder, **o).load()
    assert read().count() == 30 and sorted(os.listdir(tmp_path / "packs"))[0].startswith("part-")
    assert read().rdd.getNumPartitions() == 1 and read(partition_bytes="1").rdd.getNumPartitions() == 30
    # a write in which one document cannot be packed leaves nothing behind
    bad = df.unionByName(spark.createDataFrame([("bad", "{")], "doc_id string, tree string"))
    with pytest.raises(Exception):
        write(bad, "append")
    assert read().count() == 30 and not [n for n in os.listdir(tmp_path / "packs") if not n.startswith("part-")]
    write(df.limit(3), "overwrite")
    assert read().count() == 3 and pk.read_packs(spark, folder).count() == 3


def test_json_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/one.json").write_text(json.dumps(TINY))
    read = src.read_json_trees(spark, str(tmp_path / "j"))
    assert read.first().doc_id == "one" and src.flatten(read, "documents").first().block_count == 2
    stream = ingest.arriving_trees(spark, str(tmp_path / "j"))
    ingest.write_tables(stream, str(tmp_path / "o"), str(tmp_path / "c"), ("pages",)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o/pages")).count() == 1
    (tmp_path / "l.jsonl").write_text(json.dumps({"doc_id": "x", **TINY}) + "\n")
    assert src.read_json_lines(spark, str(tmp_path / "l.jsonl")).first().doc_id == "x"
