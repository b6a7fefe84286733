"""Packs: one document in a compact binary container, read in parts.

A pack is header, index, metadata, catalog, and chunks of top-level blocks, each part deflated by itself.
Reading touches the front of the file once and then only the sections and chunks that are asked for.
"""

from __future__ import annotations

import json
import logging
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Fixed values of the format.
MAGIC = bytes([0x89, 0x53, 0x44, 0x54, 0x0D, 0x0A, 0x1A, 0x0A])
VERSION = 1
HEADER = 16
FRONT = 64 * 1024
CHUNK = 32 * 1024
LARGE_BLOCK = 64 * 1024
MOST_BYTES = 0xFFFFFFFF

log = logging.getLogger(__name__)


class PackError(ValueError):
    """Bytes that are no valid pack, or a document that cannot be one."""


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(wbits=-15)
    return c.compress(data) + c.flush()


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data, wbits=-15)


def _json(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")


def validate(tree) -> None:
    """Raises TypeError, naming the field, for a document that cannot be packed."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise TypeError(f"invalid {what}")

    need(isinstance(tree, dict), "document")
    need(isinstance(tree.get("schemaVersion"), str) and re.fullmatch(r"\d+\.\d+\.\d+", tree["schemaVersion"]) is not None, "schemaVersion")
    meta = tree.get("metadata")
    need(isinstance(meta, dict), "metadata")
    processor = meta.get("processor")
    need(isinstance(processor, dict), "metadata.processor")
    need(isinstance(processor.get("type"), str) and processor["type"] != "", "metadata.processor.type")
    need(isinstance(processor.get("version"), int), "metadata.processor.version")
    need(isinstance(meta.get("dateCreated"), str) and meta["dateCreated"] != "", "metadata.dateCreated")
    source = meta.get("source")
    need(isinstance(source, dict), "metadata.source")
    need(isinstance(source.get("contentType"), str) and source["contentType"] != "", "metadata.source.contentType")
    need(isinstance(source.get("hash"), str) and re.fullmatch(r"[0-9a-f]{32}", source["hash"]) is not None, "metadata.source.hash")
    need(isinstance(tree.get("catalog"), dict), "catalog")
    need(isinstance(tree.get("content"), list), "content")


def encode_chunk(blocks: list[bytes]) -> bytes:
    offsets, at = [], 0
    for b in blocks:
        offsets.append(at)
        at += len(b)
    return struct.pack(f"<{len(blocks)}I", *offsets) + b"".join(blocks)


def block_of_chunk(chunk: bytes, count: int, k: int) -> bytes:
    if not 0 <= k < count:
        raise IndexError(f"no block {k} in the chunk")
    head = 4 * count
    if len(chunk) < head:
        raise PackError("invalid offset table of a chunk")
    start = struct.unpack_from("<I", chunk, 4 * k)[0]
    end = struct.unpack_from("<I", chunk, 4 * (k + 1))[0] if k + 1 < count else len(chunk) - head
    if start > end or head + end > len(chunk):
        raise PackError("invalid block range of a chunk")
    return chunk[head + start : head + end]


def pack(tree: dict, deflate: Callable[[bytes], bytes] = deflate, destructive: bool = False) -> bytes:
    """A document as a pack.  Chunks are filled while they stay within 32 KiB of block JSON; a larger block is one by itself.

    ``destructive`` gives the document's blocks free as they are written.
    """
    validate(tree)
    meta, catalog = deflate(_json(tree["metadata"])), deflate(_json(tree["catalog"]))
    chunks: list[bytes] = []
    starts = [0]
    waiting: list[bytes] = []
    size = large = 0
    content = tree["content"]

    def flush() -> None:
        nonlocal size
        if waiting:
            chunks.append(deflate(encode_chunk(waiting)))
            starts.append(starts[-1] + len(waiting))
            waiting.clear()
            size = 0

    for k, block in enumerate(content):
        raw = _json(block)
        if destructive:
            content[k] = None
        large += len(raw) > LARGE_BLOCK
        if size + len(raw) > CHUNK:
            flush()
        waiting.append(raw)
        size += len(raw)
        if size > CHUNK:
            flush()
    flush()
    if large:
        log.warning("%d oversized blocks are chunks by themselves", large)
    offsets = [0]
    for c in chunks:
        offsets.append(offsets[-1] + len(c))
    index = struct.pack(f"<2I{len(offsets)}I{len(starts)}I", len(meta), len(catalog), *offsets, *starts)
    version = [int(x) for x in tree["schemaVersion"].split(".")]
    if any(v > 255 for v in version):
        raise PackError("invalid schema version")
    out = MAGIC + bytes([VERSION, *version]) + struct.pack("<I", len(index)) + index + meta + catalog + b"".join(chunks)
    if len(out) > MOST_BYTES:
        raise PackError("the pack is too large")
    return out


class Pack:
    """A reader of one pack over ``read(offset, length)``; it reads its front once and keeps metadata and catalog."""

    def __init__(self, size: int, read: Callable[[int, int], bytes], inflate: Callable[[bytes], bytes] = inflate):
        self.size, self._source, self._inflate = size, read, inflate
        if size < HEADER:
            raise PackError("the file is too small")
        self._front = self._exactly(0, min(size, FRONT))
        if self._front[:8] != MAGIC:
            raise PackError("invalid magic")
        if self._front[8] != VERSION:
            raise PackError(f"unsupported version {self._front[8]}")
        self.schema_version = ".".join(str(b) for b in self._front[9:12])
        length = struct.unpack_from("<I", self._front, 12)[0]
        if length < 16 or (length - 8) % 8:
            raise PackError("invalid index length")
        if HEADER + length > size:
            raise PackError("the index exceeds the file")
        index = self._range(HEADER, length)
        n = (length - 8) // 8
        meta, catalog, *rest = struct.unpack(f"<2I{2 * n}I", index)
        self._offsets, self._starts = rest[:n], rest[n:]
        if not meta or not catalog:
            raise PackError("invalid section length")
        if self._offsets[0] or self._starts[0]:
            raise PackError("invalid first chunk")
        if any(a >= b for values in (self._offsets, self._starts) for a, b in zip(values, values[1:])):
            raise PackError("chunks are not in ascending order")
        self._meta_at, self._meta_length, self._catalog_length = HEADER + length, meta, catalog
        self._content_at = self._meta_at + meta + catalog
        if self._content_at + self._offsets[-1] != size:
            raise PackError("the content does not end with the file")
        self._kept: dict[str, object] = {}

    @classmethod
    def of_bytes(cls, data: bytes) -> Pack:
        return cls(len(data), lambda offset, length: data[offset : offset + length])

    @classmethod
    def of_file(cls, path: str) -> Pack:
        """A pack in any file system that Arrow knows by its URI, read in ranges."""
        system, place = file_system(path)
        file = system.open_input_file(place)
        return cls(file.size(), lambda offset, length: file.read_at(length, offset))

    def _exactly(self, offset: int, length: int) -> bytes:
        data = self._source(offset, length)
        if len(data) != length:
            raise PackError("short read")
        return data

    def _range(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise PackError("invalid read range")
        if offset + length <= len(self._front):
            return self._front[offset : offset + length]
        return self._exactly(offset, length)

    def _section(self, name: str, offset: int, length: int):
        if name not in self._kept:
            self._kept[name] = json.loads(self._inflate(self._range(offset, length)))
        return self._kept[name]

    def metadata(self) -> dict:
        return self._section("metadata", self._meta_at, self._meta_length)

    def catalog(self) -> dict:
        return self._section("catalog", self._meta_at + self._meta_length, self._catalog_length)

    def block_count(self) -> int:
        return self._starts[-1]

    def raw_blocks(self, first: int, last: int) -> Iterator[tuple[int, bytes]]:
        """(index, JSON) of the top-level blocks first..last, both clamped, by one read of the chunks they lie in."""
        first, last = max(0, first), min(self.block_count() - 1, last)
        if first > last:
            return
        a, b = bisect_right(self._starts, first) - 1, bisect_right(self._starts, last) - 1
        base = self._offsets[a]
        data = self._range(self._content_at + base, self._offsets[b + 1] - base)
        for c in range(a, b + 1):
            chunk = self._inflate(data[self._offsets[c] - base : self._offsets[c + 1] - base])
            count = self._starts[c + 1] - self._starts[c]
            for k in range(max(first - self._starts[c], 0), min(last - self._starts[c], count - 1) + 1):
                yield self._starts[c] + k, block_of_chunk(chunk, count, k)

    def blocks(self, first: int, last: int) -> list[dict]:
        return [json.loads(raw) for _, raw in self.raw_blocks(first, last)]

    def block(self, ref) -> dict | None:
        if not isinstance(ref, (list, tuple)) or not ref or not all(isinstance(x, int) and not isinstance(x, bool) for x in ref):
            return None
        found = self.blocks(ref[0], ref[0]) if 0 <= ref[0] < self.block_count() else []
        node = found[0] if found else None
        for k in ref[1:]:
            inner = node.get("content") if isinstance(node, dict) else None
            node = inner[k] if isinstance(inner, list) and 0 <= k < len(inner) else None
        return node if isinstance(node, dict) else None

    def page_span(self, page: int) -> tuple[int, int] | None:
        """(first, end) of a page's top-level blocks, None if its range is missing or invalid."""
        pages = self.catalog().get("pages")
        entry = pages[page] if isinstance(pages, list) and 0 <= page < len(pages) else None
        bounds = entry.get("contentRange") if isinstance(entry, dict) else None
        good = lambda b: isinstance(b, list) and b and all(isinstance(x, int) and x >= 0 for x in b)
        if not isinstance(bounds, list) or len(bounds) != 2 or not good(bounds[0]) or not good(bounds[1]):
            return None
        (start, *_), (end, *more), count = bounds[0], bounds[1], self.block_count()
        if start > count or end > count and bounds[0] != bounds[1]:
            return None
        if bounds[0] == bounds[1]:
            return start, start
        return start, max(start, count if end == count else end + (1 if more else 0))

    def page_blocks(self, page: int) -> list[dict]:
        span = self.page_span(page)
        return self.blocks(span[0], span[1] - 1) if span and span[0] < span[1] else []

    def tree(self) -> dict:
        return {"schemaVersion": self.schema_version, "metadata": self.metadata(), "catalog": self.catalog(), "content": self.blocks(0, self.block_count() - 1)}


# ---- columns


def pack_trees(trees: DataFrame, key: str = "doc_id", column: str = "tree") -> DataFrame:
    """(key, pack, error): every document as a pack; what cannot be one has a NULL pack and says why."""
    out = T.StructType().add("pack", T.BinaryType()).add("error", T.StringType())

    @F.pandas_udf(out)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                rows.append((pack(json.loads(text), destructive=True), None))
            except (TypeError, ValueError) as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=out.names)

    return trees.select(key, run(column).alias("p")).select(key, "p.*")


def unpack_trees(packs: DataFrame, key: str = "doc_id", column: str = "pack") -> DataFrame:
    """(key, tree, error): the documents of packs in JSON."""
    out = T.StructType().add("tree", T.StringType()).add("error", T.StringType())

    @F.pandas_udf(out)
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            try:
                rows.append((None if d is None else json.dumps(Pack.of_bytes(bytes(d)).tree(), ensure_ascii=False, separators=(",", ":")), None))
            except (PackError, zlib.error, ValueError) as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=out.names)

    return packs.select(key, run(column).alias("p")).select(key, "p.*")


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pack): packs of any file system that Spark reads, one per file, in folders of any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "").alias("doc_id"), F.col("content").alias("pack"))


# ---- data source

#: Bytes of packs that one task reads, unless a pack is larger.
PARTITION_BYTES = 64 << 20


def file_system(path: str):
    """(file system, path in it) of a URI (file, hdfs, s3, gs, ...) or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str, section: str, partition_bytes: int):
        self.path, self.section, self.partition_bytes = path, section, partition_bytes
        self.low, self.high, self.documents = 0, None, None

    def pushFilters(self, filters):
        """Bounds of block_index narrow the chunks that are read; equal ids narrow the files.  Spark checks again behind it."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("block_index",):
                if isinstance(f, EqualTo):
                    self._bound(f.value, f.value)
                elif isinstance(f, In):
                    self._bound(min(f.value), max(f.value))
                elif isinstance(f, GreaterThanOrEqual):
                    self._bound(f.value, None)
                elif isinstance(f, GreaterThan):
                    self._bound(f.value + 1, None)
                elif isinstance(f, LessThanOrEqual):
                    self._bound(None, f.value)
                elif isinstance(f, LessThan):
                    self._bound(None, f.value - 1)
            elif column == ("doc_id",) and isinstance(f, EqualTo):
                self.documents = {f.value} if self.documents is None else self.documents & {f.value}
            yield f

    def _bound(self, low, high) -> None:
        self.low = self.low if low is None else max(self.low, low)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def partitions(self):
        """Packs side by side, as many as PARTITION_BYTES hold."""
        from pyarrow import fs

        system, place = file_system(self.path)
        found = system.get_file_info(place)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        base = found.path if found.type != fs.FileType.File else ""
        out: list[_Files] = []
        size = self.partition_bytes
        for f in sorted(files, key=lambda f: f.path):
            inside = f.path[len(base) :].strip("/").split("/") if base else [f.base_name]
            if f.type != fs.FileType.File or any(n.startswith((".", "_")) for n in inside) or self.documents is not None and f.base_name.rpartition(".")[0] not in self.documents:
                continue
            if size + f.size > self.partition_bytes:
                out.append(_Files([]))
                size = 0
            size += f.size
            # the authority of a URI stands before the path that the file system knows
            out[-1].paths.append(self.path[: self.path.index(place)] + f.path if scheme and place in self.path else f.path)
        return out

    def read(self, partition):
        for path in partition.paths:
            name = path.rpartition("/")[2].rpartition(".")[0]
            opened = Pack.of_file(path)
            if self.section == "metadata":
                yield name, opened.schema_version, json.dumps(opened.metadata(), ensure_ascii=False), opened.block_count()
            elif self.section == "catalog":
                yield name, json.dumps(opened.catalog(), ensure_ascii=False)
            else:
                last = opened.block_count() - 1 if self.high is None else self.high
                for k, raw in opened.raw_blocks(self.low, last):
                    yield name, k, raw.decode("utf-8")


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Writer(DataSourceWriter):
    """Each task writes a folder of its own under ``_temporary``; the commit moves whole folders in place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows):
        system, place = file_system(self.path)
        name = f"part-{uuid.uuid4().hex}"
        aside = f"{place}/_temporary/{self.job}/{name}"
        system.create_dir(aside, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{aside}/{row.doc_id}.pack") as file:
                file.write(pack(json.loads(row.tree), destructive=True))
        return _Written(name)

    def _finish(self) -> None:
        system, place = file_system(self.path)
        system.delete_dir(f"{place}/_temporary/{self.job}")
        from pyarrow import fs

        if not system.get_file_info(fs.FileSelector(f"{place}/_temporary")):
            system.delete_dir(f"{place}/_temporary")

    def commit(self, messages):
        from pyarrow import fs

        system, place = file_system(self.path)
        system.create_dir(f"{place}/_temporary/{self.job}", recursive=True)
        old = system.get_file_info(fs.FileSelector(place)) if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(f"{place}/_temporary/{self.job}/{m.name}", f"{place}/{m.name}")
        for f in old:
            if not f.base_name.startswith(("_", ".")):
                system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)
        self._finish()

    def abort(self, messages):
        try:
            self._finish()
        except OSError:
            pass  # nothing had been written


class PackDataSource(DataSource):
    """``spark.read.format('treepack')`` over a folder of packs, of any depth, on any file system that Arrow knows by URI.

    Option ``section``: 'blocks' (doc_id, block_index, block), 'metadata' or 'catalog'; ``partition_bytes``:
    how much a task reads.  Writing takes (doc_id, tree) and puts one file per document; the files of a
    write appear when all its tasks are done, those of failed or repeated tasks never, and mode 'overwrite'
    replaces what was there.
    """

    @classmethod
    def name(cls):
        return "treepack"

    def schema(self):
        section = self.options.get("section", "blocks")
        return {
            "metadata": "doc_id string, schema_version string, metadata string, block_count int",
            "catalog": "doc_id string, catalog string",
            "blocks": "doc_id string, block_index int, block string",
        }[section]

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("section", "blocks"), int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackDataSource)
