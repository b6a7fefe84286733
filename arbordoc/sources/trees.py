"""From document trees in JSON to tables.

Each table is one narrow Arrow pass over the documents, without a shuffle; malformed parts of a tree give
fewer rows, never an error, and text that is no JSON object gives none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model

_NODE_FIELDS = {
    "type", "content", "text", "style", "target", "refs", "backRefs", "anchor", "flowClass", "reference", "previousPart", "nextPart",
}


def _ref(value) -> list[int] | None:
    ok = isinstance(value, list) and all(isinstance(x, int) and not isinstance(x, bool) for x in value)
    return value if ok else None


def _refs(value) -> list[list[int]] | None:
    return [r for r in map(_ref, value) if r is not None] if isinstance(value, list) else None


def _of(value, kind):
    return value if isinstance(value, kind) and (kind is bool or not isinstance(value, bool)) else None


def _dump(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def is_text(node) -> bool:
    return isinstance(node, dict) and isinstance(node.get("text"), str)


def document_rows(tree: dict) -> Iterator[tuple]:
    meta = tree.get("metadata") if isinstance(tree.get("metadata"), dict) else {}
    processor = meta.get("processor") if isinstance(meta.get("processor"), dict) else {}
    source = meta.get("source") if isinstance(meta.get("source"), dict) else {}
    catalog = tree.get("catalog") if isinstance(tree.get("catalog"), dict) else {}
    content = tree.get("content") if isinstance(tree.get("content"), list) else []
    yield (
        _of(tree.get("schemaVersion"), str), _of(processor.get("type"), str), _of(processor.get("version"), int), _of(meta.get("dateCreated"), str),
        _of(meta.get("characterCount"), int), _of(source.get("contentType"), str), _of(source.get("hash"), str), _of(source.get("fileSize"), int),
        _dump(source.get("properties")), _of(catalog.get("pageMappingType"), str), len(content),
    )


def page_rows(tree: dict) -> Iterator[tuple]:
    catalog = tree.get("catalog") if isinstance(tree.get("catalog"), dict) else {}
    numbers = [int(x) for x in str(tree.get("schemaVersion") or "0").split(".") if x.isdigit()]
    settled = numbers >= [1, 1]
    for k, page in enumerate(catalog.get("pages") if isinstance(catalog.get("pages"), list) else []):
        if not isinstance(page, dict):
            continue
        bounds = page.get("contentRange")
        start, end = (_ref(bounds[0]), _ref(bounds[1])) if isinstance(bounds, list) and len(bounds) == 2 else (None, None)
        view = page.get("viewRect")
        unit = page.get("userUnit", 1.0 if settled else None)
        yield (
            k, start, end, _of(page.get("label"), str), [float(x) for x in view] if isinstance(view, list) else None,
            page.get("rotation", 0 if settled else None), None if unit is None else float(unit), _of(page.get("textSource"), str),
            _of(page.get("extractionDegraded"), bool), _of(page.get("injected"), bool), _of(page.get("fingerprint"), str),
        )


def outline_rows(tree: dict) -> Iterator[tuple]:
    catalog = tree.get("catalog") if isinstance(tree.get("catalog"), dict) else {}
    count = 0
    stack = [(item, None, (), True) for item in reversed(catalog.get("outline") if isinstance(catalog.get("outline"), list) else [])]
    while stack:
        item, parent, path, titled = stack.pop()
        if not isinstance(item, dict):
            continue
        title = item.get("title")
        here = (*path, title if isinstance(title, str) else "")
        titled = titled and isinstance(title, str) and title != ""
        target = item.get("target") if isinstance(item.get("target"), dict) else {}
        position = target.get("position")
        source = item.get("source")
        yield (
            count, parent, len(path), _of(title, str), list(here), titled, _ref(item.get("ref")), _of(target.get("url"), str),
            _dump(position) if isinstance(position, dict) else None, source if source in ("native", "detected") else None,
        )
        children = item.get("children")
        if isinstance(children, list):
            stack += [(child, count, here, titled) for child in reversed(children)]
        count += 1


def node_rows(tree: dict) -> Iterator[tuple]:
    content = tree.get("content") if isinstance(tree.get("content"), list) else []
    stack = [(node, [k], node.get("flowClass") if isinstance(node, dict) else None) for k, node in reversed(list(enumerate(content)))]
    while stack:
        node, ref, top_flow = stack.pop()
        if not isinstance(node, dict):
            continue
        text = is_text(node)
        inner = node.get("content") if isinstance(node.get("content"), list) else []
        blocks = any(isinstance(c, dict) and not is_text(c) for c in inner)
        anchor = node.get("anchor") if isinstance(node.get("anchor"), dict) else {}
        style = node.get("style") if isinstance(node.get("style"), dict) else None
        rects = anchor.get("pageRects")
        rest = {k: v for k, v in node.items() if k not in _NODE_FIELDS}
        yield (
            ref, [*ref[:-1], ref[-1] + 1], ref[:-1], len(ref), ref[-1], ref[0], "text" if text else "block", _of(node.get("type"), str),
            node["text"] if text else None, tuple(_of(style.get(k), bool) for k in model.STYLE.names) if style else None, _dump(node.get("target")),
            _refs(node.get("refs")), _refs(node.get("backRefs")), _of(anchor.get("textMap"), str), _of(anchor.get("selectorMap"), str),
            _of(anchor.get("stream"), int), _of(anchor.get("deltaMap"), str),
            [[float(x) for x in r] for r in rects if isinstance(r, list) and all(isinstance(x, (int, float)) for x in r)] if isinstance(rects, list) else None,
            _of(node.get("flowClass"), str), _of(top_flow, str), _of(node.get("reference"), bool), _ref(node.get("previousPart")), _ref(node.get("nextPart")),
            not text and not blocks, blocks, len(inner), _dump(rest) if rest else None,
        )
        if not text:
            stack += [(c, [*ref, k], top_flow) for k, c in reversed(list(enumerate(inner)))]


def dom_rows(tree: dict) -> Iterator[tuple]:
    catalog = tree.get("catalog") if isinstance(tree.get("catalog"), dict) else {}
    roots = catalog.get("domMap") if isinstance(catalog.get("domMap"), list) else []
    stack = [(node, None, 0, k) for k, node in reversed(list(enumerate(roots)))]
    count = 0
    while stack:
        node, parent, depth, sibling = stack.pop()
        if not isinstance(node, dict):
            continue
        yield (
            count, parent, depth, sibling, _of(node.get("tag"), str), _of(node.get("index"), int), _of(node.get("flags"), int) or 0,
            _of(node.get("id"), str), _of(node.get("prevId"), str), _of(node.get("textStart"), int), _of(node.get("textLength"), int),
        )
        children = node.get("children")
        if isinstance(children, list):
            stack += [(c, count, depth + 1, k) for k, c in reversed(list(enumerate(children)))]
        count += 1


ROWS = {"documents": document_rows, "pages": page_rows, "outline": outline_rows, "nodes": node_rows, "dom_nodes": dom_rows}


def parse(text: str | None) -> dict | None:
    try:
        tree = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return tree if isinstance(tree, dict) else None


def flatten(trees: DataFrame, table: str, key: str = "doc_id", column: str = "tree") -> DataFrame:
    """A table of :mod:`arbordoc.model` (``documents``, ``pages``, ``outline``, ``nodes``, ``dom_nodes``) of (key, tree in JSON)."""
    rows, fields = ROWS[table], model.TABLES[table]
    schema = T.StructType([trees.schema[key], *fields])

    def flat(batches):
        for pdf in batches:
            out = [(k, *row) for k, text in zip(pdf[key], pdf[column]) if (tree := parse(text)) is not None for row in rows(tree)]
            yield pd.DataFrame(out, columns=schema.names).astype({f.name: "Int64" for f in fields if isinstance(f.dataType, (T.IntegerType, T.LongType))})

    return trees.select(key, column).mapInPandas(flat, schema)


def read_json_trees(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tree): one document per file; the id is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_name"))
    return files.select(F.regexp_replace("path", "\\.[^.]*$", "").alias("doc_id"), F.col("value").alias("tree"))


def read_json_lines(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, tree): one document per line, with its id in a field of the tree."""
    return spark.read.text(path).select(F.get_json_object("value", f"$.{key}").alias("doc_id"), F.col("value").alias("tree"))


def tables(trees: DataFrame, key: str = "doc_id", column: str = "tree") -> dict[str, DataFrame]:
    return {name: flatten(trees, name, key, column) for name in ROWS}
