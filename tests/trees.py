"""Small document trees for tests."""

import json


def text(value, **more):
    return {"text": value, **more}


def paragraph(*texts, **more):
    return {"type": "paragraph", "content": [t if isinstance(t, dict) else text(t) for t in texts], **more}


def listing(*items, **more):
    return {"type": "list", "content": [{"type": "listitem", "content": [i if isinstance(i, dict) else text(i)]} for i in items], **more}


def tree(content, pages=None, **catalog):
    return {
        "schemaVersion": "1.2.0",
        "metadata": {"processor": {"type": "pdf", "version": 1}, "dateCreated": "2020-01-01T00:00:00Z", "source": {"contentType": "application/pdf", "hash": "0" * 32}},
        "catalog": {"pages": [{"contentRange": r} for r in pages or []], **catalog},
        "content": content,
    }


def frame(spark, trees):
    return spark.createDataFrame([(k, json.dumps(t, ensure_ascii=False)) for k, t in trees.items()], "doc_id string, tree string")
