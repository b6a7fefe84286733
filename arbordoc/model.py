"""The relational form of structured documents: one table per part of the tree, keyed by document and place."""

from __future__ import annotations

from pyspark.sql import types as T

#: The version of the tree's schema that is read in full.
SCHEMA_VERSION = "1.2.0"
REF = T.ArrayType(T.IntegerType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

#: Absent flags are NULL, not false.
STYLE = _struct(bold=B, italic=B, sub=B, sup=B, monospace=B)

#: One row per document.  ``properties`` is JSON of open shape.
DOCUMENTS = _struct(
    schema_version=S, processor_type=S, processor_version=I, date_created=S, character_count=L, content_type=S,
    source_hash=S, file_size=L, properties=S, page_mapping_type=S, block_count=I,
)

#: One row per page.  Rotation and user unit are NULL (unknown) before schema 1.1.0 and 0 and 1 from then on, if absent.
PAGES = _struct(
    page_index=I, range_start=REF, range_end=REF, page_label=S, view_rect=T.ArrayType(D), rotation=I, user_unit=D,
    text_source=S, extraction_degraded=B, injected=B, fingerprint=S,
)

#: One row per outline entry in preorder.  ``titled`` is whether it and all its ancestors have a title.
OUTLINE = _struct(
    ord=I, parent_ord=I, depth=I, title=S, title_path=T.ArrayType(S), titled=B, ref=REF, url=S, position=S, entry_source=S
)

#: One row per node of the content, blocks and texts, in preorder.  ``ref_end`` is the ref of the next sibling place.
NODES = _struct(
    ref=REF, ref_end=REF, parent_ref=REF, depth=I, ordinal=I, top_index=I, kind=S, type=S, text=S, style=STYLE,
    target=S, refs=T.ArrayType(REF), back_refs=T.ArrayType(REF), text_map=S, selector_map=S, stream=L, delta_map=S,
    page_rects=T.ArrayType(T.ArrayType(D)), flow_class=S, top_flow_class=S, reference=B, previous_part=REF, next_part=REF,
    is_leaf=B, has_child_block=B, child_count=I, attributes=S,
)

#: One row per element of the page skeleton in preorder, numbered within its document.
DOM_NODES = _struct(
    node_no=I, parent_no=I, depth=I, sibling=I, tag=S, index=I, flags=I, element_id=S, previous_id=S, text_start=L, text_length=L
)

TABLES = {"documents": DOCUMENTS, "pages": PAGES, "outline": OUTLINE, "nodes": NODES, "dom_nodes": DOM_NODES}
