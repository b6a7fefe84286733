"""CSS selectors on page skeletons: escaping, segments and parsing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of an element's flags.
FIRST_OF_TYPE, LAST_OF_TYPE, LAST_CHILD = 1, 2, 4


def escape(value: str) -> str:
    """An identifier as it stands in a selector, by the serialization rules of CSSOM."""
    out = []
    for i, c in enumerate(value):
        digit = "0" <= c <= "9"
        if c == "\0":
            out.append("�")
        elif c <= "\x1f" or c == "\x7f" or digit and (i == 0 or i == 1 and value[0] == "-"):
            out.append(f"\\{ord(c):x} ")
        elif c == "-" and len(value) == 1:
            out.append("\\-")
        elif c >= "\x80" or c in "-_" or c.isalnum():
            out.append(c)
        else:
            out.append("\\" + c)
    return "".join(out)


@F.pandas_udf(T.StringType())
def escape_col(value: pd.Series) -> pd.Series:
    return value.map(escape, na_action="ignore")


def segment(tag: Column, index: Column, flags: Column) -> Column:
    """An element's part of a selector: its tag, and the shortest class that tells it from its siblings."""
    flags = F.coalesce(flags, F.lit(0))
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    pseudo = (
        F.when(has(FIRST_OF_TYPE) & has(LAST_OF_TYPE), "")
        .when(index == 0, ":first-child")
        .when(has(FIRST_OF_TYPE), ":first-of-type")
        .when(has(LAST_CHILD), ":last-child")
        .when(has(LAST_OF_TYPE), ":last-of-type")
        .otherwise(F.concat(F.lit(":nth-child("), (index + 1).cast("string"), F.lit(")")))
    )
    return F.concat(tag, pseudo)


_SEGMENT = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*)(?::(first-child|first-of-type|last-child|last-of-type|nth-child\((\d+)\)))?")


def _parse_segment(part: str) -> dict | None:
    m = _SEGMENT.fullmatch(part)
    if not m:
        return None
    kind = m[2] and ("nth-child" if m[3] else m[2])
    return {"tag": m[1].lower(), "pseudo": kind, "n": int(m[3]) if m[3] else None, "id": None, "previous_id": None}


def parse(selector: str | None) -> dict | None:
    """{anchor: 'body' | 'id' | None, anchor_id, segments} of a selector of the supported form, else None.

    Parts are joined by ' > '.  The first may be 'body', '#id', or '#id + tag' (ids in escaped form).
    """
    if selector is None:
        return None
    first, *rest = selector.split(" > ")
    anchor = anchor_id = lead = None
    if first == "body":
        if not rest:
            return None
        anchor = "body"
    elif first.startswith("#"):
        before, plus, after = first.partition(" + ")
        if plus:
            lead = _parse_segment(after)
            if lead is None:
                return None
            lead["previous_id"] = before[1:]
        elif not rest:
            lead = {"tag": None, "pseudo": None, "n": None, "id": first[1:], "previous_id": None}
        else:
            anchor, anchor_id = "id", first[1:]
    else:
        rest = [first, *rest]
    segments = [_parse_segment(p) for p in rest]
    if lead is not None:
        segments.insert(0, lead)
    if not segments or None in segments:
        return None
    return {"anchor": anchor, "anchor_id": anchor_id, "segments": segments}


PARSED = T.StructType(
    [
        T.StructField("anchor", T.StringType()),
        T.StructField("anchor_id", T.StringType()),
        T.StructField(
            "segments",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.IntegerType() if n == "n" else T.StringType()) for n in ("tag", "pseudo", "n", "id", "previous_id")]
                )
            ),
        ),
    ]
)


@F.pandas_udf(PARSED)
def parse_col(selector: pd.Series) -> pd.DataFrame:
    """The parts of a selector column; all NULL for selectors of another form."""
    told = [parse(x) or {} for x in selector]
    return pd.DataFrame({name: [t.get(name) for t in told] for name in PARSED.names}, dtype=object)
