"""Positions in e-books: selector maps and EPUB canonical fragment identifiers, as Spark expressions.

A selector map is one path, or lines of ``length path``; lengths and offsets are UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .deltamap import to_source_col
from .let import let

# Fixed value: the standard that fragment selectors conform to.
CONFORMS_TO = "http://www.idpf.org/epub/linking/cfi/epub-cfi.html"


def entries(selector_map: Column) -> Column:
    """ARRAY<STRUCT<length, path>> of a map of several entries; NULL for a single path."""
    line = F.split(selector_map, "\n")
    parsed = F.transform(
        line,
        lambda x: F.struct(
            F.regexp_extract(x, "^\\s*(-?\\d+)", 1).try_cast("bigint").alias("length"),
            F.when(F.instr(x, " ") > 0, F.substring(x, F.instr(x, " ") + 1, F.length(x))).otherwise(x).alias("path"),
        ),
    )
    return F.when(~selector_map.startswith("/"), parsed)


def expand(block_map: Column, selector_map: Column) -> Column:
    """A text's selector map put behind its block's path, every entry of it."""
    several = F.array_join(F.transform(entries(selector_map), lambda e: F.concat(e.length.cast("string"), F.lit(" "), block_map, e.path)), "\n")
    return F.when(F.coalesce(selector_map, F.lit("")) == "", block_map).when(selector_map.startswith("/"), F.concat(block_map, selector_map)).otherwise(several)


def fragment(value: Column) -> Column:
    return F.when(
        value.isNotNull(),
        F.struct(F.lit("FragmentSelector").alias("type"), F.lit(CONFORMS_TO).alias("conformsTo"), F.concat(F.lit("epubcfi("), value, F.lit(")")).alias("value")),
    )


def block_fragment(block_map: Column) -> Column:
    return fragment(block_map)


def entry_at(parsed: Column, offset: Column) -> Column:
    """STRUCT<path, local, before>: the entry an offset lies in; behind the last entry, its end."""
    sums = F.aggregate(
        parsed,
        F.array().cast("array<struct<path:string,length:bigint,before:bigint>>"),
        lambda done, e: F.array_append(
            done,
            F.struct(
                e.path.alias("path"), e.length.alias("length"),
                F.coalesce(F.get(done, F.size(done) - 1).before + F.get(done, F.size(done) - 1).length, F.lit(0).cast("bigint")).alias("before"),
            ),
        ),
    )
    behind = lambda e: F.struct(e.path.alias("path"), e.length.cast("bigint").alias("local"), e.before.alias("before"))
    inside = lambda e: F.struct(e.path.alias("path"), (offset - e.before).cast("bigint").alias("local"), e.before.alias("before"))
    found = lambda all_: F.coalesce(F.get(F.transform(F.filter(all_, lambda e: offset < e.before + e.length), inside), F.lit(0)), behind(F.element_at(all_, -1)))
    return let(sums, found)


def _local_source(delta_map: Column, before: Column, local: Column) -> Column:
    return to_source_col(delta_map, before + local) - to_source_col(delta_map, before)


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def common_path(a: Column, b: Column) -> Column:
    """STRUCT<common, remainder_a, remainder_b> of two paths, step by step."""
    steps = F.struct(*(F.regexp_extract_all(x, F.lit("/[^/]*"), F.lit(0)).alias(n) for n, x in (("a", a), ("b", b))))

    def cut(s: Column) -> Column:
        differ = F.array_position(F.zip_with(s.a, s.b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
        n = F.when(differ == 0, F.least(F.size(s.a), F.size(s.b))).otherwise(differ - 1).cast("int")
        rest = lambda x, n: F.array_join(F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))), "")
        return let(n, lambda n: F.struct(F.array_join(F.slice(s.a, 1, n), "").alias("common"), rest(s.a, n).alias("remainder_a"), rest(s.b, n).alias("remainder_b")))

    same = F.struct(a.alias("common"), F.lit("").alias("remainder_a"), F.lit("").alias("remainder_b"))
    return F.when(a == b, same).otherwise(let(steps, cut))


def _between(path_a: Column, at_a: Column, path_b: Column, at_b: Column, one: Column | None = None) -> Column:
    apart = let(common_path(path_a, path_b), lambda p: _text(p.common, ",", p.remainder_a, ":", at_a, ",", p.remainder_b, ":", at_b))
    together = _text(path_a, ",:", at_a, ",:", at_b)
    if one is not None:
        together = F.when(one, _text(path_a, ":", at_a)).otherwise(together)
    return F.when(path_a == path_b, together).otherwise(apart)


def resolve(selector_map: Column, start: Column, end: Column | None = None, delta_map: Column | None = None) -> Column:
    """The fragment of the units [start, end) of one text; one unit if there is no end."""
    delta = F.lit(None).cast("string") if delta_map is None else delta_map
    start = start.cast("bigint")
    end = start + 1 if end is None else F.coalesce(end.cast("bigint"), start + 1)
    ends = F.struct(to_source_col(delta, start).alias("a"), to_source_col(delta, end).alias("b"))
    single = let(ends, lambda x: F.when(x.b == x.a + 1, _text(selector_map, ":", x.a)).otherwise(_text(selector_map, ",:", x.a, ",:", x.b)))

    def several(e: Column) -> Column:
        at = F.struct(_local_source(delta, e.a.before, e.a.local).alias("a"), (_local_source(delta, e.b.before, e.b.local) + 1).alias("b"))
        return let(at, lambda x: _between(e.a.path, x.a, e.b.path, x.b, x.b == x.a + 1))

    both = let(entries(selector_map), lambda parsed: F.struct(entry_at(parsed, start).alias("a"), entry_at(parsed, end - 1).alias("b")))
    return fragment(F.when(selector_map.startswith("/"), single).otherwise(let(both, several)))


def _point(selector_map: Column, offset: Column, delta: Column) -> Column:
    """STRUCT<path, at> of one position."""
    whole = F.struct(selector_map.alias("path"), to_source_col(delta, offset).alias("at"))
    part = let(entry_at(entries(selector_map), offset), lambda e: F.struct(e.path.alias("path"), _local_source(delta, e.before, e.local).alias("at")))
    return F.when(selector_map.startswith("/"), whole).otherwise(part)


def resolve_range(start_map: Column, start: Column, end_map: Column, end: Column, start_delta: Column | None = None, end_delta: Column | None = None) -> Column:
    """The fragment from a unit of one text to a unit of another."""
    none = F.lit(None).cast("string")
    start, end = start.cast("bigint"), end.cast("bigint")
    start_delta, end_delta = none if start_delta is None else start_delta, none if end_delta is None else end_delta
    points = F.struct(_point(start_map, start, start_delta).alias("a"), _point(end_map, end, end_delta).alias("b"))
    apart = let(points, lambda p: _between(p.a.path, p.a.at, p.b.path, p.b.at))
    return F.when(start_map == end_map, resolve(start_map, start, end, start_delta)).otherwise(fragment(apart))
