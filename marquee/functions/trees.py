"""JSON of any depth as rows, one for each value, and back.

A text is checked by Spark's own parser; then one pass over its tokens finds
where each value begins and ends, so that depth costs neither rounds nor
copies. ``path`` holds a value's place in each of the lists and objects around
it, in the order of the text, so that sorting by it is reading order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import spread

KINDS = ("object", "list", "value")
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.DOTALL)
#: Strings (the colon after a key in a group of its own), brackets and commas; and the other values.
_FRAME = re.compile(r'("[^"\\]*(?:\\.[^"\\]*)*")(\s*:)?|[\[\]{},]', re.DOTALL)
_EVERY = re.compile(_FRAME.pattern + r'|[^\s\[\]{},:"]+', re.DOTALL)
#: Tokens that are written as they stand.
_PLAIN = re.compile(r'"[^"\\]*"|true|false|null|0|-?[1-9][0-9]{0,17}')
#: Rows and characters of a batch.
BATCH_ROWS, BATCH_TEXT = 1 << 14, 1 << 23


def _name(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def _values(text: str, kinds: frozenset[str]) -> list[list]:
    """Path, names, kind and text of the values of ``kinds`` in a JSON text, in reading order."""
    out: list[list] = []
    around: list[tuple[bool, list, list, list[int], list | None, int]] = []  # what is open: an object, path, names, commas so far, its row, start
    is_object, path, names, count, key, values = False, [], [], [], None, "value" in kinds
    for m in (_EVERY if values else _FRAME).finditer(text):
        token = m[0]
        c = token[0]
        if c == ",":
            count[0] += 1
            continue
        if c == '"':
            if m.lastindex == 2:
                key = m[1]
                continue
            if not values:
                continue
        elif c in "}]":
            *_, row, start = around.pop()
            if row is not None:
                row[3] = text[start : m.end()]
            if not around:
                break
            is_object, path, names, count, _, _ = around[-1]
            continue
        kind = "object" if c == "{" else "list" if c == "[" else "value"
        own = [*path, *count], [*names, _name(key) if is_object else None] if around else []
        row = [*own, kind, token] if kind in kinds else None
        if row is not None:
            out.append(row)
        if kind != "value":
            is_object, (path, names), count = c == "{", own, [0]
            around.append((is_object, path, names, count, row, m.start()))
        elif not around:
            break
    return out


def nodes(rows: DataFrame, keys: list[str], text: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Values of ``kinds`` of the JSON in column ``text`` with ``keys``: path (places from 0), names (keys of the objects on the way, null for a list's items), kind (object, list or value), value (variant) and raw (JSON text of objects and lists).

    Text that is no JSON has no rows, nor has a null; a text with one value has one row.
    """
    known = spread(rows.select(*keys, F.col(text).alias("_json"))).filter(F.try_parse_json("_json").isNotNull())
    own = {"path": "array<int>", "names": "array<string>", "kind": "string", "_text": "string"}
    shape = known.select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in own.items())).schema
    wanted, n = frozenset(kinds), len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(x: pa.RecordBatch, which: list[int], out: list[list]) -> pa.RecordBatch:
            own = [c.take(pa.array(which, pa.int64())) for c in x.columns[:n]]
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*x.schema.names[:n], "path", "names", "kind", "_text"])

        for x in batches:
            which: list[int] = []
            out: list[list] = []
            held = 0
            for i, t in enumerate(x.column(n).to_pylist()):
                own = _values(t, wanted)
                out += own
                which += [i] * len(own)
                held += sum(len(r[3]) for r in own)
                if len(out) >= BATCH_ROWS or held >= BATCH_TEXT:
                    yield batch(x, which, out)
                    which, out, held = [], [], 0
            yield batch(x, which, out)

    found = known.mapInArrow(read, shape)
    return found.select(*keys, "path", "names", "kind", F.try_parse_json("_text").alias("value"), F.when(F.col("kind") != "value", F.col("_text")).alias("raw"))


def _tree(text: str) -> dict | tuple[str, bool]:
    """Objects that stand in objects alone as dicts of name to (token, value), in order; anything else as its text, and whether that is a single token."""
    root: dict = {}
    around, key, lists, start = [root], ('""', ""), 0, 0  # a place for the text's own value
    for m in _TOKEN.finditer(text):
        token = m[0]
        c = token[0]
        if lists:
            lists += (c in "[{") - (c in "]}")
            if lists:
                continue
            value = (text[start : m.end()], False)
        elif c in ",:":
            continue
        elif c == "}":
            around.pop()
            if len(around) == 1:
                break
            continue
        elif key is None:
            key = (token, _name(token))
            continue
        elif c == "[":
            lists, start = 1, m.start()
            continue
        else:
            value = {} if c == "{" else (token, True)
        around[-1][key[1]] = (key[0], value)
        key = None
        if isinstance(value, dict):
            around.append(value)
        elif len(around) == 1:
            break
    return root[""][1]


def _laid(under: dict | tuple, over: dict | tuple) -> dict | tuple:
    """One tree over another, which it changes."""
    if not isinstance(under, dict) or not isinstance(over, dict):
        return over
    todo = [(under, over)]
    while todo:
        a, b = todo.pop()
        for name, (token, value) in b.items():
            old = a.get(name)
            if old and isinstance(old[1], dict) and isinstance(value, dict):
                todo.append((old[1], value))
            else:
                a[name] = (old[0] if old else token, value)
    return under


def _pieces(tree: dict | tuple[str, bool]) -> list[tuple[str, bool]]:
    """The text of a tree in pieces, with whether a piece is a token that may be written in another way."""
    out, held, todo = [], [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            parts: list = [("{", False)]
            for token, value in x.values():
                parts += [(token, True), (":", False), value, (",", False)]
            todo += [*(parts[:-1] if x else parts), ("}", False)][::-1]
        elif x[1] and not _PLAIN.fullmatch(x[0]):
            out += [("".join(held), False), x]
            held = []
        else:
            held.append(x[0])
    return [*out, ("".join(held), False)]


def overlaid(rows: DataFrame, keys: list[str], under: str, over: str, text: str) -> DataFrame:
    """``keys`` and ``text`` of each row: the JSON of column ``over`` laid over that of ``under``. What is null or no JSON counts as missing; rows without either have no row."""
    known = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.col(c))
    both = spread(rows.select(*keys, F.col(under).alias("_under"), F.col(over).alias("_over")))
    both = both.select(*keys, known("_under").alias("_under"), known("_over").alias("_over")).filter("_under is not null or _over is not null")
    shape = both.select(*keys, F.lit(None).cast("array<struct<raw:string,odd:boolean>>").alias("_pieces")).schema
    n = len(keys)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for a, b in zip(x.column(n).to_pylist(), x.column(n + 1).to_pylist(), strict=True):
                tree = _tree(b) if a is None else _tree(a) if b is None else _laid(_tree(a), _tree(b))
                out.append([{"raw": t, "odd": odd} for t, odd in _pieces(tree)])
            kind = pa.list_(pa.struct([("raw", pa.string()), ("odd", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*x.columns[:n], pa.array(out, kind)], [*x.schema.names[:n], "_pieces"])

    written = F.transform("_pieces", lambda p: F.when(p["odd"], F.to_json(F.try_parse_json(p["raw"]))).otherwise(p["raw"]))
    return both.mapInArrow(lay, shape).select(*keys, F.array_join(written, "").alias(text))


def merged(defaults: DataFrame, own: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and JSON ``text`` of the objects in ``defaults`` overlaid by those of ``own`` (both: keys, text), at any depth.

    An object is merged into an object key by key; anything else in ``own``
    replaces what stands there, lists as a whole, and an object replaces what is
    no object. Keys of the defaults come first, in their order, then new ones.
    Rows that only one side has stay as they are.
    """
    side = lambda t, name: t.filter(F.try_parse_json(text).isNotNull()).select(*keys, F.col(text).alias(name))
    return overlaid(side(defaults, "_l").join(side(own, "_r"), keys, "full"), keys, "_l", "_r", text)
