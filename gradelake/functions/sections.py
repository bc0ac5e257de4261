"""Sections of a Markdown text: headings are found line by line, texts are cut out between them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.reader import by_slices

#: A heading of the first three levels, and a line that opens or closes a fence, within which there are no headings.
_LINE = re.compile(r"^(?:(?P<marks>#{1,3})[^\S\n]+(?P<title>\S[^\n]*?)[^\S\n]*#*[^\S\n]*|[^\S\n]*(?P<fence>```|~~~)[^\n]*)$", re.M)
SCHEMA = "array<struct<heading: string, level: int, text: string, tokens: int>>"


def split_sections(text: str) -> Iterator[tuple[str, int, str, int]]:
    """(heading, level, text, tokens) of the sections of a text that hold anything, the part before the first heading as
    level 0. The text of a section begins with its heading's line. One pass over the lines that matter."""
    heads, fenced = [(0, "(intro)", 0)], False
    for m in _LINE.finditer(text):
        if m["fence"]:
            fenced = not fenced
        elif not fenced:
            heads.append((m.start(), m["title"], len(m["marks"])))
    for (start, title, level), (end, _, _) in zip(heads, [*heads[1:], (len(text), "", 0)]):
        body = text[start:end].strip(" \t\r\n\f\v")
        if body:
            yield title, level, body, -(-len(body) // 4)


def sections(c: Column) -> Column:
    """split_sections() of a column, as an array of structs; null stays null."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct({"heading": pa.string(), "level": pa.int32(), "text": pa.string(), "tokens": pa.int32()}))
        names = ("heading", "level", "text", "tokens")
        return by_slices(lambda t: [dict(zip(names, s)) for s in split_sections(t)], kind, texts)

    return run(c.cast("string"))
