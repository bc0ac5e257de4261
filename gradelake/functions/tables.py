"""Table functions for SQL: one row of a table to many. register() makes them known to a session.

    select * from sections(table(select doc_id, text from docs))
    select * from shingles(table(docs) partition by (doc_id), 5)
    select doc_id, size(shingles) from shingle_sets(table(docs) partition by (doc_id), 5)

Each takes a table whose first column is a key and whose second is a text; its output begins with the key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gradelake.functions.reader import visible
from gradelake.functions.sections import split_sections
from gradelake.guard.inspect import inspect, pack_windows


def _shaped(rows: AnalyzeArgument, **columns: DataType) -> AnalyzeResult:
    if not rows.isTable or len(rows.dataType.fields) < 2:
        raise ValueError("the argument is a table of a key and a text")
    schema = StructType().add(rows.dataType.fields[0].name, rows.dataType.fields[0].dataType)
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return AnalyzeResult(schema)


class _Sections:
    """(key, section, heading, level, text, tokens) of each section of a Markdown text."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        i, s = IntegerType(), StringType()
        return _shaped(rows, section=i, heading=s, level=i, text=s, tokens=i)

    def eval(self, rows: Row) -> Iterator[tuple]:
        for k, part in enumerate(split_sections(rows[1] or "")):
            yield rows[0], k, *part


class _Windows:
    """(key, window, text) of each window for a classifier, at most so many characters long."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        return _shaped(rows, window=IntegerType(), text=StringType())

    def eval(self, rows: Row, most: int) -> Iterator[tuple]:
        for k, window in enumerate(pack_windows(rows[1] or "", most)):
            yield rows[0], k, window


class _Findings:
    """(key, kind, severity, rule, blocks) of each finding of the input guard."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        s = StringType()
        return _shaped(rows, kind=s, severity=s, rule=s, blocks=BooleanType())

    def eval(self, rows: Row) -> Iterator[tuple]:
        for f in inspect(rows[1] or "")[1]:
            yield rows[0], f["kind"], f["severity"], f["rule"], f["severity"] == "block"


def _shingles(text: str, n: int) -> dict[str, None]:
    """The different runs of n visible words, in order."""
    words = visible(text).split()
    return dict.fromkeys(map(" ".join, zip(*(words[k:] for k in range(n)))))


class _Shingles:
    """(key, shingle) of each different run of n visible words of a text."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if n.isConstantExpression and (n.value or 0) < 1:
            raise ValueError("a run has one word or more")
        return _shaped(rows, shingle=StringType())

    def eval(self, rows: Row, n: int) -> Iterator[tuple]:
        for run in _shingles(rows[1] or "", n):
            yield rows[0], run


class _ShingleSets:
    """(key, shingles): those of shingles(), all of a text in one row. A text without any has no row."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if n.isConstantExpression and (n.value or 0) < 1:
            raise ValueError("a run has one word or more")
        return _shaped(rows, shingles=ArrayType(StringType()))

    def eval(self, rows: Row, n: int) -> Iterator[tuple]:
        if runs := _shingles(rows[1] or "", n):
            yield rows[0], list(runs)


FUNCTIONS = {"sections": _Sections, "windows": _Windows, "findings": _Findings, "shingles": _Shingles, "shingle_sets": _ShingleSets}


def register(spark: SparkSession) -> None:
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
