"""The library's functions by name in SQL: register(spark) once, then `SELECT box_iou(a, b)`, `parse_report(text)`, and table
functions over `TABLE(maps) PARTITION BY doc`.

Scalar functions are SQL functions whose body is the expression that the Python function builds, so Catalyst inlines
them and no Python worker runs.  Table functions are polymorphic: `analyze` looks at the table's own types.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import raster
from . import geometry as G, report as R, text as X
from .geometry import Box

_BOX = "STRUCT<x1: BIGINT, y1: BIGINT, x2: BIGINT, y2: BIGINT>"
_REPORT = f"STRUCT<conclusion: STRING, risk_score: INT, anomalies: ARRAY<{R.ANOMALY_TYPE}>, summary: STRING, raw: STRING>"


def _two(f: Callable[[Box, Box], Column | Box]) -> tuple[dict[str, str], Callable[..., Column]]:
    def made(a: Column, b: Column) -> Column:
        out = f(Box.in_struct(a), Box.in_struct(b))
        return out.struct() if isinstance(out, Box) else out

    return {"a": _BOX, "b": _BOX}, made


def _of(kind: str, f: Callable[[Column], Column]) -> tuple[dict[str, str], Callable[..., Column]]:
    return {"value": kind}, f


#: name: parameters with their types, and the function of Columns.
SCALARS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "box_iou": _two(G.iou),
    "box_iou_clamped": _two(G.iou_clamped),
    "box_intersection_over_min": _two(G.intersection_over_min),
    "box_overlap_fraction": _two(G.overlap_fraction),
    "box_union": _two(G.union_box),
    "report_conclusion": _of("STRING", lambda t: R.conclusion(F.coalesce(t, F.lit("")))),
    "report_conclusion_strict": _of("STRING", R.conclusion_strict),
    "report_risk_score": _of("STRING", R.risk_score),
    "report_blocks": _of("STRING", R.blocks),
    "report_summary": _of("STRING", R.summary),
    "parse_report": _of("STRING", R.parse_report),
    "report_boxes": _of(_REPORT, R.boxes),
    "report_explanation": _of(_REPORT, R.explanation),
    "report_for_dataset": _of(_REPORT, R.serialize_dataset),
    "report_for_submission": _of(_REPORT, R.serialize_submission),
    "viewed_anomalies": _of("STRING", R.visual_anomalies),
    "clean_report": _of("STRING", X.clean_report),
    "clean_report_v0": _of("STRING", X.clean_report_v0),
    "strip_thinking": _of("STRING", X.strip_thinking),
    "think_or_stages": _of("STRING", X.think_or_stages),
    "trim_tail": _of("STRING", X.trim_tail),
    "kept_boxes": _of("STRING", X.kept_boxes),
    "report_groundings": _of("STRING", X.groundings),
}
#: Names of operators that SQL takes as functions only between backquotes.
_OPERATOR = re.compile(r"(?<![\w`'])(and|or|not|in|[-+*/%<>=!&|^~]+)\(")


def sql_of(c: Column) -> str:
    """The expression as SQL: operators are called as functions, by their quoted names."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", c._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`(", p) for i, p in enumerate(parts))


class _Boxes:
    """Rows of a table (doc, h, w, data) become numbered boxes; doc keeps its type."""

    numbers: tuple[str, ...] = ()

    @classmethod
    def analyzed(cls, maps: AnalyzeArgument, *more: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in maps.dataType} if maps.isTable else {}
        if not {"doc", "h", "w", "data"} <= set(kinds):
            raise ValueError("the first argument is a table with doc, h, w and data")
        if len(more) != len(cls.numbers):
            raise ValueError(f"numbers wanted after the table: {', '.join(cls.numbers)}")
        ints = [T.StructField(n, T.IntegerType()) for n in ("number", "x1", "y1", "x2", "y2")]
        return AnalyzeResult(T.StructType([T.StructField("doc", kinds["doc"]), *ints]))

    @staticmethod
    def found(row, kernel: Callable[[np.ndarray], list[list[int]]]) -> Iterator[tuple]:
        if row["data"] is not None:
            for i, b in enumerate(kernel(np.asarray(row["data"], np.float32).reshape(row["h"], row["w"])), 1):
                yield (row["doc"], i, *b)


class MaskToBoxes(_Boxes):
    numbers = ("threshold", "least area", "connectivity")

    @staticmethod
    def analyze(maps: AnalyzeArgument, threshold: AnalyzeArgument, least: AnalyzeArgument, connectivity: AnalyzeArgument) -> AnalyzeResult:
        return MaskToBoxes.analyzed(maps, threshold, least, connectivity)

    def eval(self, row, threshold, least, connectivity):
        yield from self.found(row, lambda m: raster.component_boxes(m >= np.float32(threshold), int(least), int(connectivity)))


class DetectorRegions(_Boxes):
    numbers = ("threshold", "least area", "opening")

    @staticmethod
    def analyze(maps: AnalyzeArgument, threshold: AnalyzeArgument, least: AnalyzeArgument, opening: AnalyzeArgument) -> AnalyzeResult:
        return DetectorRegions.analyzed(maps, threshold, least, opening)

    def eval(self, row, threshold, least, opening):
        yield from self.found(row, lambda m: raster.detector_regions(m, float(threshold), int(least), opening=int(opening)))


class SparseBoxes(_Boxes):
    numbers = ("threshold", "least area", "fill")

    @staticmethod
    def analyze(maps: AnalyzeArgument, threshold: AnalyzeArgument, least: AnalyzeArgument, fill: AnalyzeArgument) -> AnalyzeResult:
        return SparseBoxes.analyzed(maps, threshold, least, fill)

    def eval(self, row, threshold, least, fill):
        yield from self.found(row, lambda m: raster.sparse_boxes(m >= np.float32(threshold), least_area=int(least), least_gap=1, fill=float(fill)))


TABLES = {"mask_to_boxes": MaskToBoxes, "detector_regions": DetectorRegions, "sparse_boxes": SparseBoxes}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes all functions known to this session's SQL; returns their names."""
    for name, (parameters, f) in SCALARS.items():
        body = f(*[F.col(p) for p in parameters])
        empty = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS {p}" for p, kind in parameters.items()))
        kind = empty.select(body).schema[0].dataType.simpleString()
        given = ", ".join(f"{p} {k}" for p, k in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {kind} RETURN {sql_of(body)}")
    for name, cls in TABLES.items():
        spark.udtf.register(prefix + name, F.udtf(cls))
    return [prefix + n for n in (*SCALARS, *TABLES)]
