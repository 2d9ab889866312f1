"""Text functions that Spark lacks, as Arrow UDFs over whole batches."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


def _ratio(one: pa.Array, two: pa.Array) -> pa.Array:
    pairs = zip(one.to_pylist(), two.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs], pa.float64())


def nfkc(text: Column) -> Column:
    """Unicode normal form KC."""
    return F.arrow_udf(_nfkc, T.StringType())(text)


def sequence_ratio(one: Column, two: Column) -> Column:
    """Twice the matching characters over all characters, by longest matching blocks."""
    return F.arrow_udf(_ratio, T.DoubleType())(one, two)
