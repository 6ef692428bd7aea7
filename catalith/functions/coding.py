"""Codings that Spark has no function for, in Arrow batches: normal forms and half floats.

Normal forms come from the Unicode tables of Python, as the normalisation kernel of the Arrow
version at hand gives decomposed texts for NFC.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from catalith.functions.columns import col


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def nfc(text) -> Column:
    """The composed normal form of a text; null stays null."""
    return _nfc(col(text))


def compare_key(path) -> Column:
    """A path in the form it is compared by: composed, with forward slashes, case kept."""
    return nfc(F.replace(col(path), F.lit("\\"), F.lit("/")))


@F.pandas_udf(T.BinaryType())
def _encode(vectors: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):  # what is too large becomes infinite
        return pd.Series([None if v is None else np.asarray(v, np.float32).astype("<f2").tobytes() for v in vectors], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode(halves: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else np.frombuffer(b, "<f2").astype(np.float32) for b in halves], dtype=object)


def half_encoded(vector) -> Column:
    """Little-endian half floats of an array, two bytes each: nearest, ties to even."""
    return _encode(col(vector).cast("array<float>"))


def half_decoded(halves, width: int) -> Column:
    """The floats of `width` halves; null for any other length."""
    return _decode(F.when(F.octet_length(col(halves)) == 2 * width, col(halves)))
