"""What the learned operators share: which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def chance(id_col: Column) -> Column:
    """A number in [0, 1) drawn from an id; the same in every run."""
    return F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sampled(rows: DataFrame, id_col: str, at_most: int) -> DataFrame:
    """About ``at_most`` of the rows, the same in every run; all where there are fewer."""
    n = rows.count()
    return rows if n <= at_most else rows.filter(chance(F.col(id_col)) < at_most / n)


def slices(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The frames of a worker cut into at most ``rows`` rows each: Spark bounds a batch by rows and bytes, this bounds what is made of it."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows].reset_index(drop=True)
