"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product, accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: (x / length).cast("float"))).otherwise(v)


def unscoped(applies_to: Column) -> Column:
    return F.size(F.coalesce(applies_to, F.array().cast("array<string>"))) == 0


def entity_filter(applies_to: Column, classes: list[str] | str | None) -> Column:
    """Rows that bind one of the classes, or none at all; every row where no class is asked for."""
    if not classes:
        return F.lit(True)
    listed = [classes] if isinstance(classes, str) else list(classes)
    return F.coalesce(F.arrays_overlap(applies_to, F.array(*map(F.lit, listed))), F.lit(False)) | unscoped(applies_to)
