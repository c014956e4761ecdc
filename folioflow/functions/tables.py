"""Table functions for SQL: ``register`` makes them known to a session.

``page_blocks(TABLE(pages) PARTITION BY page_id)`` gives the blocks of the column html of any table: its other columns as they are, then position, kind and text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from folioflow.operators.blocks import blocks_of

HTML = "html"


class PageBlocks:
    """The blocks of each page of a table; a page's rows leave one by one."""

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or HTML not in pages.dataType.fieldNames():
            raise ValueError(f"page_blocks takes a table with a column {HTML}")
        schema = StructType([f for f in pages.dataType.fields if f.name != HTML])
        return AnalyzeResult(schema.add("pos", IntegerType()).add("kind", StringType()).add("text", StringType()))

    def eval(self, page: Row) -> Iterator[tuple]:
        given = tuple(value for name, value in page.asDict().items() if name != HTML)
        for at, (kind, text) in enumerate(blocks_of(page[HTML])):
            yield *given, at, kind, text


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_blocks", udtf(PageBlocks))
