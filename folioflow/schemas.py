"""The tables of the engine, and bringing older ones up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

DOCS_DDL = (
    "key string, doc_type string, rbi_id bigint, number string, issue_date string, raw_date string, department string, ref_code string, "
    "meant_for string, applies_to array<string>, subject string, source_url string, pdf_url string, local_path string, body_path string, fetched_at timestamp"
)
CHUNKS_DDL = (
    "chunk_id bigint, doc_key string, rbi_id bigint, number string, ref_code string, issue_date string, department string, applies_to array<string>, "
    "meant_for string, subject string, source_url string, chunk_index int, section_path array<string>, section string, text string, n_chars int"
)
BLOCKS_TYPE = "array<struct<kind:string,text:string>>"
ANSWER_DDL = "answer string, citations array<struct<source_id:int,quote:string>>, insufficient_context boolean"
CHECK_TYPE = "array<struct<source_id:int,quote:string,status:string,found_in:array<int>,cited_doc:string>>"
LOG_DDL = (
    "seq bigint, timestamp timestamp, run_id string, source string, question string, entity array<string>, filtered boolean, retrieved array<string>, answer string, "
    f"insufficient_context boolean, citations {CHECK_TYPE}, verified int, n_citations int, seconds double, model string, error string"
)
PAYLOAD = ["doc_key", "number", "ref_code", "issue_date", "department", "applies_to", "subject", "section", "source_url", "chunk_index", "text"]


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def migrate(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` in the columns of ``ddl``: missing ones become null, others are cast, extra ones go."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl).fields])
