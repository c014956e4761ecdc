"""Structure-aware chunking as a fold over the blocks of a document, in built-in functions.

The state is what is held back, its counted length, the heading path and the chunks so far. A table is a chunk of its own (or several,
with its header repeated); a heading ends the chunk and changes the path; a long paragraph is packed by sentences; other paragraphs are packed up
to the target size. A chunk cut for size hands its tail on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import dictionaries as D
from folioflow.functions import text as X

CHUNK_TYPE = "array<struct<section_path:array<string>,text:string>>"
PIECE_TYPE = "array<struct<op:string,text:string,level:int>>"
STRINGS = "array<string>"
#: Unicode's white space. Trimming by it looks at the ends of a text, a pattern at each of its characters.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def split_table(md: Column, max_chars: int = D.MAX_CHARS) -> Column:
    """A markdown table as parts of at most about ``max_chars``, each with header and separator; a row is never cut."""
    lines = F.split(md, "\n")
    head, rule, rows = lines[0], F.get(lines, F.lit(1)), F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    room = F.lit(max_chars - 2) - F.char_length(head) - F.char_length(rule)
    none = F.array().cast(STRINGS)
    made = lambda rows: F.array_join(F.concat(F.array(head, rule), rows), "\n")

    def step(acc: Column, row: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["n"] + F.char_length(row) > room)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(made(acc["cur"])))).otherwise(acc["out"]).alias("out"),
            F.when(full, F.array(row)).otherwise(F.concat(acc["cur"], F.array(row))).alias("cur"),
            (F.when(full, F.lit(0)).otherwise(acc["n"]) + F.char_length(row) + 1).alias("n"),
        )

    start = F.struct(none.alias("out"), none.alias("cur"), F.lit(0).alias("n"))
    parts = F.aggregate(rows, start, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(made(acc["cur"])))).otherwise(acc["out"]))
    return F.when((F.size(lines) < 3) | (F.char_length(md) <= max_chars), F.array(md)).otherwise(parts)


def pieces(blocks: Column) -> Column:
    """Blocks as steps of the fold: (op, text, level). ``table`` stands alone, ``head`` changes the path, ``cut`` flushes, ``add`` packs."""
    piece = lambda op, text, level=None: F.struct(F.lit(op).alias("op"), text.alias("text"), (F.lit(None) if level is None else level).cast("int").alias("level"))

    def of(b: Column) -> Column:
        level = X.heading_level(b["text"])
        long = F.concat(F.array(piece("cut", b["text"])), F.transform(X.sentences(b["text"]), lambda s: piece("add", s)))
        return (
            F.when(b["kind"] == "table", F.transform(split_table(b["text"]), lambda t: piece("table", t)))
            .when(level.isNotNull(), F.array(piece("head", b["text"], level)))
            .when(F.char_length(b["text"]) > D.MAX_CHARS, long)
            .otherwise(F.array(piece("add", b["text"])))
        )

    return F.flatten(F.transform(blocks, of))


def pack(steps: Column) -> Column:
    """The chunks (section_path, text) of a document from its steps."""
    no_lines, no_chunks = F.array().cast(STRINGS), F.array().cast(CHUNK_TYPE)
    strip = lambda t: F.btrim(t, F.lit(WHITE))
    # names a value inside an expression that gives a state; a transform would copy the state, with all chunks so far, at each step
    bind = lambda value, state, body: F.aggregate(F.array(value), state, lambda _, v: body(v))
    emit = lambda out, path, text: F.when(F.char_length(text) >= D.MIN_CHARS, F.concat(out, F.array(F.struct(path.alias("section_path"), text.alias("text"))))).otherwise(out)

    def step(acc: Column, x: Column) -> Column:
        over = (acc["n"] > 0) & (acc["n"] + F.char_length(x["text"]) > D.TARGET_CHARS)
        alone = x["op"].isin("table", "head")
        flush = alone | (x["op"] == "cut") | over

        def cut(text: Column) -> Column:
            return bind(F.when(~alone, X.overlap_tail(text)), acc, lambda tail: with_text(text, tail))

        def with_text(text: Column, tail: Column) -> Column:
            flush = text.isNotNull()
            out = F.when(flush, emit(acc["out"], acc["path"], text)).otherwise(acc["out"])
            carried = F.when(~flush, acc["buf"]).when(tail.isNull(), no_lines).otherwise(F.array(tail))
            counted = F.when(~flush, acc["n"]).when(tail.isNull(), F.lit(0)).otherwise(F.char_length(tail))
            path = F.when(x["op"] == "head", F.concat(F.slice(acc["path"], 1, F.coalesce(x["level"], F.lit(0))), F.array(x["text"]))).otherwise(acc["path"])
            adds = x["op"] == "add"
            return F.struct(
                F.when(x["op"] == "table", emit(out, acc["path"], strip(x["text"]))).otherwise(out).alias("out"), path.alias("path"),
                F.when(adds, F.concat(carried, F.array(x["text"]))).otherwise(carried).alias("buf"),
                F.when(adds, counted + F.char_length(x["text"]) + 1).otherwise(counted).alias("n"),
            )

        return bind(F.when(flush, strip(F.array_join(acc["buf"], "\n"))), acc, cut)  # what is held back is joined only to be cut

    start = F.struct(no_chunks.alias("out"), no_lines.alias("path"), no_lines.alias("buf"), F.lit(0).alias("n"))
    return F.aggregate(steps, start, step, lambda acc: bind(strip(F.array_join(acc["buf"], "\n")), acc["out"], lambda text: emit(acc["out"], acc["path"], text)))


def chunk(docs: DataFrame, blocks_col: str = "blocks", keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: the columns ``keep`` of its document, chunk_index, section_path, section (null without a path), text, n_chars."""
    kept = [c for c in docs.columns if c != blocks_col] if keep is None else keep
    made = docs.withColumn("_steps", pieces(F.col(blocks_col))).select(*kept, F.posexplode(pack(F.col("_steps"))).alias("chunk_index", "c"))
    path = F.col("c.section_path")
    return made.select(
        *kept, "chunk_index", path.alias("section_path"), F.when(F.size(path) > 0, F.array_join(path, " > ")).alias("section"), F.col("c.text").alias("text"),
        F.char_length("c.text").alias("n_chars"),
    )


def text_blocks(text: Column) -> Column:
    """The lines of a plain text as blocks; lines without text go."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.lit("text").alias("kind"), x.alias("text")))


def with_ids(chunks: DataFrame, key: str = "doc_key") -> DataFrame:
    """``chunks`` with chunk_id, a hash of document key and index: an identity that doesn't depend on order."""
    return chunks.withColumn("chunk_id", F.xxhash64(F.col(key), F.col("chunk_index")))


def upper_median_by(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The upper median of ``value`` for each key from counts of equal values: no group is collected."""
    from pyspark.sql import Window as W

    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).count()
    upto = F.sum("count").over(W.partitionBy(*keys).orderBy(value))
    total = F.sum("count").over(W.partitionBy(*keys))
    return counts.withColumns({"_upto": upto, "_n": total}).filter(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(*keys).agg(F.min(value).alias(out))


def chunk_stats(chunks: DataFrame, key: str) -> DataFrame:
    """One row: documents with chunks, chunks, per document min, upper median and max, characters min, floor of mean and max, share with a section."""
    per_doc = chunks.groupBy(key).agg(
        F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.sum("n_chars").alias("s"), F.max("n_chars").alias("hi"),
        F.count_if(F.col("section").isNotNull()).alias("sec"), F.count_if(F.startswith("text", F.lit("|"))).alias("tab"),
    )
    whole = per_doc.agg(
        F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"), F.min("lo").alias("min_chars"),
        F.floor(F.sum("s") / F.sum("n")).alias("mean_chars"), F.max("hi").alias("max_chars"), F.sum("sec").alias("with_section"), F.sum("tab").alias("tables"),
        F.floor(100 * F.sum("sec") / F.greatest(F.sum("n"), F.lit(1))).alias("section_percent"),
    )
    middle = upper_median_by(per_doc.withColumn("all", F.lit(1)), ["all"], "n", "median_chunks").select("median_chunks")
    return whole.join(F.broadcast(middle.agg(F.max("median_chunks").alias("median_chunks"))))


def class_counts(rows: DataFrame, column: str = "applies_to") -> DataFrame:
    """Rows per class; a row counts once for each class it binds, rows without one under ``(unscoped)``."""
    listed = F.when(F.size(F.coalesce(F.col(column), F.array().cast(STRINGS))) == 0, F.array(F.lit("(unscoped)"))).otherwise(F.col(column))
    return rows.select(F.explode(listed).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
