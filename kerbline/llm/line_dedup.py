"""Lines that many documents share, dropped with DataFrame functions only.

Lines are normalised and those long enough are exploded with their places and hashed; each
hash counts its distinct documents; the places of hashes over the threshold are dropped in
all documents but one, and the rest of each text is put together again by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, texts_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Taken off both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without blanks around it, A-Z in lower case; others keep their case."""
    bare = F.trim(line, F.lit(BLANKS))
    # a line of as many bytes as code points is ASCII, for which the fast form does the same
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def long_lines(docs: DataFrame, least_length: int) -> DataFrame:
    """``doc_id, mark, at, h1, h2``: a row for each line with a key of at least
    ``least_length`` code points. ``mark`` hashes the text: rows with equal ids and equal
    texts have the same lines dropped, so ``doc_id, mark`` names what a place belongs to."""
    entries = F.transform(F.split("text", "\n"), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("at")))
    # the length of the bare line is that of its key, and costs no change of case
    entries = F.filter(entries, lambda e: F.length(e["key"]) >= least_length)
    hashed = F.transform(entries, lambda e: F.struct(e["at"].alias("at"), F.xxhash64(e["key"]).alias("h1"), F.xxhash64(F.lit(13), e["key"]).alias("h2")))
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.explode(hashed).alias("e")).select("doc_id", "mark", "e.at", "e.h1", "e.h2")


def line_dedup(docs: DataFrame, least_length: int = 40, least_documents: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every row of ``docs``.

    A line whose key (see ``line_key``) has at least ``least_length`` code points and is
    found in at least ``least_documents`` documents stays only in the document with the
    largest id that holds it, there as often as it stands. Keys are compared by 128 bits of
    hashes. A null or empty text is one empty line; a text that loses all its lines is
    empty. Rows that share an id count as one document, each keeping its own text; a null
    id counts as one document, below all others. Other columns are ignored; an empty table
    gives no rows.

    Hot lines: documents are counted by Spark's two-step distinct count, so a line's rows
    are spread by document before they meet, one row a task; the join back is a plain
    shuffle join, whose skewed side adaptive execution splits. No list spans two documents.
    """
    rows = texts_of(docs, id_col, text_col)
    found = staged(long_lines(rows, least_length), "line-hashes")
    per_document = found.select("h1", "h2", "doc_id").distinct()
    shared = per_document.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_documents).select("h1", "h2", "last")
    # kept, so that the join is between two plain shuffles, of which a hot line's can be split
    shared = staged(shared, "line-shared")
    surplus = found.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = surplus.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.collect_set("at").alias("drops"))

    marked = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    met = marked.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    lines = F.split("text", "\n")
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.array_join(F.transform(kept_at, lambda i: F.get("lines", i)), "\n")
    placed = met.select("doc_id", "text", lines.alias("lines"), "drops")
    return placed.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
