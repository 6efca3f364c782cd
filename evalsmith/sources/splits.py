"""One large quoted CSV (S2) or JSON array (S1) read by many tasks.

A file is cut by byte range into blocks, as Spark cuts any text file, and each
block into pieces at a one-character separator (line feed, or ``}``). Whether a
separator ends a record depends on what stands before it: a line feed within
quotes, or a ``}`` within a string or a deeper object, doesn't. What a piece
does to that state is one of two small functions, computed by expressions:

* state 0 (outside) or 1 (inside quotes or a string) at its start
  -> the state at its end, and by how much the depth of brackets changes.

Such functions compose, so a block is one too. ``_block_step`` composes a
block's, ``_entries`` runs over the blocks of a file (one row a block) to find
the state each begins in, and ``_records`` then cuts every block at its true
record ends. A record over the edge of blocks leaves a fragment in each; these
meet in a grouping by the block in which the record begins. A task holds one
record, or the fragment of one, at a time.

Order rests on the file's name, the byte where a block starts and Spark's row
order within a block, not on how blocks are packed into tasks. Files in a
format that can't be split (gzip) are one block each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store

_STEP = "file string, block long, x0 int, d0 long, m0 long, x1 int, d1 long, m1 long"
_ENTRY = "file string, block long, state int, depth long, opened long, open_at_end long"
_RECORD = "file string, opened long, block long, seq long, first boolean, whole boolean, text string"
_FAR = 1 << 60  # depth of a block without a separator outside quotes

# A quoted field that is open at the end of a line: whole fields, each with its
# comma, then a quote whose closing one doesn't come. Possessive: no backtracking.
_OPEN_FIELD = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+"[^"]*+(?:""[^"]*+)*+\z'
_JSON_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'


def _csv_step(text: Column) -> list[Column]:
    """State 1: within a quoted field. Depth stays zero."""
    inside = F.concat(F.lit('"'), text)
    zero = F.lit(0).cast("long")
    return [text.rlike(_OPEN_FIELD).cast("int"), zero, inside.rlike(_OPEN_FIELD).cast("int"), zero]


def _json_step(text: Column) -> list[Column]:
    """State 1: within a string. Depth counts brackets outside strings."""

    def end(t: Column) -> list[Column]:
        bare = F.regexp_replace(t, _JSON_STRING, "")
        outside = F.substring_index(bare, '"', 1)
        brackets = lambda pair: F.length(outside) - F.length(F.translate(outside, pair, ""))
        return [bare.contains('"').cast("int"), (brackets("[{") - brackets("]}")).cast("long")]

    return end(text) + end(F.concat(F.lit('"'), text))


def _block_step(drop: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The function of each block: end state, change of depth and the least
    depth just after a separator outside quotes, for both states at its start.
    ``drop`` is what such a separator takes off the depth (1 for ``}``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for pdf in batches:
            done = []
            for file, block, x0, d0, x1, d1 in pdf.itertuples(index=False, name=None):
                first = at != (file, block)
                if first:
                    done += [(*at, *held)] if at else []
                    at, held = (file, block), [0, 0, _FAR, 1, 0, _FAR]
                for o in (0, 3):
                    # A separator stands before every piece but a file's first.
                    if held[o] == 0 and not (first and block == 0):
                        held[o + 1] -= drop
                        held[o + 2] = min(held[o + 2], held[o + 1])
                    held[o + 1] += d1 if held[o] else d0
                    held[o] = x1 if held[o] else x0
            yield pd.DataFrame(done, columns=["file", "block", "x0", "d0", "m0", "x1", "d1", "m1"])
        if at:
            yield pd.DataFrame([(*at, *held)], columns=["file", "block", "x0", "d0", "m0", "x1", "d1", "m1"])

    return run


def _entries(base: int, strict: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The state, depth and open record with which each block of a file
    begins. ``strict``: the file must end outside strings at depth zero."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, state, depth, opened = [], 0, 0, 0
        for file, block, x0, d0, m0, x1, d1, m1 in pdf.sort_values("block").itertuples(index=False, name=None):
            out.append([file, block, state, depth, opened])
            change, least, state = (d1, m1, x1) if state else (d0, m0, x0)
            opened = block if depth + least == base else opened
            depth += change
        if strict and (state or depth):
            raise ValueError(f"{pdf['file'].iloc[0]}: not a whole JSON array")
        return pd.DataFrame(out, columns=["file", "block", "state", "depth", "opened"]).assign(open_at_end=opened)

    return run


def _records(base: int, drop: int, sep: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Records and fragments of each block, ``whole`` where a separator within
    the block ends a record that began in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, text, seq, opened, state, depth, since, first = None, [], 0, 0, 0, 0, False, False
        columns = ["file", "opened", "block", "seq", "first", "whole", "text"]
        for pdf in batches:
            done = []
            for file, block, piece, x0, d0, x1, d1, s, d, o in pdf.itertuples(index=False, name=None):
                new = at != (file, block)
                if new:
                    if at and text:
                        done.append((at[0], opened, at[1], seq, first, False, sep.join(text)))
                    at, text, seq, state, depth, opened, since = (file, block), [], 0, s, d, o, False
                    first = block == 0
                if not (new and block == 0) and state == 0:
                    depth -= drop
                    if depth == base:
                        if text:
                            done.append((file, opened, block, seq, first, since or block == 0, sep.join(text)))
                        first, since, opened, text, seq = False, True, block, [], seq + 1
                text.append(piece)
                depth += d1 if state else d0
                state = x1 if state else x0
            yield pd.DataFrame(done, columns=columns)
        if at and text:
            yield pd.DataFrame([(at[0], opened, at[1], seq, first, False, sep.join(text))], columns=columns)

    return run


def record_texts(spark: SparkSession, path: str, sep: str, step: Callable[[Column], list[Column]], base: int, drop: int, strict: bool) -> DataFrame:
    """(file, opened, seq, first, ended, text): the text of each record, with
    what follows the last one. ``first``: the first of its file; ``ended``: by
    a separator rather than by the end of the file. The order in a file is that of
    (opened, seq)."""
    raw = spark.read.option("lineSep", sep).text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    steps = [c.alias(n) for c, n in zip(step(F.col("text")), ("x0", "d0", "x1", "d1"))]
    blocks = store(pieces.select("file", "block", *steps).mapInPandas(_block_step(drop), _STEP), "split-blocks")
    # One row a block: a file's bytes over maxPartitionBytes.
    entries = store(blocks.groupBy("file").applyInPandas(_entries(base, strict), _ENTRY), "split-entries")
    placed = pieces.select("file", "block", "text", *steps).join(F.broadcast(entries.drop("open_at_end")), ["file", "block"])
    placed = placed.select("file", "block", "text", "x0", "d0", "x1", "d1", "state", "depth", "opened")
    cut = store(placed.mapInPandas(_records(base, drop, sep), _RECORD), "split-records")
    whole = cut.where("whole").select("file", "opened", "seq", "first", F.lit(True).alias("ended"), "text")
    parts = cut.where("NOT whole").groupBy("file", "opened").agg(
        F.sort_array(F.collect_list(F.struct("block", "seq", "first", "text"))).alias("parts")
    )
    # One record of a file ends with the file and not with a separator. Every file has a block 0.
    parts = parts.join(F.broadcast(entries.where("block = 0").select("file", "open_at_end")), "file")
    joined = parts.select(
        "file", "opened", F.lit(_FAR).alias("seq"), F.col("parts")[0]["first"].alias("first"),
        (F.col("opened") < F.col("open_at_end")).alias("ended"), F.array_join("parts.text", sep).alias("text"),
    )
    return whole.unionByName(joined)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S2 by byte range: what ``read_table_csv`` reads (header, line feeds
    within quotes, doubled quotes, FAILFAST), with many tasks a file."""
    rows = record_texts(spark, path, "\n", _csv_step, 0, 0, False).where(~F.col("first"))
    text = F.regexp_replace("text", r"\r$", "")
    rows = rows.select(text.alias("text")).where(F.col("text") != "")
    if not isinstance(schema, str):
        quoted = lambda name: "`" + name.replace("`", "``") + "`"
        schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    options = {"escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    return rows.select(F.from_csv("text", schema, options).alias("r")).select("r.*")


def read_split_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S1 by byte range: the objects of a JSON array, as ``read_records``
    reads them, with many tasks a file. A file that isn't one array of objects,
    or an object that doesn't fit the schema, fails the job."""
    rows = record_texts(spark, path, "}", _json_step, 1, 1, True)
    lead = F.when(F.col("first"), r"^\s*\[\s*").otherwise(r"^\s*,\s*")
    ok = F.when(F.col("ended"), F.regexp_like("text", F.concat(lead, F.lit(r"\{")))).otherwise(
        F.regexp_like("text", F.when(F.col("first"), r"^\s*\[\s*\]\s*$").otherwise(r"^\s*\]\s*$"))
    )
    rows = rows.select("first", "ended", "text", "file", ok.alias("ok")).where("ended OR NOT ok")
    text = F.concat(F.regexp_replace("text", r"^\s*[\[,]\s*", ""), F.lit("}"))
    checked = F.when(F.col("ok"), text).otherwise(F.raise_error(F.concat(F.lit("not an array of objects: "), "file")))
    return rows.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
