"""WARC archives: a normaliser for archives gzipped as one stream.

Some archives are one gzip stream over all their records, which cannot be
read from the middle. The normaliser inflates each such file once, as a
stream, and writes every record as a gzip member of its own, next to a
sidecar index (record, offset, length) that lets any record be read alone.
While it rewrites, responses whose payload another record holds already can
become revisit records.

    write_archives  rows to whole-stream archives, one per task
    survey          the record list of archives from anywhere, with digests
                    taken while they are inflated
    plan_revisits   which records keep their payload: Spark joins over the
                    record list, without payloads
    normalise       whole-stream archives to member-wise ones with an index,
                    one task per archive
    read_records    records back from index ranges, dealt by their bytes

Archives go through ``pyarrow.fs`` to the shared folder, in a file named anew
by each attempt of a task; only files that a finished task reports are read,
so a lost executor or a second attempt leaves nothing but an unread file.
Every report is stored before the next step reads it. A record is held in
memory while it is handled, a file never.

Records that aren't changed are rewritten byte by byte. Header names are read
in any case, values with or without blanks, folded lines as one. Only HTTP
responses have a payload apart from their block; of all other records, and of
a block without an HTTP header, the payload is the block.

Defined results: a null or empty payload is an empty block; repeated rows are
records of their own (of equal id and payload the first written is the
response); ids are of any type, numbers in the order of numbers, before them
text; a null id is the last choice for a response and reads back as null; very
long payloads are read whole; columns other than the three named take no part,
whatever their names; an empty table makes no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, shared_path, store

VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNK, _LEVEL, _GZIP = 1 << 20, 3, 31
#: Bytes read at once when neighbouring records are wanted.
_RANGE = 1 << 22
#: Rows given out at a time.
_ROWS = 10_000

WRITTEN = "file string, nth long, record_id string, page_id string, payload_bytes long, payload_digest string, record_type string"
INDEX = "file string, nth long, page_id string, offset long, length long"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _open(path: str):
    """(file system, path in it) of a shared path."""
    if urlparse(path).scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _urn(page_id) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _page(name: str | None):
    """The id that a record's name stands for; a foreign name stands for itself."""
    if name is None or name == "<urn:page>":
        return None
    bare = name.strip().removeprefix("<").removesuffix(">")
    return unquote(bare.removeprefix("urn:page:")) if bare.startswith("urn:page:") else bare


def _id(value):
    """A cell of a pandas id column: text, or None."""
    return value if isinstance(value, str) else None


def digest_of(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def encode(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return VERSION + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def response(page_id, url, payload: bytes) -> bytes:
    """A response record. The digest stands in the header as base 32 of SHA-1."""
    b32 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = {"WARC-Target-URI": " ".join(url.split())} if url else {}
    return encode(
        {"WARC-Type": "response", "WARC-Record-ID": _urn(page_id)} | target
        | {"WARC-Payload-Digest": f"sha1:{b32}", "Content-Type": "application/http;msgtype=response"},
        HTTP + payload,
    )


class Record(NamedTuple):
    head: bytes  # the header as it stands, with its empty line
    headers: dict[str, str]  # by lower-case name
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "").lower()

    @property
    def payload_at(self) -> int:
        """Where in the block the payload begins."""
        http = self.headers.get("content-type", "").lower().startswith("application/http")
        end = self.block.find(b"\r\n\r\n") if http else -1
        return end + 4 if end >= 0 else 0

    def whole(self) -> bytes:
        return self.head + self.block + b"\r\n\r\n"


def revisit(record: Record, refers_to) -> bytes:
    """The revisit record in place of a response: its HTTP header stays, its
    payload is named by digest, by the record that has it and by its size."""
    head, payload = record.block[: record.payload_at], record.block[record.payload_at :]
    names = ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "Content-Type")
    kept = {k: record.headers[k.lower()] for k in names if k.lower() in record.headers}
    b32 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return encode(
        {"WARC-Type": "revisit", "WARC-Profile": PROFILE} | ({"WARC-Refers-To": refers_to} if refers_to else {}) | kept
        | {"WARC-Payload-Digest": f"sha1:{b32}", "X-Payload-Length": str(len(payload))}, head,
    )


def records(stream) -> Iterator[Record]:
    """The records of an inflated stream of byte chunks."""
    held, at, chunks = b"", 0, iter(stream)

    def more(least: int) -> bool:
        """Holds ``least`` bytes from the record's start, if there are so many."""
        nonlocal held, at
        parts, have = [held[at:]], len(held) - at
        while have < least and (got := next(chunks, b"")):
            parts.append(got)
            have += len(got)
        held, at = b"".join(parts), 0
        return have >= least

    while True:
        # Empty lines between records, however many.
        while at < len(held) and held[at] in b"\r\n" or at >= len(held) and more(1):
            if held[at] not in b"\r\n":
                break
            at += 1
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more(len(held) - at + 1):
                if held[at:].strip():
                    raise ValueError("the archive ends within a record's header")
                return
        lines = re.sub(r"\r\n[ \t]+", " ", held[at:end].decode("utf-8", "surrogateescape")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a record without its length")
        head, length = end + 4 - at, int(headers["content-length"])
        if len(held) - at < head + length and not more(head + length):
            raise ValueError("the archive ends within a record's block")
        yield Record(held[at : at + head], headers, held[at + head : at + head + length])
        at += head + length


def inflated(file) -> Iterator[bytes]:
    """Inflated chunks of a gzip file of one or several members."""
    inflate = zlib.decompressobj(_GZIP)
    while raw := file.read(_CHUNK):
        while raw:
            out = inflate.decompress(raw, _CHUNK)
            if out:
                yield out
            if inflate.eof:
                raw, inflate = inflate.unused_data, zlib.decompressobj(_GZIP)
            else:
                raw = inflate.unconsumed_tail
    while out := inflate.decompress(inflate.unconsumed_tail, _CHUNK):
        yield out


def member(record: bytes) -> bytes:
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes one whole-stream archive per task; returns its records in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for f in frames:
            if not len(f):
                continue
            if out is None:
                where, inside = _open(folder)
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                where.create_dir(inside, recursive=True)
                out, z, nth = where.open_output_stream(f"{inside}/{name}", compression=None), zlib.compressobj(_LEVEL, zlib.DEFLATED, _GZIP), 0
            rows = []
            for page_id, url, html in zip(f["page_id"], f["url"], f["payload"], strict=True):
                page_id, payload = _id(page_id), as_text(html).encode("utf-8", "surrogatepass")
                out.write(z.compress(response(page_id, as_text(url), payload)))
                rows.append((name, nth, _urn(page_id), page_id, len(payload), digest_of(payload), "response"))
                nth += 1
            yield _frame(rows, WRITTEN)
        if out is not None:
            out.write(z.flush())
            out.close()

    slim = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    return store(slim.mapInPandas(run, WRITTEN), "warc-written")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    types = {"long": "Int64", "string": object, "binary": object}
    columns = [x.split(" ") for x in schema.split(", ")]
    out = pd.DataFrame(rows, columns=[c for c, _ in columns], dtype=object)
    return out.astype({c: types[t] for c, t in columns})


def _one_a_task(files: DataFrame, n: int) -> DataFrame:
    """Dealt by file, about one file a task: a given number isn't merged by
    the bytes of these small rows, and neighbours in the order of names don't
    meet by chance as hashes do."""
    return files.repartitionByRange(max(1, n), "file")


def survey(files: DataFrame, source: str) -> DataFrame:
    """The records in the archives of ``source`` named by ``files`` (file): what
    ``write_archives`` returns, for archives from anywhere."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, inside = _open(source)
        for f in frames:
            for name in f["file"]:
                with where.open_input_stream(f"{inside}/{name}", compression=None) as raw:
                    rows = []
                    for nth, r in enumerate(records(inflated(raw))):
                        payload = r.block[r.payload_at :]
                        kind = r.kind if r.payload_at or r.kind != "response" else "block"
                        own = r.headers.get("warc-record-id")
                        rows.append((name, nth, own, _page(own), len(payload), digest_of(payload), kind))
                        if len(rows) == _ROWS:
                            yield _frame(rows, WRITTEN)
                            rows = []
                    yield _frame(rows, WRITTEN)

    files = files.select("file").where("file IS NOT NULL").distinct()
    return store(_one_a_task(files, files.count()).mapInPandas(run, WRITTEN), "warc-survey")


def plan_revisits(written: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``written`` with ``refers_to`` (a record_id) and ``is_revisit``: of the responses with
    equal payloads of at least ``min_bytes`` bytes, all but the one of the
    largest id. The groups are stored before the join, so that rows of a
    frequent payload can be split over tasks."""
    fit = (F.col("payload_bytes") >= min_bytes) & (F.col("record_type") == "response")
    rank = F.struct(F.col("page_id").try_cast("long").alias("number"), "page_id", F.struct((-F.col("nth")).alias("nth"), "file", "record_id").alias("at"))
    groups = store(written.where(fit).groupBy("payload_digest").agg(F.max(rank).alias("best"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "best"), "warc-groups")
    best = F.col("best")
    other = (F.col("file") != best["at"]["file"]) | (F.col("nth") != -best["at"]["nth"])
    joined = written.join(groups, "payload_digest", "left").withColumn("is_revisit", best.isNotNull() & fit & other)
    return joined.withColumn("refers_to", F.when(F.col("is_revisit"), best["at"]["record_id"])).drop("best")


def normalise(planned: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrites each whole-stream archive of ``source`` as one of ``folder``
    with a gzip member per record and a sidecar index ``<archive>.idx`` (tab
    separated: record, id, offset, length); returns the index rows.

    ``planned`` has a row per record (``plan_revisits``), read side by side
    with the archive in record order. A table of archive names alone (file)
    has every record rewritten as it is.
    """
    each = "nth" in planned.columns

    def rewritten(name: str, plan) -> Iterator[tuple]:
        (from_fs, from_dir), (to_fs, to_dir) = _open(source), _open(folder)
        to_fs.create_dir(to_dir, recursive=True)
        to_name, at = f"{name.removesuffix('.gz').removesuffix('.warc')}-{uuid.uuid4().hex[:8]}.warc.gz", 0
        with (
            from_fs.open_input_stream(f"{from_dir}/{name}", compression=None) as raw,
            to_fs.open_output_stream(f"{to_dir}/{to_name}", compression=None) as out,
            to_fs.open_output_stream(f"{to_dir}/{to_name}.idx", compression=None) as index,
        ):
            for nth, record in enumerate(records(inflated(raw))):
                is_revisit, refers_to = next(plan) if plan else (False, None)
                data = member(revisit(record, refers_to) if is_revisit else record.whole())
                out.write(data)
                page_id = _page(record.headers.get("warc-record-id"))
                index.write(f"{nth}\t{'' if page_id is None else page_id}\t{at}\t{len(data)}\n".encode("utf-8", "surrogateescape"))
                yield to_name, nth, page_id, at, len(data)
                at += len(data)
            if plan and next(plan, None) is not None:
                raise ValueError(f"{name} has fewer records than its plan")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = ((x for f in frames for x in zip(f["file"], f["is_revisit"], f["refers_to"], strict=True)) if each else ((x, False, None) for f in frames for x in f["file"]))
        rows = []
        for name, own in groupby(lines, key=lambda x: x[0]):
            plan = ((bool(x[1]), _id(x[2])) for x in own) if each else None
            for row in rewritten(name, plan):
                rows.append(row)
                if len(rows) == _ROWS:
                    yield _frame(rows, INDEX)
                    rows = []
        yield _frame(rows, INDEX)

    files = planned.select("file").distinct().count()
    if each:
        dealt = _one_a_task(planned.select("file", "nth", "is_revisit", "refers_to"), files).sortWithinPartitions("file", "nth")
    else:
        dealt = _one_a_task(planned.select("file").distinct(), files)
    return store(dealt.mapInPandas(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = False, task_bytes: int = 1 << 24) -> DataFrame:
    """Records of the index rows. Archives are cut into runs of neighbouring
    members and tasks get runs of about ``task_bytes`` together, whatever few
    bytes their index rows have. Each task reads its members by offset,
    neighbours with one request. A response's digest and size are taken from
    its payload, and a digest unlike the header's is an error; a revisit's are
    those its header names."""
    run_bytes = max(1, task_bytes // 8)
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // run_bytes), max(-(-total // task_bytes), index.sparkSession.sparkContext.defaultParallelism)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, inside = _open(folder)
        name, file = None, None
        for f in frames:
            rows = []
            f = f.sort_values(["file", "offset"])
            base, held = 0, b""
            for to_name, offset, length in zip(f["file"], f["offset"], f["length"], strict=True):
                if to_name != name:
                    if file is not None:
                        file.close()
                    name, held = to_name, b""
                    file = where.open_input_file(f"{inside}/{name}")
                    end = file.size()
                if not (base <= offset and offset + length <= base + len(held)):
                    base = int(offset)
                    held = file.read_at(min(max(int(length), _RANGE), end - base), base)
                data = zlib.decompress(held[offset - base : offset - base + length], _GZIP)
                rows.append(_parsed(data, with_payload))
            if rows:
                yield _frame(rows, RECORD)
        if file is not None:
            file.close()

    run_of = F.floor(F.col("offset") / run_bytes).alias("run")
    dealt = index.select("file", "offset", "length", run_of).repartition(tasks, "file", "run").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(run, RECORD)


def _named_digest(record: Record) -> str | None:
    """The payload's SHA-1 that the header names, in hex; None if another kind."""
    kind, _, value = record.headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex() if len(value) == 32 else None


def _parsed(data: bytes, with_payload: bool) -> tuple:
    (record,) = records([data])
    payload, named = record.block[record.payload_at :], _named_digest(record)
    size, digest = len(payload), digest_of(payload)
    if record.kind == "revisit":
        size, digest = (int(n) if (n := record.headers.get("x-payload-length", "")).isdigit() else None), named
    elif record.kind == "response" and named not in (None, digest):
        raise ValueError(f"the payload of {record.headers.get('warc-record-id')} has another digest than its header")
    refers_to = record.headers.get("warc-refers-to")
    return (
        _page(record.headers.get("warc-record-id")), record.headers.get("warc-target-uri"), size, digest, record.kind, _page(refers_to),
        payload if with_payload and record.kind != "revisit" else None,
    )


def round_trip(pages: DataFrame, min_bytes: int = 1000, with_payload: bool = False) -> DataFrame:
    """``pages`` (page_id, url, html) written as whole-stream archives,
    normalised and read back, one record per row; ids in their own type."""
    spark = pages.sparkSession
    whole, split = shared_path(spark, "warc-whole"), shared_path(spark, "warc-members")
    planned = plan_revisits(write_archives(pages, whole), min_bytes)
    kind = dict(pages.dtypes)["page_id"]
    out = read_records(normalise(planned, whole, split), split, with_payload)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
