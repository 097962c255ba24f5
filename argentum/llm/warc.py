"""WARC archives: writing, normalising monolithic gzip, and reading back.

``write_monolithic`` makes archives as some crawlers leave them: one gzip
stream around a whole file.  ``normalise`` inflates each such stream once and
rewrites every record as a gzip member of its own, with a sidecar index of
offsets.  ``read`` fetches members by that index.

Archives live in a folder that driver and executors share.  A task writes under a
name of its own, and only names in the committed index are ever read, so a task
that is run again, or twice at once, does no harm.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm.common import fresh_path, salt, salts

CHUNK = 1 << 18
END = "\r\n\r\n"
#: Bytes of members that one task fetches, about, and of payloads that it holds at once.
TASK_BYTES, HELD_BYTES = 64 << 20, 16 << 20
#: Index rows that a task holds at once.
INDEX_ROWS = 10000
INDEX_SCHEMA = "archive string, place long, offset long, length long, record_id string, record_type string, uri string"


def plan_records(
    pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: id, url, payload, bytes, digest, record_type, refers_to.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    largest id is the response; the others revisit it.  Payloads are compared by
    length and SHA-256.  Copies are folded per salt before they meet, so a payload
    that a third of all pages share is no hot key.  Null html is an empty payload.
    A null id is the smallest; repeats of the response's row are responses too.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    n = salts(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("bytes"),
        F.sha1(F.encode("payload", "UTF-8")).alias("digest"),
    )
    keyed = rows.select("*", F.sha2("payload", 256).alias("sha"), salt("id", n).alias("salt"))
    folded = (
        keyed.where(F.col("bytes") >= least)
        .groupBy("sha", "bytes", "salt")
        .agg(F.max("id").alias("top"))
    )
    whole = folded.groupBy("sha", "bytes").agg(F.max("top").alias("response"))
    answer = folded.select("sha", "bytes", "salt").join(whole, ["sha", "bytes"])
    return keyed.join(answer, ["sha", "bytes", "salt"], "left").select(
        "id",
        "url",
        "payload",
        "bytes",
        "digest",
        F.when((F.col("bytes") < least) | F.col("id").eqNullSafe(F.col("response")), "response")
        .otherwise("revisit")
        .alias("record_type"),
        F.when((F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias(
            "refers_to"
        ),
    )


def _record() -> Column:
    """The text of a record, without the blank lines that end it."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
        F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("")),
    )
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Refers-To", F.when(F.col("record_type") == "revisit", urn("refers_to"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(http).cast("string")),
        F.lit("\r\n"),
        http,
    )


def write_monolithic(records: DataFrame, path: str, per_file: int = 20000) -> None:
    """Write planned records as archives of one gzip stream each."""
    (
        records.select(_record().alias("value"))
        .write.option("compression", "gzip")
        .option("lineSep", END)
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return fs, path


def _inflated(stream):
    """Chunks of a gzip file, whether it has one member or many."""
    wide = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if out := wide.decompress(data, CHUNK):
                yield out
            data = wide.unconsumed_tail
            if wide.eof:
                data, wide = wide.unused_data, zlib.decompressobj(31)
    if out := wide.flush():
        yield out


def records_in(chunks):
    """(header bytes, block bytes) of each record; holds one record at a time."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while held[:2] == b"\r\n" or len(held) < 2:
            if len(held) < 2 and not fill(2):
                return
            if held[:2] == b"\r\n":
                del held[:2]
        at = 0
        while (cut := held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(held)
            if not fill(at + 1):
                raise ValueError("archive ends inside a header")
        head = bytes(held[: cut + 4])
        size = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", head)[1])
        if not fill(cut + 4 + size):
            raise ValueError("archive ends inside a block")
        yield head, bytes(held[cut + 4 : cut + 4 + size])
        del held[: cut + 4 + size]


def _field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the archives under source into target; the sidecar index as a DataFrame.

    The index is also kept as ``target/index`` (Parquet) and beside each archive
    as ``.idx`` (a JSON line per record).  An empty folder gives an empty index.  Only one
    record and INDEX_ROWS index rows are held at a time.
    """

    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]

    def rewrite(batches):
        for batch in batches:
            for name in batch["path"]:
                fs, path = _open(name)
                out_uri = f"{target}/{uuid.uuid4().hex}.warc.gz"
                out_fs, out_path = _open(out_uri)
                out_fs.create_dir(out_path.rpartition("/")[0], recursive=True)
                index, place, offset = [], 0, 0
                with (
                    fs.open_input_stream(path, compression=None) as src,
                    out_fs.open_output_stream(out_path, compression=None) as dst,
                    out_fs.open_output_stream(out_path + ".idx", compression=None) as side,
                ):
                    for head, block in records_in(_inflated(src)):
                        wide = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = wide.compress(head + block + END.encode()) + wide.flush()
                        dst.write(member)
                        row = (out_uri, place, offset, len(member), _field(head, "WARC-Record-ID"), _field(head, "WARC-Type"), _field(head, "WARC-Target-URI"))
                        side.write((json.dumps(dict(zip(names, row))) + "\n").encode())
                        index.append(row)
                        place, offset = place + 1, offset + len(member)
                        if len(index) == INDEX_ROWS:
                            yield pd.DataFrame(index, columns=names)
                            index = []
                yield pd.DataFrame(index, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    n = max(1, min(len(files.inputFiles()), salts(spark)))
    files.repartition(n).mapInPandas(rewrite, INDEX_SCHEMA).write.parquet(f"{target}/index")
    return spark.read.parquet(f"{target}/index")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _record_of(whole: bytes) -> tuple:
    cut = whole.index(b"\r\n\r\n") + 4
    head, block = whole[:cut], whole[cut : len(whole) - 4]
    body = block[block.index(b"\r\n\r\n") + 4 :]
    full = _field(head, "WARC-Type") == "response"
    ident = lambda name: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", _field(head, name) or "")) else None
    return (
        ident("WARC-Record-ID"),
        _field(head, "WARC-Target-URI"),
        body if full else None,
        len(body) if full else int(_field(head, "WARC-Payload-Length")),
        hashlib.sha1(body).hexdigest() if full else _field(head, "WARC-Payload-Digest").removeprefix("sha1:"),
        _field(head, "WARC-Type"),
        ident("WARC-Refers-To"),
    )


def _fetch(batches):
    """Members of an archive are read in order; no more than HELD_BYTES and one record are held."""
    for batch in batches:
        members = zip(*(batch.column(k).to_pylist() for k in range(3)))
        for archive, part in itertools.groupby(members, key=lambda m: m[0]):
            fs, path = _open(archive)
            with fs.open_input_file(path) as src:
                rows, held = [], 0
                for _, offset, length in part:
                    src.seek(offset)
                    rows.append(_record_of(zlib.decompress(src.read(length), 31)))
                    held += len(rows[-1][2] or b"")
                    if held > HELD_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)


READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(index: DataFrame) -> DataFrame:
    """The records that an index lists, each fetched at its offset.

    Digest and length of a response are taken from its payload, those of a
    revisit, which has none, from its header.  Runs of about HELD_BYTES of an archive are dealt to
    as many tasks as the archives have TASK_BYTES.  An empty index gives no rows.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(salts(index.sparkSession), -(-total // TASK_BYTES))
    rows = index.select("archive", "offset", "length", F.floor(F.col("offset") / HELD_BYTES).alias("run"))
    rows = rows.repartition(n, "archive", "run").sortWithinPartitions("archive", "offset")
    return rows.drop("run").mapInArrow(_fetch, READ_SCHEMA)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Plan, write, normalise and read back the records of pages: a row for each.

    Null and empty html, null and repeated ids: see ``plan_records``.  Html may be of any length;
    an empty table gives no rows; other columns are ignored.  The archives stay in the shared
    folder until ``common.sweep``.
    """
    spark = pages.sparkSession
    root = fresh_path(spark, "warc")
    write_monolithic(plan_records(pages, **columns), f"{root}/crawl")
    return read(normalise(spark, f"{root}/crawl", f"{root}/archives"))
