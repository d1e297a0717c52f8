"""WARC archives: written as whole-file gzip streams, then made seekable.

The normaliser inflates a whole-file stream once, writes every record as a gzip member of
its own, and puts a sidecar beside the archive: one line per record with its offset and
length. Any record can then be read by one seek.

Files go below a folder that all executors share (any file system that pyarrow opens).
Their names are new in every attempt, and only names that a finished task reported are
used, so a lost executor or a repeated task leaves at most unused files.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.workspace import new_path, written

#: Payloads below this size are never revisits.
LEAST_SHARED = 1000
#: Uncompressed bytes after which a new archive begins.
ROLL_BYTES = 64 << 20
#: Bytes of an archive whose records one reading group takes.
BLOCK_BYTES = 8 << 20
#: Most tasks that archives are dealt over.
MOST_TASKS = 10_000
_READ = 1 << 20


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


# --- records --------------------------------------------------------------------------
def with_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is
    a response (all of them, if rows share it), the others revisit it and carry no payload. A
    group without any page_id has nothing to refer to and stays responses. A missing html
    is an empty payload. The group's key is counted before anything moves, and rows meet
    their group in a join that Spark can split where one payload is very frequent.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    # Written, so that the join gets both sides freshly dealt and can split a hot payload.
    shared = written(
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"))
        .agg(F.max("page_id").alias("newest"), F.count("*").alias("rows"))
        .filter("rows > 1 and newest is not null"),
        "shared-payloads",
    )
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    met = rows.join(shared, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("n")), "left")
    return met.select(
        "page_id", "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("newest")).alias("refers_to"),
    )


def _line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def make_record(row: dict, date: str) -> bytes:
    """One record as it stands in an archive. ``X-Payload-Length`` is the length of the full payload."""
    name = lambda i: "<urn:page:%s>" % ("" if i is None else i)
    payload = row["payload"] or b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {name(row['page_id'])}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['url'])}")
    if row["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {name(row['refers_to'])}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record must begin with its WARC version")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def parse_record(record: bytes) -> dict:
    """The fields of a record; a response whose payload does not fit its digest is an error."""
    cut = record.index(b"\r\n\r\n")
    head = _headers(record[:cut])
    payload = record[cut + 4 : cut + 4 + int(head["content-length"])]
    number = lambda name: int(name[10:-1]) if name and name != "<urn:page:>" else None
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {head['warc-record-id']} does not fit its digest")
    url = head.get("warc-target-uri")
    return {
        "page_id": number(head["warc-record-id"]),
        "url": None if url is None else _unline(url),
        "record_type": kind,
        "refers_to": number(head.get("warc-refers-to")),
        "payload_digest": digest,
        "payload_bytes": int(head["x-payload-length"]),
        "payload": payload if kind == "response" else None,
    }


# --- writing and normalising ----------------------------------------------------------
def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", roll: int = ROLL_BYTES) -> DataFrame:
    """Write the rows of :func:`with_types` as ``.warc.gz`` files, each one whole gzip stream.
    Returns the stored list of archives: ``archive``, ``records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name = out = packed = None
        size = count = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    packed = gzip.GzipFile(fileobj=out, mode="wb", mtime=0)
                    size = count = 0
                record = make_record(row, date)
                packed.write(record)
                size, count = size + len(record), count + 1
                if size >= roll:
                    packed.close()
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64())})
        if out is not None:
            packed.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64())})

    columns = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")
    return written(records.select(*columns).mapInArrow(run, "archive string, records long"), "archives")


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Bytes of a gzip file, one member or many, without holding the whole."""
    unpack = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield unpack.decompress(chunk)
            chunk = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
    if rest := unpack.flush():
        yield rest


def split_records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of bytes; holds one record and one part at most."""
    held, need = bytearray(), None
    for part in parts:
        held += part
        start = 0
        while True:
            if need is None:
                cut = held.find(b"\r\n\r\n", start)
                if cut < 0:
                    break
                need = cut + 4 - start + int(_headers(bytes(held[start:cut]))["content-length"]) + 4
            if len(held) - start < need:
                break
            yield bytes(held[start : start + need])
            start, need = start + need, None
        del held[:start]
    if held:
        raise ValueError("the archive ends within a record")


def normalise(archives: DataFrame, folder: str, into: str, level: int = 6) -> DataFrame:
    """Rewrite whole-file streams in ``folder`` record by record below ``into``, each with a sidecar.
    Returns the stored list of new archives: ``archive``, ``sidecar``, ``records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, source_root = _open(folder)
        target, root = _open(into)
        target.create_dir(root, recursive=True)
        for batch in batches:
            for old in batch.column("archive").to_pylist():
                name = uuid.uuid4().hex
                offset = count = 0
                with (
                    source.open_input_stream(f"{source_root}/{old}", compression=None) as stream,
                    target.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out,
                    target.open_output_stream(f"{root}/{name}.offsets", compression=None) as side,
                ):
                    for record in split_records(inflated(iter(lambda: stream.read(_READ), b""))):
                        member = gzip.compress(record, level, mtime=0)
                        out.write(member)
                        side.write(b"%d %d\n" % (offset, len(member)))
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_pydict(
                    {"archive": [f"{name}.warc.gz"], "sidecar": [f"{name}.offsets"], "records": pa.array([count], pa.int64())}
                )

    dealt = _dealt(archives.select("archive"))
    return written(dealt.mapInArrow(run, "archive string, sidecar string, records long"), "normalised")


def _dealt(archives: DataFrame) -> DataFrame:
    """One archive per task where possible: their names are too small to be told apart by size."""
    return archives.repartition(max(1, min(archives.count(), MOST_TASKS)))


# --- reading --------------------------------------------------------------------------
def read_offsets(normalised: DataFrame, folder: str) -> DataFrame:
    """The sidecars as a table: ``archive``, ``offset``, ``length``, one row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist()):
                with system.open_input_stream(f"{root}/{sidecar}", compression=None) as stream:
                    held = b""
                    for chunk in iter(lambda: stream.read(_READ), b""):
                        lines = (held + chunk).split(b"\n")
                        held = lines.pop()
                        pairs = [x.split() for x in lines]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "archive": pa.array([archive] * len(pairs), pa.string()),
                                "offset": pa.array([int(a) for a, _ in pairs], pa.int64()),
                                "length": pa.array([int(b) for _, b in pairs], pa.int64()),
                            }
                        )

    return _dealt(normalised.select("archive", "sidecar")).mapInArrow(run, "archive string, offset long, length long")


_FIELDS = {
    "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(),
}


def read_records(offsets: DataFrame, folder: str, tasks: int, payloads: bool = True) -> DataFrame:
    """The records that ``offsets`` (archive, offset, length) points to, by seeking. Without ``payloads`` the
    payloads are checked against their digests but not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name = file = None
        for batch in batches:
            found, held = [], 0
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if file is not None:
                        file.close()
                    name = row["archive"]
                    file = system.open_input_file(f"{root}/{name}")
                file.seek(row["offset"])
                record = parse_record(zlib.decompress(file.read(row["length"]), 31))
                held += len(record["payload"] or b"")
                found.append(record)
                if held > 16 << 20:
                    yield _batch(found, payloads)
                    found, held = [], 0
            yield _batch(found, payloads)
        if file is not None:
            file.close()

    block = (F.col("offset") / BLOCK_BYTES).cast("long")
    dealt = offsets.repartition(tasks, "archive", block).sortWithinPartitions("archive", "offset")
    kinds = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    return dealt.mapInArrow(run, kinds + ", payload binary" * payloads)


def _batch(records: list[dict], payloads: bool) -> pa.RecordBatch:
    fields = {k: v for k, v in _FIELDS.items() if payloads or k != "payload"}
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in records], t) for k, t in fields.items()})


def archived(pages: DataFrame, least: int = LEAST_SHARED, roll: int = ROLL_BYTES, payloads: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, normalise them, and read every record back.

    Missing urls are left out of a record and come back missing, as do missing page ids.
    Repeated rows give repeated records; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    whole, single = new_path(spark, "warc-whole"), new_path(spark, "warc")
    archives = write_archives(with_types(pages, least), whole, roll=roll)
    normalised = normalise(archives, whole, single)
    tasks = max(normalised.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_records(read_offsets(normalised, single), single, min(tasks, MOST_TASKS), payloads)
