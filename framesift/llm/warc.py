"""Web archives (WARC 1.1): writing, normalising whole-file gzip, and reading by a sidecar index.

An archive that is one gzip stream can only be read from its start. The
normaliser inflates such a file once, as a stream, rewrites every record as a
gzip member of its own and writes the members' offsets to an index beside the
file, from which any record can be read by itself.

Archives are files below one folder. Tasks reach it through `pyarrow.fs`, by
its URI. Every attempt of a task writes files of its own name; only those that
the finished attempt lists are read later.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ROW, keyed, text_batches, write_shared
from framesift.operators.keys import fits_broadcast
from framesift.session import new_shared_path

#: Payloads of at least so many bytes are looked for again; smaller ones are always stored.
REVISIT_BYTES = 1000

#: Bytes read or inflated at a time, and payload after which a task begins another archive.
CHUNK, ARCHIVE_BYTES = 1 << 20, 1 << 30

GZIP, LEVEL = 31, 6

#: Written to every record unless the caller knows better: the tables hold no time of capture.
CAPTURED = "1970-01-01T00:00:00Z"

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, n_records long, n_bytes long"


def _record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}')}>"


def _field(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unfield(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def build_record(row: int, key: str | None, url: str | None, payload: bytes, of_row: int | None, of_key: str | None) -> bytes:
    """A response record, or with ``of_row`` a revisit, which has the HTTP header but no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "response" if of_row is None else "revisit"),
        ("WARC-Record-ID", _record_id(row)),
        ("WARC-Date", CAPTURED),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _field(url)))
    if key is not None:
        fields.append(("X-Page-Id", _field(key)))
    if of_row is None:
        block += payload
    else:
        fields += [("WARC-Refers-To", _record_id(of_row)), ("WARC-Profile", _PROFILE)]
        if of_key is not None:
            fields.append(("X-Refers-To-Page-Id", _field(of_key)))
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields of a record, names in lower case."""
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of each record in a stream. Holds one record and a chunk."""
    held, done = bytearray(), False

    def fill(size: int) -> bool:
        nonlocal done
        while len(held) < size and not done:
            chunk = next(chunks, None)
            done = chunk is None
            held.extend(chunk or b"")
        return len(held) >= size

    while fill(1):
        searched, end = 0, -1
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("archive ends within a record's header")
        fields = parse_head(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("archive ends within a record")
        yield fields, bytes(held[:size])
        del held[:size]


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The contents of a gzip stream, of one member or many, in bounded chunks."""
    member = zlib.decompressobj(GZIP)
    begun = False
    while data := stream.read(chunk):
        while data:
            begun = True
            yield member.decompress(data, chunk)
            data = member.unconsumed_tail
            if member.eof:
                data = member.unused_data
                member, begun = zlib.decompressobj(GZIP), False
    if begun and not member.eof:
        raise ValueError("gzip stream ends early")


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _open(folder: str) -> tuple[fs.FileSystem, str, str]:
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    return system, path, folder.rstrip("/")


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "n_records", "n_bytes"]
    kinds = [pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_archives(records: DataFrame, folder: str, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (row key, _key, _url, _payload, _of_row, _of_key) as archives, each one gzip stream.

    Returns (path, n_records, n_bytes), written out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path, uri = _open(folder)
        name, stream, done = "", None, []
        count = size = 0

        def close() -> None:
            stream.write(packer.flush())
            stream.close()
            done.append((f"{uri}/{name}", count, size))

        for batch in batches:
            columns = [batch[c] for c in (ROW, "_key", "_url", "_payload", "_of_row", "_of_key")]
            for values in zip(*columns):
                if stream is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{path}/{name}", compression=None, buffer_size=CHUNK)
                    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                record = build_record(*(v.as_py() for v in values))
                stream.write(packer.compress(record))
                count, size = count + 1, size + len(record)
                if size >= archive_bytes:
                    close()
                    stream = None
        if stream is not None:
            close()
        if done:
            yield _manifest(done)

    return write_shared(records.mapInArrow(run, _MANIFEST), "archives")


def normalise_archives(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite each archive of (path, ...) with a gzip member per record, and its index beside it.

    The index has a line of JSON per record: offset, length, type, id and URI.
    Returns (path, n_records, n_bytes) of the new archives, written out; the
    index of ``path`` is ``path`` + ".idx".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, to, uri = _open(folder)
        for batch in batches:
            for source in batch["path"].to_pylist():
                own, place = _file_system(source)
                name = f"{uuid.uuid4().hex}.warc.gz"
                offset = count = 0
                with (
                    own.open_input_stream(place, compression=None) as stream,
                    system.open_output_stream(f"{to}/{name}", compression=None, buffer_size=CHUNK) as out,
                    system.open_output_stream(f"{to}/{name}.idx", compression=None, buffer_size=CHUNK) as index,
                ):
                    for fields, record in split_records(inflate(stream)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        line = {
                            "offset": offset,
                            "length": len(member),
                            "type": fields.get("warc-type"),
                            "id": fields.get("warc-record-id"),
                            "uri": fields.get("warc-target-uri"),
                        }
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield _manifest([(f"{uri}/{name}", count, offset)])

    tasks = max(1, archives.count())  # files, so one task each
    dealt = archives.select("path").repartitionByRange(tasks, "path")
    return write_shared(dealt.mapInArrow(run, _MANIFEST), "normalised")


def read_member(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The fields and the block of one record of a normalised archive."""
    system, place = _file_system(path)
    with system.open_input_file(place) as file:
        file.seek(offset)
        return _open_member(file.read(length))


def _open_member(member: bytes) -> tuple[dict[str, str], bytes]:
    record = zlib.decompress(member, GZIP)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    return fields, rest[: int(fields["content-length"])]


def _lines(stream) -> Iterator[dict]:
    held = b""
    while chunk := stream.read(CHUNK):
        *lines, held = (held + chunk).split(b"\n")
        yield from map(json.loads, lines)


def read_archives(normalised: DataFrame) -> DataFrame:
    """The records of normalised archives, found by their indexes.

    (page_id, url, record_type, payload, payload_bytes, payload_digest,
    refers_to, path, offset, length). Ids are strings, the payload is null for
    a revisit, and its size and digest are those of the full payload. The
    digest of a response is computed from what was read; one that differs from
    the record's own is an error.
    """
    names = "page_id url record_type payload payload_bytes payload_digest refers_to path offset length".split()
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                system, place = _file_system(path)
                held, size = [], 0
                with (
                    system.open_input_stream(f"{place}.idx", compression=None) as index,
                    system.open_input_stream(place, compression=None, buffer_size=CHUNK) as archive,
                ):
                    for entry in _lines(index):
                        fields, block = _open_member(archive.read(entry["length"]))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if fields["warc-type"] == "revisit":
                            payload, total = None, int(head.rpartition(b"Content-Length:")[2].split(b"\r\n")[0])
                        else:
                            total = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{path} at {entry['offset']}: the payload differs from its digest")
                        ids = [fields.get(f) for f in ("x-page-id", "warc-target-uri", "x-refers-to-page-id")]
                        key, url, of_key = (None if v is None else _unfield(v) for v in ids)
                        held.append((key, url, fields["warc-type"], payload, total, digest, of_key, path, entry["offset"], entry["length"]))
                        size += len(payload or b"")
                        if size > 4 * CHUNK or len(held) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    tasks = max(1, normalised.count())
    schema = (
        "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
        "refers_to string, path string, offset long, length long"
    )
    return normalised.select("path").repartitionByRange(tasks, "path").mapInArrow(run, schema)


def page_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES
) -> DataFrame:
    """Rows for `write_archives`: each page's payload, and the page it revisits.

    Of equal payloads of ``revisit_bytes`` or more the page with the largest id
    is the response, rows with a null id coming last. Payloads are compared by
    SHA-256 and length.
    """
    rows = keyed(pages, id_col, _url=url_col, _html=html_col)
    payload = F.coalesce(F.col("_html"), F.lit("")).cast("binary")
    rows = rows.select(ROW, "_id", "_url", payload.alias("_payload"))
    large = rows.filter(F.octet_length("_payload") >= revisit_bytes).select(
        ROW, "_id", F.sha2("_payload", 256).alias("_sha"), F.octet_length("_payload").alias("_n")
    )
    large = write_shared(large, "payload-digests")
    latest = F.max(F.struct(F.col("_id").isNotNull().alias("known"), "_id", ROW)).alias("latest")
    groups = large.groupBy("_sha", "_n").agg(F.count("*").alias("copies"), latest).filter("copies > 1")
    groups = write_shared(
        groups.select("_sha", "_n", F.col(f"latest.{ROW}").alias("_of_row"), F.col("latest._id").alias("_of")), "equal-payloads"
    )
    revisits = large.join(groups, ["_sha", "_n"]).filter(F.col(ROW) != F.col("_of_row"))
    revisits = write_shared(revisits.select(ROW, "_of_row", F.col("_of").cast("string").alias("_of_key")), "revisits")
    if fits_broadcast(revisits, "_of_key"):
        revisits = F.broadcast(revisits)
    return rows.join(revisits, ROW, "left").select(
        ROW, F.col("_id").cast("string").alias("_key"), "_url", "_payload", "_of_row", "_of_key"
    )


def archive_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    folder: str | None = None,
    revisit_bytes: int = REVISIT_BYTES,
    level: int = LEVEL,
) -> DataFrame:
    """Archive pages, normalise the archives and return their manifest (path, n_records, n_bytes).

    ``folder`` is a URI all executors reach, a new one in the shared folder by
    default. The whole-file archives are deleted once they are normalised.

    A null html is an empty payload, a null url is left out of its record, and
    a null or repeated id makes records of their own. An empty table gives no
    archive. Other columns are not read.
    """
    text_batches(pages.sparkSession)
    folder = folder or new_shared_path(pages.sparkSession, "warc")
    whole = write_archives(page_records(pages, id_col, url_col, html_col, revisit_bytes), f"{folder}/whole", level)
    normalised = normalise_archives(whole, f"{folder}/records", level)
    system, path = _file_system(f"{folder}/whole")
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
    return normalised


def archived_pages(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Every page as read back from its archive, the ids in the type they had; see `read_archives`."""
    kind = pages.schema[id_col].dataType
    rows = read_archives(archive_pages(pages, id_col, **options))
    return rows.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
