"""WARC archives: write, normalise monolithic gzip, read back by offset.

* :func:`write_warc` writes pages as records into archives that are one gzip
  stream each, with revisits in place of repeated payloads.
* :func:`normalise` inflates each such stream once, from start to end, writes
  every record as a gzip member of its own and, beside the archive, an index
  of record, offset and length.
* :func:`read_records` opens archives by that index.

Tasks stream: they hold one record and a read buffer.  Archives go to a new
folder under ``spark.checkpoint.dir``; a task that runs again writes under new
names, and only the names that a finished task returns are read.

Defined results: NULL html is the empty payload; a NULL url is written as an
empty URI; a NULL page_id is read back as NULL and never referred to while the
payload has another page; rows that share the largest page_id of a payload are
all responses; no rows give no archives and no records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from loupe.frames import require
from loupe.llm.rows import text_of
from loupe.session import durable, shared_folder

#: raw bytes after which a task starts its next archive
ROLL_BYTES = 256 << 20
#: fixed values of the format
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"

ARCHIVES = "path string, records long, bytes long"
NORMALISED = "path string, index_path string, records long, bytes long"
RECORDS = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to string, path string, offset long, length long, payload binary"
)


def opened(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, text, digest, refers_to): refers_to is NULL for responses.

    Of equal payloads of at least ``min_bytes`` the largest page_id is the
    response.  Digests are pre-aggregated; the join on them is one that
    adaptive execution splits where a payload is very common.
    """
    require(pages, "page_id", "url", "html")
    text = text_of("html")
    hashed = pages.select("page_id", "url", text.alias("text"), F.sha1(F.encode(text, "UTF-8")).alias("digest"))
    latest = hashed.groupBy("digest").agg(F.max("page_id").alias("latest"))
    revisits = (F.octet_length("text") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return hashed.join(latest, "digest").select("page_id", "url", "text", "digest", F.when(revisits, F.col("latest")).alias("refers_to"))


def record_bytes(page_id, url, text, digest, refers_to) -> bytes:
    import base64
    import re

    payload = text.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives (path, records, bytes) of one gzip stream each."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator) -> Iterator:
        import zlib

        import pandas as pd

        sink = None
        done = []

        def close():
            nonlocal sink
            if sink is not None:
                sink.write(deflate.flush())
                sink.close()
                done.append((path, records, raw))
                sink = None

        for batch in batches:
            ids = batch["page_id"].astype(object)
            refs = batch["refers_to"].astype(object)
            for page_id, url, text, digest, refers_to in zip(ids, batch["url"], batch["text"], batch["digest"], refs):
                if sink is None:
                    path, records, raw = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    files, inner = opened(path)
                    files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    sink, deflate = files.open_output_stream(inner, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                known = lambda x: None if pd.isna(x) else int(x)
                record = record_bytes(known(page_id), url, text, digest, known(refers_to))
                sink.write(deflate.compress(record))
                records, raw = records + 1, raw + len(record)
                if raw >= roll_bytes:
                    close()
        close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    decided = decide(pages, min_bytes)
    return durable(decided.mapInPandas(write, ARCHIVES))


def inflated(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever the number of its members."""
    import zlib

    inflate = zlib.decompressobj(31)
    while chunk := source.read(size):
        while chunk:
            yield inflate.decompress(chunk)
            chunk = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    yield inflate.flush()


def headers(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode().split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of a stream."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while True:
        end, seen = -1, 0
        while end < 0:
            end = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held)
            if end < 0 and not fill(seen + 1):
                if held:
                    raise ValueError("the archive ends within a record's header")
                return
        fields = headers(bytes(held[:end]))
        total = end + 4 + int(fields["content-length"]) + 4
        if not fill(total):
            raise ValueError("the archive ends within a record")
        yield fields, bytes(held[:total])
        del held[:total]


def one_task_each(files: DataFrame) -> DataFrame:
    """Rows of a path in a partition each; a number that is given isn't merged however small the rows are."""
    return files.repartitionByRange(max(1, files.count()), "path")


def normalise(archives: DataFrame) -> DataFrame:
    """Archives with a gzip member per record, and the index of each.

    An index line holds record id, type, offset and length, split by blanks.
    """

    def rewrite(batches: Iterator) -> Iterator:
        import zlib

        import pandas as pd

        for batch in batches:
            rows = []
            for source in batch["path"]:
                target = f"{source.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                index = f"{target}.idx"
                files, inner = opened(source)
                offset = records = 0
                with (
                    files.open_input_stream(inner, compression=None) as stream,
                    files.open_output_stream(opened(target)[1], compression=None) as members,
                    files.open_output_stream(opened(index)[1], compression=None) as lines,
                ):
                    for fields, record in split_records(inflated(stream)):
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflate.compress(record) + deflate.flush()
                        members.write(member)
                        lines.write(f"{fields['warc-record-id']} {fields['warc-type']} {offset} {len(member)}\n".encode())
                        offset, records = offset + len(member), records + 1
                rows.append((target, index, records, offset))
            yield pd.DataFrame(rows, columns=["path", "index_path", "records", "bytes"])

    return durable(one_task_each(archives.select("path")).mapInPandas(rewrite, NORMALISED))


def read_records(normalised: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records, each fetched by its offset and length and checked.

    ``payload_bytes`` and ``payload_digest`` speak of the full payload; a
    revisit's payload itself is NULL.  A payload that doesn't have its digest
    is an error.
    """

    def read(batches: Iterator) -> Iterator:
        import base64
        import hashlib
        import zlib

        import pandas as pd

        names = [field.split(" ")[0] for field in RECORDS.split(", ")]
        for batch in batches:
            for path, index in zip(batch["path"], batch["index_path"]):
                files, inner = opened(path)
                rows, held = [], 0
                with files.open_input_file(inner) as members, files.open_input_stream(opened(index)[1], compression=None) as lines:
                    import io

                    for line in io.TextIOWrapper(io.BufferedReader(lines), encoding="utf-8"):
                        record_id, kind, offset, length = line.split()
                        members.seek(int(offset))
                        record = zlib.decompress(members.read(int(length)), 31)
                        head, _, rest = record.partition(b"\r\n\r\n")
                        fields = headers(head)
                        http, _, payload = rest[:-4].partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "revisit":
                            size, payload = int(headers(http)["content-length"]), None
                        else:
                            size = len(payload)
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{record_id} in {path}: the payload doesn't have its digest")
                        rows.append((
                            fields["warc-record-id"], kind, fields["warc-target-uri"], digest, size,
                            fields.get("warc-refers-to"), path, int(offset), int(length), payload if with_payload else None,
                        ))
                        held += len(payload or b"") * with_payload
                        if len(rows) >= 10_000 or held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return one_task_each(normalised.select("path", "index_path")).mapInPandas(read, RECORDS)


def page_of(record_id: str):
    """The page_id in a record id column."""
    return F.expr(f"try_cast(regexp_extract({record_id}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")
