"""Web archives compressed record by record with a shared Zstandard dictionary.

Each archive file is a leading skippable frame that holds the dictionary, followed by one Zstandard frame
a record, so any record can be read alone.  The dictionary is built from a bounded sample of the records
to be archived.  Tasks write their own files through a file system named by URI, each under a name of its
own attempt; only files that the finished job lists count, so a lost or repeated task leaves no record twice.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, shared_dir, slices, stage

SKIPPABLE = 0x184D2A5D  # the frame kind that holds a dictionary
FRAME = 0xFD2FB528
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sample_dictionary(pages: DataFrame, payload: str, sample_rows: int, sample_bytes: int, size: int) -> bytes:
    """A dictionary trained on about ``sample_rows`` records of at most ``sample_bytes`` bytes each.

    The sample is spread over the table by a hash of the key and only feeds the dictionary; the bounds keep
    what reaches the driver to ``sample_rows * sample_bytes``.  Too few samples give an empty dictionary.
    """
    picked = hash_sample(pages.select("page_id", payload), "page_id", sample_rows, pages.count())
    start = F.expr(f"substring(encode({payload}, 'UTF-8'), 1, {sample_bytes})").alias("b")
    rows = picked.select("page_id", start).filter("length(b) > 8").orderBy("page_id").collect()
    head = [record_head({"WARC-Type": "response", "WARC-Record-ID": record_id(i, ""), "WARC-Payload-Digest": "sha1:" + "A" * 32}, len(r["b"])) for i, r in enumerate(rows)]
    try:
        return zstandard.train_dictionary(size, [h + bytes(r["b"]) for h, r in zip(head, rows, strict=True)]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_head(fields: dict[str, str], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def frames(data: bytes):
    """(dictionary, iterator over each frame's bytes) of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")

    def each():
        at = 8 + n
        while at < len(data):
            if struct.unpack_from("<I", data, at)[0] != FRAME:
                raise ValueError(f"no frame at byte {at}")
            end = at + zstandard.frame_header_size(data[at : at + 18])
            last = False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
            yield data[at:end]
            at = end

    return data[8 : 8 + n], each()


def write_archives(pages: DataFrame, where: str, dictionary: bytes, payload: str = "html", level: int = 3, file_bytes: int = 64 << 20) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, ``payload``, refers_to) as a record; returns the files written.

    A file is closed at ``file_bytes``, so a task holds one at most.  Result, staged: file, records, bytes.
    """

    def run(batches):
        from pyarrow import fs

        out, folder = fs.FileSystem.from_uri(where)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
        ctx = TaskContext.get()
        done, buffer, count, held = 0, [], 0, 0

        def close():
            nonlocal done, buffer, count, held
            name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{done:04d}.warc.zst"
            with out.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                f.write(b"".join(buffer))
            row = pa.RecordBatch.from_pydict({"file": [f"{where}/{name}"], "records": [count], "bytes": [held]})
            done, buffer, count, held = done + 1, [], 0, 0
            return row

        for b in slices(batches, payload):
            ids, urls, refers = (b.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            bodies = b.column(payload).cast(pa.binary()).to_pylist()
            for page, url, body, ref in zip(ids, urls, bodies, refers, strict=True):
                body = body or b""
                digest = base32_sha1(body)
                fields = {
                    "WARC-Type": "response" if ref is None else "revisit", "WARC-Record-ID": record_id(page, digest),
                    "WARC-Target-URI": " ".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{digest}",
                    "X-Payload-Length": str(len(body)),
                }
                if page is not None:
                    fields["X-Page-ID"] = str(page)
                if ref is not None:
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(ref, digest), "X-Refers-To-Page-ID": str(ref)}
                    body = b""
                frame = pack.compress(record_head(fields, len(body)) + body + b"\r\n\r\n")
                buffer.append(frame)
                count, held = count + 1, held + len(frame)
                if held >= file_bytes:
                    yield close()
        if count:
            yield close()

    cols = pages.select("page_id", "url", payload, "refers_to")
    return stage(cols.mapInArrow(run, "file string, records long, bytes long"), "archive-list")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the archives listed in ``files`` (column file): RECORDS, each response's payload checked."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for name in b.column("file").to_pylist():
                source, path = fs.FileSystem.from_uri(name)
                with source.open_input_stream(path, compression=None) as f:
                    data = f.read()  # at most about file_bytes
                dictionary, each = frames(data)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                rows = [read_record(unpack.decompress(x)) for x in each]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file").repartition(n, "file").mapInArrow(run, RECORDS)


def read_record(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(fields["X-Payload-Length"])
    if kind == "response":
        if base32_sha1(body) != digest or len(body) != n:
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
    page, ref = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return None if page is None else int(page), n, digest, kind, None if ref is None else int(ref)


def mark_revisits(pages: DataFrame, payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, ``payload`` (null: empty) and refers_to: the largest page_id with the same payload, null for
    that record itself and for payloads under ``least_bytes`` bytes.

    Only a digest and a key travel for the grouping; groups are pre-aggregated, and only payloads that occur
    twice reach the join.  Rows without a page_id are responses; of rows that share the largest page_id all are.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col(payload), F.lit("")).alias(payload))
    p = p.withColumn("digest", F.unhex(F.sha2(payload, 256)))
    groups = (
        p.filter(f"octet_length({payload}) >= {least_bytes}").groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("low")).filter("low < last").select("digest", "last")
    )
    first = F.col("page_id").isNull() | (F.col("page_id") == F.col("last"))
    return p.join(groups, "digest", "left").select("page_id", "url", payload, F.when(~first, F.col("last")).alias("refers_to"))


def archive(pages: DataFrame, where: str | None = None, payload: str = "html", least_bytes: int = 0, sample_rows: int = 400, sample_bytes: int = 8192, dictionary_bytes: int = 65536) -> DataFrame:
    """Write ``pages`` as archives under ``where`` (a URI; default: a new folder in the shared one) and read them back.

    RECORDS of every row.  Null payloads are empty; a null page_id or url is left out of the record; repeated
    rows are records of their own; an empty table writes no file; other columns are not read.
    """
    where = where or f"{shared_dir(pages.sparkSession)}/llm/archives-{uuid.uuid4().hex}"
    if "://" not in where:
        where = f"file://{where}" if where.startswith("/") else where.replace("file:/", "file:///", 1)
    from pyarrow import fs

    target, folder = fs.FileSystem.from_uri(where)
    target.create_dir(folder, recursive=True)
    dictionary = sample_dictionary(pages, payload, sample_rows, sample_bytes, dictionary_bytes)
    return read_archives(write_archives(mark_revisits(pages, payload, least_bytes), where, dictionary, payload))
