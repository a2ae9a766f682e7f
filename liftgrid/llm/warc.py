"""WARC archives with a two-level capture index.

*Archives.* Each task writes one ``.warc.gz``, a gzip member per record, to the shared folder and
reports where each record lies; a retried task writes a file of another name, and only what the
successful attempt reported is kept. Equal payloads are stored once: the record of the smallest
key is the response, the others are revisits that refer to it.

*Index.* Captures are keyed by the reversed host (``com,example,www)/path``) and range-partitioned
on it. Each partition is one file of compressed blocks of sorted captures, followed by a sparse
directory with the first key of each block. The list of partitions has one row per file, bounded
by the number of partitions.

*Lookup.* Wanted captures are range-partitioned too, so a task meets few index files. It reads
their directories, binary-searches the block, reads that byte range only, and finds the capture.
Records are then read by byte range, in file order, with neighbours in one read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import pyarrow_uri, scratch, store, with_group_min

CAPTURE = "surt string, k long, archive string, offset long, length long"
#: Captures in a compressed block.
BLOCK_CAPTURES = 256
#: Bytes between two wanted records that are read rather than skipped.
READ_GAP = 65_536


def surt(url: Column) -> Column:
    """Reversed host, then the rest: ``http://www.Example.com/a?b`` is ``com,example,www)/a?b``."""
    host = F.lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"^(?s).*?://[^/?#]*(.*)$", 1)
    turned = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    return F.when(url.contains("://"), F.concat(turned, F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit("-")))


def payload_digest(payload: bytes) -> str:
    return _base32(hashlib.sha1(payload).hexdigest())


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, key: int | None, url: str | None, refers: int | None, payload: bytes, size: int, digest: str, date: str) -> bytes:
    """A WARC/1.1 response or revisit record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{key}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:capture:{refers}>")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict[str, object]:
    """The record's headers, its payload, and the payload's size as its HTTP header states it."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"fields": fields, "payload": payload, "size": int(stated["Content-Length"])}


def write_archives(df: DataFrame, key: str, url: str, payload: Column, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row and return the captures: ``surt, k, archive, offset, length``.

    ``payload`` is binary; null counts as empty. Rows whose equal payloads have ``min_bytes`` or
    more share one response, that of the smallest key; repeated rows of that key are responses
    too, a row with a null key is never referred to unless its group has no other. A null URL
    leaves out the target and is indexed as ``-``.
    """
    spark = df.sparkSession
    folder = pyarrow_uri(scratch(spark, "warc"))
    rows = df.select(
        F.col(key).cast("long").alias("k"), F.col(url).alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    sums = rows.select("k", "digest", F.length("payload").alias("size"), F.xxhash64("k", "url").alias("row"))
    first = with_group_min(sums.where(F.col("size") >= min_bytes), "digest", "k", "first", ["row"])
    # Rows of one key may differ in payload. No revisit has a null key, and no digest is null.
    revisits = first.where("k IS NOT NULL AND first < k").select("k", "digest", "first").distinct()
    surts = rows.withColumn("surt", surt(F.col("url"))).join(revisits, ["k", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, place = None, 0
        for batch in batches:
            k, urls, payloads, digests, keys, refers = (batch.column(i).to_pylist() for i in range(6))
            offsets, lengths = [], []
            for a, u, p, d, r in zip(k, urls, payloads, digests, refers, strict=True):
                kind = "response" if r is None or len(p) < min_bytes else "revisit"
                data = zlib.compress(record(kind, a, u, r, p, len(p), _base32(d), date), 6, 31)
                if out is None:
                    system, path = pafs.FileSystem.from_uri(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                out.write(data)
                offsets.append(place)
                lengths.append(len(data))
                place += len(data)
            yield pa.RecordBatch.from_pydict(
                {"surt": pa.array(keys, pa.string()), "k": pa.array(k, pa.int64()), "archive": pa.array([name] * len(k), pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())}
            )
        if out is not None:
            out.close()

    return store(surts.select("k", "url", "payload", "digest", "surt", "first").mapInArrow(write, CAPTURE), "captures")


def build_index(captures: DataFrame) -> list[tuple[str, str, str, int]]:
    """Write the block files; ``(first key, last key, file, directory offset)`` of each."""
    folder = pyarrow_uri(scratch(captures.sparkSession, "cdx"))
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx"
        system, path = pafs.FileSystem.from_uri(name)
        out, place, directory, block, last = None, 0, [], [], None

        def flush() -> None:
            nonlocal out, place
            if out is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            data = zlib.compress("\n".join(json.dumps(c) for c in block).encode(), 6)
            directory.append([block[0][:2], place, len(data)])
            out.write(data)
            place += len(data)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append([row[0], -(2**63) if row[1] is None else row[1], *row[2:]])
                last = block[-1][:2]
                if len(block) == BLOCK_CAPTURES:
                    flush()
        if block:
            flush()
        if out is not None:
            out.write(zlib.compress(json.dumps(directory).encode(), 6))
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [json.dumps(directory[0][0])], "last": [json.dumps(last)], "file": [name], "place": [place]})

    ranged = captures.repartitionByRange(parts, "surt", "k").sortWithinPartitions("surt", "k")
    files = store(ranged.mapInArrow(write, "first string, last string, file string, place long"), "cdx-files")
    return sorted((_order(json.loads(r.first)), _order(json.loads(r.last)), r.file, r.place) for r in files.collect())


def _order(key: list) -> tuple[bytes, int]:
    """Keys compare by UTF-8 bytes, as Spark sorts strings."""
    return key[0].encode(), key[1]


def parts_for(captures: DataFrame, part_bytes: int = 64 << 20) -> int:
    """Tasks for reading stored captures: they follow the archives' bytes, not those of the captures."""
    least = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, (captures.agg(F.sum("length")).first()[0] or 0) // part_bytes)


def lookup(index: list, wanted: DataFrame, parts: int) -> DataFrame:
    """The captures of distinct ``(surt, k)`` pairs; pairs that the index lacks give no row.

    A pair that was captured more than once gives each capture. Null is the smallest ``k``.
    """
    firsts = [f[0] for f in index]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, object, list] | None = None
        last: tuple[tuple, list] | None = None

        def opened(part: tuple) -> tuple:
            nonlocal held
            if held is None or held[0] != part[2]:
                system, path = pafs.FileSystem.from_uri(part[2])
                file = system.open_input_file(path)
                file.seek(part[3])
                held = (part[2], file, [(_order(k), at, size) for k, at, size in json.loads(zlib.decompress(file.read()))])
            return held

        def captures(file: object, name: str, at: int, size: int) -> list:
            nonlocal last
            if last is None or last[0] != (name, at):
                file.seek(at)
                rows = [json.loads(x) for x in zlib.decompress(file.read(size)).split(b"\n")]
                last = ((name, at), [(_order(r), r) for r in rows])
            return last[1]

        for batch in batches:
            found = []
            for s, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                want = (s.encode(), -(2**63) if k is None else k)
                part = max(0, bisect.bisect_left(firsts, want) - 1)
                while part < len(index) and index[part][0] <= want:
                    if index[part][1] >= want:
                        name, file, directory = opened(index[part])
                        block = max(0, bisect.bisect_left(directory, want, key=lambda d: d[0]) - 1)
                        while block < len(directory) and directory[block][0] <= want:
                            rows = captures(file, name, *directory[block][1:])
                            at = bisect.bisect_left(rows, want, key=lambda r: r[0])
                            while at < len(rows) and rows[at][0] == want:
                                found.append([s, k, *rows[at][1][2:]])
                                at += 1
                            block += 1
                    part += 1
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                    names=["surt", "k", "archive", "offset", "length"],
                )

    ranged = wanted.select("surt", "k").repartitionByRange(parts, "surt", "k").sortWithinPartitions("surt", "k")
    return ranged.mapInArrow(find, CAPTURE)


def read_records(captures: DataFrame, parts: int) -> DataFrame:
    """``k, record_type, refers_to, payload, payload_bytes, payload_digest`` of each capture.

    A response whose payload doesn't have the digest or size that the record states is an error. A
    revisit has a null payload, its size and digest are those of the payload it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, object] | None = None
        for batch in batches:
            k, archive, offset, length = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            while at < len(k):
                to, end = at + 1, offset[at] + length[at]
                while to < len(k) and archive[to] == archive[at] and offset[to] - end <= READ_GAP and end - offset[at] < 64 * READ_GAP:
                    end = max(end, offset[to] + length[to])
                    to += 1
                if held is None or held[0] != archive[at]:
                    system, path = pafs.FileSystem.from_uri(archive[at])
                    held = (archive[at], system.open_input_file(path))
                held[1].seek(offset[at])
                data = held[1].read(end - offset[at])
                out: dict[str, list] = {c: [] for c in ("k", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest")}
                for i in range(at, to):
                    start = offset[i] - offset[at]
                    got = parse(gzip.decompress(data[start : start + length[i]]))
                    fields, kind = got["fields"], got["fields"]["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (payload_digest(got["payload"]) != digest or len(got["payload"]) != got["size"]):
                        raise ValueError(f"record {k[i]} in {archive[i]} is damaged")
                    refers = fields.get("WARC-Refers-To")
                    out["k"].append(k[i])
                    out["record_type"].append(kind)
                    out["refers_to"].append(int(refers.removeprefix("<urn:capture:").rstrip(">")) if refers else None)
                    out["payload"].append(got["payload"] if kind == "response" else None)
                    out["payload_bytes"].append(got["size"])
                    out["payload_digest"].append(digest)
                types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))
                at = to

    ranged = captures.select("k", "archive", "offset", "length").repartitionByRange(parts, "archive", "offset")
    return ranged.sortWithinPartitions("archive", "offset").mapInArrow(
        read, "k long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    )
