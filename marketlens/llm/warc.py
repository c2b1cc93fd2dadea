"""WARC archives: one gzip member per record, written by tasks and read back by a sequential reader.

write_archives() turns pages into records. Of pages with equal payloads of at least `revisit_from` bytes the one with the
smallest id becomes a response record and the others become revisit records without payload that refer to it; pages
with shorter payloads are all responses. Each task writes its own archives, of about ARCHIVE_BYTES, in the shared folder
under names that its attempt alone uses; only the archives that the manifest names count, so lost tasks do no harm.

read_archives() reads each archive once from front to back: members are inflated piece by piece, a record's length is
that of its Content-Length field, and block and payload digests are computed while the bytes pass and compared with the
fields. A record that breaks a rule is an error, unless `strict` is off; then `problem` tells. A null html is empty. Rows
with a null page id are written and read back with a null id. The folder must be one that pyarrow can open (file, s3,
gs, hdfs). A revisit's payload digest is that of its field; unlike_responses() holds it against the response.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import attach, look_up, materialise
from marketlens.sources.shared import new_folder

ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
_PAGE = "urn:marketlens:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_text(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", "sha1:" + digest_text(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def _clean(url: str | None) -> str:
    return "".join((url or "about:blank").split())


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """The gzip member of one page: a response, or a revisit if it refers to another page."""
    name = f"{_PAGE}{page}" if page is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _clean(url) + hashlib.sha1(payload).hexdigest())}"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("Content-Type", "application/http; msgtype=response")]
    fields.append(("WARC-Payload-Digest", "sha1:" + digest_text(hashlib.sha1(payload).digest())))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_PAGE}{refers_to}>"), ("WARC-Profile", _PROFILE)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, head if refers_to is not None else head + payload)


def write_archives(pages: DataFrame, revisit_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages; the manifest: path, records, bytes of each archive."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    keyed = rows.filter(F.col("id").isNotNull() & (F.octet_length("payload") >= revisit_from))
    first = materialise(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "warc-firsts")
    found = look_up(rows, first, ["key"], "n", pages.count(), F.col("id"))
    folder = new_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task, k, out, done = TaskContext.get(), 0, None, []
        for b in batches:
            for page, url, data, ref in zip(*(b.column(i) for i in range(4)), strict=True):
                if out is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
                    out, n, k = store.open_output_stream(f"{top}/{name}", compression=None), 0, k + 1
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, folder + name)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
                    out.write(_record(info, b"format: WARC File Format 1.1\r\n"))
                page, ref = page.as_py(), ref.as_py()
                out.write(page_record(page, url.as_py(), data.as_py(), None if ref is None or ref == page else ref))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    done.append((name, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, n, out.tell()))
            out.close()
        cols = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["name", "records", "bytes"])

    refers = F.when(F.col("id").isNotNull(), F.col("first")).alias("refers_to")
    listed = found.select("id", "url", "payload", refers).mapInArrow(run, "name string, records long, bytes long")
    return materialise(listed.select(F.concat(F.lit(folder + "/"), F.col("name")).alias("path"), "records", "bytes"), "warc-manifest")


class _Members:
    """The bytes of an archive's gzip members, one member after another."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.rest, self.inflate = raw, b"", None

    def next_member(self) -> bool:
        self.rest = self.rest or self.raw.read(PIECE)
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return bool(self.rest)

    def read(self) -> bytes:
        """Some more bytes of the member; none at its end."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.rest or self.raw.read(PIECE)
            self.rest = b""
            if not data:
                raise ValueError("the archive ends inside a member")
            out = self.inflate.decompress(data, PIECE)
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
            if out:
                return out
        return b""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(raw: BinaryIO, keep_payload: bool = True) -> Iterator[dict]:
    """Each record of an archive in turn: its fields, payload (if kept), payload_bytes, payload_digest, problem."""
    members = _Members(raw)
    while members.next_member():
        data, seen = bytearray(), 0
        while (stop := data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(data)
            more = members.read()
            if not more:
                raise ValueError("a member ends inside a record's head")
            data += more
        head, data = bytes(data[:stop]), bytes(data[stop + 4 :])
        problems = [] if head.startswith(b"WARC/1.") else ["not a WARC record"]
        fields = _fields(head)
        left, block, body, kept, size = int(fields.get("content-length", "0")), hashlib.sha1(), hashlib.sha1(), [], 0
        http, http_head = fields.get("content-type", "").startswith("application/http"), b""
        in_body = not http
        while left:
            if not data and not (data := members.read()):
                problems.append("the block is shorter than its length field")
                break
            part, data = data[:left], data[left:]
            left -= len(part)
            block.update(part)
            if not in_body:
                http_head += part
                if b"\r\n\r\n" not in http_head:
                    continue
                http_head, _, part = http_head.partition(b"\r\n\r\n")
                in_body = True
            body.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        while more := members.read():
            data += more
        if data != b"\r\n\r\n" and not left:
            problems.append("the record doesn't end after its block")
        if fields.get("warc-block-digest", "") not in ("", "sha1:" + digest_text(block.digest())):
            problems.append("block digest")
        revisit, said = fields.get("warc-type") == "revisit", fields.get("warc-payload-digest", "")
        if revisit:
            size = int(_fields(http_head).get("content-length", "0"))
        elif said not in ("", "sha1:" + digest_text(body.digest())):
            problems.append("payload digest")
        digest = said.removeprefix("sha1:") if revisit else digest_text(body.digest())
        yield {"fields": fields, "payload": b"".join(kept) if keep_payload and not revisit else None, "payload_bytes": size, "payload_digest": digest, "problem": "; ".join(problems) or None}


def _page(name: str | None) -> int | None:
    name = (name or "").strip("<>")
    return int(name.removeprefix(_PAGE)) if name.startswith(_PAGE) else None


def read_archives(manifest: DataFrame, keep_payload: bool = True, strict: bool = True) -> DataFrame:
    """One row per response or revisit of the archives in manifest (path): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, problem, payload (null for revisits, or if not kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                out, held = [], 0
                with store.open_input_stream(name, compression=None) as raw:
                    for r in records(raw, keep_payload):
                        f = r["fields"]
                        if f.get("warc-type") not in ("response", "revisit"):
                            continue
                        if strict and r["problem"]:
                            raise ValueError(f"{path}: {f.get('warc-record-id')}: {r['problem']}")
                        refers = _page(f.get("warc-refers-to")) if f["warc-type"] == "revisit" else None
                        out.append((_page(f.get("warc-record-id")), f.get("warc-target-uri"), f["warc-type"], refers, r["payload_bytes"], r["payload_digest"], r["problem"], r["payload"]))
                        held += len(r["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield batch(out)
                            out, held = [], 0
                if out:
                    yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "problem", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    paths = manifest.select("path").repartition(max(1, min(10_000, manifest.count())))
    return paths.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, problem string, payload binary")


def unlike_responses(found: DataFrame) -> DataFrame:
    """Of what read_archives() found, the revisits that refer to no response, or to one of another payload digest."""
    responses = found.filter("record_type = 'response' and page_id is not null").groupBy("page_id").agg(F.min("payload_digest").alias("digest_there"))
    revisits = found.filter("record_type = 'revisit'")
    weights = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    there = responses.join(weights, F.col("page_id") == F.col("refers_to")).select("refers_to", "digest_there", "n")
    met = attach(revisits, there, ["refers_to"], "n", revisits.count(), F.col("page_id"))
    return met.filter(~F.col("payload_digest").eqNullSafe(F.col("digest_there"))).select(found.columns)
