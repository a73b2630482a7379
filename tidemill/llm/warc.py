"""WARC archives: writing, normalising to one gzip member per record, reading by index.

Three passes, each a narrow one over files in the shared folder; no payload is shuffled.

1. ``write_archives``: each task writes the pages of its partition, as it comes to them,
   into one archive that is a single gzip stream, every record a response.
2. ``decide``: from ``(page_id, digest, size, archive, place)`` alone, the smallest page_id
   of equal payloads is found by a partial aggregation, and every later record gets it as
   the one that it refers to.
3. ``normalise``: one task per archive inflates the stream once from end to end, with one
   record in memory at a time, rewrites each record as a gzip member of its own, turns
   those that repeat an earlier payload into revisits, and writes a sidecar index of
   offsets, beside the archive.

``read_archives`` then opens every member at its offset from the index.

Files are written under a name of the attempt and renamed when whole, so a task that is
run again leaves the same file. Paths may be of any file system that pyarrow opens by URI.

Defined results: null html is an empty payload; a null url is written as ``about:blank``,
control characters and spaces in a url are percent-encoded; a null page_id comes after all
others; among repeated rows the first place is the response and the rest revisit it; payloads
under ``least`` bytes are always responses; an empty table gives no archive and an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import lean, materialize, scratch_path, table

DATE = "2024-01-01T00:00:00Z"
#: Bytes inflated or read at once.
BLOCK = 1 << 20
LEAST_BYTES = 0
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_PAGE = re.compile(r"<urn:page:(-?\d+|null)>")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode("ascii")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    found = _PAGE.match(urn)
    if not found:
        raise ValueError(f"not a page's record id: {urn[:80]}")
    return None if found[1] == "null" else int(found[1])


def _http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode("ascii")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, size: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    head = _http_head(len(payload) if size is None else size)
    block = head if kind == "revisit" else head + payload
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_page_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(fields) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class _Stream:
    """Reads an iterator of byte blocks up to a mark or a length, holding no more than asked for."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def _more(self) -> bool:
        for block in self.blocks:
            if block:
                self.held += block
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without ``mark``; None at the end of the stream."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record's head")
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def inflated(source) -> Iterator[bytes]:
    """Blocks of a gzip file of one or more members, from one pass over it."""
    inflate = zlib.decompressobj(31)
    while block := source.read(BLOCK):
        while block:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            yield inflate.decompress(block, BLOCK)
            while inflate.unconsumed_tail:
                yield inflate.decompress(inflate.unconsumed_tail, BLOCK)
            block = inflate.unused_data
    if not inflate.eof:
        raise ValueError("the gzip stream is cut off")


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record, one in memory at a time."""
    stream = _Stream(blocks)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = parse_fields(head.lstrip(b"\r\n"))
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, block


def http_body(block: bytes) -> tuple[int, bytes]:
    """(the length that the HTTP head tells, the body)."""
    head, _, body = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length: *(\d+)", head)
    return int(told[1]) if told else len(body), body


def _whole(fs: pafs.FileSystem, path: str):
    """Opens a file under a name of this attempt; ``keep`` gives it its own name."""
    context = TaskContext.get()
    tmp = f"{path}.{context.taskAttemptId() if context else 0}.part"

    class Output:
        def __init__(self):
            self.file = fs.open_output_stream(tmp, compression=None)

        def keep(self):
            self.file.close()
            fs.move(tmp, path)

    return Output()


def _writer(folder: str):
    def run(batches):
        fs, base = filesystem(folder)
        name, out, squeeze, place = None, None, None, 0
        for batch in batches:
            page_ids, urls, htmls = batch.columns
            rows = []
            for page_id, url, html in zip(page_ids, urls, htmls, strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
                    out, squeeze = _whole(fs, f"{base}/{name}"), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = digest32(payload)
                out.file.write(squeeze.compress(record("response", page_id.as_py(), url.as_py(), payload, digest)))
                rows.append((page_id.as_py(), digest, len(payload), name, place))
                place += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["page_id", "digest", "size", "archive", "place"])
        if out is not None:
            out.file.write(squeeze.flush())
            out.keep()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes one monolithic archive per partition; ``(page_id, digest, size, archive, place)`` of every record."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    written = narrow.mapInArrow(lean(_writer(folder)), "page_id long, digest string, size long, archive string, place long")
    return materialize(spark, written, "warc-written")


def decide(written: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``(archive, place, refers_to, again)``: the later records of equal payloads, by a fold of one row per payload."""
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"), F.col("archive").alias("archive"), F.col("place").alias("place"))
    first = written.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    both = written.join(first, ["digest", "size"])
    return both.where("archive <> first.archive or place <> first.place").select("archive", "place", F.col("first.page_id").alias("refers_to"))


def _normaliser(folder: str, target: str, level: int):
    def run(key, rows):
        """Rewrites one archive; its group is the list of the places that become revisits."""
        fs, base = filesystem(folder)
        fs2, base2 = filesystem(target)
        fs2.create_dir(base2, recursive=True)
        name = key[0].as_py()
        places = zip(rows.column("place").to_pylist(), rows.column("refers_to").to_pylist(), rows.column("revisit").to_pylist(), strict=True)
        again = {place: refers_to for place, refers_to, revisit in places if revisit}
        out, index = _whole(fs2, f"{base2}/{name}"), _whole(fs2, f"{base2}/{name}.idx")
        offset = count = 0
        with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
            for place, (fields, block) in enumerate(records(inflated(source))):
                page_id, digest = _page_of(fields["warc-record-id"]), fields["warc-payload-digest"].partition(":")[2]
                size, body = http_body(block)
                kind = "revisit" if place in again else "response"
                raw = record(kind, page_id, fields["warc-target-uri"], b"" if kind == "revisit" else body, digest, again.get(place), size)
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = squeeze.compress(raw) + squeeze.flush()
                out.file.write(member)
                entry = {"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": kind, "digest": digest}
                index.file.write(json.dumps(entry).encode("ascii") + b"\n")
                offset, count = offset + len(member), count + 1
        out.keep()
        index.keep()
        return pa.table({"archive": pa.array([name]), "records": pa.array([count], pa.int64()), "bytes": pa.array([offset], pa.int64())})

    return run


def _dealt(archives: int) -> int:
    """Partitions over which archives are dealt by a hash of their names, most of them alone."""
    return max(1, min(3 * archives, 30_000))


def normalise(spark: SparkSession, written: DataFrame, decisions: DataFrame, folder: str, target: str, level: int = 6) -> DataFrame:
    """Rewrites every archive of ``folder`` below ``target`` with an index beside it; ``(archive, records, bytes)``."""
    names = written.select("archive").distinct().select("archive", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    work = names.unionByName(decisions.select("archive", "place", "refers_to", F.lit(True).alias("revisit")))
    # a number of partitions that isn't merged, however small the rows: each archive is much work
    work = work.repartition(_dealt(written.select("archive").distinct().count()), "archive")
    done = work.groupBy("archive").applyInArrow(_normaliser(folder, target, level), "archive string, records long, bytes long")
    return materialize(spark, done, "warc-normalised")


def _reader(target: str):
    def run(batches):
        fs, base = filesystem(target)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

        def give(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_file(f"{base}/{name}") as source, fs.open_input_stream(f"{base}/{name}.idx", compression=None) as lines:
                    for line in io.TextIOWrapper(lines, "ascii"):
                        entry = json.loads(line)
                        source.seek(entry["offset"])
                        raw = zlib.decompress(source.read(entry["length"]), 31)
                        ((fields, block),) = records(iter([raw]))
                        size, body = http_body(block)
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                        if kind == "response" and (len(body) != size or digest32(body) != digest):
                            raise ValueError(f"{name}: the payload at {entry['offset']} isn't what its digest says")
                        refers = fields.get("warc-refers-to")
                        rows.append((_page_of(fields["warc-record-id"]), size, digest, kind, _page_of(refers) if refers else None))
                        if len(rows) == 5000:
                            yield give(rows)
                            rows = []
                if rows:
                    yield give(rows)

    return run


def read_archives(archives: DataFrame, target: str) -> DataFrame:
    """One row per record of the normalised archives, each member opened at its offset; archives are dealt over tasks."""
    spread = archives.select("archive").repartition(_dealt(archives.count()), "archive")
    return spread.mapInArrow(lean(_reader(target)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """Writes, decides and normalises; the table of archives, and the folder that they and their indexes are in."""
    folder = folder or scratch_path(spark, "warc")
    written = write_archives(spark, pages, f"{folder}/raw")
    decisions = decide(written, least)
    return normalise(spark, written, decisions, f"{folder}/raw", f"{folder}/members"), f"{folder}/members"


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, target = archive_pages(spark, table(spark, sf_dir, "pages"))
    return read_archives(archives, target)


#: DuckDB has SHA-1 as hex only; base32 is spelled out from its bits, five at a time.
OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT p.page_id,
       CAST(strlen(p.body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
           CAST('0x' || substr(p.hex || '0', CAST(1 + (i * 5) // 4 AS BIGINT), 2) AS BIGINT) >> CAST(3 - (i * 5) % 4 AS BIGINT)
         ) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM p JOIN f USING (hex)
"""
