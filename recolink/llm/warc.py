"""WARC writing, normalisation of whole-file gzip archives, and reading by offset index.

``write_archives`` makes one archive per partition, compressed as one gzip
stream. ``normalise`` inflates each such stream once, from front to back,
rewrites every record as a gzip member of its own and writes a sidecar index of
offsets beside it. ``read_index`` reads the sidecars of a folder, and
``read_records`` then fetches single members by offset.

Files go to the shared folder under a name given by the task's partition, first
under a name of the attempt and then renamed, so a retried or doubled task
leaves the same file. All copying is in blocks; no archive is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recolink.llm.exact_dedup import leaf_count
from recolink.llm.shared import delete_path, discard, new_path, save

#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31
BLOCK = 1 << 20
#: Archives are normalised in so many steps, and a step's originals deleted after it: both forms of all never lie on disk together.
WAVES = 4
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _publish(fs, temporary: str, final: str) -> None:
    """Rename; where an earlier attempt has left the same file and the file system doesn't replace it, that one stays."""
    try:
        fs.move(temporary, final)
    except OSError:
        if fs.get_file_info(final).type != pafs.FileType.File:
            raise
        fs.delete_file(temporary)


def _attempt(path: str) -> str:
    return f"{path}.{TaskContext.get().taskAttemptId()}.tmp"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, url_col: str = "url", leaves: int | None = None) -> DataFrame:
    """Adds __refers_to: the smallest id with an equal payload of at least min_bytes, or null where the row is that one.

    Equal means equal SHA-256 and length. Groups are combined within hash leaves first and joined back leaf by leaf, so
    a payload that a third of all pages share is spread over the leaves, whose number grows with the table.
    """
    leaves = max(16, leaf_count(pages.count())) if leaves is None else leaves
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("__id"), url.alias("__url"), payload.alias("__payload"),
        F.sha2(payload, 256).alias("__same"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(leaves)).cast("int").alias("__leaf"),
    )
    leaf = rows.groupBy("__leaf", "__same").agg(F.min("__id").alias("__least"))
    least = leaf.groupBy("__same").agg(F.min("__least").alias("__least"))
    answer = leaf.select("__leaf", "__same").join(least, "__same")
    refers: Column = F.when(
        (F.octet_length("__payload") >= min_bytes) & (F.col("__id").isNull() | (F.col("__id") > F.col("__least"))), F.col("__least")
    )
    return rows.join(answer, ["__leaf", "__same"]).select("__id", "__url", "__payload", refers.alias("__refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 4, waves: int = WAVES) -> DataFrame:
    """One whole-stream gzip archive per partition that has rows; returns their URIs and waves (saved, so they are written once)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        uri = f"{folder}/{number % waves}/whole-{number:06d}.warc.gz"
        fs, path = _open(uri)
        sink, squeeze, n = None, zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
        for batch in batches:
            for page_id, url, html, refers in zip(batch["__id"], batch["__url"], batch["__payload"], batch["__refers_to"]):
                if sink is None:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(_attempt(path), compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                known = [None if pd.isna(x) else int(x) for x in (page_id, refers)]
                sink.write(squeeze.compress(record_bytes(known[0], url, payload, base32_sha1(payload), known[1], date)))
                n += 1
        if sink is not None:
            sink.write(squeeze.flush())
            sink.close()
            _publish(fs, _attempt(path), path)
            yield pd.DataFrame({"uri": [uri], "wave": [number % waves], "records": [n]})

    return save(rows.mapInPandas(run, "uri string, wave long, records long"), "archives")


class _Inflated:
    """The inflated bytes of a gzip file, however many members it has; holds about one block."""

    def __init__(self, source):
        self.source, self.buffer, self.inflate = source, bytearray(), zlib.decompressobj(GZIP)

    def more(self) -> bool:
        data = self.inflate.unconsumed_tail or self.inflate.unused_data or self.source.read(BLOCK)
        if self.inflate.eof:
            if not data:
                return False
            self.inflate = zlib.decompressobj(GZIP)
        if not data:
            return False
        self.buffer += self.inflate.decompress(data, 4 * BLOCK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with mark; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                if self.buffer:
                    raise ValueError("the archive ends within a record")
                return None
        got = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return got

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends within a record")
            got = bytes(self.buffer[:n])
            del self.buffer[: len(got)]
            n -= len(got)
            if got:
                yield got


def header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "surrogatepass") if found else None


def normalise_stream(source, sink, level: int = 6) -> Iterator[tuple[int, int, str, str]]:
    """Copy an archive record by record; yields offset, length, type and record id of each new member."""
    inflated, offset = _Inflated(source), 0
    while (head := inflated.until(b"\r\n\r\n")) is not None:
        squeeze, length = zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
        length += sink.write(squeeze.compress(head)) or 0
        for part in inflated.exactly(int(header(head, "Content-Length")) + 4):
            length += sink.write(squeeze.compress(part)) or 0
        length += sink.write(squeeze.flush()) or 0
        yield offset, length, header(head, "WARC-Type"), header(head, "WARC-Record-ID")
        offset += length


class _Counted:
    def __init__(self, sink):
        self.sink = sink

    def write(self, data: bytes) -> int:
        if data:
            self.sink.write(data)
        return len(data)


def normalise(archives: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrites each archive (column uri) with one member per record and a sidecar .idx; a row (uri, records) for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                out_uri = f"{folder}/{uri.rsplit('/', 1)[1].replace('whole-', 'part-')}"
                fs, path = _open(uri)
                out_fs, out = _open(out_uri)
                out_fs.create_dir(out.rsplit("/", 1)[0], recursive=True)
                with fs.open_input_stream(path, compression=None) as source, out_fs.open_output_stream(_attempt(out), compression=None) as sink, out_fs.open_output_stream(_attempt(f"{out}.idx"), compression=None) as side:
                    n = 0
                    for offset, length, kind, urn in normalise_stream(source, _Counted(sink), level):
                        side.write(f"{offset}\t{length}\t{kind}\t{urn}\n".encode())
                        n += 1
                _publish(out_fs, _attempt(out), out)
                _publish(out_fs, _attempt(f"{out}.idx"), f"{out}.idx")
                yield pd.DataFrame({"uri": [out_uri], "records": [n]})

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.repartition(n, "uri").mapInPandas(run, "uri string, records long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """uri, offset, length, type and urn of every record, from the sidecars in a folder of normalised archives."""
    side = spark.read.schema("offset long, length long, type string, urn string").csv(f"{folder}/*.idx", sep="\t")
    return side.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", "").alias("uri"), "offset", "length", "type", "urn")


def parse(member: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and the block's payload of one member."""
    raw = zlib.decompress(member, GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    block = rest[: int(header(head, "Content-Length"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, page, refers = header(head, "WARC-Type"), header(head, "X-Page-Id"), header(head, "X-Refers-To-Page")
    digest = header(head, "WARC-Payload-Digest").removeprefix("sha1:")
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"the payload of page {page} doesn't match its digest")
    return (int(page) if page else None, int(header(http, "Content-Length")), digest, kind, int(refers) if refers else None, header(head, "WARC-Target-URI"), payload)


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the index rows point to, each fetched by offset and checked against its digest; a task reads neighbouring ones in order."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = {}
        for batch in batches:
            rows = []
            for uri, offset, length in zip(batch["uri"], batch["offset"], batch["length"]):
                if uri not in opened:
                    for other in opened.values():
                        other.close()
                    fs, path = _open(uri)
                    opened = {uri: fs.open_input_file(path)}
                rows.append(parse(opened[uri].read_at(int(length), int(offset)))[: len(names)])
            frame = pd.DataFrame(rows, columns=names)
            frame[["page_id", "refers_to"]] = frame[["page_id", "refers_to"]].astype("Int64")
            yield frame
        for other in opened.values():
            other.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    near = F.floor(F.col("offset") / (16 * BLOCK))
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(parts, "uri", near).sortWithinPartitions("uri", "offset").mapInPandas(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, url_col: str = "url") -> DataFrame:
    """Write pages (id, url, payload) to archives, normalise them, and read every record back by the sidecar indexes.

    A null payload is empty; a null url, or none at all, gives an empty target; blanks and control characters of a url
    are escaped. Of equal payloads of at least min_bytes the row with the smallest id is the response and the others
    revisit it; rows that repeat that id as well are responses too. A row without an id revisits the smallest id of its
    payload, and is a response if there is none. An empty table gives no archives and no rows. Other columns, whatever
    their names, are not looked at.
    """
    spark, folder = pages.sparkSession, new_path(pages.sparkSession, "warc")
    whole = write_archives(with_revisits(pages, id_col, payload_col, min_bytes, url_col), f"{folder}/whole")
    for wave in range(WAVES):
        discard(save(normalise(whole.where(F.col("wave") == wave), f"{folder}/members"), "normalised"))
        delete_path(spark, f"{folder}/whole/{wave}")
    if whole.isEmpty():
        return read_records(spark.createDataFrame([], "uri string, offset long, length long, type string, urn string"))
    return read_records(read_index(spark, f"{folder}/members"))
