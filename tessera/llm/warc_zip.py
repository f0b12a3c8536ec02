"""WARC records inside ZIP packages, read by byte range without extraction.

Writing: each task packs its records into one ``.zip`` with two *stored* members,
``archive/data.warc.gz``, in which each record is a gzip member of its own, and ``indexes/index.cdx``, with a CDX line a
record in the order of the records. Sizes are unknown while streaming, so both
members carry data descriptors and the package ends with a ZIP64 directory as well as the plain
one. Payload equality is SHA-1 plus length; the smallest page_id of equal payloads is the
``response`` and the others are ``revisit`` records without payload.

Reading: the end record, the ZIP64 locator and the central directory give the members' places; the
index member gives each record's offset and length; records are then range-read in chunks that
Spark spreads over tasks.

Defined results: NULL html is an empty payload; every row gives a record; a payload has one response, that of smallest page_id
(then url), and rows that repeat even those are revisits of that id like all others, so record ids are unique; NULL page_id sorts
last when choosing the response; an empty table writes nothing; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import open_fs, publish, scratch, stored, table

MIN_REVISIT_BYTES = 0
CHUNK_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"  # of all records: pages have no fetch time
# Fixed value of the format: the fields of a CDX line.
CDX_HEAD = b" CDX N b a m s k r M S V g\n"
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Fixed values of the ZIP format: signatures of its structures.
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target_uri(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")


def sort_key(uri: str) -> str:
    """The URL with its host reversed and lower-cased, as CDX files are keyed: com,example)/path."""
    host, slash, path = uri.partition("://")[2].partition("/") if "://" in uri else ("", "", uri)
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path}" if host else path or "-"


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """The one response of a payload is known by page and payload; all other records by their place too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str, place: str = "", date: str = DATE) -> bytes:
    """One WARC/1.1 record with an HTTP head. A revisit keeps the digest and the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, place)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target_uri(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"Page-ID: {'' if page_id is None else page_id}", f"Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzipped(raw: bytes) -> bytes:
    """A gzip member, without time stamp, so that reruns write equal bytes."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, payload): an HTTP block without its head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not at a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("Content-Type", "").startswith("application/http") else block


class Packer:
    """A ZIP file of stored members, written in one pass with data descriptors and a ZIP64 directory."""

    def __init__(self, sink):
        self.sink, self.at, self.members, self.open = sink, 0, [], None

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, raw: bytes) -> int:
        place, self.open[2], self.open[3] = self.open[3], zlib.crc32(raw, self.open[2]), self.open[3] + len(raw)
        self._put(raw)
        return place

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", DESCRIPTOR, self.open[2], self.open[3], self.open[3]))
        self.members.append(self.open)

    def close(self) -> None:
        start = self.at
        for raw, place, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, place)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
        size, end = self.at - start, self.at
        n = len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", LOCATOR, 0, end, 1) + struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def directory(source, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (data offset, size, method, crc). ``source`` needs read_at(n, offset) only."""
    tail = source.read_at(min(size, 65_557), max(0, size - 65_557))
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)  # a signature inside the comment
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == n or FULL32 in (length, start):
        where = max(0, size - len(tail) + at - 20)
        sig, _, place, _ = struct.unpack("<IIQI", source.read_at(20, where))
        if sig != LOCATOR:
            raise ValueError("no ZIP64 locator")
        n, length, start = struct.unpack_from("<QQQ", source.read_at(56, place), 32)
    raw, found, at = source.read_at(length, start), {}, 0
    for _ in range(n):
        sig, _, _, flags, method, _, _, crc, packed, full, n_name, n_extra, n_note, _, _, _, place = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if sig != CENTRAL:
            raise ValueError("broken central directory")
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, at = raw[at + 46 + n_name : at + 46 + n_name + n_extra], at + 46 + n_name + n_extra + n_note
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                place = wide.pop(0) if place == FULL32 else place
            extra = extra[4 + k :]
        n_name2, n_extra2 = struct.unpack("<HH", source.read_at(4, place + 26))
        found[name] = (place + 30 + n_name2 + n_extra2, full, method, crc)
    return found


def write_archives(pages: DataFrame, out: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """One ZIP a partition; the stored manifest has a row per archive (path, n_records, n_bytes)."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    hashed = base.withColumn("sha", F.sha1("payload")).withColumn("n", F.length("payload"))
    # rows that repeat page and url are counted first, so a hot payload is summed before it is shuffled; only payloads with copies are kept
    per = hashed.where(F.col("n") >= min_revisit_bytes).groupBy("sha", "n", "page_id", F.coalesce("url", F.lit("")).alias("url")).agg(F.count("*").alias("rows"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "rows")
    firsts = per.groupBy(F.col("sha").alias("f_sha"), F.col("n").alias("f_n")).agg(F.min(order).alias("first"), F.sum("rows").alias("copies")).where("copies > 1")
    firsts = stored(firsts.select("f_sha", "f_n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.rows").alias("first_rows")), "warc-firsts")
    joined = hashed.join(firsts, (F.col("sha") == F.col("f_sha")) & (F.col("n") == F.col("f_n")), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.coalesce("url", F.lit("")) == F.col("first_url"))
    dup, repeats = F.col("f_sha").isNotNull(), F.coalesce(is_first & (F.col("first_rows") > 1), F.lit(False))
    marked = joined.where(~repeats).select("page_id", "url", "payload", dup.alias("dup"), "first_id", (F.col("f_sha").isNull() | is_first).alias("response"))
    if not firsts.where("first_rows > 1").isEmpty():
        # equal rows of the response: one of them is it
        same = joined.where(repeats).groupBy("page_id", F.coalesce("url", F.lit("")).alias("url"), "sha", "n", "first_id").agg(F.first("payload").alias("payload"), F.count("*").alias("rows"))
        marked = marked.unionByName(same.select("page_id", "url", "payload", F.lit(True).alias("dup"), "first_id", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("k")).withColumn("response", F.col("k") == 1).drop("k"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = open_fs(out)
        fs.create_dir(root, recursive=True)
        name, n, done = f"{root}/part-{part:06d}.zip", 0, 0
        sink = packer = listing = None  # the index grows in a file of its own, so a task holds none of it
        for batch in batches:
            for row in batch.to_pylist():
                if packer is None:
                    sink = fs.open_output_stream(f"{name}.{mine}")
                    packer, listing = Packer(sink), fs.open_output_stream(f"{name}.{mine}.cdx")
                    packer.begin(WARC)
                payload = row["payload"]
                kind, digest, uri = "response" if row["response"] else "revisit", base32_sha1(payload), target_uri(row["url"])
                place = "" if row["response"] and row["dup"] else f"{part}.{n}"
                raw = gzipped(record(row["page_id"], row["url"], payload, kind, row["first_id"], digest, place, date))
                stamp = "".join(filter(str.isdigit, date))[:14]
                mime, status = ("warc/revisit", "-") if kind == "revisit" else ("text/html", "200")
                listing.write(f"{sort_key(uri)} {stamp} {uri or '-'} {mime} {status} {digest} - - {len(raw)} {packer.write(raw)} {WARC}\n".encode())
                n, done = n + 1, done + len(raw)
        if packer is None:
            return
        packer.end()
        packer.begin(INDEX)
        packer.write(CDX_HEAD)
        listing.close()
        with fs.open_input_stream(f"{name}.{mine}.cdx") as lines:
            while part_of := lines.read(1 << 20):
                packer.write(part_of)
        fs.delete_file(f"{name}.{mine}.cdx")
        packer.end()
        packer.close()
        sink.close()
        publish(fs, f"{name}.{mine}", name)
        yield pa.RecordBatch.from_pydict({"path": [f"{out}/part-{part:06d}.zip"], "n_records": [n], "n_bytes": [done]})

    return stored(marked.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = open_fs(path)
            with fs.open_input_file(at) as source:
                found = directory(source, source.size())
                data, listing = found[WARC], found[INDEX]
                if data[2] or listing[2]:
                    raise ValueError(f"{path}: members must be stored")
                out, rest, place = [], b"", listing[0]
                first = last = None
                lengths: list[int] = []
                while place < listing[0] + listing[1]:
                    raw = rest + source.read_at(min(1 << 20, listing[0] + listing[1] - place), place)
                    place += len(raw) - len(rest)
                    *lines, rest = raw.split(b"\n")
                    for line in lines:
                        if line.startswith(b" CDX"):
                            continue
                        n, off = map(int, line.split(b" ")[8:10])
                        if first is not None and off + n - first > CHUNK_BYTES:
                            out.append((path, data[0] + first, lengths))
                            first, lengths = None, []
                        first = off if first is None else first
                        lengths.append(n)
                if lengths:
                    out.append((path, data[0] + first, lengths))
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in out], "start": pa.array([x[1] for x in out], pa.int64()), "lengths": pa.array([x[2] for x in out], pa.list_(pa.int64()))})


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _number(text: str) -> int | None:
    return int(text) if text else None


def _records(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["path"])
                out = []
                with fs.open_input_file(at) as source:
                    raw, at = source.read_at(sum(row["lengths"]), row["start"]), 0
                for n in row["lengths"]:
                    fields, payload = parse_record(zlib.decompress(raw[at : at + n], 31))
                    at += n
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"payload digest differs in {row['path']}")
                    refers = _number(fields["Refers-To-Page-ID"]) if kind == "revisit" else None
                    out.append((_number(fields["Page-ID"]), int(fields["Payload-Length"]), digest, kind, refers, fields.get("WARC-Target-URI", ""), payload if with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = manifest.select("path").repartition(n, "path").mapInArrow(_chunks, "path string, start long, lengths array<long>")
    return chunks.repartition(n, "path", "start").mapInArrow(_records(with_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(manifest, with_payload=False).drop("url", "payload")
