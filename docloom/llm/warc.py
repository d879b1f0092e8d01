"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Pages become records of type response, or revisit where an equal payload has been
stored already; only one copy of a payload moves. Tasks write archives of
bounded size into the shared folder and name them in a table, so an archive that a lost task
left behind is never read. The reader takes archives of any writer with this layout
through Spark's binary file source, decodes frame by frame and checks what each record says of itself.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_batches, pick, shared_dir, worker_state, written

#: Payloads below this are stored each time.
LEAST_BYTES = 100
#: Uncompressed bytes after which a task begins another archive; a larger record has one of its own.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is made from at most this many payloads, and the first bytes of each.
SAMPLE_PAYLOADS = 400
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
#: Compressed bytes that the reader hands to a decoder at once.
STEP = 1 << 15

# Magic numbers of the frame formats, and the words of the WARC format.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
DICTIONARY = b"\x37\xa4\x30\xec"
VERSIONS = ("WARC/1.0", "WARC/1.1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http; msgtype=response"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

RECORD = "archive string, at long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to_id string, payload string, problem string"


def _page_order(page: Column, url: Column) -> Column:
    """Sorts by page, null last, then by address."""
    return F.struct(page.isNull().alias("none"), page.alias("page_id"), url.isNull().alias("no_url"), url.alias("url"))


def _coder(dictionary: bytes | None) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    known = None if dictionary is None else zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True), zstandard.ZstdDecompressor(dict_data=known)


def _packed(dictionary: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, _ = _coder(dictionary)
        for batch in batches:
            payloads = [(x.as_py() or "").encode("utf-8", "replace") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(map(press.compress, payloads), pa.binary()),
                    pa.array(map(len, payloads), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in payloads]),
                ],
                names=["page_id", "url", "payload", "payload_bytes", "payload_digest"],
            )

    return run


def records_of(pages: DataFrame, dictionary: bytes | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record_id, record_type, url, payload, payload_bytes, payload_digest, refers_to_id, refers_to_url) of every page; payloads are compressed, as they move.

    Of payloads of at least ``least_bytes`` that are equal, the one with the
    smallest page_id (null last, then by url) is the response, all others revisit it. A null html is an empty payload.
    Repeated rows are records of their own.
    """
    narrow = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = written(in_batches(narrow, _packed(dictionary), "page_id long, url string, payload binary, payload_bytes long, payload_digest string"), "payloads")
    order = _page_order(F.col("page_id"), F.col("url"))
    large = F.col("payload_bytes") >= least_bytes
    # equal rows become one with a number; a short payload stays with them, of a large one a single copy moves
    counted = rows.groupBy("page_id", "url", "payload_bytes", "payload_digest").agg(F.count("*").alias("copies"), F.min(F.when(~large, F.col("payload"))).alias("short"))
    stored = rows.where(large).groupBy("payload_digest").agg(F.min(F.struct(order.alias("order"), "payload", "payload_bytes")).alias("m"))
    stored = stored.select("payload_digest", F.col("m.order.page_id").alias("page_id"), F.col("m.order.url").alias("url"), F.col("m.payload").alias("payload"), F.col("m.payload_bytes").alias("payload_bytes"))

    def name(page: str, url: str, copy: Column) -> Column:
        mark = F.left(F.sha2(F.concat_ws(" ", F.coalesce(F.col(url), F.lit("")), F.col(url).isNull().cast("string"), "payload_digest"), 256), F.lit(32))
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), mark, F.lit(":"), copy.cast("string"), F.lit(">"))

    none = F.lit(None).cast("string")
    figures = ["payload", "payload_bytes", "payload_digest"]
    first = stored.select(name("page_id", "url", F.lit(0)).alias("record_id"), F.lit("response").alias("record_type"), "url", *figures, none.alias("refers_to_id"), none.alias("refers_to_url"))
    small = _copies(counted.where(~large), F.lit(0)).select(
        name("page_id", "url", F.col("copy")).alias("record_id"), F.lit("response").alias("record_type"), "url", F.col("short").alias("payload"), *figures[1:], none.alias("refers_to_id"), none.alias("refers_to_url")
    )
    lead = rows.where(large).groupBy("payload_digest").agg(F.min(order).alias("lead"))
    met = counted.where(large).join(lead, "payload_digest")
    own = F.col("page_id").eqNullSafe(F.col("lead.page_id")) & F.col("url").eqNullSafe(F.col("lead.url"))
    again = _copies(met, F.when(own, 1).otherwise(0)).withColumns({"lead_page": F.col("lead.page_id"), "lead_url": F.col("lead.url")})
    again = again.select(
        name("page_id", "url", F.col("copy")).alias("record_id"), F.lit("revisit").alias("record_type"), "url", F.lit(None).cast("binary").alias("payload"), *figures[1:],
        name("lead_page", "lead_url", F.lit(0)).alias("refers_to_id"), F.col("lead_url").alias("refers_to_url"),
    )
    return first.unionByName(small).unionByName(again)


def _copies(counted: DataFrame, first: Column, block: int = 10_000) -> DataFrame:
    """A row for each ``copy`` from ``first`` to below ``copies``; rows with very many copies are dealt out in blocks."""
    whole = counted.withColumn("first", first.cast("long")).where("first < copies")
    few, many = whole.where(F.col("copies") <= block), whole.where(F.col("copies") > block)
    blocks = many.withColumn("first", F.explode(F.expr(f"sequence(first, copies - 1, {block}L)"))).withColumn("copies", F.least("copies", F.col("first") + block)).repartition("payload_digest", "first")
    return few.unionByName(blocks).withColumn("copy", F.explode(F.expr("sequence(first, copies - 1)")))


def train_dictionary(pages: DataFrame, payloads: int = SAMPLE_PAYLOADS, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes | None:
    """A Zstandard dictionary from the beginnings of at most ``payloads`` payloads, spread by hash; None where there is too little to learn from."""
    html = pick(pages, "page_id", "html").where("html is not null")
    spread = max(1, html.count() // payloads)
    chosen = html.where(F.pmod(F.xxhash64("page_id"), F.lit(spread)) == 0).select(F.left("html", F.lit(sample_bytes)).alias("text")).limit(payloads)
    samples = [x[:sample_bytes] for x in (r["text"].encode("utf-8", "replace") for r in chosen.collect()) if len(x) >= 8]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(size, total // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return None


def archive_head(dictionary: bytes | None) -> bytes:
    """The skippable frame with the compressed dictionary that an archive begins with; nothing without one."""
    if dictionary is None:
        return b""
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_FRAME + struct.pack("<I", len(body)) + body


def _line(value: str) -> str:
    """A header value on one line: white space and control characters are percent-encoded."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def encode_record(row: dict, payload: bytes, date: str) -> bytes:
    """The bytes of one record: version, headers, a blank line, the block and the two line ends that close it."""
    if row["record_type"] == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date)]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", _line(row["url"])))
    headers += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", RESPONSE_TYPE)]
    if row["record_type"] == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", row["refers_to_id"])]
        if row["refers_to_url"] is not None:
            headers.append(("WARC-Refers-To-Target-URI", _line(row["refers_to_url"])))
    headers.append(("Content-Length", str(len(block))))
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in headers)])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archived(folder: str, dictionary: bytes | None, date: str, most: int):
    head = archive_head(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = _coder(dictionary)
        place, root = pa.fs.FileSystem.from_uri(folder)
        parts, size, n = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with place.open_output_stream(name, compression=None) as out:
                out.write(head)
                for part in parts:
                    out.write(part)
            return pa.RecordBatch.from_pydict({"name": [name.rpartition("/")[2]], "records": [n], "bytes": [len(head) + sum(map(len, parts))]})

        for batch in batches:
            for row in batch.to_pylist():
                record = encode_record(row, b"" if row["payload"] is None else unpress.decompress(row["payload"]), date)
                if n and size + len(record) > most:
                    yield close()
                    parts, size, n = [], 0, 0
                parts.append(press.compress(record))
                size, n = size + len(record), n + 1
        if n:
            yield close()

    return run


def write_archives(records: DataFrame, folder: str, dictionary: bytes | None = None, date: str = "2000-01-01T00:00:00Z", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of ``records_of``, made with the same dictionary, as archives into ``folder``; a table (name, records, bytes) has those that count.

    Pages have no date of capture, so all records carry ``date``. Nothing is written for an empty table.
    """
    place, root = pa.fs.FileSystem.from_uri(folder)
    place.create_dir(root, recursive=True)
    return written(in_batches(records, _archived(folder, dictionary, date, most), "name string, records long, bytes long"), "archives")


class BadRecord(ValueError):
    """What is wrong with an archive or a record."""


@lru_cache(maxsize=8)
def _decoder(dictionary: bytes | None) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=None if dictionary is None else zstandard.ZstdCompressionDict(dictionary))


def read_dictionary(data: memoryview) -> tuple[bytes | None, int]:
    """(dictionary, bytes of the frame) of an archive's leading skippable frame; (None, 0) without one."""
    if bytes(data[:4]) != DICTIONARY_FRAME:
        return None, 0
    if len(data) < 8 or len(data) < 8 + (size := struct.unpack("<I", data[4:8])[0]):
        raise BadRecord("the dictionary's frame ends early")
    body = bytes(data[8 : 8 + size])
    if body[:4] == FRAME:
        try:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError as e:
            raise BadRecord(f"the dictionary cannot be decoded: {e}") from None
    if body[:4] != DICTIONARY:
        raise BadRecord("the leading frame holds no dictionary")
    return body, 8 + size


def frames(data: memoryview, dictionary: bytes | None, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of each frame from ``at`` on, decoded in small steps; other skippable frames are passed over."""
    while at < len(data):
        magic = bytes(data[at : at + 4])
        if magic != FRAME:
            if len(magic) == 4 and magic[1:] == DICTIONARY_FRAME[1:] and 0x50 <= magic[0] <= 0x5F and at + 8 <= len(data):
                at += 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
                continue
            raise BadRecord("no frame begins where one should")
        decoder, content, to = _decoder(dictionary).decompressobj(), [], at
        try:
            while not decoder.eof and to < len(data):
                step = data[to : to + STEP]
                content.append(decoder.decompress(step))
                to += len(step)
        except zstandard.ZstdError as e:
            raise BadRecord(f"the frame cannot be decoded: {e}") from None
        if not decoder.eof:
            raise BadRecord("the last frame ends early")
        yield at, b"".join(content)
        at = to - len(decoder.unused_data)


def _digest_of(text: str, data: bytes) -> bool:
    """Whether a digest header is that of the data; a digest of another kind than SHA-256 is not judged."""
    kind, _, value = text.partition(":")
    return kind.lower() != "sha256" or value.lower() == hashlib.sha256(data).hexdigest()


def decode_record(content: bytes) -> dict:
    """One record's fields, after checks of its version, headers, length and digests.

    ``record_type`` and ``payload`` (after the HTTP head, null in a revisit) among them.
    Raises BadRecord with what does not fit.
    """
    head, blank, rest = content.partition(b"\r\n\r\n")
    if not blank:
        raise BadRecord("the headers have no end")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if version not in VERSIONS:
        raise BadRecord("the version is not known")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadRecord("a header line has no name")
        if name.lower() in headers:
            raise BadRecord(f"{name} stands twice")
        headers[name.lower()] = value.strip()
    for name in REQUIRED:
        if not headers.get(name.lower()):
            raise BadRecord(f"{name} is missing")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit():
        raise BadRecord("Content-Length is no number")
    if len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord(f"the block has {len(rest) - 4} bytes, Content-Length says {length}")
    block = rest[:-4]
    if "warc-block-digest" in headers and not _digest_of(headers["warc-block-digest"], block):
        raise BadRecord("the block does not have its digest")
    out = {"record_id": headers["warc-record-id"], "record_type": headers["warc-type"], "url": headers.get("warc-target-uri"), "refers_to_id": headers.get("warc-refers-to")}
    out |= {"payload": None, "payload_bytes": None, "payload_digest": None}
    kind, _, value = headers.get("warc-payload-digest", "").partition(":")
    if kind.lower() == "sha256":
        out["payload_digest"] = value.lower()
    if out["record_type"] not in ("response", "revisit"):
        return out
    http, blank, body = block.partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise BadRecord("the block is no HTTP message")
    stated = [v.strip() for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"]
    if out["record_type"] == "revisit":
        if not out["refers_to_id"]:
            raise BadRecord("WARC-Refers-To is missing")
        if body:
            raise BadRecord("a revisit has a payload")
        out["payload_bytes"] = int(stated[0]) if stated and stated[0].isdigit() else None
        return out
    if stated and stated[0] != str(len(body)).encode():
        raise BadRecord(f"the payload has {len(body)} bytes, its head says {stated[0].decode('ascii', 'replace')}")
    if "warc-payload-digest" in headers and not _digest_of(headers["warc-payload-digest"], body):
        raise BadRecord("the payload does not have its digest")
    out |= {"payload": body, "payload_bytes": len(body), "payload_digest": out["payload_digest"] or hashlib.sha256(body).hexdigest()}
    return out


def decode_archive(data: bytes) -> Iterator[dict]:
    """Records of an archive with their place in it; one that does not fit has only ``problem``, after a broken frame nothing follows."""
    view, at = memoryview(data), 0
    try:
        dictionary, at = read_dictionary(view)
        for place, content in frames(view, dictionary, at):
            at = place
            try:
                yield {"at": place, "problem": None} | decode_record(content)
            except BadRecord as e:
                yield {"at": place, "problem": str(e)}
    except BadRecord as e:
        yield {"at": at, "problem": str(e)}


def _decoded(with_payload: bool):
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("warc")
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for record in decode_archive(content.as_py()):
                    body = record.get("payload")
                    record |= {"archive": path.as_py(), "payload": body.decode("utf-8", "replace") if body is not None and with_payload else None}
                    rows.append([record.get(n) for n in names])
                    size += len(body or b"")
                    if len(rows) >= 5000 or size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, paths: list[str] | str, with_payload: bool = True) -> DataFrame:
    """Records of archives: archive, at, record_id, record_type, url, payload_bytes, payload_digest, refers_to_id, payload, problem.

    ``paths`` are files or folders of any file system that Spark reads. A
    record that breaks the format has nothing but its place and ``problem``. A payload is text in UTF-8,
    bytes that are none are replaced; other record types than response and revisit have no payload.
    """
    files = spark.read.format("binaryFile").load(paths)
    return in_batches(files.select("path", "content"), _decoded(with_payload), RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Records of ``read_archives`` with revisits filled from what they refer to: payload_bytes, payload_digest and payload of that response.

    A revisit whose response is missing, or has another digest or length, gets a ``problem``.
    """
    stored = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), F.col("payload").alias("p")
    )
    revisits = records.where("record_type = 'revisit'").join(stored, "refers_to_id", "left")
    fits = F.col("payload_digest").eqNullSafe(F.col("d")) & F.coalesce(F.col("payload_bytes") == F.col("b"), F.lit(True))
    problem = F.when(F.col("d").isNull(), "what it refers to is missing").when(~fits, "what it refers to has another payload").otherwise(F.col("problem"))
    filled = revisits.withColumns({"payload": F.col("p"), "payload_bytes": F.col("b"), "payload_digest": F.coalesce("d", "payload_digest"), "problem": problem})
    return records.where("record_type is null or record_type != 'revisit'").unionByName(filled.select(*records.columns))


def page_of(record_id: Column) -> Column:
    """The page_id in a record id of ``records_of``; null where the page had none."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*):", 1).try_cast("long")


def archived_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES, most: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written as archives and read back.

    A null html is an empty payload; repeated rows, and rows that share an id,
    are records of their own; a null page_id stays null and sorts last; extra columns are ignored. An
    empty table writes no archive. A record that cannot be read back is an error, never a lost row.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if ":" not in folder.split("/")[0]:
        folder = spark.conf.get("spark.hadoop.fs.defaultFS", "file://").rstrip("/") + folder
    dictionary = train_dictionary(pages)
    manifest = write_archives(records_of(pages, dictionary, least_bytes), folder, dictionary, most=most)
    found = read_archives(spark, folder, with_payload=False).withColumn("name", F.substring_index("archive", "/", -1))
    records = resolve(found.join(manifest.select("name"), "name", "left_semi").drop("name"))  # a lost task's archive is in no row of the manifest
    kind = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "at", "problem")).cast("string")).otherwise(F.col("record_type"))
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", kind.alias("record_type"), page_of(F.col("refers_to_id")).alias("refers_to"))
