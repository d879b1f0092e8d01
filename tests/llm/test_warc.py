import hashlib
import struct
from collections import defaultdict

import pyarrow.fs
import pytest
import zstandard

from docloom.llm import warc

from .helpers import prose

SCHEMA = "page_id long, url string, html string, record_id string, payload string, copies long"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 3) for i, u, h in rows], SCHEMA)


def plain(rows):
    groups, out = defaultdict(list), []
    for i, _, html in rows:
        payload = (html or "").encode()
        groups[payload].append(i)
    for payload, ids in groups.items():
        digest, ids = hashlib.sha256(payload).hexdigest(), sorted(ids, key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= 100
            out.append((i, len(payload), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def pages(n=60):
    long = [f"<p>{prose(k, 60)}</p>" for k in range(n)]
    return [(k, f"http://host.example/{k}", long[k % (n // 2)] if k % 3 else long[k]) for k in range(n)]


def odd_pages():
    same, short = "<p>" + prose(1, 80) + "</p>", "x" * 99
    return [
        (900, None, None), (901, "u", ""), (None, "u", same), (None, None, same), (905, "u", same), (905, "u", same), (905, "v", same), (906, None, same), (907, "u", short), (907, "u", short),
        (908, "u", "y" * 100), (909, "u", "y" * 100), (910, "http://a/ b\r\nWARC-Type: x\x00", "é" * 60), (911, "", "\r\n\r\n" * 40), (-5, "u", prose(3, 20_000)), (-6, "u", prose(3, 20_000)), (905, "u", "another text of the same page " * 9),
    ]


def test_equals_plain_grouping(spark):
    rows = pages() + odd_pages()
    assert result(warc.archived_pages(frame(spark, rows).repartition(5))) == plain(rows)


def test_small_archives_and_very_many_copies(spark):
    rows = [(k % 3, "u", "hot page " * 30) for k in range(400)] + pages(20)
    docs = frame(spark, rows)
    assert result(warc.archived_pages(docs, most=2000)) == plain(rows)
    counted = docs.groupBy("page_id").count().withColumnRenamed("count", "copies").withColumn("payload_digest", warc.F.lit("d"))
    copies = warc._copies(counted, warc.F.when(warc.F.col("page_id") == 0, 1).otherwise(0), block=50)
    want = {(k, c) for k, n in {(r["page_id"], r["copies"]) for r in counted.collect()} for c in range(1 if k == 0 else 0, n)}
    got = [(r["page_id"], r["copy"]) for r in copies.collect()]
    assert len(got) == len(want) and set(got) == want


def test_empty_table_and_nothing_to_learn_from(spark):
    assert result(warc.archived_pages(frame(spark, []))) == []
    rows = [(1, "u", None), (2, "u", "a")]
    assert warc.train_dictionary(frame(spark, rows)) is None and result(warc.archived_pages(frame(spark, rows))) == plain(rows)


def test_archives_lead_with_their_dictionary_and_hold_one_frame_a_record(spark, tmp_path):
    docs = frame(spark, pages())
    dictionary = warc.train_dictionary(docs)
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_archives(warc.records_of(docs, dictionary).coalesce(1), folder, dictionary).collect()
    assert sum(r["records"] for r in manifest) == 60
    data = (tmp_path / "a" / manifest[0]["name"]).read_bytes()
    size = struct.unpack("<I", data[4:8])[0]
    assert data[:4] == warc.DICTIONARY_FRAME and zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20) == dictionary
    assert zstandard.get_frame_parameters(data[8 + size :]).dict_id == zstandard.ZstdCompressionDict(dictionary).dict_id() != 0
    assert [r["problem"] for r in warc.decode_archive(data)] == [None] * manifest[0]["records"]
    records = warc.resolve(warc.read_archives(spark, folder))
    want = {i: h for i, _, h in pages()}
    assert {r["p"]: r["payload"] for r in records.select(warc.page_of(records.record_id).alias("p"), "payload").collect()} == want


def record(payload=b"hello", **change):
    row = {"record_type": "response", "record_id": "<urn:page:1:a:0>", "url": "http://x/", "payload_bytes": 5, "payload_digest": hashlib.sha256(b"hello").hexdigest(), "refers_to_id": None, "refers_to_url": None}
    return warc.encode_record(row | change, payload, "2000-01-01T00:00:00Z")


def problems(data):
    return [r["problem"] for r in warc.decode_archive(data)]


def test_archives_of_other_writers():
    press = zstandard.ZstdCompressor()
    good = press.compress(record())
    raw = zstandard.train_dictionary(4096, [prose(k, 60).encode() for k in range(200)])
    known = zstandard.ZstdCompressor(dict_data=raw)
    led = warc.DICTIONARY_FRAME + struct.pack("<I", len(raw.as_bytes())) + raw.as_bytes()
    skipped = b"\x50\x2a\x4d\x18" + struct.pack("<I", 3) + b"abc"
    assert problems(good + skipped + good) == [None, None]
    assert problems(led + known.compress(record()) + skipped) == [None]
    info = press.compress(b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert [(r["record_type"], r["payload"], r["problem"]) for r in warc.decode_archive(info + good)] == [("warcinfo", None, None), ("response", b"hello", None)]
    big = press.compress(record(b"q" * 3_000_000, payload_bytes=3_000_000, payload_digest=hashlib.sha256(b"q" * 3_000_000).hexdigest()))
    assert problems(big + good) == [None, None]


@pytest.mark.parametrize(
    ("old", "new", "said"),
    [
        (b"WARC/1.1", b"WARC/9", "version"), (b"WARC-Date: 2000-01-01T00:00:00Z\r\n", b"", "WARC-Date is missing"), (b"hello", b"hello!", "Content-Length"), (b"hello", b"hullo", "block does not have its digest"),
        (b"Content-Length: 5", b"Content-Length: 6", "block does not have its digest"), (b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: revisit", "twice"), (b"WARC-Type: response", b"WARC-Type response", "no name"),
        (b"\r\n\r\n", b"\r\n", "no end"), (b"WARC-Type: response", b"WARC-Type: revisit", "WARC-Refers-To is missing"),
    ],
)
def test_records_that_break_the_format(old, new, said):
    press = zstandard.ZstdCompressor()
    broken = record().replace(old, new)
    assert broken != record()
    first, second = problems(press.compress(broken) + press.compress(record()))
    assert said in first and second is None


def test_payload_is_checked_where_the_block_has_no_digest():
    import re

    bare = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", record())
    assert problems(zstandard.compress(bare)) == [None]
    assert "payload does not have its digest" in problems(zstandard.compress(bare.replace(b"hello", b"hullo")))[0]
    assert "its head says 7" in problems(zstandard.compress(bare.replace(b"Content-Length: 5", b"Content-Length: 7")))[0]


def test_broken_archives():
    good = zstandard.compress(record())
    assert problems(good + good[:-3]) == [None, "the last frame ends early"]
    assert problems(good + b"garbage") == [None, "no frame begins where one should"]
    assert problems(b"") == []
    assert problems(warc.DICTIONARY_FRAME + struct.pack("<I", 99) + b"x") == ["the dictionary's frame ends early"]
    assert problems(warc.DICTIONARY_FRAME + struct.pack("<I", 4) + b"none") == ["the leading frame holds no dictionary"]
    flipped = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(record()))
    flipped[len(good) // 2] ^= 0xFF
    assert problems(bytes(flipped))[0]


def test_revisits_of_nothing_and_of_another_payload(spark, tmp_path):
    press = zstandard.ZstdCompressor()
    revisit = {"record_type": "revisit", "refers_to_id": "<urn:page:1:a:0>"}
    parts = [record(), record(**revisit, record_id="<b>"), record(**revisit, record_id="<c>", payload_digest="0" * 64), record(record_type="revisit", refers_to_id="<none>", record_id="<d>"), record(**revisit, record_id="<e>", payload_bytes=6)]
    (tmp_path / "a.warc.zst").write_bytes(b"".join(map(press.compress, parts)))
    got = {r["record_id"]: r["problem"] for r in warc.resolve(warc.read_archives(spark, f"file://{tmp_path}")).collect()}
    assert got == {"<urn:page:1:a:0>": None, "<b>": None, "<c>": "what it refers to has another payload", "<d>": "what it refers to is missing", "<e>": "what it refers to has another payload"}


def test_archives_that_no_manifest_names_are_not_read(spark, monkeypatch):
    rows, real = pages(20), warc.write_archives

    def with_orphan(records, folder, *args, **kw):
        out = real(records, folder, *args, **kw)
        place, root = pyarrow.fs.FileSystem.from_uri(folder)
        with place.open_output_stream(f"{root}/orphan.warc.zst", compression=None) as f:
            f.write(zstandard.compress(record()))
        return out

    monkeypatch.setattr(warc, "write_archives", with_orphan)
    assert result(warc.archived_pages(frame(spark, rows))) == plain(rows)
