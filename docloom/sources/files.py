"""File sources: types, routing, decoding, JSON and JSONL of several shapes, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {"txt": "TXT", "md": "MARKDOWN", "markdown": "MARKDOWN", "html": "HTML", "htm": "HTML", "pdf": "PDF", "docx": "DOCX", "xlsx": "XLSX", "csv": "CSV", "json": "JSON", "pptx": "PPTX"}
NATIVE = ("TXT", "MARKDOWN", "HTML")
REJECTED = ("XLS", "DOC")


def file_type(name: Column, given: Column, mime: Column) -> Column:
    """An explicit type, else by suffix, else text by media type, else unknown."""
    suffix = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    explicit = F.nullif(F.upper(F.trim(F.coalesce(given, F.lit("")))), F.lit(""))
    return F.coalesce(explicit, F.try_element_at(known, suffix), F.upper(suffix), F.when(mime.startswith("text/"), "TXT"), F.lit("UNKNOWN"))


def route(kind: Column) -> Column:
    """Which parser takes a type."""
    return F.when(kind.isin(*REJECTED), "REJECTED").when(kind.isin(*NATIVE), "NATIVE_TEXT").when(kind == "UNKNOWN", "REJECTED").otherwise("LAYOUT_SERVICE")


def decode_base64(text: Column) -> Column:
    """Bytes of strict base64; null where it is empty or not valid."""
    return F.nullif(F.try_to_binary(text, F.lit("base64")), F.lit(b""))


def decode_text(content: Column) -> Column:
    """UTF-8, else GB18030, else UTF-8 with replacement marks; a byte-order mark stays."""
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))

    @F.pandas_udf("string")
    def other(raw):
        def one(b):
            try:
                return bytes(b).decode("gb18030")
            except UnicodeDecodeError:
                return bytes(b).decode("utf-8", "replace")

        return raw.map(lambda b: None if b is None else one(b))

    # only what is not UTF-8 passes through Python
    return F.coalesce(utf8, other(F.when(utf8.isNull(), content)))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, content, kind, parser) of the files of a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", F.substring_index("path", "/", -1).alias("name"), "content")
    typed = named.withColumn("kind", file_type(F.col("name"), F.lit(None).cast("string"), F.lit("")))
    return typed.withColumn("parser", route(F.col("kind")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file: blank lines and what is no object are skipped, other fields ignored."""
    lines = spark.read.text(path).where("trim(value) like '{%'")
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files that hold a list, an object with a ``data`` list, one object, or an object per line."""
    files = spark.read.option("wholetext", "true").text(path).select(F.trim("value").alias("v"))
    listed = F.from_json(F.col("v"), f"array<struct<{schema}>>")
    enveloped = F.from_json(F.col("v"), f"data array<struct<{schema}>>")["data"]
    one = F.array(F.from_json(F.col("v"), schema))
    lines = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, schema))
    many = (F.size(F.filter(F.split("v", "\n"), lambda x: F.trim(x).startswith("{"))) > 1) & F.try_parse_json("v").isNull()
    rows = F.when(F.col("v").startswith("["), listed).when(many, lines).when(enveloped.isNotNull(), enveloped).otherwise(one)
    return files.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def artifacts(blocks: DataFrame) -> DataFrame:
    """(doc_id, kind, content, sha256): each document's blocks as Markdown and as JSON."""
    row = F.sort_array(F.collect_list(F.struct("block_no", "block_type", "block_text")))
    grouped = blocks.groupBy("doc_id").agg(row.alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.when(x["block_type"] == "TITLE", F.concat(F.lit("# "), x["block_text"])).otherwise(x["block_text"])), "\n\n")
    pair = F.array(F.struct(F.lit("MARKDOWN").alias("kind"), text.alias("content")), F.struct(F.lit("JSON_BLOCKS").alias("kind"), F.to_json("b").alias("content")))
    return grouped.select("doc_id", F.explode(pair).alias("a")).select("doc_id", "a.*", F.sha2("a.content", 256).alias("sha256"))
