"""Sources and sinks: tables, manifests, uploads, artifacts, and changes of stored tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scalars as X

MANIFEST = (
    "document_id string, document_type string, image_number int, split string, image_path string, text string, ground_truth_text string, "
    "pii_items array<struct<type:string,value:string,expected_redaction_action:string>>, page_number int, line_bbox array<double>"
)
PREDICTION = "backend string, image_path string, page_number int, truth string, prediction string, confidence double, cer double, wer double, elapsed_seconds double"
UPLOAD_KINDS = ["pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "docx"]
MAX_UPLOAD = 25 * 1024 * 1024
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails at the first bad line, otherwise bad lines are skipped, as blank ones are."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A manifest by its suffix: CSV with a header (all strings), else JSON lines."""
    return spark.read.option("header", True).csv(path) if path.lower().endswith(".csv") else read_jsonl(spark, path, schema)


def local_csv(rows: DataFrame, image: list[str], text: list[str], split: str = "train") -> DataFrame:
    """image_path, text and split from the first of several column names each; rows without image or text go."""
    pick = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in rows.columns))
    kind = F.col("split") if "split" in rows.columns else F.lit(None).cast("string")
    kind = F.when(kind.isin("val", "valid", "dev"), "validation").otherwise(F.coalesce(kind, F.lit(split)))
    return rows.select(pick(image).alias("image_path"), pick(text).alias("text"), kind.alias("split")).dropna(subset=["image_path", "text"])


def answer_keys(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document for each file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)


def upload_problems(rows: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """rows with safe_name, kind and problem (null if the file may come in): suffix, size, first bytes."""
    suffix = F.lower(F.element_at(F.split(F.col(name), r"\."), -1))
    kind, size = X.sniffed(F.col(content)), F.length(content)
    alias = F.when(suffix.isin("jpg", "jpeg"), "jpg").when(suffix.isin("tif", "tiff"), "tiff").otherwise(suffix)
    problem = F.when(~suffix.isin(UPLOAD_KINDS), "unsupported type").when(size == 0, "empty file").when(size > MAX_UPLOAD, "too large").when((suffix != "webp") & ~kind.eqNullSafe(alias), "content does not match type")
    return rows.select("*", X.safe_filename(F.col(name)).alias("safe_name"), kind.alias("kind"), problem.alias("problem"))


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs and table rows (cells four spaces apart) of a DOCX in order, without blank ends."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t")).strip()
    out = []
    for child in body if body is not None else []:
        if child.tag == f"{WORD}p":
            out.append(text(child))
        elif child.tag == f"{WORD}tbl":
            out += ["    ".join(text(c) for c in row.findall(f"{WORD}tc")) for row in child.findall(f"{WORD}tr")]
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    return out


def docx_pages(rows: DataFrame) -> DataFrame:
    """path, text and error of DOCX files (path, content); a file that cannot be read fails alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    lines = docx_lines(bytes(content))
                    out.append((path, "\n".join(lines) or None, None if lines else "no text"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((path, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return rows.select("path", "content").mapInPandas(run, "path string, text string, error string")


def docx_bytes(text: str) -> bytes:
    """A minimal DOCX with one paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    parts = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> None:
    """One folder of text for each key. With buckets, Parquet files of key and text in that many folders by the key's hash
    instead: a folder for each of very many keys is more than file systems and their listings bear."""
    if buckets is None:
        rows.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    rows.select(bucket, key, F.col(text).alias("value")).repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_text(spark: SparkSession, path: str, key: str, value, buckets: int) -> DataFrame:
    """The rows of one key that write_texts put into buckets; reads that key's folder only."""
    rows = spark.read.parquet(path)
    at = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast(rows.schema[key].dataType)), F.lit(buckets)).cast("int")).first()[0]
    return rows.where((F.col("bucket") == at) & (F.col(key) == value)).select(key, "value")


def write_artifacts(rows: DataFrame, path: str, fields: list[str]) -> None:
    """One JSON object of the fields for each row, with sorted keys, as lines of text."""
    rows.select(F.to_json(F.struct(*sorted(fields))).alias("value")).write.mode("overwrite").text(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Rows added to a table of Parquet files."""
    rows.write.mode("append").parquet(path)


def write_report(summary: DataFrame, path: str) -> None:
    """A summary of few rows as one file of JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def renamed_splits(rows: DataFrame, split: str = "split") -> DataFrame:
    """Splits of a published dataset under this package's names."""
    return rows.withColumn(split, F.when(F.col(split).isin("val", "valid", "validation", "dev"), "validation").when(F.col(split) == "test", "test").otherwise("train"))


#: Datasets by name: a function of the session and its options.
DATASETS: dict = {"manifest": read_manifest, "jsonl": read_jsonl, "answer_keys": answer_keys}


def dataset(spark: SparkSession, name: str, **options) -> DataFrame:
    """A registered dataset; more can be put into DATASETS."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, **options)


def replace_documents(rows: DataFrame, path: str, partition: str) -> None:
    """Write rows over the partitions that they hold; running again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def migrated(rows: DataFrame, additions: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with the columns they lack added: name -> (type, default)."""
    return rows.withColumns({n: default.cast(kind) for n, (kind, default) in additions.items() if n not in rows.columns})


def with_first_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages, and a first page for documents that have none."""
    lacking = documents.join(pages.where("page_number = 1").select(F.col("document_id").alias("id")), "id", "left_anti")
    return pages.unionByName(lacking.select(F.col("id").alias("document_id"), F.lit(1).cast(pages.schema["page_number"].dataType).alias("page_number")), allowMissingColumns=True)
