"""Sources: uploaded files, text acquisition, recognised words, job tables, training samples, label files.

Recognition engines and model inference are outside; what they produce comes in as the tables below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import EXACT, has, sub

WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("page", T.IntegerType())])
SAMPLE = "id string, image_path string, words array<string>, bboxes array<array<int>>, labels array<int>, label_names array<string>, non_o int"
JOB_TABLES = {
    "batch_job": "id long, uploaded_by long, created_at timestamp, status string, total_files int, done_files int, batch_excel string, batch_zip string, error_msg string, used_for_training boolean",
    "invoice_job": "id long, uploaded_by long, batch_id long, original_filename string, uploaded_file string, status string, extracted_data string, output_file string, uploaded_at timestamp, processed_at timestamp, error_msg string, field_count int, used_for_training boolean",
    "training_run": "id long, started_at timestamp, finished_at timestamp, status string, invoices_used int, epochs int, best_f1 double, model_path string, log string, triggered_by long",
    "model_version": "id long, version int, created_at timestamp, training_run_id long, f1_score double, invoices_trained_on int, model_path string, is_active boolean, notes string",
    "user_profile": "id long, user_id long, company_name string, gstin string, created_at timestamp",
    "uploaded_document": "id long, user_id long, original_file string, original_filename string, file_type string, output_excel string, status string, error_message string, uploaded_at timestamp, processed_at timestamp, invoice_number string, gstin_supplier string, gstin_recipient string, invoice_date string, total_amount string, total_tax string",
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def accepted(path: Column, size: Column) -> Column:
    """Whether a file has an allowed suffix and size."""
    return suffix(path).isin(fixed.UPLOAD_SUFFIXES) & (size <= fixed.UPLOAD_BYTES)


def upload_gate(files: DataFrame, path: str = "path", size: str = "length", batch: str | None = None) -> DataFrame:
    """files with ``gate``: 'accepted', 'skipped' for suffix or size, 'over' beyond the first files of a batch (without ``batch`` all are one)."""
    fine = accepted(F.col(path), F.col(size))
    if batch is None:
        # a table of so many paths at most
        first = files.where(fine).select(F.col(path).alias("_first")).orderBy("_first").limit(fixed.UPLOAD_FILES).distinct()
        marked = files.join(F.broadcast(first), F.col(path) == F.col("_first"), "left")
        return marked.withColumn("gate", F.when(~fine, "skipped").when(F.col("_first").isNull(), "over").otherwise("accepted")).drop("_first")
    rank = F.row_number().over(W.partitionBy(batch, fine).orderBy(path))
    return files.withColumn("gate", F.when(~fine, "skipped").when(rank > fixed.UPLOAD_FILES, "over").otherwise("accepted"))


def files(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """Files of a folder, sorted by path when ordered: path, length, modificationTime, content."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return got.where(suffix(F.col("path")).isin(suffixes)) if suffixes else got


def has_text_layer(text: Column) -> Column:
    """A PDF's own text counts if it is longer than 80 characters."""
    return F.coalesce(F.length(F.trim(text)) > 80, F.lit(False))


def needs_hard_preprocessing(width: Column, height: Column, scanned_page: bool = True) -> Column:
    return width * height > (2_000_000 if scanned_page else 1_500_000)


def confident_text(lines: Column, least: float = 0.25) -> Column:
    """Recognised lines (structs text, confidence) above a threshold, joined by line feeds."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["confidence"] > least), lambda x: x["text"]), "\n")


def needs_fallback(text: Column, least: int = 20) -> Column:
    return F.length(F.trim(text)) < least


def longest_layout(layouts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Per document the longest of several recognitions, the first of equals."""
    length = F.length(F.trim(text))
    return layouts.groupBy(key).agg(F.max_by(text, F.struct(length.alias("n"), (-F.col(order)).alias("o"))).alias(text))


def acquire_text(layer: Column, pages: Column) -> Column:
    """A PDF's text layer and every page's recognised text, all joined by line feeds."""
    return F.array_join(F.concat(F.when(has_text_layer(layer), F.array(layer)).otherwise(F.array().cast("array<string>")), F.coalesce(pages, F.array().cast("array<string>"))), "\n")


def document_words(pages: DataFrame, key: str, words: str) -> DataFrame:
    """One row per recognised word with its page number, from arrays of words per page."""
    return pages.select(key, F.posexplode(words).alias("page0", "ws")).select(key, (F.col("page0") + 1).alias("page"), F.posexplode("ws").alias("pos", "word")).select(key, "page", "pos", "word.*")


def job_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A job table kept as Parquet, in its declared schema."""
    return spark.read.schema(JOB_TABLES[name]).parquet(f"{folder}/{name}")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str = "id", low: int = 0, high: int = 1_000_000, parts: int = 8) -> DataFrame:
    """A job table in a database, read in parallel ranges of its key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def training_samples(spark: SparkSession, path: str, lists: bool = True) -> DataFrame:
    """Training samples of JSON lists, a list in each file, or of one object a line as write_samples writes them."""
    return spark.read.schema(SAMPLE).option("multiLine", str(lists).lower()).json(path)


def label_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, word, label) of tab-separated label files, one word per line."""
    got = spark.read.schema("word string, label string").option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.txt").csv(folder)
    return got.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("doc_id"), "word", "label")


def is_latin(value: Column) -> Column:
    return ~has(value, r"[^\x20-\x7E -ɏ]", EXACT)


def one_line(word: Column) -> Column:
    """A word without tabs and line feeds, for label files."""
    return sub(word, "[\t\n]", " ", EXACT)
