"""Files as rows: kinds, limits, validation and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and names of each family, and size limits in bytes.
TEXT_EXTENSIONS = ("txt", "md", "csv", "tsv", "json", "jsonl", "xml", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "log", "sql", "js", "ts", "jsx", "tsx", "py", "rb", "go", "rs", "java", "kt", "c", "h", "cpp", "cs", "php", "sh", "bash", "ps1", "bat", "html", "css", "tf", "tfvars", "properties", "pem")
DOCUMENT_EXTENSIONS = ("pdf", "docx", "xlsx")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp")
TEXT_NAMES = ("dockerfile", "makefile")
FAST, OPTIMIZED, LARGEST = 2 << 20, 4 << 20, 50 << 20
MOST_SMALL, MOST_LARGE = 20, 5


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"[\\/]"), -1))


def extension(path: Column) -> Column:
    """After the last dot; ``.env`` is its own, other names that begin or end with their only dot have none."""
    name = base_name(path)
    return F.when(name.rlike(r"\A\.env(\..*)?\z"), "env").otherwise(F.regexp_extract(name, r"\A[^.].*\.([^.]+)\z|\A[^.]+\.([^.]+)\z", 1))


def mime(x: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(x, F.lit("")), ";", 1)))


def classified(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with name, extension, family and status."""
    name, ext = base_name(F.col(path)), extension(F.col(path))
    family = F.when(name.isin(*TEXT_NAMES) | ext.isin(*TEXT_EXTENSIONS), "text").when(ext.isin(*DOCUMENT_EXTENSIONS), "document").when(ext.isin(*IMAGE_EXTENSIONS), "image").otherwise("unknown")
    out = files.withColumn("name", name).withColumn("extension", ext).withColumn("family", family)
    return out.withColumn("status", F.when(F.col("family") == "text", "supported").when(F.col("family").isin("document", "image"), "planned_unsupported").otherwise("unsupported"))


def size_zone(size: Column) -> Column:
    return F.when(size <= FAST, "fast").when(size <= OPTIMIZED, "optimized").otherwise("blocked")


def validated(files: DataFrame) -> DataFrame:
    """``files`` (path, length, content) with a code: unsupported, too-large, binary, invalid-utf8 or ok. No bad file fails the job."""
    out = classified(files)
    head = F.substring("content", 1, 65536)
    zeros = F.length(F.decode(head, "ISO-8859-1")) - F.length(F.replace(F.decode(head, "ISO-8859-1"), F.lit("\0"), F.lit("")))
    heavy = (zeros >= 1) & (zeros * 100 >= F.length(head))
    bad = F.try_validate_utf8(F.col("content").cast("string")).isNull()
    code = F.when(F.col("status") != "supported", "unsupported").when(F.col("length") > LARGEST, "too-large").when(heavy, "binary").when(bad, "invalid-utf8").otherwise("ok")
    return out.withColumn("code", code).withColumn("text", F.when(F.col("code") == "ok", F.col("content").cast("string")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as validated text rows."""
    return validated(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content"))


def batches(files: DataFrame, batch: str = "batch_id", size: str = "length") -> DataFrame:
    """Verdict of each batch before any file is read: few enough small and large files, none over the limit."""
    small = F.col(size) <= OPTIMIZED
    counts = files.groupBy(batch).agg(F.count_if(small).alias("n_small"), F.count_if(~small).alias("n_large"), F.bool_and(F.col(size) <= LARGEST).alias("in_limit"))
    return counts.withColumn("admitted", (F.col("n_small") <= MOST_SMALL) & (F.col("n_large") <= MOST_LARGE) & F.col("in_limit"))
