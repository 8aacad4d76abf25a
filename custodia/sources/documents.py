"""Reading document collections."""

from pyspark.sql import DataFrame, SparkSession

DOCUMENT_SCHEMA = (
    "id string, title string, content string, domain string, author string, date date, "
    "classification string"
)


def scan_documents(spark: SparkSession, path: str, array_files=True) -> DataFrame:
    """Documents from JSON: files holding one array each, or one object per line.

    A missing path or an invalid file aborts. Array files are read whole by one task each, so a
    large collection should be many files or JSON lines."""
    reader = spark.read.schema(DOCUMENT_SCHEMA).option("mode", "FAILFAST")
    return reader.option("multiLine", str(array_files).lower()).json(path)
