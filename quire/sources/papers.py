"""Sources and sinks of the paper workflow.

A page provider yields (path, pages array<string>).  PDF text needs a library that may be absent;
everything behind the provider works on the pages relation alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import in_year_folder, path_file, path_parent
from quire.schemas import CSV_READ, CSV_WRITE


def pdf_paths(spark: SparkSession, root: str, recursive: bool = True, year_folders: bool = True) -> DataFrame:
    """(path) of the PDF files; contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", str(recursive).lower()).load(root)
    paths = files.select("path")
    return paths.filter(in_year_folder(F.col("path"))) if recursive and year_folders else paths


def year_folders(paths: DataFrame) -> DataFrame:
    """(folder): distinct parent folders whose name is four digits."""
    return paths.select(path_parent(F.col("path")).alias("folder")).filter(F.col("folder").rlike(r"^\p{Nd}{4}$")).distinct()


def flat_files(paths: DataFrame) -> DataFrame:
    """(path, filename, id) of a flat folder's files."""
    name = path_file(F.col("path"))
    return paths.select("path", name.alias("filename"), F.regexp_replace(name, r"\.pdf$", "").alias("id"))


def _by_pypdf(data: bytes) -> list[str]:
    import io

    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def pdf_pages(spark: SparkSession, root: str, year_folders: bool = True, decode=None) -> DataFrame:
    """(path, pages) by pypdf, or by another decoder of a file's bytes; pages is null where a file can't be read."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            pages = []
            for data in batch["content"]:
                try:
                    pages.append((decode or _by_pypdf)(data))
                except Exception:  # one unreadable file is one null, not a failed job
                    pages.append(None)
            yield pd.DataFrame({"path": batch["path"], "pages": pages})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(root)
    if year_folders:
        files = files.filter(in_year_folder(F.col("path")))
    return files.select("path", "content").mapInPandas(read, "path string, pages array<string>")


#: CSV is read with multiLine, as fields may hold line ends: a file is one task, so write many.
def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").options(**CSV_WRITE).csv(path)


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """Manual fixes from CSV, or from Excel where pandas can read it."""
    from quire.schemas import MANUAL_FIXES

    if path.endswith((".xls", ".xlsx")):
        import pandas as pd

        cells = pd.read_excel(path, dtype=str).astype(object)
        return spark.createDataFrame(cells.where(cells.notna(), None).values.tolist(), MANUAL_FIXES)
    return read_csv(spark, path, MANUAL_FIXES)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local master without one uses its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Checkpoint of a stage as Parquet, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
