"""Keeping a flat folder of files in step with the index: plans first, deeds only on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_plan(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose id the index lacks."""
    return files.join(index.select("id"), "id", "left_anti")


def sync_check(files: DataFrame, index: DataFrame) -> DataFrame:
    """One row: files and papers, what each side lacks, and whether they agree."""
    here = files.select("id").distinct().withColumn("f", F.lit(1))
    papers = index.select("id").distinct().withColumn("p", F.lit(1))
    return (
        here.join(papers, "id", "full")
        .agg(F.count("f").alias("n_files"), F.count("p").alias("n_index"), F.count_if(F.col("p").isNull()).alias("extra"), F.count_if(F.col("f").isNull()).alias("missing"))
        .withColumn("in_sync", (F.col("extra") == 0) & (F.col("missing") == 0))
    )


def _done(plan: DataFrame, columns: list[str], deed) -> int:
    """Runs a deed for each row in the tasks; how many it did.  A retried task does them again: deeds are idempotent."""

    def rows(batches):
        import pyarrow as pa

        n = 0
        for batch in batches:
            n += sum(bool(deed(*row)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return plan.select(*columns).mapInArrow(rows, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copy_files(plan: DataFrame, overwrite: bool = True) -> int:
    """Copies (path_original, path_new), each file in pieces; returns how many.  Without overwrite an existing file is an error."""

    def copied(old: str, new: str) -> bool:
        from pyarrow import fs

        (source, a), (target, b) = (fs.FileSystem.from_uri(x if ":" in x else f"file://{x}") for x in (old, new))
        if not overwrite and target.get_file_info(b).type != fs.FileType.NotFound:
            raise FileExistsError(new)
        target.create_dir(b.rpartition("/")[0], recursive=True)
        with source.open_input_stream(a, compression=None) as have, target.open_output_stream(b, compression=None) as put:
            while data := have.read(1 << 22):
                put.write(data)
        return True

    return _done(plan, ["path_original", "path_new"], copied)


def delete_files(plan: DataFrame, confirmed: bool = False) -> int:
    """Deletes the planned files (column path), missing ones aside; refuses unless confirmed."""
    if not confirmed:
        raise ValueError("deleting needs confirmed=True")

    def deleted(path: str) -> bool:
        from pyarrow import fs

        store, own = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        if store.get_file_info(own).type == fs.FileType.NotFound:
            return False
        store.delete_file(own)
        return True

    return _done(plan, ["path"], deleted)
