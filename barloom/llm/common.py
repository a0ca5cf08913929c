"""Small helpers of the document operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import shared_folder, until_exit

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the hand-over between passes, which lost executors don't undo.

    The table goes when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    until_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def whole_text(text: str = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a non-null text, in order: runs of anything but the white space above."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's text modulo ``n``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def per_process(kind: str, key, make):
    """What ``make`` gives, made once in a Python worker as long as ``key`` stays the same: the functions of a task come anew
    with each task, its process stays. One value of a kind is kept."""
    import sys
    import types

    kept = sys.modules.setdefault("_kept_per_process", types.ModuleType("_kept_per_process")).__dict__.setdefault("kept", {})
    if kind not in kept or kept[kind][0] != key:
        kept[kind] = (key, make())
    return kept[kind][1]


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column in ``taken`` has it (in any case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def slices(batches, column: str, most_bytes: int):
    """Arrow batches cut so that the texts in ``column`` hold about ``most_bytes``, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)
