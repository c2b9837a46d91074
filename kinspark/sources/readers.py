"""Sources: whole files, directory trees, format detection, prior snapshots, ledgers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Only the head of a text is looked at when its format is detected (a rule of the detector, not a row limit).
DETECTION_CHARS = 16_384


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def tree(spark: SparkSession, root: str, pattern: str = "*.txt", skip: str = "node_modules") -> DataFrame:
    """Whole files below a directory, without those in a folder named ``skip`` at any depth below it."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = root.rstrip("/").rpartition("/")[2]
    below = F.split(F.substring_index("path", f"/{name}/", -1), "/")
    return files.where(~F.array_contains(F.slice(below, F.lit(1), F.size(below) - 1), skip))


def records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Committed records of a run: JSON lines of a known schema; fields they lack are null."""
    return spark.read.schema(schema).json(path)


def detect_kind(spark: SparkSession, path: str) -> str:
    """The format of a folder by the endings of its files; text where none is known."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    for kind in ("parquet", "orc", "json", "csv"):
        if any(n.endswith(f".{kind}") for n in names):
            return kind
    return "text"


def statements(df: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """One row per statement, with its ordinal."""
    return df.select(key, F.posexplode(F.split(text, separator)).alias("stmt", "line"))


def detect(text: Column, signals: list[tuple[str, str, str]]) -> Column:
    """The signal of highest tier whose pattern the head of the text holds: signals are (name, tier, pattern) with tier definitive, likely or hint; ties go to the earlier one."""
    head = F.substring(text, 1, DETECTION_CHARS)
    rank = {"definitive": 0, "likely": 1, "hint": 2}
    ordered = sorted(range(len(signals)), key=lambda i: (rank[signals[i][1]], i))
    return F.coalesce(*[F.when(head.rlike(signals[i][2]), F.struct(F.lit(signals[i][0]).alias("name"), F.lit(signals[i][1]).alias("tier"))) for i in ordered])


def snapshot(spark: SparkSession, path: str, schema: StructType | str, version: int, version_col: str = "version") -> DataFrame:
    """A ledger of a prior run; rows of another version are treated as absent, not misread."""
    return spark.read.schema(schema).json(path).where(F.col(version_col) == version)


def ledger_rows(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Parallel arrays of a ledger as one row per position; null elements stay."""
    return df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_x")).select(key, "pos", *[F.col(f"_x.{a}").alias(a) for a in arrays])


READERS = {"parquet": lambda s, p: s.read.parquet(p), "orc": lambda s, p: s.read.orc(p), "json": lambda s, p: s.read.json(p), "csv": lambda s, p: s.read.option("header", True).csv(p), "text": whole_files}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Registry of formats; unknown ones pass through as whole text."""
    return READERS.get(kind, whole_files)(spark, path)
