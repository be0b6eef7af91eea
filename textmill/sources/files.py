"""Text files as documents, and given tables as DataFrames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_GLOB = "*.txt"


def scan_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """`(url, content)` of every .txt file directly in a folder; none if it does not exist."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([], "url string, content string")
    reader = spark.read.option("pathGlobFilter", TEXT_GLOB)
    return _whole_files(reader.text(path, wholetext=True))


def stream_text_dir(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.option("pathGlobFilter", TEXT_GLOB)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return _whole_files(reader.text(path, wholetext=True))


def _whole_files(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("content"))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    return _filesystem(spark, path).exists(_path(spark, path))


def child_folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names of the folders in a folder, and when they were written; none if it does not exist."""
    if not folder_exists(spark, path):
        return []
    found = _filesystem(spark, path).listStatus(_path(spark, path))
    return sorted((f.getPath().getName(), f.getModificationTime() / 1000) for f in found if f.isDirectory())


def bytes_in(spark: SparkSession, path: str) -> int:
    return _filesystem(spark, path).getContentSummary(_path(spark, path)).getLength()


def delete_folder(spark: SparkSession, path: str) -> None:
    _filesystem(spark, path).delete(_path(spark, path), True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, files_at_once=None) -> DataFrame:
    """The same table as a stream of its files, whether it is a folder or a single file."""
    folder, file = folder.rstrip("/"), f"{name}.parquet"
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    if _filesystem(spark, folder).getFileStatus(_path(spark, f"{folder}/{file}")).isDirectory():
        return reader.parquet(f"{folder}/{file}")
    return reader.option("pathGlobFilter", file).parquet(folder)
