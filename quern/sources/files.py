"""Small files and folder sizes in whatever file system a path names, through Hadoop's interface."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _at(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p, _ = _at(spark, path)
    fs.mkdirs(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p, jvm = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def rename_over(spark: SparkSession, path: str, to: str) -> None:
    """Gives a file another's name, in its stead, in one step of the file system."""
    _, p, jvm = _at(spark, path)
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(p), context.makeQualified(jvm.org.apache.hadoop.fs.Path(to)), how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file and then takes its place: a reader, also after a crash, finds the old text or the new."""
    fs, _, jvm = _at(spark, path)
    stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}.new"), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename_over(spark, f"{path}.new", path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; there are none if it doesn't exist."""
    fs, p, _ = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


@dataclass(frozen=True)
class FolderSize:
    files: int
    bytes: int


def folder_size(spark: SparkSession, path: str) -> FolderSize:
    """Data files and their bytes; files whose names begin with ``_`` or ``.`` don't count."""
    fs, p, _ = _at(spark, path)
    files = size = 0
    found = fs.listFiles(p, True)
    while found.hasNext():
        one = found.next()
        if one.getPath().getName()[0] not in "_.":
            files, size = files + 1, size + one.getLen()
    return FolderSize(files, size)
