"""Files as frames: walks, bounded reads, listings, JSON lines, notes, runs and markers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.text import leaks_answers

BOUND = 100_000
#: Marker file of a framework, in order of precedence.
FRAMEWORKS = (("foundry.toml", "foundry"), ("hardhat.config.js", "hardhat"), ("hardhat.config.ts", "hardhat"))


def walk(spark: SparkSession, root: str, blind: bool = False) -> DataFrame:
    """path (relative), size of the files below a local folder: no .git, no symlinks, nothing outside.

    In blind mode paths that give answers away are left out. Only names and sizes pass the driver.
    """
    base, rows = os.path.realpath(root), []
    for folder, names, files in os.walk(base, followlinks=False):
        names[:] = sorted(n for n in names if n != ".git" and not os.path.islink(os.path.join(folder, n)))
        for name in sorted(files):
            full = os.path.join(folder, name)
            if not os.path.islink(full) and os.path.realpath(full).startswith(base + os.sep):
                rows.append((os.path.relpath(full, base), os.path.getsize(full)))
    found = spark.createDataFrame(rows, "path string, size long")
    return found.where(~leaks_answers(F.col("path"))) if blind else found


def listed(paths: DataFrame, most: int) -> DataFrame:
    """The first ``most`` paths with n and truncated: whether there are more."""
    first = paths.orderBy("path").limit(most + 1)  # the window below holds these rows only
    return first.withColumn("truncated", F.count("*").over(Window.partitionBy()) > most).orderBy("path").limit(most)


def read_bounded(spark: SparkSession, path: str, most: int = BOUND) -> DataFrame:
    """path, text (the first ``most`` bytes), truncated, n_lines of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.decode(F.substring("content", 1, most), "UTF-8")
    return files.select("path", text.alias("text"), (F.col("length") > most).alias("truncated"), F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\r\n|\r|\n"))).alias("n_lines"))


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped; a broken line is an error if ``strict``, else it is dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    sound = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    return lines.where(sound).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, value of whole text files; generated ones (*.generated.json) are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value").where(~F.col("path").endswith(".generated.json"))


def read_notes(spark: SparkSession, root: str, folders: tuple[str, ...] = ("findings", "hacks")) -> DataFrame:
    """path (folder/name), text of the Markdown notes in some folders, in order of the path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.regexp_extract(F.col("_metadata.file_path"), rf"({'|'.join(folders)})/[^/]+\.md$", 0)
    return files.select(path.alias("path"), F.col("value").alias("text")).where("path != ''").orderBy("path")


def framework(paths: DataFrame) -> DataFrame:
    """repo, framework of (repo, path): by the first marker file, else unknown."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    return paths.groupBy("repo").agg(*(F.bool_or(name == m).alias(f"m{i}") for i, (m, _) in enumerate(FRAMEWORKS))).select("repo", F.coalesce(*(F.when(F.col(f"m{i}"), F.lit(f)) for i, (_, f) in enumerate(FRAMEWORKS)), F.lit("unknown")).alias("framework"))
