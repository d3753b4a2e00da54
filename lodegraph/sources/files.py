"""Files of a working tree as a source, and the filters that decide which are taken."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import scalars as X

MAX_BYTES = 10 * 1024 * 1024
CODE_EXTENSIONS = ("py", "js", "ts", "java", "go")
SKIPPED_DIRS = ("node_modules", "build", "dist", "target", ".git", "__pycache__")


def keep_file(path: Column, size: Column, extensions: tuple[str, ...] = CODE_EXTENSIONS, skipped: tuple[str, ...] = SKIPPED_DIRS) -> Column:
    """Small enough, of a known extension, in no skipped folder."""
    dirs = "|".join(d.replace(".", "\\.") for d in skipped)
    return (size <= MAX_BYTES) & X.extension(path).isin(*extensions) & ~path.rlike(f"(^|/)({dirs})/")


def working_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(rel_path, n_bytes, text) of the files below a folder that any `include` glob and no `exclude` glob matches.

    Version control folders and empty globs aside, every text file is read; bytes that aren't UTF-8 become U+FFFD.
    """
    base = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.col("path"), "^.*?" + base.replace(".", "\\.") + "/", "")
    got = files.select(rel.alias("rel_path"), F.col("length").alias("n_bytes"), F.col("content")).where(~F.col("rel_path").rlike(r"(^|/)\.(git|svn|hg)/"))
    if include:
        got = got.where(X.any_of([F.col("rel_path").rlike(X.glob_regex(p)) for p in include]))
    if exclude:
        got = got.where(~X.any_of([F.col("rel_path").rlike(X.glob_regex(p)) for p in exclude]))
    return got.select("rel_path", "n_bytes", F.decode("content", "UTF-8").alias("text"))


class SourceRegistry:
    """Named sources: a name maps to a function of (spark, location, **options) that gives a DataFrame of files."""

    def __init__(self):
        self._made = {}

    def register(self, name: str, make) -> None:
        self._made[name.lower()] = make

    def names(self) -> list[str]:
        return sorted(self._made)

    def create(self, name: str, spark: SparkSession, location: str, **options) -> DataFrame:
        if name.lower() not in self._made:
            raise KeyError(f"no source named {name!r}; there are {', '.join(self.names()) or 'none'}")
        return self._made[name.lower()](spark, location, **options)


def exported_pages(spark: SparkSession, location: str) -> DataFrame:
    """Pages or issues exported as JSON lines: (rel_path, n_bytes, text) from key / id, title and body."""
    rows = spark.read.schema("id string, key string, title string, body string").json(location)
    name = F.coalesce("key", "id")
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), F.col("body"))
    return rows.select(F.concat(name, F.lit(".md")).alias("rel_path"), F.length(text).cast("long").alias("n_bytes"), text.alias("text"))


SOURCES = SourceRegistry()
SOURCES.register("git", working_tree)
SOURCES.register("confluence", exported_pages)
SOURCES.register("jira", exported_pages)
