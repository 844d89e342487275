"""Artifacts as versions: every build is a folder of its own, one pointer written last makes it the current one.

A build that is interrupted leaves no pointer and so was never published; readers of the version before are
not disturbed, and it stays readable for the gate that compares the two. Nothing is overwritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import clean_nulls
from tidemark.operators.pit import stored_or_none
from tidemark.session import written

_POINTER = "number long, build string, source string, updated_at string, n long, groups long"

#: Folders of shards that one job writes or one reader lists; the driver knows every file of a table that it reads.
MOST_FOLDERS = 20_000


def balanced(df: DataFrame, by: Sequence[str], rows_per_file: int) -> DataFrame:
    """Rows dealt out so that each shard lies in files of about `rows_per_file` rows, a big shard in many.

    Shards are counted first; a row's file is a hash of its content, so one shard with a third of all rows is written by
    as many tasks as it has files, and a small one by a single task.
    """
    files = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    renamed = files.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_files")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    content = F.xxhash64(F.to_json(F.struct(*df.columns)))
    salted = df.join(renamed, same).withColumn("_file", F.pmod(content, "_files"))
    return salted.repartition(*by, "_file").select(*df.columns)


class Artifact:
    """A published table at `path`: `builds/<id>/rows` per build and a pointer per published build.

    Every shard has its folder. Where there are more than MOST_FOLDERS of them the folders lie in groups, by hash, that are
    written and read one after the other, so that the driver holds the files of one group at a time.
    """

    def __init__(self, path: str):
        self.path = path

    def versions(self, spark: SparkSession) -> DataFrame:
        """Published builds: number, build, source, updated_at, n, groups of shards."""
        stored = stored_or_none(lambda: spark.read.schema(_POINTER).json(f"{self.path}/pointers"))
        return spark.createDataFrame([], _POINTER) if stored is None else stored

    def write(self, df: DataFrame, source: str, updated_at: str, by: Sequence[str] = (), rows_per_file: int = 100_000) -> int:
        """Publish a build and return its number; with `by`, rows lie in a folder per shard."""
        spark = df.sparkSession
        number = (self.versions(spark).agg(F.max("number")).first()[0] or 0) + 1
        build = f"{number:08d}-{uuid.uuid4().hex}"
        rows = clean_nulls(df, keep_infinite=False)
        rows = written(rows) if by else rows  # shards are counted before they are dealt out
        groups = max(1, -(-rows.select(*by).distinct().count() // MOST_FOLDERS)) if by else 1
        for part, folder in zip([rows] if groups == 1 else [rows.where(F.pmod(F.xxhash64(*by), F.lit(groups)) == k) for k in range(groups)],
                                self._folders(build, groups), strict=True):
            out = balanced(part, by, rows_per_file).write.partitionBy(*by) if by else part.write
            out.option("ignoreNullFields", "true").option("maxRecordsPerFile", 2 * rows_per_file).json(folder)
        n = sum(spark.read.schema(df.schema).json(folder).count() for folder in self._folders(build, groups))
        pointer = spark.createDataFrame([(number, build, source, updated_at, n, groups)], _POINTER)
        pointer.coalesce(1).write.mode("append").json(f"{self.path}/pointers")
        return number

    def _folders(self, build: str, groups: int) -> list[str]:
        rows = f"{self.path}/builds/{build}/rows"
        return [rows] if groups == 1 else [f"{rows}/group={k}" for k in range(groups)]

    def _rows(self, spark: SparkSession, build: str, groups: int | None, schema, path: str | None = None) -> DataFrame:
        def of(folder: str) -> DataFrame:
            rows = spark.read.schema(schema).json(folder)
            return rows.withColumn(path, F.input_file_name()) if path else rows

        folders = self._folders(build, groups or 1)
        return of(folders[0]) if len(folders) == 1 else reduce(DataFrame.unionByName, [written(of(folder)) for folder in folders])

    def read(self, spark: SparkSession, schema, back: int = 0, path: str | None = None) -> DataFrame:
        """Rows of the current version, or of the one `back` versions before; empty if there is none. `path` names a column for
        the file a row lies in."""
        known = self.versions(spark).orderBy(F.desc("number"), F.desc("build")).limit(back + 1).collect()
        if len(known) <= back:
            none = spark.createDataFrame([], schema)
            return none.withColumn(path, F.lit(None).cast("string")) if path else none
        return self._rows(spark, known[back]["build"], known[back]["groups"], schema, path)

    def previous(self, spark: SparkSession, schema) -> DataFrame:
        return self.read(spark, schema, 1)

    def provenance(self, spark: SparkSession) -> DataFrame:
        """(source, updated_at, n) of the current version."""
        return self.versions(spark).orderBy(F.desc("number"), F.desc("build")).limit(1).select("source", "updated_at", "n")

    def shards(self, spark: SparkSession, schema, by: Sequence[str], back: int = 0) -> DataFrame:
        """(by, n, files): how many rows and files each shard of a version has."""
        rows = self.read(spark, schema, back, "_path")
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_path").alias("files"))


def compared(current: DataFrame, previous: DataFrame, key: Sequence[str], measures: dict[str, Column] | None = None) -> DataFrame:
    """Two builds side by side, one row per key of either: `here`, `before`, and every measure with its `<name>_before`."""
    measures = measures or {}

    def side(df: DataFrame, mark: str, suffix: str) -> DataFrame:
        aggs = [F.lit(True).alias(mark), *[c.alias(f"{name}{suffix}") for name, c in measures.items()]]
        return df.groupBy(*key).agg(*[F.first(aggs[0]).alias(mark), *aggs[1:]])

    both = side(current, "here", "").join(side(previous, "before", "_before"), list(key), "full_outer")
    return both.withColumns({m: F.coalesce(F.col(m), F.lit(False)) for m in ("here", "before")})
