"""Versioned Parquet tables of one index.

Every sync writes new directories ``<table>/v=<n>`` and becomes visible by one
row appended to ``commits``. A failed sync leaves directories above the last
committed version; readers ignore them and the next sync overwrites them.

Chunks, postings, lengths and vectors are append-only. Rows of removed chunks
stay in place and are hidden through the ``removed`` id table, which all layers
share, until :meth:`Store.compact` rewrites the live rows as a new floor version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex import schemas
from loomdex.operators.blockmax import block_table

LAYERS = {
    "chunks": schemas.CHUNKS,
    "postings": schemas.POSTINGS,
    "lengths": schemas.LENGTHS,
    "vectors": schemas.VECTORS,
    "codes": schemas.CODES,
}
#: Tables without chunk ids, appended by each version.
TABLES = {"terms": schemas.TERMS, "ranges": schemas.RANGES, "blocks": schemas.BLOCKS}
TERM_BUCKETS = 64
#: Writer options of stored and staged tables: ids are stored as differences, columns are packed closer than Spark does by default.
PACKED = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "6",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#doc_id": "false",
}
#: Those of tables that are sorted by term.
BY_TERM = {"parquet.bloom.filter.enabled#term": "true"}
#: A version is worked on in portions of so many stored bytes at least, and in so many portions at most.
PORTION_BYTES = 48 << 20
MAX_PORTIONS = 12
#: Nothing reads the shuffles of a write once it is done: Spark removes them then, not when the driver collects its garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A task may write so many partition folders side by side; without that, Spark sorts its rows by folder.
SIDE_BY_SIDE = {"spark.sql.maxConcurrentOutputFileWriters": str(TERM_BUCKETS)}


@dataclass(frozen=True)
class Head:
    """Last committed version, lowest version still read, highest id ever given out."""

    version: int
    floor: int
    max_id: int


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the writes in here."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self._opened: dict[str, DataFrame] = {}
        self._opened_at: Head | None = None
        if self._is_empty():
            self._create()
        else:
            self.head = self._read_head()

    def _folder(self, path: str):
        """Hadoop's file system and path object of a folder, wherever it lies."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _is_empty(self) -> bool:
        """Whether there is no index yet; a base with tables but without commits is damaged, not new."""
        files, base = self._folder(self.base)
        if not files.exists(base) or not files.listStatus(base):
            return True
        if not files.exists(self._folder(self.path("commits"))[1]):
            raise ValueError(f"{self.base} holds files but no commits: not an index, or a damaged one")
        return False

    def drop(self, table: str, version: int | None = None) -> None:
        """Delete a version of a table; intermediate tables have theirs below their own names."""
        files, folder = self._folder(self.path(table))
        if not files.exists(folder):
            return
        if version is None:
            files.delete(folder, True)
            return
        for status in files.listStatus(folder):
            own = status.getPath()
            if own.getName() == f"v={version}":
                files.delete(own, True)
            elif table == "stage":
                files.delete(self._folder(f"{own}/v={version}")[1], True)

    def path(self, table: str, version: int | None = None) -> str:
        return f"{self.base}/{table}" if version is None else f"{self.base}/{table}/v={version}"

    def _read_head(self) -> Head:
        commits = self.spark.read.schema(schemas.COMMITS).parquet(self.path("commits"))
        row = commits.agg(F.max("version"), F.max("floor"), F.max("max_id")).first()
        return Head(row[0] or 0, row[1] or 0, row[2] or 0)

    def refresh(self) -> Head:
        self.head = self._read_head()
        return self.head

    def _create(self) -> None:
        for name, schema in {**LAYERS, **TABLES, "registry": schemas.REGISTRY, "removed": schemas.REMOVED}.items():
            self.write(name, 0, self.spark.createDataFrame([], schema))
        self.commit(0, {}, max_id=0, floor=0)

    def commit(self, version: int, counts: dict[str, int], *, max_id: int, floor: int | None = None) -> None:
        row = {
            "version": version,
            "committed_at": None,
            **{c: int(counts.get(c, 0)) for c in ("added", "modified", "deleted", "errors")},
            "max_id": max_id,
            "floor": self.head.floor if floor is None else floor,
        }
        stamped = self.spark.createDataFrame([row], schemas.COMMITS).withColumn("committed_at", F.current_timestamp())
        stamped.coalesce(1).write.mode("append").parquet(self.path("commits"))
        self.refresh()

    def commits(self) -> DataFrame:
        return self.spark.read.schema(schemas.COMMITS).parquet(self.path("commits"))

    def _open(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """Keep the opened tables of the current version, so that their files are listed once, not per query."""
        if self._opened_at != self.head:
            self._opened, self._opened_at = {}, self.head
        if name not in self._opened:
            self._opened[name] = make()
        return self._opened[name]

    def _versions(self, table: str, schema: T.StructType) -> DataFrame:
        with_version = T.StructType([*schema.fields, T.StructField("v", T.LongType())])
        rows = self.spark.read.schema(with_version).parquet(self.path(table))
        return rows.where(F.col("v").between(self.head.floor, self.head.version)).select(*schema.fieldNames())

    def removed(self) -> DataFrame:
        return self._open("removed", lambda: self._versions("removed", schemas.REMOVED))

    def layer(self, name: str) -> DataFrame:
        """Live rows of one layer; filters on ids, terms and buckets reach the Parquet scan."""

        def live() -> DataFrame:
            rows = self._versions(name, LAYERS[name]).join(self.removed(), "doc_id", "left_anti")
            return rows.select(*LAYERS[name].fieldNames())

        return self._open(name, live)

    def terms(self) -> DataFrame:
        """All terms of the versions that are read, some of them more than once; terms of hidden chunks may be among them."""
        return self._open("terms", lambda: self._versions("terms", schemas.TERMS))

    def ranges(self) -> DataFrame:
        """``file_path, first_id, last_id``: where the chunks of each file lie, by its last version (ids only grow)."""
        last = F.max_by(F.struct("first_id", "last_id"), "last_id").alias("r")
        return self._versions("ranges", schemas.RANGES).groupBy("file_path").agg(last).select("file_path", "r.*")

    def blocks(self) -> DataFrame | None:
        """Bounds of the postings' blocks, if they cover all postings: after :meth:`compact`, until the next commit."""
        if self.head.version != self.head.floor or not self.head.version:
            return None
        return self._open("blocks", lambda: self.read_version("blocks", self.head.version, schemas.BLOCKS))

    def stored_vectors(self) -> DataFrame:
        """Vectors of all versions that are read, those of hidden chunks too: texts that come again need no model."""
        return self._versions("vectors", schemas.VECTORS)

    def registry(self) -> DataFrame:
        return self.spark.read.schema(schemas.REGISTRY).parquet(self.path("registry", self.head.version))

    def write(self, table: str, version: int, df: DataFrame) -> None:
        options, folders = {}, []
        if table in ("postings", "blocks"):
            # hot terms are split over several tasks by the rebalance, each file stays sorted by term
            place = "doc_id" if table == "postings" else "block"
            df = df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", place)
            options, folders = BY_TERM, ["bucket"]
        elif table == "terms":
            # sorted by range, so that the terms with one beginning lie in few row groups
            df = df.repartitionByRange("field", "term").sortWithinPartitions("field", "term")
        with settings(self.spark, DROP_SHUFFLES):
            df.write.options(**PACKED, **options).partitionBy(*folders).mode("overwrite").parquet(self.path(table, version))

    def write_sorted(self, table: str, version: int, df: DataFrame, mode: str) -> None:
        """Write rows with a bucket as they come; each task's rows of a bucket ascend by term."""
        with settings(self.spark, DROP_SHUFFLES | SIDE_BY_SIDE):
            df.write.options(**PACKED, **BY_TERM).partitionBy("bucket").mode(mode).parquet(self.path(table, version))

    def stage(self, name: str, version: int, df: DataFrame) -> DataFrame:
        """An intermediate table of a version; ``drop("stage/...", version)`` deletes it."""
        path = self.path(f"stage/{name}", version)
        with settings(self.spark, DROP_SHUFFLES):
            df.write.options(**PACKED).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stored_files(self, table: str, version: int) -> list[tuple[str, int]]:
        """Path and bytes of the files of a version of a table without partition folders, in the order of its partitions."""
        files, folder = self._folder(self.path(table, version))
        found = [(status.getPath(), status.getLen()) for status in files.listStatus(folder)]
        return sorted((path.toString(), size) for path, size in found if path.getName().endswith(".parquet"))

    def portions(self, table: str, version: int, schema: T.StructType) -> list[tuple[DataFrame, int]]:
        """All rows of a version in runs of whole files, with their bytes, so that what is made of a run can be stored before the next run is read."""
        stored = self.stored_files(table, version)
        size = max(PORTION_BYTES, -(-sum(n for _, n in stored) // MAX_PORTIONS))
        runs: dict[int, list[tuple[str, int]]] = {}
        before = 0
        for path, n in stored:
            runs.setdefault(before // size, []).append((path, n))
            before += n
        read = self.spark.read.schema(schema)
        return [(read.parquet(*[p for p, _ in run]), sum(n for _, n in run)) for run in runs.values()] or [(self.read_version(table, version, schema), 0)]

    def read_version(self, table: str, version: int, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table, version))

    def clear(self) -> int:
        """Start anew with empty tables; ids go on from the last one given out."""
        version = self.refresh().version + 1
        for name, schema in {**LAYERS, **TABLES, "registry": schemas.REGISTRY, "removed": schemas.REMOVED}.items():
            self.write(name, version, self.spark.createDataFrame([], schema))
        self.commit(version, {}, max_id=self.head.max_id, floor=version)
        return version

    def compact(self, keep_versions: int = 1) -> int:
        """Rewrite the live rows of every layer, sorted by id, as the new floor version.

        Readers of an older version may still be at work: the folders below the floor before the last ``keep_versions``
        ones are deleted, newer ones stay.
        """
        version = self.refresh().version + 1
        for name in LAYERS:
            rows = self.layer(name)
            if name in ("chunks", "vectors", "codes"):
                rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
            self.write(name, version, rows)
        self.write("terms", version, self.read_version("postings", version, schemas.POSTINGS).select(*schemas.TERMS.fieldNames()).distinct())
        self.write("blocks", version, block_table(self.read_version("postings", version, schemas.POSTINGS)))
        self.write("ranges", version, self.ranges())
        self.write("registry", version, self.registry())
        self.write("removed", version, self.spark.createDataFrame([], schemas.REMOVED))
        self.commit(version, {}, max_id=self.head.max_id, floor=version)
        floors = [r["floor"] for r in self.commits().select("floor").distinct().orderBy(F.desc("floor")).take(keep_versions + 1)]
        if len(floors) > keep_versions:
            for old in range(floors[keep_versions], floors[keep_versions - 1]):
                for name in (*LAYERS, *TABLES, "removed", "registry"):
                    self.drop(name, old)
        return version
