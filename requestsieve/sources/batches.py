"""Parquet tables that numbered batches add to, and that are compacted while readers go on.

A write goes to a folder of its own, `batch=<first>-<last>-<attempt>`, and counts once Spark has
put its success file there. Of several attempts at a batch only the last counts, so a batch that
runs again leaves nothing of what it wrote before, whatever the partitions were. Compaction
writes the rows of many batches to one folder that covers their range; the folders it replaces
are removed by the next compaction, so readers that listed them can finish.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Folders of one size that are joined into one of the next size.
FAN_IN = 10


@dataclass(frozen=True, order=True)
class Part:
    """A committed folder: the batches it covers and the attempt that wrote it."""

    first: int
    last: int
    attempt: int

    @property
    def folder(self) -> str:
        return f"batch={self.first}-{self.last}-{self.attempt}"

    def covers(self, other: "Part") -> bool:
        if (self.first, self.last) == (other.first, other.last):
            return self.attempt >= other.attempt
        return self.first <= other.first and other.last <= self.last


class Files:
    """Folder operations on whatever file system a path is on."""

    def __init__(self, spark: SparkSession, root: str):
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self.root = self._path(root)
        self._fs = self.root.getFileSystem(context._jsc.hadoopConfiguration())

    def folders(self) -> list[str]:
        if not self._fs.exists(self.root):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self.root) if s.isDirectory()]

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(self.root, name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.root, name), True)


class BatchTable:
    """`partitions` are columns of `schema`, by which the folders are divided further; rows are
    sorted by `order` within files."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        partitions: tuple[str, ...] = (),
        order: tuple[str, ...] = (),
    ):
        self.spark = spark
        self.path = path
        self.schema = schema
        self.partitions = partitions
        self.order = order
        self._files = Files(spark, path)

    # --- what is there ---------------------------------------------------------------------

    def _all_parts(self) -> list[Part]:
        names = [n.removeprefix("batch=").split("-") for n in self._files.folders() if n.startswith("batch=")]
        return sorted(Part(*map(int, n)) for n in names)

    def _committed(self) -> list[Part]:
        return [p for p in self._all_parts() if self._files.has(f"{p.folder}/_SUCCESS")]

    def parts(self) -> list[Part]:
        """The folders that count, in the order of their batches."""
        found = self._committed()
        return [p for p in found if not any(o != p and o.covers(p) for o in found)]

    def has(self, batch_id: int) -> bool:
        return any(p.first <= batch_id <= p.last for p in self.parts())

    def next_batch(self) -> int:
        return 1 + max((p.last for p in self.parts()), default=-1)

    def read(self, since: int | None = None, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those from `since` on and before another one.

        Bounds must not fall within what compaction has joined.
        """
        wanted = [
            p
            for p in self.parts()
            if (since is None or p.first >= since) and (before is None or p.last < before)
        ]
        return self._of(wanted)

    def _of(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType())])
        folders = [f"{self.path}/{p.folder}" for p in parts]
        rows = self.spark.read.schema(stored).option("basePath", self.path).parquet(*folders)
        return rows.select(*self.schema.fieldNames())

    # --- writing ---------------------------------------------------------------------------

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch, replacing earlier attempts at it."""
        self._write(rows, batch_id, batch_id)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        attempts = [p for p in self._all_parts() if (p.first, p.last) == (first, last)]
        new = Part(first, last, 1 + max((p.attempt for p in attempts), default=0))
        even = rows.select(*self.schema.fieldNames()).hint("rebalance", *self.partitions)
        if self.order:
            even = even.sortWithinPartitions(*self.partitions, *self.order)
        writer = even.write.mode("errorifexists").option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true"
        )
        if self.partitions:
            writer = writer.partitionBy(*self.partitions)
        writer.parquet(f"{self.path}/{new.folder}")

    def remove_before(self, batch_id: int) -> None:
        """Remove batches that something else holds now."""
        for part in self._all_parts():
            if part.last < batch_id:
                self._files.remove(part.folder)

    def compact(
        self, before: int, merge: Callable[[DataFrame], DataFrame] | None = None, fan_in: int = FAN_IN
    ) -> None:
        """Join `fan_in` neighbouring folders of one size, of batches before this one.

        `merge` may reduce their rows. Few folders are left after any number of batches, and a
        row is rewritten a logarithmic number of times.
        """
        counted = self.parts()
        for stale in set(self._all_parts()) - set(counted):
            if stale.last < before:
                self._files.remove(stale.folder)

        def size(part: Part) -> int:
            covered, tier = part.last - part.first + 1, 0
            while covered >= fan_in:
                covered, tier = covered // fan_in, tier + 1
            return tier

        run: list[Part] = []
        for part in (p for p in counted if p.last < before):
            if run and size(run[-1]) != size(part):
                run = []
            run.append(part)
            if len(run) == fan_in:
                rows = self._of(run)
                self._write(rows if merge is None else merge(rows), run[0].first, run[-1].last)
                run = []
