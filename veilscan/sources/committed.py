"""A table of files that a write changes as a whole: tasks write rows, one manifest at commit says which files count.

A version is a manifest in the folder ``_manifests``; readers take the newest. Files of a write that failed, or was run
again under the same batch, are in no manifest. Rows lie in buckets of a key, so putting rows on top of stored ones
rewrites the buckets that they touch and keeps the other files as they are.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, BUCKET = "committed_table", "bucket"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (bucket, file, rows) of each file."""

    files: list[tuple[int, str, int]]


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _manifests(path: str) -> list[str]:
    from pyarrow import fs

    where, top = _place(path)
    found = where.get_file_info(fs.FileSelector(f"{top}/_manifests", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json"))


def latest(path: str) -> dict:
    """The newest manifest: version, batches, files (bucket, file, rows); an empty one where there is none."""
    names = _manifests(path)
    if not names:
        return {"version": 0, "batches": [], "files": []}
    where, _ = _place(path)
    with where.open_input_stream(names[-1]) as f:
        return json.loads(f.read())


class CommittedTable(DataSource):
    """``df.write.format("committed_table")`` with the options path, batch (a name; a batch is committed once) and replaces
    (numbers of buckets whose files the write stands for, comma-joined, or ``all``). Rows must have an int column ``bucket``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("batch", uuid.uuid4().hex), "all" if overwrite else self.options.get("replaces", ""))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, replaces: str):
        self.path, self.batch, self.replaces, self.attempt = path, batch, replaces, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        where, top = _place(self.path)
        where.create_dir(f"{top}/data")
        open_: dict[int, tuple] = {}
        rows: dict[int, int] = {}
        try:
            for batch in iterator:
                at = batch.schema.get_field_index(BUCKET)
                for bucket in pc.unique(batch.column(at)).to_pylist():
                    part = pa.Table.from_batches([batch]).filter(pc.equal(batch.column(at), bucket))
                    if bucket not in open_:
                        file = f"{top}/data/{self.attempt}-{bucket:06d}-{uuid.uuid4().hex}.parquet"
                        open_[bucket] = (file, pq.ParquetWriter(file, part.schema, filesystem=where))
                    open_[bucket][1].write_table(part)
                    rows[bucket] = rows.get(bucket, 0) + part.num_rows
        finally:
            for _, out in open_.values():
                out.close()
        return Written([(bucket, file.rsplit("/", 1)[1], rows[bucket]) for bucket, (file, _) in open_.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        where, top = _place(self.path)
        now = latest(self.path)
        made = [list(f) for m in messages if m for f in m.files]
        if self.batch in now["batches"]:
            return self.abort(messages)
        gone = {f[0] for f in now["files"]} if self.replaces == "all" else {int(x) for x in self.replaces.split(",") if x}
        kept = [f for f in now["files"] if f[0] not in gone]
        version = now["version"] + 1
        text = json.dumps({"version": version, "batches": [*now["batches"][-1000:], self.batch], "files": sorted(kept + made)})
        where.create_dir(f"{top}/_manifests")
        draft, final = f"{top}/_manifests/.{self.attempt}", f"{top}/_manifests/{version:012d}.json"
        with where.open_output_stream(draft) as f:
            f.write(text.encode())
        if where.get_file_info(final).type != fs.FileType.NotFound:
            where.delete_file(draft)
            raise RuntimeError(f"version {version} of {self.path} was written by another job meanwhile")
        where.move(draft, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        where, top = _place(self.path)
        for f in where.get_file_info(fs.FileSelector(f"{top}/data", allow_not_found=True)):
            if f.base_name.startswith(self.attempt):
                where.delete_file(f.path)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def read(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the newest version, of some buckets only where they are given; an empty frame where nothing was committed."""
    files = [f"{path}/data/{name}" for bucket, name, _ in latest(path)["files"] if buckets is None or bucket in set(buckets)]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def write(rows: DataFrame, path: str, key: str, buckets: int = 64, batch: str | None = None, replaces: str = "") -> None:
    """Rows as a new version on top of the files that stay; each bucket is written by as few tasks as its size asks for."""
    rows.sparkSession.dataSource.register(CommittedTable)
    out = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    options = {"path": path, "replaces": replaces} | ({"batch": batch} if batch else {})
    out.hint("rebalance", BUCKET).write.format(NAME).options(**options).mode("append").save()


def upsert(rows: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64, batch: str | None = None, schema: StructType | None = None) -> None:
    """Stored rows of the buckets that ``rows`` touch, merged with them by ``merge(stored, rows)``, as a new version. The other
    buckets' files are neither read nor written. ``schema`` is that of stored rows, where it isn't that of ``rows``. A batch that was committed before changes nothing."""
    spark = rows.sparkSession
    if batch is not None and batch in latest(path)["batches"]:
        return
    touched = sorted(r[BUCKET] for r in rows.select(bucket_of(F.col(key), buckets)).distinct().collect())  # at most ``buckets``
    if touched:
        stored = read(spark, path, schema or rows.schema, touched)
        write(merge(stored, rows), path, key, buckets, batch, ",".join(map(str, touched)))
