"""The Spark data source ``ragweave_shards``: raw examples of shard files, a partition for some ``PART_BYTES`` of a shard.

``register(spark)``, then ``spark.read.format("ragweave_shards").option("shards", catalog_json(...)).load()``.
Filters on ``split`` and ``shard_lang`` are taken over, so shards that they rule out are never opened; the
option ``rows`` stops each shard after so many rows. Every row has the source's fields, nulls where a
file lacks one. A shard is a file, or several in order. Small files of a shard are read together, a large one by
runs of its row groups; the task of such a part reads what is in it and nothing else. A file, or part of it, that can't be opened or
read is one row with ``error`` (and nulls), after the rows read before; all others go on.

Files are opened by the tasks (and the footers of large ones, and of a shard of several files with a row limit, by the planner), from whatever file system pyarrow knows by the path's scheme. Where only
Spark's own readers reach a store, ``catalog.read_raw`` reads shard by shard.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ragweave.functions.session import ship
from ragweave.sources import catalog

NAME = "ragweave_shards"
SCHEMA = T.StructType([*catalog.RAW.fields, *(T.StructField(n, T.StringType()) for n in ("shard_lang", "split", "path", "error"))])
BATCH = 1024
#: Bytes of files, as stored, that a partition has at least if its shard has more; a row group is not divided.
PART_BYTES = 16 << 20


def catalog_json(shards: dict[str, dict[str, str | list[str]]]) -> str:
    """{split: {lang: path or paths}} as the option ``shards``."""
    return json.dumps([([path] if isinstance(path, str) else path, split, lang) for split, by in shards.items() for lang, path in by.items()])


def catalog_of(shards: DataFrame) -> dict[str, dict[str, str | list[str]]]:
    """A catalog (path, split, lang) as {split: {lang: path or paths}}: a row for each file of the dataset."""
    out: dict[str, dict[str, str | list[str]]] = {}
    for r in shards.sort("path").collect():
        have = out.setdefault(r["split"], {}).get(r["lang"])
        out[r["split"]][r["lang"]] = r["path"] if have is None else [*([have] if isinstance(have, str) else have), r["path"]]
    return out


def register(spark: SparkSession) -> None:
    """Make the source known to a session and its workers; filters are pushed into Python sources from then on."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardSource)


def read(spark: SparkSession, shards: dict[str, dict[str, str | list[str]]], rows: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format(NAME).option("shards", catalog_json(shards))
    return (reader.option("rows", rows) if rows else reader).load()


@dataclass
class Shard(InputPartition):
    paths: list[str]
    split: str
    lang: str
    #: Row groups of the only path that are read; None: all of all paths.
    groups: list[int] | None = None
    #: Rows of each path that are read; none or 0: all.
    rows: list[int] = field(default_factory=list)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _parts(shard: Shard, limit: int) -> Iterator[Shard]:
    """A shard in parts; what can't be looked at here is left to a task, which tells why."""
    left, some, filled = limit, [], 0  # rows of the shard that are still wanted; small files that go together
    for path in shard.paths:
        if limit and left <= 0:
            break
        try:
            store, at = _opened(path)
            size, footer = store.get_file_info(at).size or 0, None
            if size > PART_BYTES or (limit and len(shard.paths) > 1):
                with store.open_input_file(at) as file:
                    footer = pq.ParquetFile(file).metadata
        except (OSError, pa.ArrowException):
            size, footer = 0, None
        if size <= PART_BYTES:
            take = limit if len(shard.paths) == 1 else min(left, footer.num_rows) if limit and footer else 0
            some.append((path, take))
            filled += size
            left -= take
            if filled >= PART_BYTES:
                yield Shard([p for p, _ in some], shard.split, shard.lang, rows=[n for _, n in some] if limit else [])
                some, filled = [], 0
            continue
        groups, held, rows = [], 0, 0
        for g in range(footer.num_row_groups if footer else 0):
            if limit and left <= 0:
                break
            group = footer.row_group(g)
            groups.append(g)
            held += sum(group.column(c).total_compressed_size for c in range(group.num_columns))
            n = min(left, group.num_rows) if limit else group.num_rows
            rows, left = rows + n, left - n if limit else left
            if held >= PART_BYTES:
                yield Shard([path], shard.split, shard.lang, groups, [rows] if limit else [])
                groups, held, rows = [], 0, 0
        if groups:
            yield Shard([path], shard.split, shard.lang, groups, [rows] if limit else [])
    if some:
        yield Shard([p for p, _ in some], shard.split, shard.lang, rows=[n for _, n in some] if limit else [])


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ShardReader:
        shards = [Shard(*s) for s in json.loads(self.options["shards"])]
        return ShardReader(shards, int(self.options.get("rows") or 0))


class ShardReader(DataSourceReader):
    def __init__(self, shards: list[Shard], rows: int):
        self.shards, self.rows = shards, rows

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Leave shards out by ``split`` and ``shard_lang``; Spark applies all other filters."""
        for f in filters:
            column = {("split",): "split", ("shard_lang",): "lang"}.get(getattr(f, "attribute", None))
            if column and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.shards = [s for s in self.shards if getattr(s, column) in wanted]
            else:
                yield f

    def partitions(self) -> list[Shard]:
        return [part for shard in self.shards for part in _parts(shard, self.rows)]

    def read(self, shard: Shard | None) -> Iterator[pa.RecordBatch]:
        if shard is None or not isinstance(shard, Shard):  # no shard is left
            return
        schema = to_arrow_schema(SCHEMA)
        for i, at in enumerate(shard.paths):
            fixed = {"shard_lang": shard.lang, "split": shard.split, "path": at}
            left = shard.rows[i] if i < len(shard.rows) and shard.rows[i] else None
            try:
                store, path = _opened(at)
                with store.open_input_file(path) as file:
                    source = pq.ParquetFile(file)
                    have = [n for n in catalog.RAW.names if n in source.schema_arrow.names]
                    for batch in source.iter_batches(BATCH, row_groups=shard.groups, columns=have):
                        batch = batch if left is None else batch.slice(0, left)
                        yield pa.RecordBatch.from_arrays([_typed(batch, f, fixed) for f in schema], schema=schema)
                        left = None if left is None else left - len(batch)
                        if left == 0:
                            break
            except (OSError, pa.ArrowException) as e:
                found = fixed | {"error": str(e).splitlines()[0][:300]}
                yield pa.RecordBatch.from_arrays([pa.array([found.get(f.name)], f.type) for f in schema], schema=schema)


def _typed(batch: pa.RecordBatch, field: pa.Field, fixed: dict[str, str]) -> pa.Array:
    """A column of the source's schema: a file's own, cast, or the shard's, or nulls."""
    if field.name not in batch.schema.names:
        return pa.array([fixed.get(field.name)] * len(batch), field.type)
    column = batch.column(field.name)
    try:
        return column.cast(field.type)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # structs with other fields
        return pa.array(column.to_pylist(), field.type)
