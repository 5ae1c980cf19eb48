"""A collection: a folder of immutable snapshots and a pointer that names the current one.

Vectors, metadata and graph are Parquet tables; an insert adds files, other writes write a table anew, and a write becomes
visible, whole, when the pointer is replaced. Readers keep the snapshot they began with. One writer at a time holds a
lock file.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CorruptionError, InvalidArgumentError, IoError, NotFoundError
from .functions import metadata as M
from .operators import hnsw
from .operators import search as knn
from .operators import store as ops
from .operators.index import INDEXES
from .plans.filters import Filter
from .plans.options import CollectionConfig, QueryOptions
from .sources.csvs import read_csv, write_csv
from .sources.vecs import read_vecs, write_vecs

FORMAT = 1
BATCH = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", M.METADATA)])


class Collection:
    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self._state = spark, path.rstrip("/"), state
        self.config = CollectionConfig.of(state["config"])
        self.index = INDEXES[self.config.index](self.config)
        self._staging = False
        self._written = dict(state.get("written", {}))

    # files, by Hadoop's file systems, so that any store that Spark reads will do

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    @classmethod
    def _write_text(cls, spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
        fs, where = cls._fs(spark, path)
        out = fs.create(where, overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    @classmethod
    def _read_state(cls, spark: SparkSession, path: str) -> dict:
        fs, where = cls._fs(spark, f"{path.rstrip('/')}/current.json")
        if not fs.exists(where):
            raise NotFoundError(f"there is no collection at {path}")
        reader = fs.open(where)
        try:
            text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(reader)).decode()
        finally:
            reader.close()
        try:
            state = json.loads(text)
        except ValueError as e:
            raise CorruptionError(f"{path}/current.json is damaged: {e}") from e
        if state.get("format") != FORMAT:
            raise CorruptionError(f"{path} has format {state.get('format')}; this build reads {FORMAT}")
        return state

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: CollectionConfig) -> Collection:
        fs, where = cls._fs(spark, path)
        if fs.exists(where):
            raise InvalidArgumentError(f"{path} exists already")
        fs.mkdirs(where)
        out = cls(spark, path, {"format": FORMAT, "version": 0, "config": config.plain(), "next_id": 0, "next_slot": 0, "vectors": [], "metadata": [], "edges": [], "edges_from": [], "graph_of": None, "graph_slots": 0, "written": {}})
        out._publish({})
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        """Open the current snapshot; a graph that is missing or of other vectors is built anew, an older one is added to."""
        out = cls(spark, path, cls._read_state(spark, path))
        if out.index.stored and out._state["vectors"] and not out._graph_fits():
            out.flush()
        return out

    def _graph_there(self) -> bool:
        return bool(self._state["edges"]) and all(self._fs(self.spark, p)[0].exists(self._fs(self.spark, p)[1]) for p in self._state["edges"])

    def _graph_fits(self) -> bool:
        return self._state["graph_of"] == self._state["vectors"] and self._graph_there()

    def _graph_grows(self) -> bool:
        """Whether the graph is of the vectors of before some inserts, and of nothing else."""
        of = self._state["graph_of"]
        return bool(of) and self._state["vectors"][: len(of)] == of and self._state.get("graph_slots", 0) > 0 and self._graph_there()

    @contextmanager
    def transaction(self) -> Iterator[Collection]:
        """Several writes that become visible together, or, after an error, not at all. Reads in between see them."""
        with self._writer():
            before, outer = self._state, self._staging
            self._staging = True
            try:
                yield self
            except BaseException:
                self._state = before
                raise
            finally:
                self._staging = outer
            if not outer:
                after, self._state = self._state, before
                if after is not before:
                    self._publish({k: v for k, v in after.items() if k != "version"})

    @contextmanager
    def _writer(self) -> Iterator[None]:
        if self._staging:  # within a transaction, which holds the lock
            yield
            return
        fs, lock = self._fs(self.spark, f"{self.path}/writer.lock")
        if not fs.createNewFile(lock):
            raise IoError(f"{self.path} has another writer (remove {self.path}/writer.lock if it died)")
        try:
            self._state = self._read_state(self.spark, self.path) if self._state["version"] else self._state
            yield
        finally:
            fs.delete(lock, False)

    def _publish(self, changed: Mapping) -> None:
        """Make a new state the current one: it is written beside the pointer and then renamed over it."""
        if self._staging:
            self._state = {**self._state, **changed}
            return
        state = {**self._state, **changed, "version": self._state["version"] + 1}
        state["written"] = {p: self._written[p] for p in (*state["vectors"], *state["metadata"], *state["edges"]) if p in self._written}
        part = f"{self.path}/.{uuid.uuid4().hex}.json"
        self._write_text(self.spark, part, json.dumps(state), True)
        jvm = self.spark._jvm
        fs, where = self._fs(self.spark, part)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(where), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.path}/current.json")), options)
        self._state = state

    def _save(self, df: DataFrame, name: str) -> str:
        """Write a new table; its rows are counted and hashed while they are written."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        seen = Observation()
        df.observe(seen, *self._digest(df)).write.parquet(path)
        if "rows" in (found := seen.get):  # plans without any row may be cut off above what observes them
            self._written[path] = [found["rows"], found["digest"]]
        return path

    @staticmethod
    def _digest(df: DataFrame) -> list[Column]:
        """The number of rows and the sum of their hashes, which does not depend on their order."""
        maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
        cols = [F.array_sort(F.map_entries(c)) if c in maps else F.col(c) for c in sorted(df.columns)]
        total = F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(20,0)")), F.lit(0))
        return [F.count(F.lit(1)).alias("rows"), total.cast("string").alias("digest")]

    def _damaged(self, deep: bool) -> list[str]:
        """What tables do not hold the rows that were written: by their number, or by their hashes."""
        out = []
        for name, schema in (("vectors", ops.VECTORS), ("metadata", ops.METADATA), ("edges", hnsw.EDGES)):
            for path in self._state[name]:
                if path in self._written:
                    df = self.spark.read.schema(schema).parquet(path)
                    rows, digest = self._written[path]
                    found = df.agg(*self._digest(df)).first() if deep else None
                    if (found["rows"] if deep else df.count()) != rows:
                        out.append(f"{path} does not hold the {rows} rows that were written")
                    elif deep and found["digest"] != digest:
                        out.append(f"{path} does not hold what was written: its checksum differs")
        return out

    def _bytes(self, name: str) -> int:
        """The size of the files of a table."""
        return sum(fs.getContentSummary(where).getLength() for fs, where in (self._fs(self.spark, p) for p in self._state[name]) if fs.exists(where))

    def _load(self, name: str, schema: T.StructType | str) -> DataFrame:
        paths = self._state[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # tables of the current snapshot

    def vectors(self) -> DataFrame:
        return self._load("vectors", ops.VECTORS)

    def metadata(self) -> DataFrame:
        return self._load("metadata", ops.METADATA)

    def edges(self) -> DataFrame:
        """Each table counts for the shards from its first one on, up to that of the next."""
        paths = self._state["edges"]
        if len(paths) < 2:
            return self._load("edges", hnsw.EDGES)
        first = self._state["edges_from"]
        parts = [self.spark.read.schema(hnsw.EDGES).parquet(p).where(F.col("shard") >= a) for p, a in zip(paths, first, strict=True)]
        parts = [part.where(F.col("shard") < b) for part, b in zip(parts, first[1:], strict=False)] + parts[-1:]
        return functools.reduce(DataFrame.unionByName, parts)

    def _store(self, with_metadata: bool) -> DataFrame:
        if not with_metadata:
            return self.vectors()
        held = self.metadata().withColumnRenamed("id", "_id")
        return self.vectors().join(held, F.col("id") == F.col("_id"), "left").drop("_id")

    # writes

    def batch(self, rows: Iterable[tuple[int | None, Sequence[float], Mapping[str, M.Value] | None]]) -> DataFrame:
        """A batch of Python rows (id or None, vector, metadata)."""
        return self.spark.createDataFrame([(i, id, [float(x) for x in v], M.tagged(m or {})) for i, (id, v, m) in enumerate(rows)], BATCH)

    @staticmethod
    def _whole(batch: DataFrame) -> DataFrame:
        if "ordinal" not in batch.columns:
            batch = batch.withColumn("ordinal", F.monotonically_increasing_id())
        for f in BATCH.fields:
            if f.name not in batch.columns:
                batch = batch.withColumn(f.name, F.lit(None).cast(f.dataType))
        return batch.select(*BATCH.names)

    def insert(self, batch: DataFrame) -> int:
        """Add a batch (id or null, embedding, metadata); nothing is written if a row cannot be. Gives the number of rows."""
        with self._writer():
            rows = self.spark.read.schema(BATCH).parquet(self._save(self._whole(batch), "batch"))
            ops.validate(rows, self.config)
            rows = ops.with_auto_ids(rows, self._state["next_id"])
            ops.check_duplicates(rows, self.vectors())
            n, top = rows.agg(F.count("*"), F.max("id")).first()
            if not n:
                return 0
            vectors = self._save(ops.new_rows(rows, self.config, self._state["next_slot"]), "vectors")
            held = rows.where(F.size("metadata") > 0).select("id", "metadata")
            metadata = self._state["metadata"] if held.isEmpty() else [*self._state["metadata"], self._save(held, "metadata")]
            self._publish({"vectors": [*self._state["vectors"], vectors], "metadata": metadata, "next_id": max(self._state["next_id"], top + 1), "next_slot": self._state["next_slot"] + n})
            return n

    def upsert(self, batch: DataFrame) -> int:
        """Replace vector and metadata of ids that exist, insert the others."""
        with self._writer():
            rows = self.spark.read.schema(BATCH).parquet(self._save(self._whole(batch), "batch"))
            ops.validate(rows, self.config)
            if rows.where("id IS NULL").limit(1).count():
                raise InvalidArgumentError("a row without an id cannot replace any")
            ops.check_duplicates(rows, self.vectors().where("false"))
            n, top = rows.agg(F.count("*"), F.max("id")).first()
            if not n:
                return 0
            vectors = self._save(ops.upsert(self.vectors(), rows, self.config, self._state["next_slot"]), "vectors")
            slots = self.spark.read.schema(ops.VECTORS).parquet(vectors).agg(F.max("slot")).first()[0]
            given = rows.select("id", F.coalesce("metadata", F.create_map().cast(M.METADATA)).alias("metadata"))
            metadata = self._save(ops.replace_metadata(self.metadata(), given), "metadata")
            self._publish({"vectors": [vectors], "metadata": [metadata], "next_id": max(self._state["next_id"], top + 1), "next_slot": slots + 1})
            return n

    def remove(self, ids: Iterable[int]) -> int:
        """Tombstone ids and drop their metadata; ids that are not there do not count."""
        gone = self.spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")
        with self._writer():
            n = gone.join(self.vectors().where("live"), "id", "left_semi").count()
            if n:
                fits = self._state["graph_of"] == self._state["vectors"]
                vectors = [self._save(ops.remove(self.vectors(), gone), "vectors")]
                metadata = [self._save(ops.remove_metadata(self.metadata(), gone), "metadata")]
                self._publish({"vectors": vectors, "metadata": metadata} | ({"graph_of": vectors} if fits else {}))
            return n

    def set_metadata(self, id: int, metadata: Mapping[str, M.Value]) -> None:
        """Replace all keys of an id; an empty map clears them."""
        given = self.spark.createDataFrame([(id, M.tagged(metadata))], ops.METADATA)
        with self._writer():
            ops.require(self.vectors(), given)
            self._publish({"metadata": [self._save(ops.replace_metadata(self.metadata(), given), "metadata")]})

    def set_key(self, id: int, key: str, value: M.Value) -> None:
        given = self.spark.createDataFrame([(id, M.tagged({key: value}))], ops.METADATA)
        with self._writer():
            ops.require(self.vectors(), given)
            self._publish({"metadata": [self._save(ops.merge_metadata(self.metadata(), given), "metadata")]})

    def remove_key(self, id: int, key: str) -> None:
        with self._writer():
            self._publish({"metadata": [self._save(ops.remove_key(self.metadata(), self.spark.createDataFrame([(id,)], "id long"), key), "metadata")]})

    def rebuild_index(self) -> None:
        """Build the graph over all slots, tombstones included."""
        with self._writer():
            self._rebuild()

    def _rebuild(self) -> None:
        if self.index.stored and self._state["vectors"]:
            edges = self._save(self.index.build(self.vectors()), "edges")
            self._publish({"edges": [edges], "edges_from": [0], "graph_of": self._state["vectors"], "graph_slots": self._state["next_slot"]})

    def _extend(self) -> None:
        """Add the slots of inserts to the graph; shards that got none are not read."""
        built = self._state["graph_slots"]
        first = built // self.index.shard_slots
        edges = self._save(self.index.extend(self.vectors(), self.edges(), built), "edges")
        held = [(p, a) for p, a in zip(self._state["edges"], self._state["edges_from"], strict=True) if a < first] + [(edges, first)]
        self._publish({"edges": [p for p, _ in held], "edges_from": [a for _, a in held], "graph_of": self._state["vectors"], "graph_slots": self._state["next_slot"]})

    def compact(self) -> int:
        """Drop tombstones and orphaned metadata, number slots anew, rebuild the graph. Gives the slots reclaimed."""
        with self._writer():
            dead = self.vectors().where("NOT live").count()
            stray = not ops.orphans(self.vectors(), self.metadata()).isEmpty()
            if dead or stray or len(self._state["vectors"]) > 1:
                vectors = self._save(ops.compact(self.vectors()), "vectors")
                metadata = self._save(ops.remove_orphans(self.vectors(), self.metadata()), "metadata")
                self._publish({"vectors": [vectors], "metadata": [metadata], "next_slot": self._state["next_slot"] - dead})
                self._rebuild()
            return dead

    def flush(self) -> None:
        """Bring the graph up to date; vectors and metadata are durable as soon as a write returns."""
        with self._writer():
            if self._state["vectors"] and not self._graph_fits():
                if self.index.stored and self._graph_grows():
                    self._extend()
                else:
                    self._rebuild()

    def vacuum(self, hours: float = 24) -> int:
        """Delete tables that the current snapshot does not name and that are older than some hours, which leaves readers of
        older snapshots that long. Gives their number."""
        with self._writer():
            fs, root = self._fs(self.spark, self.path)
            used = {p.rsplit("/", 1)[-1] for name in ("vectors", "metadata", "edges") for p in self._state[name]}
            old = [x.getPath() for x in fs.listStatus(root) if x.isDirectory() and x.getModificationTime() <= (time.time() - hours * 3600) * 1000]
            gone = [p for p in old if p.getName() not in used and p.getName().partition("-")[0] in ("vectors", "metadata", "edges", "batch")]
            for p in gone:
                fs.delete(p, True)
            return len(gone)

    # reads

    def search(self, query: Sequence[float], options: QueryOptions = QueryOptions()) -> DataFrame:
        q = knn.check_query(query, self.config.dimension)
        if options.exact or not self.index.stored:
            return knn.knn(self._store(bool(options.filter) or options.include_metadata), q, self.config.metric, options)
        return self.batch_search(self.spark.createDataFrame([(0, q)], "qid long, query array<float>"), options).drop("qid")

    def batch_search(self, queries: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
        """queries: qid, query. Exact by blocks of products, or by the graph."""
        bad = queries.select("qid", ops.fault(F.col("query"), self.config.dimension).alias("why")).where("why IS NOT NULL").orderBy("qid").first()
        if bad:
            raise InvalidArgumentError(f"query {bad['qid']}: {bad['why']}")
        store = self._store(bool(options.filter) or options.include_metadata)
        if options.exact:
            return knn.knn_blocks(store, queries, self.config.metric, options, self.config.dimension)
        if self.index.stored and self._state["vectors"] and not self._graph_fits():
            try:
                self.flush()
            except IoError:  # another writer is at work: this snapshot is searched without the graph
                return knn.knn_blocks(store, queries, self.config.metric, options, self.config.dimension)
            store = self._store(bool(options.filter) or options.include_metadata)
        return self.index.search(store, self.edges(), queries, options)

    def get(self, id: int) -> tuple[list[float], dict[str, M.Value]] | None:
        row = ops.get(self.vectors(), self.metadata(), [id]).first()
        return None if row is None else (list(row["embedding"]), M.plain(row["metadata"]))

    def contains(self, id: int) -> bool:
        return ops.contains(self.vectors(), id)

    def size(self) -> int:
        return self.vectors().where("live").count()

    def all_ids(self) -> DataFrame:
        return ops.all_ids(self.vectors())

    def filter_ids(self, filter: Filter | str) -> DataFrame:
        return ops.filter_ids(self.vectors(), self.metadata(), Filter.parse(filter) if isinstance(filter, str) else filter)

    def stats(self) -> dict:
        out = ops.stats(self.vectors(), self.metadata()).first().asDict()
        keys = [r["key"] for r in ops.metadata_keys(self.metadata()).collect()]
        files = {f"{name}_file_bytes": self._bytes(name) for name in ("vectors", "metadata")} | {"index_bytes": self._bytes("edges")}
        return {**self.config.plain(), **out, **files, "describe": self.index.describe(), "metadata_keys": keys, "dirty": self.index.stored and self._state["graph_of"] != self._state["vectors"]}

    def check(self, deep: bool = False) -> list[tuple[str, str]]:
        """(error or warning, message) for all that is wrong."""
        missing = [p for name in ("vectors", "metadata", "edges") for p in self._state[name] if not self._fs(self.spark, p)[0].exists(self._fs(self.spark, p)[1])]
        out = [("error", f"{p} is missing") for p in missing]
        if missing:
            return out
        out += [("error", message) for message in self._damaged(deep)]
        out += [tuple(r) for r in ops.check(self.vectors(), self.metadata(), self.config.dimension, deep).collect()]
        if self.index.stored:
            if not self._state["edges"]:
                out.append(("warning", "there is no graph; it is built on the next open"))
            else:
                if self._state["graph_of"] != self._state["vectors"]:
                    out.append(("warning", "the graph is older than the vectors; flush brings it up to date"))
                if deep:
                    out += [("error", f"graph: {r['violations']} x {r['check']}") for r in self.index.integrity(self.edges()).where("violations > 0").collect()]
        return out

    # files

    def import_file(self, path: str, csv: bool = False, csv_ids: bool = False, start_id: int | None = None) -> int:
        """start_id wins over the file's ids, which win over automatic ones."""
        rows = read_csv(self.spark, path, csv_ids) if csv else read_vecs(self.spark, path)
        if start_id is not None:
            rows = ops.numbered(rows.drop("id"), "ordinal", "id", start_id)
        return self.insert(rows)

    def export_file(self, path: str, csv: bool = False) -> int:
        rows = self.vectors().where("live").select("id", "embedding")
        (write_csv if csv else write_vecs)(rows, path)
        return rows.count()


