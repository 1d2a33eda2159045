"""Stored tables as generations of bucketed files, named by a log of manifests.

Every write adds one generation: Parquet files bucketed and sorted by patient. A manifest lists the generations
that make up the table, with the rows and the ranges of patients and times in each of their files; the next
manifest is renamed into place under the next number, which fails if another writer was there first. That
writer's generations are then compared with, not the whole store, and the commit is tried again. Readers see a
manifest or the one before it, never half a write. A feed's batch number is committed with its rows,
so that a replayed batch is known and left out.

A join of a batch with the store exchanges only the batch: it is dealt by patient into the store's number of buckets, and each
generation is read in its own buckets beside it. Generations whose files cannot hold any of the batch's patients and times are not read at
all; with few patients their names reach the scan, which then opens their buckets only.

All rows of a patient lie in one bucket. Many small generations are merged by `compact`; files that no manifest names
stay until `vacuum`, as a reader may still be at them.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Patients whose names are sent to the scan; with more, nearly every bucket is read anyway.
NAMED = 1000
#: Generations from which on an insert merges them first.
MOST_GENERATIONS = 12
PATIENT = "patient_id"
_BATCH_RANGE = ["first_patient", "last_patient", "first_time", "last_time"]
#: A store on one machine's disk looks before it renames; one writer of this process at a time does.
_renaming = threading.Lock()


@dataclass(frozen=True)
class Manifest:
    """The table at one moment."""

    number: int = 0
    generations: list[dict] = field(default_factory=list)
    feeds: dict[str, int] = field(default_factory=dict)
    schema: dict | None = None

    @property
    def rows(self) -> int:
        return sum(f["rows"] for g in self.generations for f in g["files"])


@dataclass(frozen=True)
class Commit:
    """What an insert did."""

    submitted: int
    inserted: int
    replayed: bool = False

    @property
    def duplicates(self) -> int:
        return self.submitted - self.inserted


class Ledger:
    """A table under `root`, on storage that every executor reaches.

    `time` names a timestamp column for file ranges, if any. Without a schema the table has the one of its first rows.
    `keep` picks the rows that stay when generations are merged.
    """

    def __init__(
        self, spark: SparkSession, root: str, key: list[str], schema: T.StructType | None = None, time: str | None = None,
        buckets: int = BUCKETS, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ):
        self.spark, self.root, self.key, self.time, self.buckets, self.keep = spark, root, key, time, buckets, keep
        self.schema = schema or self._known_schema()
        # a bucketed scan is dealt by patient alone, which is enough for a join on patient and more
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def _known_schema(self) -> T.StructType | None:
        known = self.current().schema
        return None if known is None else T.StructType.fromJson(known)

    # manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> Manifest:
        """The newest manifest."""
        files, log = self._files(), self._path("log")
        names = sorted(s.getPath().getName() for s in files.listStatus(log)) if files.exists(log) else []
        numbers = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not numbers:
            return Manifest()
        stream = files.open(self._path(f"log/{numbers[-1]}"))
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(**said)

    def _publish(self, manifest: Manifest) -> bool:
        """Whether the manifest is the table now; not if one with its number is there."""
        jvm, files = self.spark._jvm, self._files()
        files.mkdirs(self._path("log"))
        draft, final = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{manifest.number:020}.json")
        stream = files.create(draft)
        stream.write(json.dumps(manifest.__dict__).encode())
        stream.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            with _renaming:
                context.rename(files.makeQualified(draft), files.makeQualified(final), options)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            files.delete(draft, False)
            return False
        return True

    # generations

    def _table(self, generation: dict) -> DataFrame:
        """A generation with its buckets known to the planner."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        place = f"{self.root}/data/{generation['id']}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(generation)} ({columns}) USING parquet"
            f" CLUSTERED BY ({PATIENT}) SORTED BY ({', '.join(self.key)}) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        return self.spark.table(_name(generation)).select(*self.schema.names)

    def _write(self, rows: DataFrame) -> dict | None:
        """A new generation of rows dealt by patient; null if there are none."""
        self.schema = self.schema or self._known_schema() or rows.schema
        generation = {"id": uuid.uuid4().hex}
        dealt = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        writer = dealt.write.bucketBy(self.buckets, PATIENT).sortBy(*self.key)
        writer.option("path", f"{self.root}/data/{generation['id']}").saveAsTable(_name(generation))
        when = F.unix_micros(self.time) if self.time else F.lit(None).cast("long")
        files = (
            self.spark.table(_name(generation))
            .groupBy(F.col("_metadata.file_name").alias("name"))
            .agg(F.count(F.lit(1)), F.min(PATIENT), F.max(PATIENT), F.min(when), F.max(when))
            .toDF("name", "rows", *_BATCH_RANGE)
            .collect()  # one row per file, a few per bucket
        )
        generation["files"] = [r.asDict() for r in files]
        return generation if files else None

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows beside the store's buckets."""
        return rows.repartition(self.buckets, PATIENT)

    def _ranges(self, rows: DataFrame) -> tuple[dict | None, list[str] | None]:
        """Ranges of a batch's patients and times, and the patients if they are few."""
        when = F.unix_micros(self.time) if self.time and self.time in rows.columns else F.lit(None).cast("long")
        found = rows.agg(F.min(PATIENT), F.max(PATIENT), F.min(when), F.max(when)).toDF(*_BATCH_RANGE).first().asDict()
        if found["first_patient"] is None:
            return None, None
        names = [r[0] for r in rows.select(PATIENT).distinct().limit(NAMED + 1).collect()]
        return found, names if len(names) <= NAMED else None

    def beside(self, rows: DataFrame, generations: list[dict], how: str = "left_anti") -> DataFrame:
        """Rows of the batch, dealt by patient, without those whose key a generation holds."""
        wanted, names = self._ranges(rows)
        out = self.dealt(rows)
        for generation in generations:
            if wanted is None or not any(_meet(f, wanted) for f in generation["files"]):
                continue
            held = self._named(self._table(generation), names)
            if self.time and wanted["first_time"] is not None:
                held = held.where(F.col(self.time).between(*[F.timestamp_micros(F.lit(wanted[t])) for t in ("first_time", "last_time")]))
            out = out.join(held.select(*self.key).hint("merge"), self.key, how)
        return out

    def _named(self, rows: DataFrame, names: list[str] | None) -> DataFrame:
        return rows if names is None else rows.where(F.col(PATIENT).isin(names))

    # reading

    def _scan(self, paths: list[str]) -> DataFrame:
        # plain files: a union of bucketed scans may be taken for dealt by patient, which it is not
        if not paths:
            return self.spark.createDataFrame([], self.schema or T.StructType([]))
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{path}" for path in paths])

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """All rows."""
        return self._scan([g["id"] for g in (manifest or self.current()).generations])

    def of_patients(self, people: DataFrame) -> DataFrame:
        """Rows of the patients in `people`: if they are few, only the files of their buckets are opened."""
        people = people.select(PATIENT).where(F.col(PATIENT).isNotNull()).distinct()
        generations = self.current().generations
        if not generations:
            return self._scan([])
        bucket = F.pmod(F.hash(PATIENT), F.lit(self.buckets))
        named = people.select(PATIENT, bucket).limit(NAMED + 1).collect()
        if len(named) > NAMED:
            return self._scan([g["id"] for g in generations]).join(people, PATIENT, "left_semi")
        wanted: dict[int, list[str]] = {}
        for name, number in named:
            wanted.setdefault(number, []).append(name)
        paths = [
            f"{g['id']}/{f['name']}" for g in generations for f in g["files"]
            if f["first_patient"] is not None and any(f["first_patient"] <= name <= f["last_patient"] for name in wanted.get(_bucket(f["name"]), ()))
        ]
        return self._named(self._scan(paths), [name for name, _ in named])

    # writing

    def insert(self, rows: DataFrame, feed: str | None = None, number: int | None = None, once: bool = True) -> Commit:
        """Add rows, one for each key (`once`: those whose key is not stored yet).

        `rows` should not repeat a key and is read several times. Feed and number, if given, mark a batch of a stream: it counts once.
        """
        before = self.current()
        if feed is not None and before.feeds.get(feed, -1) >= number:
            return Commit(rows.count(), 0, replayed=True)
        if len(before.generations) >= MOST_GENERATIONS:
            self.compact()
            before = self.current()
        submitted, compared = rows.count(), {g["id"] for g in before.generations}
        added = self._write(self.beside(rows, before.generations) if once else self.dealt(rows))
        while True:
            latest = self.current()
            if feed is not None and latest.feeds.get(feed, -1) >= number:
                return Commit(submitted, 0, replayed=True)
            others = [g for g in latest.generations if g["id"] not in compared]
            if once and added and others:  # only what other writers committed meanwhile
                left = self.beside(self._table(added), others)
                added = self._write(left)
            compared |= {g["id"] for g in others}
            feeds = latest.feeds if feed is None else {**latest.feeds, feed: number}
            if not added and feeds == latest.feeds:
                return Commit(submitted, 0)
            if self._publish(self._next(latest, [*latest.generations, *([added] if added else [])], feeds)):
                return Commit(submitted, sum(f["rows"] for f in added["files"]) if added else 0)

    def _next(self, manifest: Manifest, generations: list[dict], feeds: dict[str, int]) -> Manifest:
        return Manifest(manifest.number + 1, generations, feeds, self.schema and self.schema.jsonValue())

    def compact(self) -> None:
        """Merge the generations into one, of the rows that `keep` leaves."""
        before = self.current()
        old = {g["id"] for g in before.generations}
        merged = self._write(self.dealt(self.keep(self.read(before)))) if old else None
        while old:
            latest = self.current()
            if not old <= {g["id"] for g in latest.generations}:
                return  # another writer merged them
            rest = [g for g in latest.generations if g["id"] not in old]
            if self._publish(self._next(latest, [*([merged] if merged else []), *rest], latest.feeds)):
                return

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest does not name; for times without readers or writers."""
        files, data = self._files(), self._path("data")
        live = {g["id"] for g in self.current().generations}
        old = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in live] if files.exists(data) else []
        for path in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {_name({'id': path.getName()})}")
            files.delete(path, True)
        return len(old)


def _name(generation: dict) -> str:
    return f"labtide_{generation['id']}"


def _bucket(file_name: str) -> int:
    """The bucket that Spark's writer puts into a file's name."""
    return int(file_name.split(".")[0].rsplit("_", 1)[1])


def _meet(a: dict, b: dict) -> bool:
    """Whether two ranges of patients and times overlap; an unknown time meets all."""
    if a["first_patient"] is None or a["last_patient"] < b["first_patient"] or b["last_patient"] < a["first_patient"]:
        return False
    if None in (a["first_time"], b["first_time"]):
        return True
    return a["first_time"] <= b["last_time"] and b["first_time"] <= a["last_time"]
