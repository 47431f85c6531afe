"""State between runs: versions of tables, and a pointer that is written last."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where a local session names none.

    A cluster's executors can't see the driver's temporary folder, so there a session must name one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='heartwood-')}"
        spark.conf.set("spark.checkpoint.dir", d)
        atexit.register(shutil.rmtree, d.removeprefix("file://"), ignore_errors=True)
    return d.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/heartwood-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


#: Folders of the tables that cut() has written, by the frames it returned.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete tables that cut() returned and that nothing will read again."""
    for df in tables:
        if path := _folders.pop(df, None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with what it holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


class Conflict(RuntimeError):
    """Another commit has taken the version that this one was going to make."""


#: Versions after which a commit writes whole tables again, so that readers never merge more.
COMPACT = 10


class Store:
    """Tables kept as a log of changed rows, in one base folder.

    A commit compares whole tables with those of the version that this store has
    read, and writes what differs: new and changed rows, and marks of rows that
    are gone. A version is its file in the folder `log`, made last and only if no
    other commit has made it, so that of two commits from one version the second
    is refused (Conflict), and readers see all of a version or none of it. Reads
    merge the rows of the versions since the last whole one, the newest of each
    key; a key is all of a table's columns but the last. Names of the files in
    `log`, and the contents of at most COMPACT of them, are all that the driver
    handles.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._seen: int | None = None  # the version that reads and the next commit start from

    # files of the log

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self) -> list[int]:
        path, fs = self._fs(f"{self.base}/log")
        if not fs.exists(path):
            return []
        return sorted(int(n[:-5]) for n in (f.getPath().getName() for f in fs.listStatus(path)) if re.fullmatch(r"\d+\.json", n))

    def _entry(self, version: int) -> dict:
        path, fs = self._fs(f"{self.base}/log/{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, entry: dict) -> None:
        path, fs = self._fs(f"{self.base}/log/{version}.json")
        try:
            out = fs.create(path, False)  # fails where the file is there
        except Exception as e:
            if fs.exists(path):
                raise Conflict(f"version {version} has been made by another commit") from e
            raise
        out.write(json.dumps(entry).encode())
        out.close()

    def refresh(self) -> int:
        """Read from the newest version on."""
        self._seen = max(self._versions(), default=0)
        return self._seen

    def _at(self, version: int | None) -> int:
        return version if version is not None else self.refresh() if self._seen is None else self._seen

    # reading

    def state(self, repo: str = "*") -> tuple[int, str | None, str | None]:
        """(version, folder, sha) of the version that is read; version 0 where there is none."""
        at = self._at(None)
        entry = self._entry(at) if at else {}
        return at, entry.get("folder"), entry.get("shas", {}).get(repo)

    def _parts(self, name: str, version: int) -> list[str]:
        """Folders with rows of a table, back to where it was written whole."""
        out: list[str] = []
        while version:
            entry = self._entry(version)
            if name in entry["tables"]:
                out.append(f"{entry['folder']}/{name}")
                if entry["tables"][name] == "whole":
                    break
            version = entry["before"].get(name, 0)
        return out

    def read(self, name: str, schema: str, repo: str = "*", version: int | None = None) -> DataFrame:
        """A table as of a version, the one that is read if none is given; empty before the first."""
        own = self.spark.createDataFrame([], schema)
        parts = self._parts(name, self._at(version))
        if not parts:
            return own
        rows = self.spark.read.schema(f"{schema}, version bigint, gone boolean").parquet(*parts)
        if len(parts) == 1:  # nothing to merge
            return rows.where("NOT gone").select(own.columns)
        keys = own.columns[:-1]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(own.columns[-1], "gone"), "version").alias("r"))
        return newest.where("NOT r.gone").select(*keys, f"r.{own.columns[-1]}")

    # writing

    def commit(self, tables: Mapping[str, DataFrame], sha: str, repo: str = "*", repos: DataFrame | None = None) -> int:
        """Make the next version, in which tables have these rows. An empty sha is refused.

        repos, a table of `repo`, limits what the tables say to these repositories; rows of others stay.
        """
        if not sha:
            raise ValueError("a commit needs the id of the version it stands for")
        seen = self._at(None)
        version, last = seen + 1, self._entry(seen) if seen else {"shas": {}, "before": {}, "tables": {}}
        folder = f"{self.base}/data/{version}-{uuid.uuid4().hex}"
        before = last["before"] | {n: seen for n in last["tables"]}
        kinds: dict[str, str] = {}
        for name, df in tables.items():
            *keys, value = df.columns
            merged = len(self._parts(name, seen))
            whole = not merged or merged >= COMPACT
            old = self.read(name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
            here = old if repos is None else old.join(repos.select("repo"), "repo", "left_semi")
            if whole:
                rest = old.limit(0) if repos is None else old.join(repos.select("repo"), "repo", "left_anti")
                rows = df.unionByName(rest).withColumn("gone", F.lit(False))
            else:
                new = df.select(*keys, F.struct(F.col(value).alias("v")).alias("new"))
                both = new.join(here.select(*keys, F.struct(F.col(value).alias("v")).alias("old")), keys, "full_outer").where("NOT (new <=> old)")
                rows = both.select(*keys, F.col("new.v").alias(value), F.col("new").isNull().alias("gone"))
            rows.withColumn("version", F.lit(version).cast("bigint")).select(*df.columns, "version", "gone").write.parquet(f"{folder}/{name}")
            kinds[name] = "whole" if whole else "delta"
        self._publish(version, {"folder": folder, "tables": kinds, "before": before, "shas": last["shas"] | {repo: sha}})
        self._seen = version
        return version

    def advance(self, sha: str, repo: str = "*") -> None:
        """The same tables for another sha, as after a run with nothing to do."""
        self.commit({}, sha, repo)
