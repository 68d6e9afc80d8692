"""Tables as sets of files that a manifest names.

Below a table's folder, ``data`` has one folder of Parquet files for each write
and ``manifests`` one small file for each version: the schema, the files that
belong to it and the streams' batches that it has taken in. A change writes new
files only, and then a manifest whose number must not be there yet; who comes
second reads the new version and tries again. So two writers at once both
succeed, a writer that is lost leaves nothing that is read, and an upsert
rewrites the files that hold a key of the new rows and no others.

The version before the current one is kept for readers that have begun. Files
that only older versions name are deleted; files that no version names yet, as
of a writer at work, are never touched.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRITE = "lodestar_write"
#: Local file systems rename without looking; this makes it one step for writers of one process.
_lock = threading.Lock()


class Conflict(RuntimeError):
    """Another writer was faster, again and again."""


class VersionedTables:
    """Tables below one folder; those with a ``theme_id`` are partitioned by it."""

    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, root: str, names: tuple[str, ...] | None = None) -> None:
        self.spark, self.root, self.names = spark, root.rstrip("/"), names

    # files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        where = self._path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _home(self, table: str) -> str:
        if self.names is not None and table not in self.names:
            raise KeyError(table)
        return f"{self.root}/{table}"

    def _put(self, table: str, df: DataFrame, own: str | None = None) -> list[str]:
        """Writes ``df`` into a folder of its own and gives its files, from the table's data folder on."""
        own = own or f"{_WRITE}={uuid.uuid4().hex}"
        target = f"{self._home(table)}/data/{own}"
        themed = "theme_id" in df.columns and len(df.columns) > 1
        (df.write.partitionBy("theme_id") if themed else df.write).parquet(target)
        fs, where = self._fs(target)
        base, found, listed = fs.makeQualified(where).toString(), [], fs.listFiles(where, True)
        while listed.hasNext():
            path = listed.next().getPath()
            if path.getName().endswith(".parquet"):
                found.append(own + path.toString()[len(base) :])
        return found

    def _forget(self, table: str, files: list[str]) -> None:
        for name in sorted(files):
            fs, where = self._fs(f"{self._home(table)}/data/{name}")
            fs.delete(where, False)

    def _load(self, table: str, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        base = f"{self._home(table)}/data"
        whole = T.StructType([*schema.fields, T.StructField(_WRITE, T.StringType())])
        return self.spark.read.schema(whole).option("basePath", base).parquet(*[f"{base}/{f}" for f in files]).select(*schema.names)

    # manifests

    def versions(self, table: str) -> list[int]:
        """Those that can be read."""
        fs, where = self._fs(f"{self._home(table)}/manifests")
        if not fs.exists(where):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(where) if s.getLen())
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, table: str, version: int) -> dict:
        fs, where = self._fs(f"{self._home(table)}/manifests/{version:08d}.json")
        stream = fs.open(where)
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        if not data:
            raise RuntimeError(f"FileNotFound: version {version} of {table} has gone")
        return json.loads(data)

    def _current(self, table: str) -> tuple[int, dict | None]:
        for _ in range(self.ATTEMPTS):
            found = self.versions(table)
            try:
                return (found[-1], self._manifest(table, found[-1])) if found else (-1, None)
            except Exception as e:  # noqa: BLE001  two later versions since it was listed
                if "FileNotFound" not in str(e):
                    raise
        raise Conflict(table)

    def _commit(self, table: str, version: int, manifest: dict) -> bool:
        """Makes ``version`` the current one, unless there is one of that number."""
        home = f"{self._home(table)}/manifests"
        draft, final = f"{home}/draft-{uuid.uuid4().hex}", f"{home}/{version:08d}.json"
        fs, where = self._fs(draft)
        out = fs.create(where, False)
        try:
            out.write(json.dumps(manifest, ensure_ascii=False).encode())
        finally:
            out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        with _lock:
            if fs.exists(self._path(final)):
                fs.delete(where, False)
                return False
            try:
                files.rename(where, self._path(final), options)
                return True
            except Exception as e:  # noqa: BLE001  py4j wraps what Hadoop throws
                if "FileAlreadyExists" not in str(e):
                    raise
                fs.delete(where, False)
                return False

    def _change(self, table: str, plan: Callable[[dict | None], tuple[dict, list[str]] | None]) -> None:
        """Commits what ``plan`` makes of the current manifest: a new one, and the files that go if another writer is faster; None changes nothing."""
        for _ in range(self.ATTEMPTS):
            version, old = self._current(table)
            try:
                planned = plan(old)
            except Exception:
                if self._current(table)[0] == version:
                    raise
                continue  # files of the version that it read may have gone meanwhile
            if planned is None:
                return
            if self._commit(table, version + 1, planned[0]):
                self._clean(table)
                return
            self._forget(table, planned[1])
        raise Conflict(table)

    def _clean(self, table: str) -> None:
        found = self.versions(table)
        kept = {f for v in found[-2:] for f in self._manifest(table, v)["files"]}
        for v in found[:-2]:
            try:
                self._forget(table, [f for f in self._manifest(table, v)["files"] if f not in kept])
            except Exception as e:  # noqa: BLE001  another writer may clean up too
                if "FileNotFound" not in str(e):
                    raise
            fs, where = self._fs(f"{self._home(table)}/manifests/{v:08d}.json")
            fs.create(where, True).close()  # empty, so that its number stays taken for a writer that began long ago

    # reading and writing

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def files(self, table: str) -> list[str]:
        """Files of the current version."""
        manifest = self._current(table)[1]
        return manifest["files"] if manifest else []

    def read(self, table: str) -> DataFrame:
        manifest = self._current(table)[1]
        if manifest is None:
            raise FileNotFoundError(self._home(table))
        return self._load(table, manifest["files"], T.StructType.fromJson(manifest["schema"]))

    @staticmethod
    def _named(schema: T.StructType, files: list[str], old: dict | None, batch: tuple[str, int] | None = None) -> dict:
        streams = {**(old or {}).get("streams", {}), **({batch[0]: batch[1]} if batch else {})}
        return {"schema": json.loads(schema.json()), "files": files, "streams": streams}

    def write(self, table: str, df: DataFrame) -> str:
        """``df`` replaces the table, of which it may be made; gives the folder written."""
        own = f"{_WRITE}={uuid.uuid4().hex}"
        files = self._put(table, df, own)
        self._change(table, lambda old: (self._named(df.schema, files, old), []))
        return f"{self._home(table)}/data/{own}"

    def rewrite(self, table: str, make: Callable[[DataFrame | None], DataFrame]) -> None:
        """What ``make`` gives of the table, or of None, replaces it; made anew if another writer was faster."""

        def plan(old: dict | None) -> tuple[dict, list[str]]:
            df = make(None if old is None else self._load(table, old["files"], T.StructType.fromJson(old["schema"])))
            files = self._put(table, df)
            return self._named(df.schema, files, old), files

        self._change(table, plan)

    def append(self, table: str, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds rows; the files that are there stay. ``batch``, a stream's name and its batch's number, is taken in once only."""
        self._add(table, df, None, batch)

    def upsert(self, table: str, new: DataFrame, keys: tuple[str, ...], together: bool = False, batch: tuple[str, int] | None = None) -> None:
        """Adds rows in place of those that share any of ``keys`` with one of them, or with ``together`` all of them, nulls too.

        Alone, a null key replaces nothing.
        """
        self._add(table, new, (tuple(k for k in keys if k in new.columns), together), batch)

    def _add(self, table: str, new: DataFrame, keys: tuple[tuple[str, ...], bool] | None, batch: tuple[str, int] | None) -> None:
        done = self._current(table)[1]
        if batch and done and done["streams"].get(batch[0], -1) >= batch[1]:
            return
        files = self._put(table, new)
        fresh = self._load(table, files, new.schema)

        def plan(old: dict | None) -> tuple[dict, list[str]] | None:
            if old is None:
                return self._named(new.schema, files, old, batch), []
            if batch and old["streams"].get(batch[0], -1) >= batch[1]:
                self._forget(table, files)
                return None
            schema = T.StructType.fromJson(old["schema"])
            kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
            themed = ("theme_id" in kinds) != ("theme_id" in new.columns)
            if themed or any(f.name in kinds and kinds[f.name] != f.dataType.simpleString() for f in new.schema.fields):  # other types or folders: all is written anew
                stored = self._load(table, old["files"], schema)
                both = (stored if keys is None else _without(stored, fresh, *keys)).unionByName(fresh, allowMissingColumns=True)
                made = self._put(table, both)
                return self._named(both.schema, made, old, batch), made
            whole = T.StructType([*schema.fields, *(f for f in new.schema.fields if f.name not in kinds)])
            touched = [] if keys is None else self._touched(table, old["files"], schema, fresh, *keys)
            again = self._put(table, _without(self._load(table, touched, schema), fresh, *keys)) if touched else []
            gone = set(touched)
            return self._named(whole, [f for f in old["files"] if f not in gone] + again + files, old, batch), again

        self._change(table, plan)

    def _touched(self, table: str, files: list[str], schema: T.StructType, fresh: DataFrame, keys: tuple[str, ...], together: bool) -> list[str]:
        """Those of ``files`` that hold a row which ``fresh`` replaces."""
        if not files or any(k not in schema.names for k in keys) and together:
            return []
        base = f"{self._home(table)}/data"
        whole = T.StructType([*schema.fields, T.StructField(_WRITE, T.StringType())])
        stored = self.spark.read.schema(whole).option("basePath", base).parquet(*[f"{base}/{f}" for f in files])
        keys = tuple(k for k in keys if k in schema.names)
        stored = stored.select(*keys, F.col("_metadata.file_path").alias("lodestar_file"))
        found = set()
        for own in [keys] if together else [(k,) for k in keys]:
            hit = stored.join(_keys(fresh, own, together), _same(stored, own, together), "left_semi")
            found |= {r.lodestar_file for r in hit.select("lodestar_file").distinct().collect()}  # file names, as the manifest has them
        names = {f[f.index(f"{_WRITE}=") :] for f in found}
        names |= set(map(unquote, names))  # Spark gives the place as a URI
        return [f for f in files if f in names]


def _keys(new: DataFrame, keys: tuple[str, ...], nulls: bool) -> DataFrame:
    found = new.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct()
    return found if nulls else found.dropna()


def _same(old: DataFrame, keys: tuple[str, ...], nulls: bool):
    on = F.lit(True)
    for k in keys:
        on = on & (old[k].eqNullSafe(F.col(f"new_{k}")) if nulls else old[k] == F.col(f"new_{k}"))
    return on


def _without(old: DataFrame, new: DataFrame, keys: tuple[str, ...], together: bool = False) -> DataFrame:
    """``old`` without the rows that ``new`` replaces: one anti join for each key, so no join has an OR."""
    if together and any(k not in old.columns for k in keys):
        return old
    own = tuple(k for k in keys if k in old.columns)
    for part in [own] if together else [(k,) for k in own]:
        old = old.join(_keys(new, part, together), _same(old, part, together), "left_anti")
    return old
