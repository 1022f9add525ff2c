"""S3: results kept as Parquet snapshots that notice changed inputs.

A snapshot's key is a digest of what it was made from: its name or SQL text, its
parameters, the library's code and the *source version*, a digest of path,
length and time of every file below the plan's input folders. Any changed,
added or removed input file gives another key, so a stale result is never read.

The data go to a folder of their own (``data-<uuid>``); a small ``CURRENT`` file
that names it is written aside and renamed into place, and read back. Readers
see a whole snapshot or none, two writers of one key don't disturb each other,
and a failed write leaves nothing that counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import shared_root

DIR_CONF = "spark.basketlens.snapshot.dir"


class UnversionedSource(ValueError):
    """An input that has no files (rows made in the session)."""


def _seq(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def input_folders(df: DataFrame) -> list[str]:
    """Folders and files the plan of ``df`` reads, sorted."""
    roots = set()
    for leaf in _seq(df._jdf.queryExecution().analyzed().collectLeaves()):
        kind = leaf.getClass().getSimpleName()
        if kind in ("OneRowRelation", "Range"):
            continue
        if kind != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            raise UnversionedSource(f"{kind} is not read from files")
        roots |= {p.toString() for p in _seq(leaf.relation().location().rootPaths())}
    return sorted(roots)


def source_version(spark: SparkSession, *inputs: DataFrame) -> str:
    """Digest of path, length and modification time of all input files. Spark
    lists the folders (no file is opened) and only sums reach the driver."""
    roots = sorted({r for df in inputs for r in input_folders(df)})
    if not roots:
        return "none"
    row = F.xxhash64("path", "length", "modificationTime")
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
             .select("path", "length", "modificationTime")
             .agg(F.count(F.lit(1)), F.sum("length"), F.max(F.col("modificationTime").cast("double")),
                  F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first())
    return hashlib.sha256(json.dumps([roots, [str(v) for v in found]]).encode()).hexdigest()


@lru_cache(maxsize=1)
def code_version() -> str:
    """Digest of the library's own source text."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    digest = hashlib.sha256()
    for folder, names, files in os.walk(home):
        names[:] = sorted(n for n in names if n not in ("__pycache__", "llm"))
        for name in sorted(f for f in files if f.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as f:
                digest.update(name.encode() + b"\0" + f.read())
    return digest.hexdigest()


def snapshot_key(what: str, params: dict, source: str, code: str = "") -> str:
    said = json.dumps({"what": what, "params": {k: str(v) for k, v in sorted(params.items())}, "source": source,
                       "code": code}, sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()


class Snapshots:
    """Snapshots below one folder all executors share: ``root``, else the
    session's ``spark.basketlens.snapshot.dir``, else a folder beside its
    checkpoints."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        root = root or spark.conf.get(DIR_CONF, None) or f"{shared_root(spark)}/basketlens-snapshots"
        self.root = root.rstrip("/")

    # Small files, through the file system that holds the snapshots.
    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs().exists(self._path(path))

    def _home(self, name: str, key: str) -> str:
        return f"{self.root}/{name}-{key[:40]}"

    def current(self, name: str, key: str) -> str | None:
        """Data folder of a complete snapshot."""
        pointer = f"{self._home(name, key)}/CURRENT"
        if not self._exists(pointer):
            return None
        stream = self._fs().open(self._path(pointer))
        try:
            data = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()
        data = f"{self._home(name, key)}/{data}"
        return data if self._exists(f"{data}/_SUCCESS") else None

    def _publish(self, name: str, key: str, data: str) -> str:
        fs, home = self._fs(), self._home(name, key)
        aside, pointer = f"{home}/CURRENT-{uuid.uuid4().hex}", f"{home}/CURRENT"
        stream = fs.create(self._path(aside), False)
        stream.write(bytearray(data.rsplit("/", 1)[1].encode()))
        stream.close()
        if self._exists(pointer) and self.current(name, key) is None:
            fs.delete(self._path(pointer), False)  # names data that are gone
        if not fs.rename(self._path(aside), self._path(pointer)):
            fs.delete(self._path(aside), False)  # another writer was first
        kept = self.current(name, key)
        if kept is None:
            raise OSError(f"snapshot {home} could not be published")
        if kept != data:
            fs.delete(self._path(data), True)
        return kept

    def get(self, name: str, build: Callable[[], DataFrame], inputs: list[DataFrame], params: dict | None = None,
            source: str | None = None, code: str | None = None,
            write: Callable[[DataFrame, str], None] | None = None,
            read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
        """The snapshot of ``build()``, made now if there is none. ``inputs``
        are the tables it reads (their files are the source version, unless
        ``source`` gives one), ``write`` lays the rows out and ``read`` reads them (default: Parquet)."""
        source = source if source is not None else source_version(self.spark, *inputs)
        key = snapshot_key(name, params or {}, source, code_version() if code is None else code)
        data = self.current(name, key)
        if data is None:
            data = f"{self._home(name, key)}/data-{uuid.uuid4().hex}"
            (write or (lambda df, path: df.write.parquet(path)))(build(), data)
            data = self._publish(name, key, data)
        return read(self.spark, data) if read else self.spark.read.parquet(data)

    def vacuum(self, older_than_seconds: float = 7 * 86400) -> list[str]:
        """Remove what no snapshot needs and no writer or reader can still use:
        data folders and asides that ``CURRENT`` does not name, and snapshots
        whose latest data are older than the bound. Returns the paths."""
        fs, gone = self._fs(), []
        before = (time.time() - older_than_seconds) * 1000
        if not self._exists(self.root):
            return gone
        for home in fs.listStatus(self._path(self.root)):
            parts = list(fs.listStatus(home.getPath()))
            name, _, key = home.getPath().getName().rpartition("-")
            live = self.current(name, key)
            for part in parts:
                at, file = part.getPath(), part.getPath().getName()
                if part.getModificationTime() < before and file != "CURRENT" and (live is None or file != live.rsplit("/", 1)[1]):
                    fs.delete(at, True)
                    gone.append(at.toString())
            if parts and all(p.getModificationTime() < before for p in parts):
                fs.delete(home.getPath(), True)
                gone.append(home.getPath().toString())
        return gone
