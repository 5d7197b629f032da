"""Tables kept between sessions: written once for their inputs and model, found again, replaced
when either changes."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.forest import TreeEnsemble
from riskloom.session import kept_folder


def files_fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the names, lengths and times of change of all files below the paths. The
    files are listed, not read, and summed up where they are listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    each = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(each), F.sum(F.pmod(each, F.lit(1 << 40)))).first()
    return hashlib.sha256(json.dumps(list(row)).encode()).hexdigest()


def model_fingerprint(ensemble: TreeEnsemble) -> str:
    h = hashlib.sha256(json.dumps(ensemble.features).encode())
    for tree in ensemble.trees:
        for part in (tree.feature, tree.threshold, tree.left, tree.right, tree.cover, tree.value):
            h.update(part.tobytes())
    return h.hexdigest()


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, name: str) -> list[str]:
    """Keys of the whole versions kept under a name."""
    folder = f"{kept_folder(spark)}/{name}"
    fs = _file_system(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]
    return sorted(k for k in found if not k.startswith("_"))


def keep_table(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table kept under (name, key), and whether it was there already. Otherwise it is built,
    written beside its place and moved there when whole, so that a lost session leaves no half
    of it; versions under other keys go."""
    folder = f"{kept_folder(spark)}/{name}"
    place, fs = f"{folder}/{key}", _file_system(spark, folder)
    reused = fs.exists(_path(spark, place))
    if not reused:
        draft = f"{folder}/_{uuid.uuid4().hex}"
        build().write.parquet(draft)
        if not fs.rename(_path(spark, draft), _path(spark, place)):
            fs.delete(_path(spark, draft), True)  # another session was first
        for other in versions(spark, name):
            if other != key:
                fs.delete(_path(spark, f"{folder}/{other}"), True)
    return spark.read.parquet(place), reused


def keep_scored(spark: SparkSession, name: str, sources: Sequence[str], ensemble: TreeEnsemble, score: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A scored table kept for its source files and its model."""
    key = hashlib.sha256((files_fingerprint(spark, sources) + model_fingerprint(ensemble)).encode()).hexdigest()[:32]
    return keep_table(spark, name, key, score)
