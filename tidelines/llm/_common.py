"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Executors get the code of these operators inside the task, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Largest file that is shipped to every executor (vocabularies, model weights).
MAX_SHIPPED_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only where all run on one machine may it be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/tidelines-shared"
    return f"{base.rstrip('/')}/tidelines"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: it outlives any executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*written: DataFrame) -> None:
    """Remove the tables that materialize() wrote for these; nothing may read them any more."""
    for df in written:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 2)[-2] == "tidelines":
                jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)


def read_vocabulary(path: str) -> bytes:
    """A tokenizer's file, read once on the driver; its size is checked because every executor gets a copy."""
    with open(path, "rb") as f:
        data = f.read(MAX_SHIPPED_BYTES + 1)
    if len(data) > MAX_SHIPPED_BYTES:
        raise ValueError(f"{path} is larger than {MAX_SHIPPED_BYTES} bytes and can't be shipped to every executor")
    return data


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold at most a few MB of long texts, where the session doesn't say otherwise."""
    said = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        if key not in said:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return this process's freed memory to the system, which the allocators keep otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def clean_driver(spark: SparkSession) -> None:
    """Drop what former stages left on the driver: Spark removes broadcasts and shuffles once their handles are collected."""
    give_back()
    spark._jvm.System.gc()


def worker_state(key: str, make):
    """Something that one Python worker keeps between its tasks (a parsed vocabulary, a word cache).

    Workers outlive stages. A new state makes room: states of other operators (by the key up to the first hyphen) that this stage
    hasn't used go, and of all others only the one used last and those of this stage stay.
    """
    import sys as _sys

    from pyspark import TaskContext

    context = TaskContext.get()
    stage = context.stageId() if context else None
    states = _sys.__dict__.setdefault("_tidelines_states", {})
    if key in states:
        value = states.pop(key)[1]
    else:
        family = key.partition("-")[0]
        idle = [k for k, (used, _) in states.items() if used != stage or stage is None]
        kept = [k for k in idle if k.partition("-")[0] == family][-1:]
        for k in idle:
            if k not in kept:
                del states[k]
        if len(kept) < len(idle):
            give_back()
        value = make()
    states[key] = (stage, value)
    return value


def memo(make, size: int, longest: int):
    """A dict that makes missing values for keys up to `longest` long; of two generations of `size` entries the older goes."""

    class Memo(dict):
        old: dict = {}

        def __missing__(self, key):
            if (value := self.old.get(key)) is None:
                value = make(key)
            if len(key) <= longest:
                if len(self) >= size:
                    self.old = dict(self)
                    self.clear()
                self[key] = value
            return value

    return Memo()
