"""What the operators share: the shared work folder, staged tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python pattern of a white-space separated word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir; where none is named, below a local
    one if driver and executors are one process, else an error, as other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "corvane-shared")
    return f"{base}/corvane-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputing."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            delete(df.sparkSession, folder.rsplit("/", 1)[0])


_KEPT: dict[str, object] = {}


def trim() -> None:
    """Give memory that a Python worker has freed back to the machine: allocators keep it, and an executor has several
    workers beside its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> str:
    """Give memory that the driver's JVM has freed outside its heap back to the machine, as jcmd's System.trim_native_heap does:
    each of the threads that plan, compile and broadcast many small jobs leaves some in its allocator. Returns what the JVM
    says; nothing where it lacks the command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    given = gateway.new_array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = gateway.new_array(jvm.Object, 1), gateway.new_array(jvm.String, 1)
    given[2][0], given[3][0] = gateway.new_array(jvm.String, 0), "[Ljava.lang.String;"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    try:
        return str(call.invoke(server, given))
    except Py4JError:
        return ""


def collect_garbage(spark: SparkSession) -> None:
    """Broadcasts and shuffles of ended jobs are dropped by Spark's cleaner only after the driver's JVM has collected its heap,
    by default every half hour. After many small jobs, or a large result, have it collected now; give what the JVM and Python
    have freed outside it back too."""
    spark._jvm.System.gc()
    trim_driver(spark)
    trim()


def forget() -> None:
    """For tasks that need nothing kept: free what an earlier operator left in this worker."""
    _KEPT.clear()
    trim()


def kept(key: str, make: Callable[[], object]):
    """What a Python worker keeps for its next tasks: the last large thing alone, so that an operator's model or memo does
    not stay beside the next operator's."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def words_of(text: Column | str) -> Column:
    """Number of white-space separated words; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bytes_of(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, most: int = 4 << 20) -> DataFrame:
    """mapInArrow with a function that is made once a task and turns a batch into columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, most):
                got = f(part)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) if not isinstance(got[x.name], pa.Array) else got[x.name].cast(x.type) for x in out], schema=out)
        trim()

    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 4000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")  # texts are long; batches are held twice
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes; a longer row stands alone."""
    n = batch.num_rows
    if n < 2 or batch.nbytes <= most:
        if n:
            yield batch
        return
    half = n // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like this one that is not taken."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name
