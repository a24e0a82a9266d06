"""Small helpers that several operators share."""

import gc
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Longer lists hold no objects of this package.
FEW = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; one of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        kept = sc._jsc.sc().getCheckpointDir()
        folder = kept.get() if kept.isDefined() else tempfile.mkdtemp(prefix="umbral-work-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut in the work folder. What came before it is given back where it fills the driver."""
    work_folder(df.sparkSession)
    kept = df.checkpoint(eager)
    give_back(df.sparkSession, FULL)
    return kept


#: Of the driver's heap, the share beyond which garbage goes, and the percentage that may stay free then.
FULL, FREE = 0.4, 40


def give_back(spark: SparkSession, full: float = 0.0) -> None:
    """Collects the driver's garbage where its heap takes more than the share `full` of what it may take, and lets the heap shrink to about what is in use.

    Plans and compiled code of queries that have ended are garbage. Else the heap grows to its limit, be there ever so little in
    it, beside all that the driver holds outside of it. Of a JVM without such a limit the garbage is collected only.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= full * runtime.maxMemory():
        return
    try:
        factory = jvm.java.lang.management.ManagementFactory
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        bean = factory.newPlatformMXBeanProxy(factory.getPlatformMBeanServer(), "com.sun.management:type=HotSpotDiagnostic", kind)
        if int(bean.getVMOption("MaxHeapFreeRatio").getValue()) > FREE:
            bean.setVMOption("MaxHeapFreeRatio", str(FREE))
    except Py4JError:
        pass
    gc.collect()
    jvm.System.gc()


#: Rows of an Arrow batch, where the session does not say otherwise: texts are wide, and a batch of 10 000 long ones fills a worker.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Sets, where the session does not say otherwise, BATCH_ROWS as rows of an Arrow batch, and that a query's shuffle files go when it ends.

    Else shuffles before a checkpoint, which nothing reads any more, stay on disk until the driver collects garbage. A
    stage that should need them again makes them again. What earlier stages left in the driver, plans and
    compiled code most of all, is given back first.
    """
    give_back(spark)
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def plain(value):
    """value with each object of this package as (its class's name, its attributes): a broadcast that needs no package to be read."""
    if type(value).__module__.startswith(__package__):
        return {"__class": type(value).__name__, "__state": plain(vars(value))}
    if isinstance(value, dict) and len(value) <= FEW:
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple) and len(value) <= FEW:
        return type(value)(map(plain, value))
    return value


def rebuilt(value, *classes: type):
    """The value that plain() took apart; the classes travel with the function that calls this."""
    if isinstance(value, dict) and "__class" in value:
        kind = next(c for c in classes if c.__name__ == value["__class"])
        made = kind.__new__(kind)
        made.__dict__.update(rebuilt(value["__state"], *classes))
        return made
    if isinstance(value, dict) and len(value) <= FEW:
        return {k: rebuilt(v, *classes) for k, v in value.items()}
    if isinstance(value, list | tuple) and len(value) <= FEW:
        return type(value)(rebuilt(v, *classes) for v in value)
    return value
