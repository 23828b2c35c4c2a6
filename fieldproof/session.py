"""Session set-up: how the package reaches the executors, and where they share intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Settings as (name, Spark's own default, ours). Two suit rows with long texts: bytes of a batch that a Python worker gets at once,
#: and rows that a Parquet reader holds at once. By the third the last of equal keys of a JSON object wins, and is no error.
SETTINGS = (
    ("spark.sql.variant.allowDuplicateKeys", "false", "true"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"),
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"),
)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, as --py-files would. SETTINGS that the session has
    left at Spark's defaults get ours, for the rest of the session; any other value stays."""
    context = spark.sparkContext
    for name, default, ours in SETTINGS:
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="fieldproof-")) / "fieldproof.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(x for x in root.rglob("*") if x.suffix in (".py", ".txt")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where the session names none, executors that
    run inside this process get a folder of their own; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "<undefined>")
    if named != "<undefined>":
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="fieldproof-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def on_files(path: str) -> str | None:
    """``path`` as a path of a file system that Python opens, or null for another store."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def made_folder(spark: SparkSession, path: str) -> None:
    """Make a folder, unless it is there."""
    place, files = _place(spark, path)
    files.mkdirs(place)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


#: Row groups of intermediate tables: a task holds one while it writes and one while it reads, so they are small, also
#: where a row holds an array of a megabyte.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later jobs never recompute it and the loss of an
    executor loses nothing. It goes when the application ends, or earlier by ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**ROW_GROUPS).parquet(path)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and nothing reads any more."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            place, files = _place(table.sparkSession, path)
            files.delete(place, True)
