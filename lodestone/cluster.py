"""Makes the package importable on executors that were not started with it on their path."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of texts go to Python workers in batches of so many bytes at most, on both sides, whatever the length of a text.
BATCH_BYTES = 4 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Only a local master, whose executors are the driver, may do without: it gets a temporary folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and context.master.startswith("local"):
        found = f"{tempfile.gettempdir()}/lodestone-checkpoints"
    if not found:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own."""
    if spark.conf.get(_LIMIT) == _DEFAULT:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application, and bound what goes to Python at a time."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = Path(tempfile.mkdtemp(prefix="lodestone-"))
    (folder / "lodestone.zip").write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(folder / "lodestone.zip"))
    _shipped.add(app)
