"""Small planning helpers shared by the operators."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Row bound under which a dimension table is hinted for broadcast.
BROADCAST_MAX_ROWS = 1_000_000
# Training rows of one task where many passes follow: at least, at most.
LEAST_TASK_ROWS = 1_000
MOST_TASK_ROWS = 100_000


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint ``df`` for broadcast only after counting it under ``max_rows``.

    Used for small sides that are already materialized (counting them is a
    cheap scan). Small sides that come out of an aggregation are left to
    AQE, which measures the shuffle stage and switches to a broadcast join
    (reading the large side locally, so a hot key is not gathered in one
    task). Beyond the bound the planner decides.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage (reliable checkpoint).

    Used at the points where a result is read by several later steps
    (corpora, models, scored pairs). The data goes to the shared folder
    named by ``spark.checkpoint.dir``, so it survives the loss of an
    executor; a scratch folder is used only when the setting is unset.
    """
    from parlance.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores, where there are enough of them.

    For small rows that many passes compute on: AQE sizes partitions by bytes
    and leaves most cores without rows. ``df`` is counted, so it should be cheap
    to read. Few rows stay as they are.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(min(cores, rows // LEAST_TASK_ROWS), rows // MOST_TASK_ROWS)
    return df.repartition(n) if n > 1 else df


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per context, so that
    tasks can import it wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_parlance_code", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(d, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="parlance-code-"), "parlance_code.zip")
    with open(path, "wb") as out:
        out.write(buf.getvalue())
    sc.addPyFile(path)
    sc._parlance_code = True
