"""Index workbook files as they appear in a folder.

The scan of ``plans.scan`` over again, fed by the file source: every
micro-batch of new files is parsed and upserted like a scanned tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.upsert import EstateStore
from quire.plans.scan import scan_files
from quire.session import ship_package
from quire.sources.workbooks import with_file_facts

_FILE = "path string, modificationTime timestamp, length long, content binary"


def index_new_files(
    spark: SparkSession, root: str, store: EstateStore, checkpoint: str,
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Upsert the workbook files below ``root`` that have not been seen yet, then stop.

    ``checkpoint`` (a shared folder) remembers the files done. A batch that is
    repeated after a failure replaces its own rows, so nothing is counted twice.
    """
    ship_package(spark)
    files = (
        spark.readStream.format("binaryFile").schema(_FILE)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .filter(F.lower("path").rlike(r"\.twbx?$"))
    )

    def index(batch: DataFrame, _batch_id: int) -> None:
        scan_files(with_file_facts(batch), store)

    return (
        files.writeStream.foreachBatch(index)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
