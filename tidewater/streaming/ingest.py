"""Price files as a stream: each file is loaded once, by a query that keeps in its checkpoint what it has read.

Spark finds the files and remembers them; a micro-batch is parsed as a table of lines, its good rows are upserted into a committed table (see
sources.versions) and its files into a table of loads. A bad file fails alone. A batch that is cut off runs again, and both tables
take it as they would the first time: a row's key, and a file's name, is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators import upsert as U
from tidewater.sources import versions
from tidewater.sources.raw import loaded_files, parsed_lines
from tidewater.sources.shared import new_path, remove

#: What names an observation, and the columns of the table of loads.
KEY = ["ServiceStationName", "Address", "FuelCode", "PriceUpdatedDate"]
LOADS = "source_file string, status string, records_read long, records_rejected long, error string, loaded_at timestamp"


def load_batch(lines: DataFrame, prices: str, loads: str, root: str) -> None:
    """Upsert the lines (source_file, value) of one batch into the two tables. Of a key that comes twice, the row of the file that is last by name counts."""
    spark, path = lines.sparkSession, new_path(lines.sparkSession, "parsed")
    try:
        rows, files = parsed_lines(lines)
        rows.write.parquet(path)  # parsed once: a filter on what is parsed would be moved before the parsing, and parse anew for each of its terms
        rows = spark.read.schema(rows.schema).parquet(path)
        good = U.latest_row(rows.where("_corrupt_record is null").drop("_corrupt_record"), KEY, "source_file")
        new = loaded_files(rows, files).withColumn("loaded_at", F.current_timestamp())
        for name, df, key in ((prices, good, KEY), (loads, new, ["source_file"])):
            versions.commit(U.upsert(versions.table(spark, name), df, key) if spark.catalog.tableExists(name) else df, name, root)
    finally:
        remove(spark, path)


def load_files(spark: SparkSession, path: str, checkpoint: str, prices: str, loads: str, root: str, files_a_batch: int = 1000) -> StreamingQuery:
    """A query that loads the files of path that it hasn't loaded yet, so many at a time, and ends. prices and loads: database.table, made if they aren't there."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path).select(F.col("_metadata.file_path").alias("source_file"), "value")
    writer = lines.writeStream.foreachBatch(lambda batch, _: load_batch(batch, prices, loads, root))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
