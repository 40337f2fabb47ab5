"""Incremental ingest: files as a stream, every signature once, and only what isn't done yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(folder)


def ingest_once(stream: DataFrame, signature: Column, out: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Each signature goes in once, whatever the files, the size of the batches and the number
    of runs, with one checkpoint or with new ones.

    Rows and ledger lie under the run (the stream's id, which its checkpoint keeps) and the batch.
    A batch's rows whose signature any other run or batch has are left out, so a batch that runs
    twice writes the same place again, and batch numbers that start anew overwrite nothing. Runs
    that share a ledger come one after the other."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = batch.withColumn("signature", signature).dropDuplicates(["signature"])
        try:
            done = spark.read.parquet(ledger).where((F.col("run") != run) | (F.col("batch") != number)).select("signature")
            rows = rows.join(done, "signature", "left_anti")
        except Exception as e:  # the first batch has no ledger yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        rows.persist()
        rows.write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")
        rows.select("signature").write.mode("overwrite").parquet(f"{ledger}/run={run}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_new(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """What arrived since the last run, then stop."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no finished record."""
    return todo.join(done.select(key), key, "left_anti")


def guarded(f, schema, seconds: float):
    """An Arrow function for mapInArrow in which a row that takes too long or fails yields its
    error instead of ending the task; `f` takes a row's dict and returns one of `schema`.

    Rows run in a process of their own, one after another. One that takes more than `seconds` is
    killed with its process, and the next row gets a new one; so it holds up nothing else."""
    import multiprocessing

    import pyarrow as pa

    def serve(link) -> None:
        while True:
            try:
                row = link.recv()
            except EOFError:
                return
            try:
                link.send((f(row), None))
            except Exception as e:  # noqa: BLE001  the row's own failure is its result
                link.send((None, type(e).__name__))

    def run(it):
        context, process, link = multiprocessing.get_context("fork"), None, None
        try:
            for b in it:
                out = []
                for row in b.to_pylist():
                    if process is None:
                        link, far = context.Pipe()
                        process = context.Process(target=serve, args=(far,), daemon=True)
                        process.start()
                        far.close()
                    found, error = None, "TimeoutError"
                    try:
                        link.send(row)
                        if link.poll(seconds):
                            found, error = link.recv()
                    except (EOFError, OSError):  # the process itself has died
                        error = "ProcessDied"
                    if error in ("TimeoutError", "ProcessDied"):
                        process.kill()
                        process.join()
                        link.close()
                        process = None
                    out.append({n: row.get(n) for n in schema.names} | {"error": error} if found is None else found | {"error": None})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        finally:
            if process is not None:
                process.kill()
                process.join()

    return run
