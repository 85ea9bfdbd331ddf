"""The method dealt for suffix dedup, prefix doubling, over all byte positions, and the bytes that it shuffles.

python tests/llm/doubling_attempt.py [table folder] prints a line a round. The library doesn't use this: see the README.
"""

import json
import os
import sys
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"

from verdict_lake.llm.rolling import BASE, U, scattered  # noqa: E402
from verdict_lake.llm.store import stored  # noqa: E402

FIRST = 25


def first_names(batches):
    """doc_id, at and a 64-bit name of the FIRST bytes from each position."""
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = np.frombuffer((text or "").encode(), dtype=np.uint8).astype(U)
            n = len(data) - FIRST + 1
            if n > 0:
                names = np.zeros(n, U)
                for k in range(FIRST):
                    names = names * U(BASE) + scattered(data[k : k + n] + U(1))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(np.arange(n)), pa.array(names.view(np.int64))], ["doc_id", "at", "name"])


def renamed(pairs: DataFrame) -> DataFrame:
    """Positions sorted by their pairs of ranks get new ranks; those whose pair is unique leave."""
    same = Window.partitionBy("name", "following")
    many = pairs.withColumn("n", F.count("*").over(same)).filter("n > 1")
    return many.select("doc_id", "at", F.xxhash64("name", "following").alias("name"))


def doubling(docs: DataFrame, length: int = 400):
    """After each round: the length that names stand for, and doc_id, at, name of the positions that are left."""
    names = docs.select("doc_id", "text").mapInArrow(first_names, "doc_id long, at long, name long")
    live = stored(renamed(names.withColumn("following", F.lit(0).cast("long"))))
    at = FIRST
    while True:
        yield at, live
        if at >= length:
            return
        step = min(at, length - at)
        later = live.select("doc_id", (F.col("at") - step).alias("at"), F.col("name").alias("following"))
        live = stored(renamed(live.join(later, ["doc_id", "at"])))
        at += step


def shuffled(folder: str) -> int:
    total = 0
    for path in Path(folder).rglob("*"):
        if path.is_file():
            for line in path.open(errors="replace"):
                if '"SparkListenerTaskEnd"' in line:
                    total += (json.loads(line).get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    return total


def main(folder: str) -> None:
    from verdict_lake.session import builder

    work = tempfile.mkdtemp(prefix="spark-doubling-")
    os.mkdir(f"{work}/events")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{work}/events", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false", "spark.checkpoint.dir": f"{work}/c", "spark.local.dir": f"{work}/l", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    spark = builder("doubling").master("local[4]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for length, live in doubling(docs):
        left = live.count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        print(f"{length} bytes: {left / size:.1%} of {size} positions left, {shuffled(work + '/events') / size:.1f} bytes shuffled a byte of text so far", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
