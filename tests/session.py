from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def make_session(name: str = "tests") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]").appName(name)
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="defectlake-tests-"))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
