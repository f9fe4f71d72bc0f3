import tempfile

import pytest

from rasterweave import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        master="local[8]",
        spark_sql_shuffle_partitions="8",
        spark_driver_memory="8g",
        spark_checkpoint_dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        spark_sql_streaming_stateStore_providerClass=(
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
