import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import common
from tidewater.llm import common as C


def test_batches_by_bytes():
    texts = ["a" * n for n in (0, 5, 100, 1, 1, 300, 2)] + [None, "é" * 30]
    for cuts in ([9], [1] * 9, [3, 0, 6], [0], []):
        at = np.r_[0, np.cumsum(cuts)].astype(int)
        batches = [pa.RecordBatch.from_arrays([pa.array(range(i, j), pa.int64()), pa.array(texts[i:j], pa.string())], ["id", "text"]) for i, j in zip(at[:-1], at[1:])]
        out = list(common.in_bytes(batches, "text", 110))
        rows = [r for b in out for r in b.to_pylist()]
        assert rows == [{"id": i, "text": t} for i, t in enumerate(texts[: sum(cuts)])]
        for b in out:
            assert b.num_rows <= 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 110


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return self

        def get(self, key):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    Context.get = lambda self, key, default=None: None
    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_sizes_with_units(spark):
    assert [C.setting_bytes(x) for x in ("64m", "2KB", "1048576", "1gb", "-1", " 3 k ", "5b")] == [64 << 20, 2048, 1 << 20, 1 << 30, -1, 3072, 5]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        C.small_batches(spark)
        assert C.setting_bytes(spark.conf.get(key)) == C.BATCH_BYTES
        spark.conf.set(key, "1k")
        C.small_batches(spark)
        assert spark.conf.get(key) == "1k"
    finally:
        spark.conf.set(key, before)
