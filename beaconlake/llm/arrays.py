"""Helpers that the operators share: Arrow rows, and column names that cannot clash."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def texts_of(batch, name="text") -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.binary()).to_pylist()]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(df: DataFrame, rows=1024) -> DataFrame:
    """The table, in a session whose Arrow batches hold at most `rows` rows. Rows carry whole texts
    here, and the usual 10,000 of them fill both sides of the pipe to Python. Results don't
    depend on it, and a smaller setting stays."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH, "10000")) > rows:
        conf.set(BATCH, str(rows))
    return df


def parts(batches, rows=1024):
    """The batches in pieces of bounded size: what Python holds of the texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def rows_of(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of [start, start + size) of every row, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def plain(docs: DataFrame) -> tuple[DataFrame, dict]:
    """The table with its columns called c0, c1, ... and the new name of each, so that columns an
    operator adds on the way cannot clash. `toDF(*names)` undoes it."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {c: f"c{i}" for i, c in enumerate(docs.columns)}
