"""SHA-256 of texts too long for one row."""
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from beaconlake.llm.arrays import parts


def of_pieces(pieces: DataFrame, key: list[str], order: list[str], text: str, between: bytes, out: str) -> DataFrame:
    """(key as _key..., `out`): the hash of a key's pieces in their order, joined by `between`. Spark sorts
    the pieces; a task reads them one after another and holds one at a time. A hash is sequential, so the
    pieces of one key are read by one task."""
    types = dict(pieces.dtypes)
    names = [f"_{k}" for k in key] + [out]

    def digests(batches):
        last, running = None, None
        for batch in parts(batches):
            done = []
            for *own, piece in zip(*[batch.column(c).to_pylist() for c in key], batch.column(text).cast(pa.binary()).to_pylist()):
                if own != last:
                    if last is not None:
                        done.append((*last, running.hexdigest()))
                    last, running = own, hashlib.sha256(piece)
                else:
                    running.update(between)
                    running.update(piece)
            yield table(done)
        if last is not None:
            yield table([(*last, running.hexdigest())])

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == out else pa.int64()) for c, n in zip([list(c) for c in zip(*done)] or [[]] * len(names), names)], names=names)
    assert all(types[k] == "bigint" for k in key)
    sorted_pieces = pieces.select(*key, *order, text).repartition(*key).sortWithinPartitions(*key, *order)
    return sorted_pieces.mapInArrow(digests, ", ".join(f"{n} {'string' if n == out else 'bigint'}" for n in names))
