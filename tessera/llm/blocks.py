"""Documents in compressed blocks: one row holds some thousand documents, so what must meet all of them again moves few bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.durable import settled
from tessera.llm.textkit import buffers, released

#: A block closes at so many bytes of text; one longer text is a block by itself.
BLOCK_BYTES = 8 << 20


def frozen(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def thawed(data: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def blocks(docs: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """(block, n_bytes, docs binary), settled in the shared folder. docs holds all columns of some rows in their order; block is unique."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, used = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> pa.RecordBatch:
            data = frozen(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([used]), pa.array([data], pa.binary())], ["block", "n_bytes", "docs"])

        for batch in batches:
            offsets = buffers(batch.column(batch.schema.get_field_index(text)))[1]
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size - used, "right")) - 1)
                end = min(end, batch.num_rows)
                held.append(batch.slice(row, end - row))
                used += int(offsets[end] - offsets[row])
                row = end
                if used >= size or row < batch.num_rows:
                    yield closed()
                    number, held, used = number + 1, [], 0
        if held:
            yield closed()
        released()

    return settled(docs.mapInArrow(work, "block long, n_bytes long, docs binary"))
