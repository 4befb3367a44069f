from __future__ import annotations

import pyarrow as pa

from plumbline.llm.common import batched_texts


def test_batches_are_bounded_by_rows_and_bytes():
    texts = ["a" * n for n in (3, 0, 40, 1, 1, 9, 9, 2)] + [None, "é" * 3]
    batch = pa.RecordBatch.from_pydict({"text": texts, "i": list(range(10))})
    cut = [b.column("i").to_pylist() for b in batched_texts([batch, batch.slice(0, 0), batch.slice(9)], rows=3, size=10)]
    assert cut == [[0, 1], [2], [3, 4], [5], [6], [7, 8, 9], [9]]
    assert [b.num_rows for b in batched_texts([batch])] == [10]
