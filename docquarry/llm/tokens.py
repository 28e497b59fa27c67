"""Token ids of whole documents, and texts from token ids."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docquarry.llm.bpe import transducer

#: Bytes of text that a task looks at together, so that memory follows the longest text only. Arrays of
#: words and vectors take some hundred bytes for each of them.
BATCH_CHARS = 1 << 18


def release_memory() -> None:
    """Give freed memory back to the system: workers are reused, and keep what earlier stages took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text", values: bool = True) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with about BATCH_CHARS bytes of text each, and their texts if ``values``."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + BATCH_CHARS, "right")))
            part = batch.slice(start, end - start)
            yield part, part.column(batch.schema.get_field_index(column)).to_pylist() if values else []
            start = end
        del texts, batch
        release_memory()


def tokenize(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Encode every whole text and decode it again.

    ``documents(doc_id, text)`` -> ``doc_id``, ``token_ids`` (array<int>), ``decoded``.
    ``tokenizer`` is the path of a tokenizer file on every executor. Special tokens are
    recognised in texts but not added. A text passes a transducer whose lookahead follows
    from the merge list; no shuffle, and a task holds about a quarter of a megabyte of text at a time,
    or one longer document.

    NULL and empty texts have no ids and decode to the empty text. NULL ids and repeated
    rows stay as they are, other columns are ignored.
    """

    def run(batches):
        machine = transducer(tokenizer)
        for part, texts in text_batches(batches):
            ids = machine.encode_batch(texts)
            offsets, flat = np.concatenate([[0], np.cumsum([len(i) for i in ids])]), np.concatenate(ids)
            data, bounds = machine.decoder.texts(flat, offsets)
            decoded = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded.cast(pa.string())], ["doc_id", "token_ids", "decoded"])

    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id bigint, token_ids array<int>, decoded string")
