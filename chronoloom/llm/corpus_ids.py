"""Ids of every text of a corpus; see ``bpe`` for the transducer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoloom.llm import bpe
from chronoloom.operators.readings import spread


def encode_corpus(documents: DataFrame, vocabulary_path: str = bpe.DEFAULT_PATH) -> DataFrame:
    """doc_id and ids of every row, repeated rows included; null and empty texts have an empty list. Nothing is shuffled, unless the input has fewer splits than cores.

    The vocabulary file must lie at the path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encoder.encode(text) for text in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.concatenate(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")
