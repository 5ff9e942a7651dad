"""Token counts of whole texts by compiled transducers (see transducer.py).

Rows: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids are kept as they
are; extra columns are ignored; long texts are run in parts that end between pretokens.  No shuffle is
needed, and a worker's memory holds one batch and a bounded number of the pretokens that it has met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenspark.llm.common import map_batches, only
from lumenspark.llm.textbytes import utf8
from lumenspark.llm.transducer import batches_of_texts, encoder


def _count(path: str, limit: int):
    def run(batches):
        machine = encoder(path)
        for batch in batches:
            text = batch.column("text")
            n_bytes = np.diff(utf8(text)[1])
            tokens = [machine.counts(some) for some in batches_of_texts(text)]
            n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit); tokenizer: a tokenizer file with the same path everywhere."""
    return map_batches(only(docs, "doc_id", "text"), _count(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
