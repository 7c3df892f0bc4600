"""Token counts of whole texts; huge texts by overlapping windows that are spliced where they agree."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import OVERLAP_CHARS, WINDOW_CHARS, encoder
from lectern.llm.common import batch, blocks, map_arrow, texts

#: Bytes of text that a Python worker handles at once.
BLOCK_BYTES = 2 << 20


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is a ``.json`` file of the tokenizers library or a ``.model`` file of sentencepiece.
    Byte-level BPE texts of more than ``window`` characters are encoded in windows that overlap and
    are spliced at proven boundaries (:meth:`Encoder.resync`); other kinds of tokenizer have no
    boundary that is stable in any context, so their texts are encoded whole. Null texts count as
    empty: 0 bytes, 0 tokens. A null id stays null, repeated rows give repeated rows, an empty input
    gives none, and other columns are ignored. Nothing is shuffled.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES):
            words = b.column(1).to_pylist()
            if tokenizer.endswith(".model"):
                n = np.array([len(x) for x in _pieces(tokenizer).encode(words, num_threads=1)], np.int64)
            else:
                enc = encoder(tokenizer)
                huge = {i: len(enc.resync(w, window, overlap)) for i, w in enumerate(words) if enc.pieces and len(w) > window}
                _, n = enc.encode_block(["" if i in huge else w for i, w in enumerate(words)])
                for i, k in huge.items():
                    n[i] = k
            yield batch(doc_id=b.column(0), n_bytes=b.column(2), n_tokens=pa.array(n))

    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = map_arrow(rows, count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
