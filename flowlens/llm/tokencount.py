"""Token counts: lengths of encodings only, in Arrow batches balanced by bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.common import ENCODE_BYTES, chunks, text_rows, texts_of
from flowlens.llm.vocab import count_all, default_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each input row, without a shuffle.

    Texts are split at safe places, so a very long one is encoded in small units; the unknown units of about 2 MB of
    texts go to the tokenizer together, and only lengths are kept. Special strings inside texts are handled as the
    library does by default. A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are
    counted each; other columns are left aside; an empty table gives an empty one.
    """
    path = vocabulary or default_path("word_bpe_49k.json")

    def count(batches):
        for batch in batches:
            texts = texts_of(batch)
            sizes = [len(x) for x in texts]
            lengths = []
            for a, b in chunks(texts, ENCODE_BYTES):
                lengths += count_all(texts[a:b], path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array([n > limit for n in lengths], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_rows(docs, id_col, text_col).mapInArrow(count, SCHEMA)
