"""Token counts: encode in Arrow batches, hand back lengths only.

A batch holds about ``batch_bytes`` of text whatever the number of rows, and a text longer than
``split_chars`` is cut at safe boundaries, so that one very long document neither makes one huge
call nor holds up the rows beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No piece of such a vocabulary has a space mark after another character, and normalisation maps
#: these characters to themselves; so no piece crosses this place, and the part after the space,
#: encoded alone, gets the same mark in front.
SAFE = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")


def split_safely(text: str, limit: int) -> list[str]:
    """Parts of at most about ``limit`` characters whose token counts add up to the text's. Where no
    safe boundary follows, a part is longer."""
    parts, start = [], 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit - 1)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


def counter(model_path: str, batch_bytes: int, split_chars: int):
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        for column in columns:
            totals = np.zeros(len(column), dtype=np.int64)
            held: list[str] = []
            rows: list[int] = []
            size = 0

            def flush() -> None:
                lengths = [len(ids) for ids in model.encode(held, num_threads=1)]
                np.add.at(totals, rows, lengths)
                held.clear()
                rows.clear()

            for row, value in enumerate(column):
                text = value.as_py()
                if not text:
                    continue
                for part in split_safely(text, split_chars):
                    held.append(part)
                    rows.append(row)
                    size += len(part) if part.isascii() else len(part.encode())
                    if size >= batch_bytes:
                        flush()
                        size = 0
            if held:
                flush()
                size = 0
            yield pa.array(totals)

    return count


def token_counts(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    batch_bytes: int = 1 << 18,
    split_chars: int = 1 << 15,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens; repeated rows and null ids stay as they are;
    an empty table gives an empty result. Further columns are not read.
    """
    counts = F.arrow_udf(counter(model_path, batch_bytes, split_chars), "long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counts("text").alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
