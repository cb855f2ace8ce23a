"""Token counts of a document's sections from one encoding of the whole document.

A text is encoded once, with the characters that each token covers. Token spans and section
spans, both in order, are joined as intervals. A token that lies in several sections counts
for the one that holds most of its characters, and of equals for the earliest; a token of
part of a character counts where that character lies.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.chunks import column, small_batches
from tidewire.llm.common import text_or_empty
from tidewire.llm.packing import chunk_table


@lru_cache(maxsize=2)
def byte_lengths(tokenizer: str) -> np.ndarray:
    """Bytes of each token; byte-level vocabularies write one character per byte."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab()
    lengths = np.zeros(max(vocabulary.values()) + 1, "int64")
    lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]
    return lengths


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(start, end) in characters of a text's tokens, from their bytes. A token of part of a character spans it whole."""
    ends = lengths[ids].cumsum()
    starts = ends - lengths[ids]
    if not text.isascii():
        raw = np.frombuffer(text.encode(), "uint8")
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts, ends = char[starts], char[ends - 1] + 1
    return np.stack([starts, ends], axis=1)


def attribute(spans: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and those of them that reach beyond it. Sections begin at ``starts``, the first at 0, and cover the text."""
    first = np.searchsorted(starts, spans[:, 0], "right") - 1
    last = np.maximum(np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1, first)
    owner = first.copy()
    ends = np.append(starts[1:], length)
    for t in np.flatnonzero(last > first):
        s = np.arange(first[t], last[t] + 1)
        owner[t] = s[np.argmax(np.minimum(ends[s], spans[t, 1]) - np.maximum(starts[s], spans[t, 0]))]
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[last > first], minlength=n)


def section_tokens(docs: DataFrame, tokenizer: str, sections: str | None = None) -> DataFrame:
    """doc_id, section, start, length, n_tokens, n_crossing: one row per section of every whole text.

    ``sections`` names a column of ascending section starts (array of int, in characters); the
    first section begins at 0 in any case, starts outside the text or out of order are left
    out. Without it the sections are the lines, each with the line break that ends it. The
    tokens of a document's sections add up to those of the document.

    Null text counts as empty: one section, no tokens. Null starts mean one section. Repeated
    rows and null doc_ids come through one by one. An empty table gives no rows. Other columns
    are ignored.
    """

    def starts_of(text: str, own: list[int] | None) -> np.ndarray:
        if sections is None:
            size = np.fromiter(map(len, text.split("\n")), "int64") + 1
            starts = size.cumsum() - size
            return starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts
        inner = np.asarray([] if own is None else own, "int64")
        inner = inner[np.maximum.accumulate(inner) == inner]
        return np.unique(np.append(0, inner[(inner > 0) & (inner < len(text))]))

    def run(batches):
        table, lengths = chunk_table(tokenizer), byte_lengths(tokenizer)
        for part in small_batches(batches):
            texts = column(part, "text").to_pylist()
            given = column(part, "starts").to_pylist() if sections else [None] * len(texts)
            ids, bounds = table.encoded(column(part, "text"))
            out = []
            for i, (text, own) in enumerate(zip(texts, given, strict=True)):
                starts = starts_of(text, own)
                n, crossing = attribute(token_spans(text, ids[bounds[i] : bounds[i + 1]], lengths), starts, len(text))
                out.append((np.full(len(starts), i), np.arange(len(starts)), starts, np.append(starts[1:], len(text)) - starts, n, crossing))
            row, section, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id").take(pa.array(row)), pa.array(section, pa.int32()), *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "section", "start", "length", "n_tokens", "n_crossing"])

    columns = ["doc_id", text_or_empty().alias("text"), *([F.col(sections).alias("starts")] if sections else [])]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, section int, start long, length long, n_tokens long, n_crossing long"
    return docs.select(*columns).mapInArrow(run, schema)
