"""Token counts of whole texts, huge ones by overlapping chunks (operator 9).

A text over `chunk` characters is encoded in chunks that overlap, with the offsets of the pieces. Two neighbours are spliced at a boundary that both have, in
the overlap, and that is proven: no piece of the vocabulary holds the character before it followed by the one after it, so no merge of the whole text
crosses it, and the pieces on either side don't hang on what is on the other. If the overlap has no such boundary,
it's widened, to the whole rest of the text if need be. Counts are those of the library on the whole text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import put

CHUNK, OVERLAP = 16_384, 256


@cache
def _loaded(model: str):
    """The model and all pairs of neighbouring characters in its pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return sp, frozenset(pair for p in pieces for pair in zip(p, p[1:]))


def _proven(a: str, b: str, pairs: frozenset) -> bool:
    return (a.replace(" ", "▁"), b.replace(" ", "▁")) not in pairs


def count_tokens(text: str, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text as the library gives them, without begin, end or added special tokens."""
    sp, pairs = _loaded(model)
    if len(text) <= chunk:
        return len(sp.encode(text))

    def begins(start: int, stop: int) -> list[int]:
        """Where the pieces of text[start:stop] begin; the library gives bytes."""
        part = text[start:stop]
        at = [p.begin for p in sp.encode(part, return_type="proto").pieces]
        if not part.isascii():
            codes = np.frombuffer(part.encode("utf-32-le"), dtype="<u4")
            bytes_before = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
            at = np.searchsorted(bytes_before, at, side="right").tolist()
        return [start + x for x in at]

    total, start, stop, since = 0, 0, chunk, 0  # text[start:stop] is encoded, its pieces from `since` on count
    left = begins(start, stop)
    while stop < len(text):
        wide, at = overlap, None
        while at is None:
            begin = max(since, stop - wide)
            right = begins(begin, stop + chunk)
            common = set(left) & set(right)
            at = next((p for p in range(stop - 1, begin, -1) if p in common and _proven(text[p - 1], text[p], pairs)), None)
            if at is None and begin == since:  # nothing to cut at: encode on from here
                stop = min(len(text), start + 2 * (stop - start))
                left = begins(start, stop)
                if stop == len(text):
                    return total + sum(p >= since for p in left)
            wide *= 2
        total += sum(since <= p < at for p in left)
        start, stop, since, left = begin, min(len(text), stop + chunk), at, right
    return total + sum(p >= since for p in left)


def token_counts(df: DataFrame, model: str, text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit). A null text counts as empty: 0 bytes, 0 tokens.

    model: path of a SentencePiece BPE model, the same on each executor. Columns of df with the names of the new ones make way. An empty table gives no rows.
    """

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_tokens(t, model, chunk, overlap))

    text = F.coalesce(F.col(text_col), F.lit(""))
    made = put(df, n_bytes=F.octet_length(text).cast("long"), n_tokens=counted(text))
    return put(made, over_limit=F.col("n_tokens") > limit)
