"""Texts over a token limit, cut into overlapping pieces at natural boundaries.

A text is encoded once. The tokens' places are prefix sums of their lengths; claims, paragraphs and sentences give sorted
arrays of token numbers at which a piece may end; a binary search finds the last one under the limit, and the next piece
starts the overlap before it. Without a boundary the cut falls at the limit itself, never inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.tokens import DEFAULT_TOKENIZER, Encoder, encoder

LIMIT = 4096
OVERLAP = 128

SCHEMA = (
    "doc_id bigint, piece int, token_start int, token_end int, char_start int, char_end int, cut string, text string"
)


def boundaries(text: str) -> list[tuple[str, np.ndarray]]:
    """Sorted characters at which a new piece may begin, from the strongest kind to the weakest."""
    import re

    kinds = (
        ("claim", r"(?:(?<=\n)|(?<=[.;:] )|(?<=[.;:]))\d{1,3}\s?[.)] (?=[^\W\d_])"),
        ("paragraph", r"(?<=\n)(?=\S)|(?<=\s)(?=\[\d{4}\])"),
        ("sentence", r"(?<=[.!?;])(?=\s)|(?<=[。！？；])"),
    )
    return [(kind, np.fromiter((m.start() for m in re.finditer(p, text)), dtype=np.int64)) for kind, p in kinds]


def cut(text: str, enc: Encoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple]:
    """(piece, token_start, token_end, char_start, char_end, kind of its end) of a text over the limit; [] for any other."""
    starts = enc.starts(text)
    n = len(starts)
    if n <= limit:
        return []
    # a token may begin a piece if it begins a character
    whole = np.concatenate(([True], starts[1:] > starts[:-1], [True]))
    char = np.append(starts, len(text))
    marks = [(kind, np.unique(np.searchsorted(starts, at, "right") - 1)) for kind, at in boundaries(text)]
    marks = [(kind, t[whole[t]]) for kind, t in marks]

    def end_of(s: int, most: int) -> tuple[int, str]:
        if s + most >= n:
            return n, "end"
        # first a boundary of any kind in the later half, the strongest kind first
        for least in (most // 2, overlap + 4):
            for kind, t in marks:
                i = int(np.searchsorted(t, s + most, "right")) - 1
                if i >= 0 and t[i] > s + least:
                    return int(t[i]), kind
        e = s + most
        while not whole[e] and e > s + 1:
            e -= 1
        return e, "hard"

    out, s = [], 0
    while True:
        most = limit
        while True:
            e, kind = end_of(s, most)
            over = len(enc.ids(text[char[s] : char[e]])) - limit
            if over <= 0:  # encoded alone, a piece can have a few tokens more than it had in the text
                break
            if most <= overlap + 8:
                raise ValueError(f"no piece of at most {limit} tokens moves on from character {char[s]}")
            most = max(most - over - 4, overlap + 8)
        out.append((len(out), s, e, int(char[s]), int(char[e]), kind))
        if e == n:
            return out
        back = e - overlap
        while back > s + 1 and not whole[back]:
            back -= 1
        s = back if back > s else e


def _pieces(path: str, limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                rows = cut(text, enc, limit, overlap)
                if rows:
                    yield pd.DataFrame(
                        [(doc, *r, text[r[3] : r[4]]) for r in rows],
                        columns=["doc_id", "piece", "token_start", "token_end", "char_start", "char_end", "cut", "text"]
                    )

    return run


def long_pieces(
    documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = DEFAULT_TOKENIZER
) -> DataFrame:
    """(doc_id, piece, token_start, token_end, char_start, char_end, cut, text): the pieces of each text of more than ``limit`` tokens.

    Each piece has at most ``limit`` tokens and begins ``overlap`` tokens before the end of the one before it (a few more if a
    character would be split). ``cut`` tells what the piece ends at: claim, paragraph, sentence, hard or end. Shorter, empty
    and null texts give no rows. A token of a rank file holds at least one byte of the text as it stands, so with these, texts
    of fewer bytes aren't encoded at all. A text that can't be cut so raises; none of those files gives such a case at this limit.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be less than a quarter of the limit")
    least = limit if tokenizer.endswith(".tiktoken") else 1  # other tokenizers may expand what they normalise
    long = documents.filter(
        (F.octet_length("text") >= least) & F.col("doc_id").isNotNull()
    ).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return long.mapInPandas(_pieces(tokenizer, limit, overlap), SCHEMA)
