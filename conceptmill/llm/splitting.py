"""Cutting texts that exceed a number of tokens into pieces within it.

The tokens' byte lengths are summed to offsets; runs of white space give a sorted array of natural boundaries by
rank (paragraph, line, sentence, word).  For each piece the last boundary within the limit is found by binary
search, the best rank first; without one the piece is cut hard, between characters.  The next piece starts
``overlap`` tokens before the cut.  Pieces are encoded again, because a piece's own tokens may differ from its
tokens in the whole text, and shortened until they are within the limit.

A token of a byte-level vocabulary holds at least one byte.  So a text of at most ``limit`` bytes cannot exceed
the limit, and only longer ones go to Python.  Texts within the limit give no rows.

Defined cases: null and empty texts give no rows; repeated rows are cut alike; further columns are ignored; a
text without any white space is cut hard; a character of several tokens is never divided, so the overlap may
be up to three tokens longer there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .tokens import VOCABULARY, encoder, token_bytes

_SPACE = re.compile(r"\s+")
#: sentence marks, with quotes and brackets that may follow them
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
#: characters of text whose pieces are given back at once
_AHEAD = 4_000_000
RANKS = ("paragraph", "line", "sentence", "word")

SCHEMA = "id {id}, piece int, n_pieces int, first_char long, end_char long, n_tokens int, overlap int, cut string, text string"


def cut(text: str, limit: int, overlap: int, path: str = VOCABULARY) -> list[tuple[int, int, int, int, str]]:
    """(first character, end character, tokens, overlap with the previous piece in tokens, kind of cut at the end) of each piece;
    nothing for a text within the limit."""
    import numpy as np

    enc = encoder(path)
    tokens = enc.encode_ordinary(text)
    n = len(tokens)
    if n <= limit:
        return []
    ends = np.concatenate([[0], np.cumsum(token_bytes(path)[np.asarray(tokens)])])  # byte offset before token i
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte offset of character i
    char_at = np.searchsorted(starts, ends)  # character at token i, rounded up inside a character
    clean = starts[char_at] == ends
    found: dict[str, list[tuple[int, int]]] = {r: [] for r in RANKS}
    for m in _SPACE.finditer(text):
        breaks = m.group().count("\n") + m.group().count("\r") - m.group().count("\r\n")
        if breaks:
            rank = "paragraph" if breaks > 1 else "line"
        else:
            rank = "sentence" if _SENTENCE.search(text, max(0, m.start() - 4), m.start()) else "word"
        found[rank].append((m.start(), m.end()))
    bounds = {}
    for rank, spans in found.items():
        if spans:
            first, last = np.array(spans).T
            at = np.searchsorted(ends, starts[last], side="right") - 1  # the last token start within the white space
            bounds[rank] = at[ends[at] >= starts[first]]
    out: list[tuple[int, int, int, int, str]] = []
    start = shared = 0
    while start < n:
        most = limit
        while True:
            stop, kind = n, "end"
            if n - start > most:
                stop, kind = _last_boundary(bounds, start, start + most, overlap, limit), ""
                if stop:
                    stop, kind = stop
                else:
                    stop, kind = start + most, "hard"
                    while not clean[stop] and stop > start + 1:
                        stop -= 1
            size = len(enc.encode_ordinary(text[char_at[start] : char_at[stop]]))
            if size <= limit or most <= overlap + 4:
                break
            most = max(overlap + 4, most - max(1, size - limit))
        out.append((int(char_at[start]), int(char_at[stop]), size, shared, kind))
        if kind == "end":
            break
        back = stop - overlap
        while not clean[back] and back > start + 1:
            back -= 1
        start, shared = max(back, start + 1), stop - max(back, start + 1)
    return out


def _last_boundary(bounds: dict, start: int, most: int, overlap: int, limit: int):
    """The last boundary up to ``most`` of the best rank; ranks above words only if they fill half of the limit."""
    import numpy as np

    for rank in RANKS:
        at = bounds.get(rank)
        if at is None:
            continue
        i = int(np.searchsorted(at, most, side="right")) - 1
        least = start + max(overlap + 4, 0 if rank == "word" else limit // 2)
        if i >= 0 and at[i] > least:
            return int(at[i]), rank
    return None


def split_texts(docs: DataFrame, id: str, text: str, limit: int = 2048, overlap: int = 128, path: str = VOCABULARY) -> DataFrame:
    """(id, piece, n_pieces, first_char, end_char, n_tokens, overlap, cut, text) of the texts over ``limit`` tokens."""
    if not 0 <= overlap <= limit - 8:
        raise ValueError("the overlap must be at least 0 and less than the limit by 8 tokens")
    ship(docs.sparkSession)
    long = docs.filter(F.octet_length(text) > limit).select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "piece", "n_pieces", "first_char", "end_char", "n_tokens", "overlap", "cut", "text"]
        for batch in batches:
            rows, size = [], 0
            for key, t in zip(batch["id"], batch["text"]):
                pieces = cut(t, limit, overlap, path)
                rows += [(key, i, len(pieces), a, b, n, o, kind, t[a:b]) for i, (a, b, n, o, kind) in enumerate(pieces)]
                size += len(t)
                if size > _AHEAD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return long.mapInPandas(run, SCHEMA.format(id=long.schema["id"].dataType.simpleString())).withColumnRenamed("id", id)
