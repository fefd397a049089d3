"""Tokenizers behind one interface, and position indices of mixed text and vision tokens."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (encode: text -> array of pieces, decode: pieces -> text)
TOKENIZERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "words": (lambda s: F.regexp_extract_all(s, F.lit(r"\s*\S+|\s+"), F.lit(0)), lambda a: F.array_join(a, "")),
    "characters": (lambda s: F.filter(F.split(s, ""), lambda c: c != ""), lambda a: F.array_join(a, "")),
}


def encode(s: Column, tokenizer: str = "words") -> Column:
    return TOKENIZERS[tokenizer][0](s)


def decode(pieces: Column, tokenizer: str = "words", special: tuple[str, ...] = ()) -> Column:
    """The text of the pieces, special ones left out."""
    kept = F.filter(pieces, lambda p: ~p.isin(*special)) if special else pieces
    return TOKENIZERS[tokenizer][1](kept)


def grid_positions(ids, grids, image_token: int, merge: int = 2) -> np.ndarray:
    """(3, n) positions: text counts on in all three rows, an image's tokens count by frame, row and column of its grid."""
    out, nxt, at, left = np.zeros((3, len(ids)), np.int64), 0, 0, list(grids)
    while at < len(ids):
        if ids[at] == image_token and left:
            t, h, w = left.pop(0)
            shape = (int(t), int(h) // merge, int(w) // merge)
            n = min(int(np.prod(shape)), len(ids) - at)
            out[:, at : at + n] = np.stack([axis.ravel() for axis in np.indices(shape)])[:, :n] + nxt
            nxt, at = int(out[:, at : at + n].max()) + 1 if n else nxt, at + max(n, 1)
        else:
            out[:, at] = nxt
            nxt, at = nxt + 1, at + 1
    return out


def rope_index(ids: Column, grids: Column, image_token: int, merge: int = 2) -> Column:
    """Three position arrays for each row of token ids with the (frames, height, width) of its images."""

    @F.pandas_udf("array<array<bigint>>")
    def index(a: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([[row.tolist() for row in grid_positions(x, () if y is None else y, image_token, merge)] for x, y in zip(a, g)])

    return index(ids, grids)
