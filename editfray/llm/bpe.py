"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are small; parts are encoded alone, and two
neighbours are joined by re-encoding a window around their boundary. The window
grows until each of its ends is a cut that no longer text can undo: a place where the
class of characters (letters, numbers, others) ends and no match of the pattern goes
on over the change. A match depends only on what stands right of its start; so tokens outside the
window are final. Where no such cut exists, the window is the whole of both parts.
Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, quoted, table

#: Characters of a part that is encoded alone, and tokens of one that is decoded alone.
LEAF = 256
# Characters that every version of Unicode has in the same class: what is in none of these makes no cut.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſΑ-ΡΣ-Ωα-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
_BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_OTHERS = "!-&(-/:-@\\[-`{-~«»‐-…、。！，：；？\U0001f600-\U0001f64f"
#: A cut lies behind the character that this matches. An apostrophe goes on to letters (as in 'll), no other sign does.
CUT = re.compile(f"[{_LETTERS}](?=[0-9'{_BLANKS}{_OTHERS}])|[0-9](?=['{_LETTERS}{_BLANKS}{_OTHERS}])|[{_OTHERS}](?=[0-9{_LETTERS}{_BLANKS}])|'(?=[0-9{_BLANKS}])")
_BLANK_RUN = re.compile(f"[{_BLANKS}]{{2048,}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Codec:
    """Encoder and decoder of one rank file. Decoding needs the list of tokens alone."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self._bytes = [ranks.get(i, b"") for i in range(max(ranks) + 1)]

    @cached_property
    def _bpe(self):
        import public_tokenizers
        import tiktoken

        ranks = {token: rank for rank, token in enumerate(self._bytes) if token}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> list[int]:
        """Encode one part by itself. Very long runs of blanks are cut from the rest as the pattern cuts them,
        so that its look-ahead never has to walk back over them."""
        if len(text) < 2048 or not (run := _BLANK_RUN.search(text)):
            return self._bpe.encode_ordinary(text)
        a, b = run.span()
        if b < len(text):  # the last blank goes with, or stands before, what follows
            b -= 1
        return self._bpe.encode_ordinary(text[:a]) + self._bpe.encode_ordinary(text[a:b]) + self.plain(text[b:])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._encode(text, 0, len(text)), dtype=np.uint32).astype("<u4", copy=False)

    def _encode(self, text: str, start: int, end: int) -> array:
        if end - start <= LEAF:
            return array("I", self.plain(text[start:end]))
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: array, right: array) -> array:
        """Tokens of text[start:end] from those of its parts before and from middle."""
        a, b = self.window(text, start, middle, end)
        if a == b == middle:
            return left + right
        n_left, n_right = self._held(reversed(left), text[a:middle]), self._held(right, text[middle:b])
        return left[: len(left) - n_left] + array("I", self.plain(text[a:b])) + right[n_right:]

    @staticmethod
    def window(text: str, start: int, middle: int, end: int) -> tuple[int, int]:
        if start < middle < end and CUT.match(text, middle - 1):
            return middle, middle
        a = b = None
        width = 32
        while a is None or b is None:
            if a is None:
                low = max(start, middle - width)
                cuts = [m.end() for m in CUT.finditer(text, low, middle)]
                a = cuts[-1] if cuts else start if low == start else None
            if b is None:
                high = min(end, middle + width)
                cut = CUT.search(text, middle, high)
                b = cut.end() if cut else end if high == end else None
            width *= 4
        return a, b

    def _held(self, ids, text: str) -> int:
        """How many of the ids, from the first on, make the text."""
        left, taken = len(text.encode()), 0
        ids = iter(ids)
        while left > 0:
            left -= len(self._bytes[next(ids)])
            taken += 1
        if left:
            raise AssertionError("a window must begin and end between tokens")
        return taken

    def decode(self, ids: np.ndarray) -> bytes:
        """Decode halves and concatenate them."""
        if len(ids) <= LEAF:
            return b"".join(map(self._bytes.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=4)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def _encoded(c: Codec, texts: list) -> tuple[list, list]:
    ids = [c.encode(x or "") for x in texts]
    return ids, [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", and_decode: bool = False) -> DataFrame:
    """id, n_tokens long, ids binary (packed little-endian unsigned 32-bit) for each row of docs; with and_decode
    also decoded binary, what decode() makes of the ids, by the same tasks.

    Null text is encoded as empty: no ids. Rows stay as they are, repeated or with
    a null id; an empty table gives an empty one. Only the two named columns are
    read. A text is held whole by one task, so its length bounds the memory."""
    vocabulary = vocabulary or default_vocabulary()
    kept = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * and_decode]

    def make():
        c = codec(vocabulary)

        def f(batch):
            ids, columns = _encoded(c, batch.column("text").to_pylist())
            if and_decode:
                columns.append(pa.array(map(c.decode, ids), pa.binary()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

        return f

    kind = kept.schema["doc_id"].dataType.simpleString()
    return arrow_map(kept, make, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * and_decode, "text")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The columns of encoded (those of encode()) and decoded binary. Null ids give null."""
    vocabulary = vocabulary or default_vocabulary()

    def make():
        c = codec(vocabulary)

        def f(batch):
            texts = [None if x is None else c.decode(np.frombuffer(x, dtype="<u4")) for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

        return f

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in encoded.schema)
    return arrow_map(encoded, make, schema + ", decoded binary", "ids")


def digests(docs: DataFrame, **how) -> DataFrame:
    out = encode(docs, and_decode=True, **how)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
