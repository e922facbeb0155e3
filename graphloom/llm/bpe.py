"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text's tokens are the product of a monoid: a node holds the tokens of its stretch, and two neighbours join by
re-encoding a window around their border. The window grows until it begins and ends at places that are borders of the
splitting pattern whatever stands around them: a white-space character after one that is none. No alternative of the
pattern crosses such a place and none looks beyond it, so tokens outside the window provably stay. Decoding concatenates
the bytes of halves up the same kind of tree.

Defined cases: a null or empty text has no tokens and decodes to no bytes; texts of any length, repeated rows and further
columns pass through; our columns get underscores where names clash. Token ids are packed as little-endian uint32.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column_names, map_texts, worker_cache

#: Characters (or tokens, when decoding) of a leaf; longer stretches are halved.
LEAF = 512
#: Characters on either side of a border that the first window takes.
WINDOW = 24
#: A place where the splitting pattern always has a border; white space here is so for every library.
BORDER = re.compile(r"(?<=\S)(?=[ \n])")


class Codec:
    """Tree encoder and decoder over the ranks of one vocabulary."""

    def __init__(self, ranks_file: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks_file.splitlines()) if t}
        self.base = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.leaf, self.window = leaf, window

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.base.encode_ordinary(text), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        return self._node(text, 0, len(text))

    def _node(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._node(text, lo, mid), self._node(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        width, a, b = self.window, None, None
        while a is None or b is None:
            if a is None:
                start = max(lo, mid - width)
                # borders that leave at least one character on each side within the left half
                places = [m.start() for m in BORDER.finditer(text, start, mid) if lo < m.start() < mid]
                a = places[-1] if places else (lo if start == lo else None)
            if b is None:
                end = min(hi, mid + width)
                places = (m.start() for m in BORDER.finditer(text, mid, end) if mid < m.start() < end)
                b = next(places, hi if end == hi else None)
            width *= 2
        keep_left = self._without(left, len(text[a:mid].encode()), from_end=True)
        keep_right = self._without(right, len(text[mid:b].encode()), from_end=False)
        return np.concatenate([keep_left, self._plain(text[a:b]), keep_right])

    def _without(self, ids: np.ndarray, n_bytes: int, from_end: bool) -> np.ndarray:
        """ids without the tokens of the last (or first) n_bytes, looking at no more of them than it must."""
        if not n_bytes:
            return ids
        side = ids[-n_bytes:][::-1] if from_end else ids[:n_bytes]
        gone = int(np.searchsorted(np.cumsum(self.size[side]), n_bytes)) + 1
        if int(self.size[side[:gone]].sum()) != n_bytes:
            raise AssertionError("a window's border isn't a border of tokens")
        return ids[: len(ids) - gone] if from_end else ids[gone:]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.base.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def read_ranks(name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> tuple[bytes, str]:
    """The ranks file's bytes and the splitting pattern; path overrides the installed vocabulary of that name."""
    import public_tokenizers

    with open(path or public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def _codec(key: str, vocabulary) -> Codec:
    cache = worker_cache()
    if key not in cache:
        cache[key] = Codec(*vocabulary.value)
    return cache[key]


def encode_documents(df: DataFrame, text: str = "text", vocabulary: tuple[bytes, str] | None = None) -> DataFrame:
    """df with token_ids (packed little-endian uint32) and decoded (the bytes that those ids stand for), in one pass.

    The vocabulary, a file of fixed size, is broadcast.
    """
    vocabulary = vocabulary or read_ranks()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    key = f"bpe-{hash(vocabulary)}"
    ids, decoded = column_names(df, "token_ids", "decoded")

    def make(texts):
        codec = _codec(key, shared)
        coded = [codec.encode(t) for t in texts]
        return [x.tobytes() for x in coded], [codec.decode(x) for x in coded]

    return map_texts(df, make, [(ids, "binary"), (decoded, "binary")], text)


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


def token_digests(docs: DataFrame, vocabulary: tuple[bytes, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode_documents(docs.select("doc_id", "text"), vocabulary=vocabulary)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
