"""Byte-level BPE over a tree: halves are encoded apart and joined by re-encoding a window around the seam."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from loamgrid.llm.base import documents, per_document
from loamgrid.llm.tokens import cut_after, cut_before, tiktoken_encoding

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points of a leaf, and of the first window on either side of a seam.
LEAF, WINDOW = 4096, 32
Encode = Callable[[str], list[int]]


def encode_tree(text: str, encode: Encode, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
    """The ids of ``encode(text)``, which is only called on leaves and on windows around seams."""

    def node(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return encode(text[low:high])
        mid = (low + high) // 2
        return join(text, low, mid, high, node(low, mid), node(mid, high), encode, window)

    return node(0, len(text))


def join(text: str, low: int, mid: int, high: int, left: list[int], right: list[int], encode: Encode, window: int) -> list[int]:
    """Ids of ``text[low:high]`` from those of its parts at ``mid``.

    Each side of the window grows until it ends at a safe cut or takes in the whole part.  At a safe cut the part and
    the whole split alike, so the ids outside the window are the same in both.
    """
    width, start = window, -1
    while start < 0:
        start = cut_before(text, max(low, mid - width), mid) if mid - width > low else cut_before(text, low, mid)
        if start < 0 and mid - width <= low:
            start = low
        width *= 2
    width, end = window, -1
    while end < 0:
        end = cut_after(text, mid, min(high, mid + width))
        if end < 0 and mid + width >= high:
            end = high
        width *= 2
    tail, head = len(encode(text[start:mid])), len(encode(text[mid:end]))
    return left[: len(left) - tail] + encode(text[start:end]) + right[head:]


def decode_tree(ids: list[int], decode: Callable[[list[int]], bytes], leaf: int = LEAF) -> bytes:
    """Bytes of ``ids``: byte strings of halves, concatenated up the tree."""
    if len(ids) <= leaf:
        return decode(ids)
    mid = len(ids) // 2
    return decode_tree(ids[:mid], decode, leaf) + decode_tree(ids[mid:], decode, leaf)


def encode_documents(docs: DataFrame, ranks: str = RANKS, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """``doc_id, ids``: the ids of each row's whole text; null and empty texts have none.  No shuffle."""
    return per_document(documents(docs), lambda t: (encode_tree(t, tiktoken_encoding(ranks).encode_ordinary, leaf, window),), "ids array<int>")


def round_trip(docs: DataFrame, ranks: str = RANKS, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: one row per row of ``docs``.

    Texts longer than a leaf are encoded by halves; very long texts cost in proportion to their length.  Null and
    empty texts have no ids, repeated rows each get a row.  No shuffle; the ids stay in the task.
    """

    def row(text: str) -> tuple:
        enc = tiktoken_encoding(ranks)
        ids = encode_tree(text, enc.encode_ordinary, leaf, window)
        back = decode_tree(ids, enc.decode_bytes)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    return per_document(documents(docs), row, "n_tokens long, ids_sha256 string, decoded_sha256 string")
