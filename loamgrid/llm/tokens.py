"""Tokenizers of public vocabularies, loaded once a worker, and places where a text may be cut before encoding."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers


@lru_cache(maxsize=4)
def tiktoken_encoding(name: str):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def byte_level_encode(name: str, ranks: str) -> Callable[[str], list[int]]:
    """Ids as the tokenizers library gives them for ``name``, without begin or end tokens.

    ``ranks`` is the same vocabulary as a rank file, which encodes several times faster; a text that holds an added
    token goes to the library itself.
    """
    library, encode = tokenizer(name), tiktoken_encoding(ranks).encode_ordinary
    added = [t.content for t in library.get_added_tokens_decoder().values()]

    def ids(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids if any(a in text for a in added) else encode(text)

    return ids


def cut_before(text: str, low: int, at: int) -> int:
    """The last safe cut in ``(low, at)``, or -1.

    A space after a character that is no white space starts a new match of the splitting pattern in whatever text
    surrounds it: no alternative of the pattern holds white space after another character, and none looks back.
    """
    i = text.rfind(" ", low + 1, at)
    while i > low and text[i - 1].isspace():
        i = text.rfind(" ", low + 1, i)
    return i if i > low else -1


def cut_after(text: str, at: int, high: int) -> int:
    """The first safe cut in ``(at, high)``, or -1."""
    i = text.find(" ", at + 1, high)
    while i > at and text[i - 1].isspace():
        i = text.find(" ", i + 1, high)
    return i if i > at else -1
