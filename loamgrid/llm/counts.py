"""Token counts; huge documents are encoded in overlapping chunks that are spliced where both sides agree."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame, functions as F

from loamgrid.llm.base import documents, per_document
from loamgrid.llm.tokens import tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Texts up to this many code points are counted word by word; longer ones by chunks of this size.
CHUNK = 32_768
OVERLAP = 256
#: Tokens after a common boundary that must agree on both sides.
AGREE = 8
#: Words whose counts are kept in a worker.
KEPT = 400_000
BLANK = re.compile(r"[ \t\n\r]")
_counts: dict[str, dict[str, int]] = {}


class _Words:
    """Token counts of words between blanks, each encoded once.

    Blanks are dropped by the tokenizer, no token or special string holds one, and no normalisation reaches across
    one, so a text has the tokens of its words.
    """

    def __init__(self, name: str):
        self.name = name
        self.known = _counts.setdefault(name, {})

    def learn(self, texts: list[str]) -> None:
        words: set[str] = set()
        for t in texts:
            if len(t) <= CHUNK:
                words.update(BLANK.sub(" ", t).split(" "))
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list(words)
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            known.update(zip(part, (len(e) for e in tokenizer(self.name).encode_batch(part, add_special_tokens=False))))

    def count(self, text: str) -> int:
        return sum(map(self.known.__getitem__, BLANK.sub(" ", text).split(" ")))


def _encode(text: str, low: int, high: int, name: str) -> tuple[list[int], list[int]]:
    e = tokenizer(name).encode(text[low:high], add_special_tokens=False)
    return e.ids, [low + a for a, _ in e.offsets]


def _common(text: str, low: int, high: int, left: tuple, right: tuple) -> tuple[int, int] | None:
    """Token counts before and from a blank in ``[low, high)`` after which both encodings agree."""
    blanks = [m.start() + low for m in BLANK.finditer(text[low:high])]
    for at in sorted(blanks, key=lambda p: abs(p - (low + high) // 2)):
        i, j = bisect_left(left[1], at), bisect_left(right[1], at)
        # tokens that end before the last blank of the overlap are whole in both chunks
        k = bisect_left(left[1], blanks[-1]) - i
        n = min(AGREE, k)
        if left[0][i : i + n] == right[0][j : j + n]:
            return i, j
    return None


def count_chunks(text: str, name: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` from overlapping chunks.

    Neighbours are spliced at a blank of their overlap, a boundary in any encoding, where the tokens that follow
    agree; without such a place the overlap is doubled and the right chunk encoded again.
    """
    high = min(chunk, len(text))
    left = _encode(text, 0, high, name)
    total = 0
    while high < len(text):
        wide = overlap
        while True:
            low = max(0, high - wide)
            end = min(len(text), max(low + chunk, high + overlap))
            right = _encode(text, low, end, name)
            found = _common(text, low, high, left, right)
            if found or low == 0:
                break
            if wide >= chunk:  # no blank in a whole chunk: take the chunks together
                low, wide = 0, len(text)
                end = min(len(text), high + chunk)
                right, found = _encode(text, 0, end, name), (0, 0)
                total = 0
                break
            wide *= 2
        i, j = found or (0, 0)
        total = total + i if found else 0
        left, high = (right[0][j:], right[1][j:]), end
    return total + len(left[0])


def token_counts(docs: DataFrame, name: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per row of ``docs``.

    Null and empty texts have no tokens, repeated rows each get a row.  No shuffle.
    """
    words = _Words(name)
    df = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    df = per_document(df, lambda t: (words.count(t) if len(t) <= CHUNK else count_chunks(t, name),), "n_tokens long", before=words.learn)
    return df.withColumn("over_limit", F.col("n_tokens") > limit).select("doc_id", "n_bytes", "n_tokens", "over_limit")
