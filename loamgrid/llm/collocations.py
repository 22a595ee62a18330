"""Phrase collocations from a weighted de Bruijn graph of words.

1.  Sieves.  A phrase that occurs ``least`` times has only words, pairs, ... that occur as often.  Runs of 1 to ``longest - 1``
    words, whose shorter runs passed, are counted by hash; the frequent ones go into a table of ``2 ** BITS`` bits, the only
    thing broadcast.  A clash of hashes keeps too much and changes no count, at any size of input.
2.  Edges.  Each run of ``longest`` words that is left is an edge between its first and its last ``longest - 1`` words.
    Equal edges are added up; so are the ends: shorter runs at a piece's end, or where the run one word longer is not kept.
3.  Paths.  A node with one edge in and one out and no end or start of a piece is passed by all that reaches it.  Edges that
    meet there are put together by pointer doubling, and a path of frequent edges is one row of words and a weight.
4.  Flow.  A run of k words occurs as often as the runs of k + 1 words that begin with it, plus its ends.
    The longest nodes take this from the paths, each shorter length from the one before.
5.  Cuts.  Each candidate looks its parts up; the least score counts.  A candidate inside a longer one that occurs as often
    is inside one of one word more that does, so the greatest count of those decides; a node inside a path needs no look.

Rows: a null text is empty, a null ``lang`` is ``und``; repeated rows count each time; columns but ``text`` and ``lang`` are
not looked at; no documents, or none with a frequent phrase, give no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgrid.llm.base import arrow_schema, cut, drop_settled

BITS = 25
#: Bits of the table in a row on its way to the driver.
BLOCK = 1 << 20
#: Bytes of text that a task works on at a time.
CHUNK = 1 << 20
#: Texts that are Python strings at once.
TEXTS = 200
#: Rows of a batch that a task sends; the other side holds a batch.
SENT = 20_000
#: Grams whose counts a task holds before it sends them.
HELD = 400_000
#: Edges of a path that are one row; a longer path goes on in the next row.
STRETCH = 1024
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: No byte of a text: where a piece ends.
END = 0xFF
MIX = np.uint64(0x9E3779B97F4A7C15)


def _fold() -> bytes:
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] += 32
    for c in ENDS:
        table[c] = END
    table[0x09] = 0x20
    return bytes(table)


FOLD = _fold()


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Folded texts of one language, about ``CHUNK`` bytes of them; a longer text is cut where a piece ends."""
    held: dict[str, list[bytes]] = {}
    size = 0
    slices = (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS))
    for some in slices:
        for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
            text = text.encode().translate(FOLD)
            while len(text) > CHUNK and (at := max(text.rfind(END, 0, CHUNK), 0) or text.find(END, CHUNK)) > 0:
                yield lang, text[:at]
                text = text[at + 1 :]
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size > CHUNK:
                yield from ((lang, bytes([END]).join(texts)) for lang, texts in held.items())
                held, size = {}, 0
    yield from ((lang, bytes([END]).join(texts)) for lang, texts in held.items())


def tokens(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word as a number, the distinct words, and whether a word and the next are in one piece."""
    data = np.frombuffer(text + b" ", np.uint8)
    end = data == END
    inside = ~(end | (data == 0x20))
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    piece = np.cumsum(end, dtype=np.int32)[starts]
    return found.indices.to_numpy().astype(np.int64), found.dictionary, piece[1:] == piece[:-1]


def hashes(lang: str, words: pa.Array) -> np.ndarray:
    """64 bits for each word of a language."""
    own = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    return (own ^ pd.util.hash_array(np.array([lang], object))[0]) * MIX


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first ^ (first >> np.uint64(29))) * MIX + second


def listed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = keys >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def kept_runs(lang: str, codes: np.ndarray, words: pa.Array, joined: np.ndarray, tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words, one length more than there are tables: where runs begin whose shorter runs are all kept, and
    their hashes.  A run of a length that has a table is kept if it is in there."""
    own = hashes(lang, words)[codes]
    start, key = np.arange(len(codes)), own
    for k in range(1, len(tables) + 2):
        if k > 1:
            inside = np.zeros(len(codes) + 1, bool)
            inside[start] = True
            goes_on = inside[start + 1]
            goes_on[goes_on] = joined[start[goes_on] + k - 2]
            start, key = start[goes_on], pair_hashes(key[goes_on], own[start[goes_on] + k - 1])
        if k <= len(tables):
            found = listed(tables[k - 1], key)
            start, key = start[found], key[found]
        yield start, key


def sieve(docs: DataFrame, least: int, tables: list[np.ndarray]) -> np.ndarray:
    """The table of runs that occur ``least`` times, one word longer than those in the last of ``tables``.

    Counts are by 64-bit hash, so two runs of one hash count together and may be kept in vain.  The table has ``2 ** BITS``
    bits whatever the input; it comes as a row for each 128 KB.
    """
    held = docs.sparkSession.sparkContext.broadcast(tables)
    out = "key long, n long"
    schema = arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in chunks(batches):
            for _, keys in kept_runs(lang, *tokens(text), held.value):
                pass
            keys, n = np.unique(keys, return_counts=True)
            yield from _sliced(pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = np.zeros(BLOCK, np.uint8)
        made[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(made, bitorder="little").tobytes()]})

    often = _texts(docs).mapInArrow(run, out).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    at = F.shiftrightunsigned("key", 64 - BITS)
    places = often.select((at / BLOCK).cast("int").alias("block"), (at % BLOCK).cast("int").alias("bit")).distinct()
    table = np.zeros((1 << BITS) >> 3, np.uint8)
    for row in places.groupBy("block").applyInPandas(packed, "block int, bits binary").collect():  # at most 32 rows
        table[row.block * (BLOCK >> 3) : (row.block + 1) * (BLOCK >> 3)] = np.frombuffer(row.bits, np.uint8)
    held.unpersist()
    return table


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return first, number


def edges_and_ends(docs: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """``lang, k, gram, n``: edges (``k`` is one more than there are tables), runs of ``k`` words that no kept run goes on
    from, and all words (``k`` is 0).

    Runs are numbered length by length, each from the run one word shorter and its last word: equal numbers are equal words.
    """
    held = docs.sparkSession.sparkContext.broadcast(tables)
    out = "lang string, k int, gram string, n long"
    schema = arrow_schema(out)

    def rows(lang: str, k: int, grams: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        cols = [pa.repeat(lang, len(n)), pa.repeat(k, len(n)), grams, pa.array(n)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in chunks(batches):
            codes, names, joined = tokens(text)
            if not len(codes):
                continue
            yield rows(lang, 0, pa.array([""]), np.array([len(codes)], np.int64))
            starts = [start for start, _ in kept_runs(lang, codes, names, joined, held.value)]
            number = codes.copy()
            for k, start in enumerate(starts, 1):
                first, dense = _distinct(number[start] * len(names) + codes[start + k - 1])
                number[start] = dense
                ends = dense if k == len(starts) else dense[~np.isin(start, starts[k], assume_unique=True)]
                n = np.bincount(ends, minlength=len(first))
                shown = np.flatnonzero(n)
                if len(shown):
                    parts = [names.take(pa.array(codes[start[first[shown]] + j])) for j in range(k)]
                    yield rows(lang, k, pc.binary_join_element_wise(*parts, " "), n[shown])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in counted(batches):
            held.append(batch)
            size += batch.num_rows
            if size > HELD:
                summed = _summed(held, schema)
                held, size = [summed], summed.num_rows
                if 2 * size > HELD:
                    yield from _sliced(summed)
                    held, size = [], 0
        if held:
            yield from _sliced(_summed(held, schema))

    return _texts(docs).mapInArrow(run, out).groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SENT):
        yield batch.slice(at, SENT)


def _summed(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    """Equal grams of a task's chunks added up."""
    table = pa.Table.from_batches(batches).group_by(schema.names[:3], use_threads=False).aggregate([("n", "sum")]).rename_columns(schema.names)
    return table.cast(schema).combine_chunks().to_batches()[0] if table.num_rows else batches[0]


def _first(gram: Column, k: Column | int) -> Column:
    return F.array_join(F.slice(F.split(gram, " "), 1, k), " ")


def _last(gram: Column, k: int) -> Column:
    return F.array_join(F.slice(F.split(gram, " "), -k, k), " ")


def unary_paths(edges: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """``lang, words, n``: ``edges(lang, gram, n)`` put together at ``nodes(lang, gram)`` that are passed straight through.

    Each edge points to the one before it; pointers double until each has its path's first edge.  Edges on a ring have none
    and are paths by themselves.  A path is cut into rows of ``STRETCH`` edges.
    """
    k = longest - 1
    ends = edges.select("lang", F.col("gram").alias("before"), _last(F.col("gram"), k).alias("node"))
    through = ends.join(nodes.select("lang", F.col("gram").alias("node")), ["lang", "node"])
    links = edges.withColumn("node", _first(F.col("gram"), k)).join(through, ["lang", "node"], "left")
    links = cut(links.select("lang", "gram", "n", F.coalesce("before", "gram").alias("head"), F.col("before").isNotNull().cast("long").alias("far")))
    rounds = max(1, links.count()).bit_length()
    for _ in range(rounds):
        ahead = links.select("lang", F.col("gram").alias("head"), F.col("head").alias("next"), F.col("far").alias("more")).where("more > 0")
        new = cut(links.join(ahead, ["lang", "head"], "left").select(
            "lang", "gram", "n", F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")
        ))
        drop_settled(links)
        links = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    else:
        on_path = links.select("lang", F.col("gram").alias("head"), "far").where("far = 0").select("lang", "head", F.lit(True).alias("open"))
        links = links.join(on_path, ["lang", "head"], "left")
        links = links.withColumn("head", F.when(F.col("open"), F.col("head")).otherwise(F.col("gram"))).withColumn("far", F.when(F.col("open"), F.col("far")).otherwise(0))
    stretch = F.floor(F.col("far") / STRETCH)
    rows = links.groupBy("lang", "head", stretch.alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("far", "gram"))).alias("run"), F.max("n").alias("n"))
    rest = F.transform(F.slice("run", F.lit(2), F.size("run")), lambda x: F.element_at(F.split(x["gram"], " "), -1))
    return rows.select("lang", F.array_join(F.concat(F.split(F.col("run")[0]["gram"], " "), rest), " ").alias("words"), "n")


def _runs(words: Column, k: int, longest: int) -> Column:
    """The first ``k`` words of each edge of a path, the edges themselves for ``longest``."""
    every = F.split(words, " ")
    return F.explode(F.transform(F.sequence(F.lit(1), F.size(every) - F.lit(longest - 1)), lambda i: F.array_join(F.slice(every, i, k), " ")))


def counted_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """``lang, k, gram, n, longer`` of every run of 1 to ``longest`` words that occurs ``least`` times, ``longer`` the
    greatest count of a run of one word more that holds it; and ``lang, n`` of all words."""
    tables: list[np.ndarray] = []
    while len(tables) < longest - 1:
        tables.append(sieve(docs, least, tables))
    counts = cut(edges_and_ends(docs, tables))
    totals = counts.where("k = 0").select("lang", "n")

    k = longest - 1
    edges, ends = counts.where(F.col("k") == longest).drop("k"), counts.where(f"k BETWEEN 1 AND {longest - 1}")
    flow = edges.select("lang", _first(F.col("gram"), k).alias("gram"), "n", F.lit(1).alias("outs"), F.lit(0).alias("ins"), F.lit(0).alias("came"))
    flow = flow.unionByName(edges.select("lang", _last(F.col("gram"), k).alias("gram"), F.lit(0).alias("n"), F.lit(0).alias("outs"), F.lit(1).alias("ins"), F.col("n").alias("came")))
    last = ends.where(F.col("k") == k).select("lang", "gram", "n", F.lit(2).alias("outs"), F.lit(0).alias("ins"), F.lit(0).alias("came"))
    nodes = flow.unionByName(last).groupBy("lang", "gram").agg(*[F.sum(c).alias(c) for c in ("n", "outs", "ins", "came")])
    straight = cut(nodes.where((F.col("outs") == 1) & (F.col("ins") == 1) & (F.col("n") == F.col("came")) & (F.col("n") >= least)).select("lang", "gram"))
    paths = cut(unary_paths(edges.where(F.col("n") >= least), straight, longest))
    level = paths.select("lang", _runs(F.col("words"), longest, longest).alias("gram"), "n")
    tables = [level.select("lang", F.lit(longest).alias("k"), "gram", "n", F.lit(0).cast("long").alias("longer"))]
    seldom = edges.where(F.col("n") < least).select("lang", _first(F.col("gram"), k).alias("gram"), "n")
    begun = paths.select("lang", _runs(F.col("words"), k, longest).alias("gram"), "n").unionByName(seldom)
    while k:
        held = ends.where(F.col("k") == k).select("lang", "gram", "n")
        found = begun.unionByName(held).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        here = cut(found)
        often = here.where(F.col("n") >= least)
        around = [level.select("lang", side(F.col("gram"), k).alias("gram"), F.col("n").alias("longer")) for side in (_first, _last)]
        around = around[0].unionByName(around[1]).groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
        level = cut(often.join(around, ["lang", "gram"], "left").select("lang", F.lit(k).alias("k"), "gram", "n", F.coalesce("longer", F.lit(0)).alias("longer")))
        if tables and k == longest - 1:  # a node inside a path is in an edge that occurs as often
            level = level.join(straight, ["lang", "gram"], "left_semi").withColumn("longer", F.col("n")).unionByName(level.join(straight, ["lang", "gram"], "left_anti"))
        tables.append(level)
        k -= 1
        begun = here.select("lang", _first(F.col("gram"), k).alias("gram"), "n")
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return cut(every), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by their weakest cut."""
    every, totals = counted_phrases(docs, least, longest)
    parts = every.select("lang", F.col("gram").alias("part"), F.col("n").alias("f"))
    found = every.where("k > 1 AND longer < n").select("lang", "k", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    rest = F.array_join(F.slice(F.split("phrase", " "), F.col("cut") + 1, F.col("k")), " ")
    cuts = cuts.withColumn("left", _first(F.col("phrase"), F.col("cut"))).withColumn("right", rest)
    cuts = cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"]).join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr("(cast(1000 * a AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))"))
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = worst.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score").withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang
), runs AS (
  SELECT lang, k, list_slice(words, i, i + k - 1) AS gram
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) AS ks(k) WHERE len(words) >= k)
), f AS (
  SELECT lang, k, gram, count(*)::HUGEINT AS f FROM runs GROUP BY ALL HAVING count(*) >= 100
), longer AS (
  SELECT DISTINCT s.lang, s.gram FROM (SELECT lang, k, f, gram, unnest(range(1, k)) AS size FROM f WHERE k > 2) b, f s
  WHERE s.lang = b.lang AND s.k = b.size AND s.k > 1 AND b.f >= s.f AND list_contains(list_transform(range(1, b.k - s.k + 2), lambda i: list_slice(b.gram, i, i + s.k - 1)), s.gram)
), cuts AS (
  SELECT c.lang, c.gram, c.f AS a, c.cutat, l.f AS l, r.f AS r, t.n, 1000 * c.f * t.n // (l.f * r.f) AS score
  FROM (SELECT lang, gram, f, unnest(range(1, k)) AS cutat FROM f WHERE k > 1 AND (lang, gram) NOT IN (SELECT (lang, gram) FROM longer)) c
  JOIN f l ON l.lang = c.lang AND l.gram = list_slice(c.gram, 1, c.cutat) JOIN f r ON r.lang = c.lang AND r.gram = list_slice(c.gram, c.cutat + 1, len(c.gram)) JOIN totals t ON t.lang = c.lang
), worst AS (
  SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cutat) AS nth FROM cuts
), ranked AS (
  SELECT *, array_to_string(gram, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(gram, ' ')) AS rank FROM worst WHERE nth = 1
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
