"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by the windows of the documents.

DataFrame functions only.  A text becomes its words, a window the hash of its words; the hash is looked up in the set and the
words themselves are compared before a hit counts.  The set is broadcast in blocks of at most ``block`` windows, each block
one more scan of the documents, so a larger test set costs time and no memory.

Rows: null and empty texts have no words and no hits; rows equal in ``doc_id`` and text come back as often as they are
there; a null ``doc_id`` is an id like any other; a null ``item_id`` reads as the empty string, and rows of one ``item_id``
are one item; an empty benchmark hits nothing.  Columns other than ``doc_id, text`` and ``item_id, text`` are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loamgrid.llm.base import cut, documents, drop_settled, same, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word as it stands in the text, before capitals are lowered.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of the test set that are broadcast at once (about 200 bytes each).
BLOCK = 400_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP, -1), "")


def _windows(length: int, of: Column) -> Column:
    """The hash of each run of ``length`` words, by the place of its first word."""
    made = F.transform(F.sequence(F.lit(1), F.size(of) - F.lit(length - 1)), lambda i: F.xxhash64(F.slice(of, i, length)))
    return F.when(F.size(of) >= length, made).otherwise(F.array().cast("array<bigint>"))


def test_windows(benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """``hash, gram, set_id`` of each distinct window, and ``set_id, items`` of each distinct set of items that share one."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.coalesce("text", F.lit(""))).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(n)))
    start = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1))
    grams = items.select("item", "w", "length", start.alias("i")).select("item", F.slice("w", F.col("i"), F.col("length")).alias("gram"))
    grams = cut(grams.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items")))
    sets = cut(grams.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()))
    held = cut(grams.join(sets, "items").select(F.xxhash64("gram").alias("hash"), "gram", "set_id"))
    drop_settled(grams)
    return held, sets


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """One row per distinct (``doc_id``, text): ``doc_id, text_key, n_words, copies``, the hit windows ``covered``
    (``place`` from 0, ``length``) in order, and ``sets`` of items; and the table of those sets.

    Each document also sends one empty window, which the first block answers, so documents without hits need no second
    scan and no join.  All rows of a document come from one task and are combined before the one shuffle.
    """
    grams, sets = test_windows(benchmark, n)
    lengths = sorted(r[0] for r in grams.select(F.size("gram")).distinct().collect())  # at most n
    blocks = max(1, math.ceil(grams.count() / block))
    found = documents(docs).select("doc_id", text_key().alias("text_key"), words(F.col("text")).alias("w"))
    runs = [F.struct(F.lit(0).alias("length"), F.array(F.lit(0).cast("long")).alias("hashes"))]
    runs += [F.struct(F.lit(k).alias("length"), _windows(k, F.col("w")).alias("hashes")) for k in lengths]
    found = found.select("doc_id", "text_key", "w", F.inline(F.array(*runs)))
    found = found.select("doc_id", "text_key", "w", "length", F.posexplode("hashes").alias("place", "hash"))
    none = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("hash"), F.array().cast("array<string>").alias("gram"), F.lit(None).cast("long").alias("set_id"))
    scans = []
    for b in range(blocks):
        some = grams.where(F.pmod(F.col("hash"), F.lit(blocks)) == b) if blocks > 1 else grams
        some = F.broadcast(some.unionByName(none) if b == 0 else some)
        met = found.join(some, (found["hash"] == some["hash"]) & (F.slice("w", F.col("place") + 1, F.col("length")) == F.col("gram")))
        scans.append(met.select("doc_id", "text_key", F.size("w").alias("n_words"), "place", "length", "set_id"))
    every = scans[0]
    for s in scans[1:]:
        every = every.unionByName(s)
    rows = every.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(F.col("length") == 0).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("length") > 0, F.struct("place", "length")))).alias("covered"),
        F.collect_set("set_id").alias("sets"),
    )
    out = cut(rows)
    drop_settled(grams)
    return out, sets


def _spans(covered: Column) -> Column:
    """Hit windows in order, as runs of words (``from``, ``to`` exclusive) that do not touch."""
    def step(runs: Column, x: Column) -> Column:
        end = x["place"] + x["length"]
        last = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], end).alias("to"))))
        fresh = F.concat(runs, F.array(F.struct(x["place"].alias("from"), end.alias("to"))))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["to"] >= x["place"]), joined).otherwise(fresh)

    return F.aggregate(covered, F.array().cast("array<struct<from:int,to:int>>"), step)


def _n_hit(covered: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        end = x["place"] + x["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["to"], x["place"]))).alias("n"), F.greatest(acc["to"], end).alias("to"))

    return F.aggregate(covered, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block: int = BLOCK) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows, sets = hits(docs, benchmark, n, block)
    shown = ["doc_id", "text_key", "n_words", "copies"]
    rows = rows.withColumn("n_hit", _n_hit(F.col("covered")))
    clean = rows.where("n_hit = 0").select(*shown, "n_hit", F.array().cast("array<string>").alias("items"))
    hit = rows.where("n_hit > 0").select(*shown, "n_hit", F.explode("sets").alias("set_id")).join(sets, "set_id")
    hit = hit.groupBy(*shown, "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = clean.unionByName(hit).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return both.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = 10, block: int = BLOCK) -> DataFrame:
    """The documents without what the test set holds: ``spans`` takes out each run of hit words with the signs between
    them, ``documents`` each document with a hit.  All columns and untouched texts, null ones too, stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    rows, _ = hits(docs, benchmark, n, block)
    hit = "hit"
    while hit in docs.columns:
        hit += "_"
    found = rows.where(F.size("covered") > 0).select(F.struct("doc_id", "text_key", _spans(F.col("covered")).alias("spans")).alias(hit))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(hit)["doc_id"]) & (text_key() == F.col(hit)["text_key"])
    if remove == "documents":
        return docs.join(found, match, "left_anti")
    cleaned = F.when(F.col(hit).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(hit)["spans"]))
    return docs.join(found, match, "left").withColumn("text", cleaned).select(docs.columns)


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and the gaps inside them: what lies between two spans, put together."""
    raw, gaps = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.split(text, RAW_WORD, -1)
    edges = F.concat(F.array(F.struct(F.lit(-1).alias("from"), F.lit(0).alias("to"))), spans)

    def between(x: Column, i: Column) -> Column:
        upto = F.when(i + 1 < F.size(edges), F.try_element_at(edges, i + 2)["from"]).otherwise(F.size(raw))
        places = F.when(upto > x["to"], F.sequence(x["to"], upto - 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.get(gaps, x["to"]), F.array_join(F.transform(places, lambda j: F.concat(F.get(raw, j), F.get(gaps, j + 1))), ""))

    return F.array_join(F.transform(edges, between), "")


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark
), starts AS (
  SELECT item, words, least(10, len(words)) AS l, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM items WHERE len(words) > 0
), grams AS (
  SELECT DISTINCT item, l, list_slice(words, i, i + l - 1) AS gram FROM starts
), places AS (
  SELECT doc_id, words, l, unnest(range(1, len(words) - l + 2)) AS i FROM w, (SELECT DISTINCT l FROM grams) WHERE len(words) >= l
), met AS (
  SELECT p.doc_id, p.i, p.l, g.item FROM places p JOIN grams g ON g.l = p.l AND g.gram = list_slice(p.words, p.i, p.i + p.l - 1)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM met)) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(held.n_items, 0) AS n_items,
  sha256(coalesce(held.items, '')) AS items_sha256, hit.n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""
