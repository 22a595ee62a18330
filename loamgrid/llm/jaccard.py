"""N-gram Jaccard join as a metric-space join: pivots, Voronoi regions, triangle-inequality windows, recursion.

Jaccard distance is a metric; documents link within ``RADIUS``.  Documents at distance 1 from all pivots would meet in
one region, so a region forms around what makes a distance below 1: a shingle.  The pivot of a region is its first document.

1.  A document with too many shingles that nobody else holds links to nothing and leaves early.  The others lie in the
    regions of their rarest shingles, as many as make two linked documents share one: a passage of many documents gives
    no region to documents that hold enough else.
2.  Regions of the same documents are one.  The distance of each document to the least pivot of its regions is computed;
    those within the radius link.  A region whose documents are now all linked is done: copies and near copies of one
    document take one distance each, however many there are.  In the other regions the distances to their pivots follow.
3.  What is left in a region joins recursively around more pivots, 16 times as many each time, against the region's
    other documents that are not linked yet, whose distances to the first pivot differ by the radius at most and whose
    sketches (parities of the set) allow a link.  The recursion ends when all are linked or each has been a pivot.
    Two documents meet once over all rounds: in the least region they share, when the first of the two is a pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamgrid.llm.base import arrow_schema, cut, documents, drop_settled, same, text_key
from loamgrid.llm.components import components
from loamgrid.llm.prints import BYTE, ODD, bucket_bits, joined_keys, mix, pieces_of, shared_prints, short, text_chunks, usable, with_answers
from loamgrid.session import has_rows

WORDS = 5
#: A pair links when 100 * intersection >= 75 * union.
PERCENT = 75
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Random odd factors of a byte's place in its word, which go on in blocks.
BLOCK = 4096
PLACE = np.random.default_rng(20240608).integers(1, 1 << 63, BLOCK, dtype=np.uint64) | np.uint64(1)
#: Words hashed at a time.
AT_ONCE = 50_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = BYTE[LOWER]
#: Bits of the longest sketch of a set.
SKETCHED = 1 << 14


def _word_hashes(data: np.ndarray, word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the words from ``starts`` to ``ends``, whose bytes are marked in ``word``: sums of values times factors of the place."""
    h = np.zeros(len(starts), np.uint64)
    for at in range(0, len(starts), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        length = ends[some] - starts[some]
        begin = np.cumsum(length) - length
        here = slice(starts[some][0], ends[some][-1])
        v = VALUE[data[here][word[here]]]
        place = np.arange(len(v)) - np.repeat(begin, length)
        v *= PLACE[place % BLOCK]
        far = np.flatnonzero(place >= BLOCK) if length.max() > BLOCK else []
        if len(far):
            v[far] = mix(v[far] + (place[far] // BLOCK).astype(np.uint64))
        h[some] = mix(np.add.reduceat(v, begin) + length.astype(np.uint64))
    return h


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, hash``: distinct 5-word shingles of each row, sorted by row and hash; 64-bit hashes stand for shingles."""
    word = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    before = np.r_[False, word[:-1]] & ~edge[:-1]
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    after = np.r_[~word[1:], True] | edge[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(word & after) + 1
    h = _word_hashes(data, word, starts, ends)
    count = np.diff(np.searchsorted(starts, offsets))
    row = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    # the words of a row with fewer than five make one shingle
    size = np.minimum(count, WORDS)[row]
    head = np.flatnonzero(np.arange(len(row)) - begin[row] + size <= count[row])
    r, size = row[head], size[head]
    s = size.astype(np.uint64)
    for i in range(WORDS):
        part = h[np.minimum(head + i, len(h) - 1)] * ODD[i]
        part[size <= i] = 0
        s += part
    s = mix(s)
    edges = np.searchsorted(r, np.arange(len(count) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        s[a:b].sort()
    new = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])]
    return r[new], s[new]


def may_miss(n: int) -> int:
    """Shingles of a set of ``n`` that a linked set can lack."""
    return n * (100 - PERCENT) // 100


def sketch(prints: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of the set falls on each of 2 to 4 bits a shingle, as 64-bit numbers.

    Where the sketches of two sets differ, one set holds what the other lacks: the bits that differ are at most those.
    """
    bits = min(SKETCHED, max(64, 2 << int(len(prints) - 1).bit_length()))
    odd = np.bincount((prints & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _may_link(a: Column, b: Column, both: Column) -> Column:
    """False if the sketches ``a, b`` show that sets with ``both`` shingles in all don't link; the longer one is folded once."""

    def folded(x: Column, other: Column) -> Column:
        n = F.size(other)
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    differ = F.zip_with(folded(a, b), folded(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    least = F.aggregate(differ, F.lit(0), lambda n, x: n + x)
    return F.coalesce(least * (100 + PERCENT) <= both * (100 - PERCENT), F.lit(True))


def _prints(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at, _, data, offsets in text_chunks(column):
        row, s = shingles(data, offsets)
        yield row + at, s


def _sets(df: DataFrame) -> DataFrame:
    """Per row: size and 128-bit signature of the set and, for what may link, the text, the keys of its shared shingles and its sketch."""
    bits = bucket_bits(df.sparkSession)
    names = df.columns
    ddl = "doc_id long, text_key long, n_shingles long, sig1 long, sig2 long, text string, regions array<long>, sketch array<long>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(names.index("text")), batch.column(names.index("keys"))
            for at, end, data, offsets in text_chunks(texts):
                row, s = shingles(data, offsets)
                n = np.bincount(row, minlength=end - at)
                begin = np.cumsum(n) - n
                full = np.flatnonzero(n)
                sig = [np.zeros(end - at, np.int64) for _ in range(2)]
                for k, odd in enumerate((ODD[1], ODD[5])):
                    sig[k][full] = np.add.reduceat(mix(s * odd + np.uint64(k)), begin[full]).view(np.int64) if len(full) else 0
                shown, regions, sketches = [], [], []
                for r in range(end - at):
                    part = keys[at + r].as_py()
                    size = int(n[r])
                    text = region = drawn = None
                    if part and size:
                        mine = short(s[begin[r] : begin[r] + size], bits)
                        hit = within(mine, joined_keys(part))
                        if size - hit.sum() <= may_miss(size):
                            text = texts[at + r].as_py()
                            region = mine[hit].view(np.int64)
                            drawn = sketch(s[begin[r] : begin[r] + size])
                    shown.append(text)
                    regions.append(region)
                    sketches.append(drawn)
                cols = [batch.column(names.index(c)).slice(at, end - at) for c in ("doc_id", "text_key")]
                cols += [pa.array(n, pa.int64()), pa.array(sig[0]), pa.array(sig[1]), pa.array(shown, pa.string()), pa.array(regions, schema.field(6).type), pa.array(sketches, schema.field(7).type)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return df.mapInArrow(run, ddl)


def within(some: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Which of ``some`` are among the sorted ``every``."""
    if not len(every):
        return np.zeros(len(some), bool)
    return every[np.minimum(np.searchsorted(every, some), len(every) - 1)] == some


def _overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, shared, union_size`` of ``pairs(a, b)``: exact set sizes from both whole texts, a batch at a time."""
    one = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    ddl = "a long, b long, shared long, union_size long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = batch.num_rows
                sets = []
                for i in (2, 3):
                    parts = [(np.bincount(r, minlength=end - at), s) for at, end, d, o in text_chunks(batch.column(i)) for r, s in [shingles(d, o)]]
                    sets.append(np.split(np.concatenate([p[1] for p in parts]), np.cumsum(np.concatenate([p[0] for p in parts]))[:-1]))
                shared = np.array([within(a, b).sum() for a, b in zip(*sets)])
                union = np.array([len(a) + len(b) for a, b in zip(*sets)]) - shared
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], schema=schema)

    return two.mapInArrow(run, ddl)


LINKED = f"100 * shared >= {PERCENT} * union_size"


def _rare_regions(regions: DataFrame) -> DataFrame:
    """``region, rid, n``: for what may link, the regions of its rarest shingles.

    Of ``may_miss(n) + 1`` shingles of a set, a linked one holds one at least.  Taken by one order of all shingles, those of
    two linked sets meet: the first shingle they share has at most ``may_miss(n)`` before it in either.  What no other
    document holds comes first in that order and makes no region.
    """
    crowd = regions.groupBy("region").agg(F.count("*").alias("m")).where("m > 1")
    one = regions.join(crowd, "region").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("m", "region"))).alias("all"))
    # may_miss(n) + 1, without those held alone
    few = (F.expr(f"n * (100 - {PERCENT}) div 100") + 1 - (F.col("n") - F.size("all"))).cast("int")
    rare = one.where(few > 0).select("rid", "n", F.explode(F.slice("all", F.lit(1), few)).alias("x"))
    return rare.select("rid", "n", "x.region")


def _placed(regions: DataFrame) -> DataFrame:
    """``region, rid, n, pivot, m``: regions of two documents or more, each with its first document and its size.

    Regions that hold the same documents (by count and 128 bits of their ids) are one: what follows a shared passage
    shingle by shingle makes many of them, and each would give the same pairs again.
    """
    held = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"held{k}") for k in (1, 2)]
    crowd = regions.groupBy("region").agg(F.min("rid").alias("pivot"), F.count("*").alias("m"), *held).where("m > 1")
    one = crowd.groupBy("pivot", "m", "held1", "held2").agg(F.min("region").alias("region"))
    return regions.join(one.select("region", "pivot", "m"), "region")


def _in_turn(placed: DataFrame) -> DataFrame:
    """``placed`` with ``turn``, a document's place among the pivots of a region, and ``before``, its open regions that are less."""
    every = placed.groupBy("rid").agg(F.collect_set("region").alias("every"))
    turn = F.pmod(F.xxhash64("rid", "region"), F.col("m"))
    before = F.filter("every", lambda r: r < F.col("region"))
    return placed.join(every, "rid").withColumns({"turn": turn, "before": before}).drop("every")


def _meeting(placed: DataFrame, low: int, high: int) -> DataFrame:
    """``a, b``: pivots whose turn is from ``low`` to ``high`` and the region's documents of later turns that they may link with.

    A pair is in the least region that both are in only, and no pair comes again in a later round.
    """
    radius = 1 - PERCENT / 100 + 1e-9
    p = placed.where((F.col("turn") >= low) & (F.col("turn") < high)).alias("p")
    x = placed.where(F.col("turn") >= low).alias("x")
    after = F.struct("p.turn", "p.rid") < F.struct("x.turn", "x.rid")
    near = F.abs(F.col("p.d") - F.col("x.d")) <= radius
    sizes = F.least("p.n", "x.n") * 100 >= F.greatest("p.n", "x.n") * PERCENT
    like = _may_link(F.col("p.sketch"), F.col("x.sketch"), F.col("p.n") + F.col("x.n"))
    here = ~F.arrays_overlap("p.before", "x.before")
    more = p.join(x, (F.col("p.region") == F.col("x.region")) & (F.col("p.label") != F.col("x.label")) & after & near & sizes & like & here)
    return more.select(F.greatest("p.rid", "x.rid").alias("a"), F.least("p.rid", "x.rid").alias("b"))


def _still_open(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """``placed`` with ``label``, of the regions whose documents are not all linked."""
    now = placed.drop("label").join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    open_ = now.groupBy("region").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("region")
    return cut(now.join(open_, "region", "left_semi"))


def _with_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        of = labels.select(F.col("rid").alias(end), F.col("label").alias(f"label_{end}"))
        links = links.join(of, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    return links


def _merging(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Of ``links(a, b)`` one for each two labels: those within a label add nothing, and one joins two."""
    two = [F.least("label_a", "label_b").alias("low"), F.greatest("label_a", "label_b").alias("high")]
    return _with_labels(links, labels).where("label_a <> label_b").groupBy(*two).agg(F.min(F.struct("a", "b")).alias("x")).select("x.a", "x.b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(rid, label)`` after ``links(a, b)``: only labels are put together, not again all that was linked before."""
    merging = cut(_merging(links, labels))
    if not has_rows(merging):
        return labels
    joins = _with_labels(merging, labels).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    least = components(joins).select(F.col("node").alias("label"), F.col("label").alias("now"))
    old = labels.join(least, "label", "left").select("rid", F.coalesce("now", "label").alias("label"))
    alone = least.select(F.col("label").alias("rid"), F.col("now").alias("label")).join(labels, "rid", "left_anti")
    return cut(old.unionByName(alone))


def _linked(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """``rid, label``: the least ``rid`` that links within ``regions(region, rid, n)`` lead to; ``texts`` has ``rid, text, sketch``."""
    rare = cut(_rare_regions(regions), free=True)
    drop_settled(regions)
    placed = cut(_placed(rare), free=True)
    drop_settled(rare)

    # a document and the least pivot of its regions: one distance each, which closes the regions of near copies
    pairs = placed.where("rid <> pivot").groupBy(F.col("rid").alias("a")).agg(F.min("pivot").alias("b"))
    known = cut(_overlaps(pairs, texts), free=True)
    labels = components(known.where(LINKED).select("a", "b")).withColumnRenamed("node", "rid")
    now = _still_open(placed, labels)
    drop_settled(placed)
    placed = now
    # the other pivots of the regions that are left
    pairs = placed.where("rid <> pivot").select(F.col("rid").alias("a"), F.col("pivot").alias("b")).distinct()
    new = cut(_overlaps(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), texts), free=True)
    known = known.unionByName(new)
    labels = _merged(labels, new.where(LINKED).select("a", "b"))
    distance = known.select(F.col("a").alias("rid"), F.col("b").alias("pivot"), (1 - F.col("shared") / F.col("union_size")).alias("d"))
    placed = placed.join(distance, ["rid", "pivot"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    low, high = 0, 16
    while True:
        now = _still_open(placed, labels)
        drop_settled(placed) if low else None
        placed = now
        if placed.limit(1).count() == 0:
            return labels
        drawn = _in_turn(placed).where("rid <> pivot").join(texts.select("rid", "sketch"), "rid")
        more = _meeting(drawn, low, high).distinct()
        new = cut(_overlaps(more.join(known.select("a", "b"), ["a", "b"], "left_anti"), texts), free=True)
        known = known.unionByName(new)
        labels = _merged(labels, new.where(LINKED).select("a", "b"))
        if placed.where(F.col("m") > high).limit(1).count() == 0:  # each document of each open region has been a pivot
            return labels
        low, high = high, 16 * high


def _labelled(docs: DataFrame) -> DataFrame:
    """:func:`jaccard_components` with ``part``, which tells components of one id apart; null without shingles or doc_id."""
    # no name holds the first plans, so that their shuffle files can go once they are written: the fingerprints before the texts move
    whole = documents(docs).withColumn("text_key", text_key())
    answers = cut(shared_prints(usable(whole), _prints), free=True)
    base = cut(_sets(with_answers(whole, answers)).withColumn("rid", F.monotonically_increasing_id()), free=True)
    drop_settled(answers)
    member = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    shape = ["n_shingles", "sig1", "sig2"]
    classes = cut(member.groupBy(*shape).agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("text").isNotNull(), F.col("rid"))).alias("rid")))
    lone = classes.where("rid IS NOT NULL")
    texts = cut(base.join(lone.select("rid"), "rid", "left_semi").select("rid", "n_shingles", "text", "regions", "sketch"))
    regions = cut(texts.select("rid", F.col("n_shingles").alias("n"), F.explode("regions").alias("region")))
    labels = _linked(regions, texts.select("rid", "text", "sketch"))
    tagged = lone.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    smallest = tagged.groupBy("label").agg(F.min("least").alias("component"))
    found = tagged.join(smallest, "label").select(*shape, F.col("component"), "label")
    every = classes.join(found, shape, "left").select(*shape, F.coalesce("component", "least").alias("component"), F.struct("label", *(F.when(F.col("label").isNull(), F.col(c)).alias(c) for c in shape)).alias("part"))
    out = base.drop("rid", "text", "regions", "sketch").join(every, shape, "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), F.when(linked, F.col("part")).alias("part"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id``: one row per row of ``docs``.

    Texts with equal sets are one class from the start; the members of a class take its component.  Null, empty and
    wordless texts have no shingles and are components of their own, as are rows without doc_id (whose component is
    null); rows that repeat a doc_id with one text repeat the row.  Hash collisions of 64 bits are not told apart.
    """
    return _labelled(docs).drop("part")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: of the least doc_id, then of the least text hash.

    Rows that repeat it are kept once; rows without doc_id are components of their own and all stay.  Only rows that
    are repeated are dealt out whole.
    """
    found = _labelled(docs).where("component_id <=> doc_id").groupBy("doc_id", "text_key", "part").agg(F.count("*").alias("n"))
    single = found.where("part IS NULL").select("doc_id", "text_key", "n")
    linked = found.where("part IS NOT NULL").groupBy("part").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("first")).select("first.*")
    found = cut(single.unionByName(linked))
    keyed = docs.withColumn("text_key", text_key())
    again = found.where("n > 1 AND doc_id IS NOT NULL")
    once = found.where("n = 1 OR doc_id IS NULL")
    kept = keyed.join(once, same(keyed, once, "doc_id", "text_key"), "left_semi")
    repeated = keyed.join(again, same(keyed, again, "doc_id", "text_key"), "left_semi").dropDuplicates(["doc_id", "text_key"])
    return kept.unionByName(repeated).drop("text_key")
