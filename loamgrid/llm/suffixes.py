"""Suffix-array dedup: bytes in a string of ``length`` bytes that starts in an earlier document are removed.

1.  The least hash among the ``GRAM``-byte strings of a window of ``length`` bytes depends on the window alone.  A window
    whose least hash lies in one document only has no copy elsewhere and needs no suffix.
2.  The other windows travel as pieces: runs of windows with one least hash, dealt by it, so equal windows meet.  A batch
    sends each distinct piece once, for its earliest document; the batch's other holders are known to be later copies.
3.  There the windows are brought into suffix order (to the depth of ``length``).  Previous and next smaller positions in
    that order, where positions ascend with doc_id, give the longest previous factor; a window whose factor reaches
    ``length`` has an earlier copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from loamgrid.llm.base import arrow_schema, cut, documents
from loamgrid.llm.prints import BYTE, ODD, RANGED, bucket_bits, by_id, by_range, joined_keys, mix, pieces_of, planes, rows_of, short, text_chunks, unplaned, with_shared

GRAM = 24
#: Of the pieces' bytes on their way.
CODEC = "zstd"
#: Windows sorted at a time.
SORTED = 100_000
#: Distinct pieces held before they are sent, and windows known to be later copies.
HELD, TOLD = 80_000, 320_000
#: Windows placed at a time, and answers held before they are sent.
PLACED, ANSWERED = 2_000_000, 1_000_000
RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes, the least hash of its ``GRAM``-byte strings."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h = BYTE[data]
    sums = {1: h}
    for n, odd in ((2, ODD[0]), (4, ODD[1]), (8, ODD[2]), (16, ODD[3])):
        half = sums[n // 2]
        sums[n] = half[: len(half) - n // 2] * odd + half[n // 2 :]
    h = mix(sums[16][: len(data) - GRAM + 1] * ODD[4] + sums[8][16:][: len(data) - GRAM + 1])
    del sums
    wide = length - GRAM + 1
    n = 1
    while 2 * n <= wide:
        h = np.minimum(h[: len(h) - n], h[n:])
        n *= 2
    if n < wide:
        h = np.minimum(h[: len(h) - (wide - n)], h[wide - n :])
    return h


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``row, first window, end window, hash``: maximal runs of windows of one row with one least hash."""
    least = least_hashes(data, length)
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    if not len(row):
        return row, row, row, np.zeros(0, np.uint64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    value = least[place + offsets[row]]
    start = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
    end = np.r_[start[1:], len(row)]
    return row[start], place[start], place[end - 1] + 1, value[start]


def _prints(length: int):
    def prints(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, _, data, offsets in text_chunks(column):
            row, _, _, value = _runs(data, offsets, length)
            yield row + at, value

    return prints


def _candidates(df: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """Rows with ``runs`` (bits of those of the row's runs that may have copies) or, without any, done."""
    bits = bucket_bits(df.sparkSession)
    carried = [f for f in df.schema.fields if f.name not in ("text", "keys")]
    schema = StructType(carried + _parse_datatype_string(f"text string, runs binary, {RESULT}").fields)
    target, names = to_arrow_schema(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(names.index("text")), batch.column(names.index("keys"))
            for at, end, data, offsets in text_chunks(texts):
                raw = data.tobytes()
                row, _, _, value = _runs(data, offsets, length)
                found = {r: v for r, v in pieces_of(row, value)}
                out = []
                for r in range(end - at):
                    part = keys[at + r].as_py()
                    packed = None
                    if part and r in found:
                        hit = np.isin(short(found[r], bits), joined_keys(part))
                        if hit.any():
                            packed = np.packbits(hit).tobytes()
                    text = raw[offsets[r] : offsets[r + 1]]
                    shown = text.decode() if packed or keep_text else None
                    out.append((shown, packed, len(text), 0, 0, None if packed else hashlib.sha256(text).hexdigest()))
                cols = [batch.column(i).slice(at, end - at).cast(target.field(f.name).type) for f in carried for i in [names.index(f.name)]]
                cols += [pa.array(c, type=target.field(len(carried) + i).type) for i, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.mapInArrow(run, schema)


def _pieces(df: DataFrame, length: int) -> DataFrame:
    """``bucket, echo, meta, bytes``: distinct pieces of a batch, for its earliest document; windows of the others are answered."""
    # least hashes crowd at the low numbers; mixed again they fill the buckets evenly, so a few a partition are enough
    bits = bucket_bits(df.sparkSession) - 2
    out_ddl = "bucket int, echo boolean, meta binary, bytes binary"
    out_schema = arrow_schema(out_ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        best: dict[bytes, tuple] = {}
        later: list[tuple] = []

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal salt
            rows: list[tuple] = []
            flat = sorted(((v >> (64 - bits), k, doc, r, s) for k, (v, doc, at) in best.items() for r, s in at))
            if flat:
                meta = [np.array([x[i] for x in flat], dtype="<i8") for i in (2, 3, 4)]
                size = np.array([len(x[1]) for x in flat], dtype="<i8")
                for b, i in pieces_of(np.array([x[0] for x in flat]), np.arange(len(flat))):
                    part = slice(i[0], i[-1] + 1)
                    data = b"".join(x[1] for x in flat[part])
                    rows.append((b, False, planes(np.concatenate([m[part] for m in (*meta, size)])), pa.compress(data, CODEC, asbytes=True)))
            for at in range(0, len(later), 20_000):
                salt += 1
                got = np.array(later[at : at + 20_000], dtype="<i8")
                rows.append(((1 << bits) + hash((int(got[0, 0]), salt)) % (1 << bits), True, got.tobytes(), None))
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at : at + 1000]), out_schema)], schema=out_schema)
            best.clear()
            later.clear()

        for batch in batches:
            rids, docs, runs = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for at, _, data, offsets in text_chunks(batch.column(2)):
                raw = data.tobytes()
                for r, first, last, value in pieces_of(*_runs(data, offsets, length)):
                    hit = np.flatnonzero(np.unpackbits(np.frombuffer(runs[at + r], np.uint8), count=len(first)))
                    rid, doc, base = rids[at + r], docs[at + r], int(offsets[r])
                    for a, b, v in zip(first[hit].tolist(), last[hit].tolist(), mix(value[hit]).tolist()):
                        key = raw[base + a : base + b + length - 1]
                        was = best.get(key)
                        if was is None:
                            best[key] = (v, doc, [(rid, a)])
                        elif doc < was[1]:
                            later += [(i, s, len(key)) for i, s in was[2]]
                            best[key] = (v, doc, [(rid, a)])
                        elif doc == was[1]:
                            was[2].append((rid, a))
                        else:
                            later.append((rid, a, len(key)))
                if len(best) >= HELD or len(later) >= TOLD:
                    yield from send()
        yield from send()

    return df.select("rid", "doc_id", "text", "runs").mapInArrow(run, out_ddl)


def previous_smaller(value: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For each place of the order, the nearest one before it in its block with a smaller value, or -1."""
    at = np.arange(-1, len(value) - 1)
    at[block != np.r_[-1, block[:-1]]] = -1
    todo = np.flatnonzero(at >= 0)
    todo = todo[value[at[todo]] >= value[todo]]
    while len(todo):
        # each step skips a whole stretch that is known to be no smaller
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
        todo = todo[value[at[todo]] >= value[todo]]
    return at


def earlier_copies(windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows (rows of bytes) have a longest previous factor of full length: an equal row of a smaller ``doc``."""
    n, length = windows.shape
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = windows
    position = np.argsort(doc, kind="stable")
    wide, rank = wide[position], doc[position]
    order = np.argsort(wide.view(f"S{wide.shape[1]}").ravel(), kind="stable")
    words = wide.view("<u8")[order]
    rank = rank[order]
    common = np.r_[False, (words[1:] == words[:-1]).all(axis=1)]  # common prefix with the one before: full, or too short
    block = np.cumsum(~common)
    before = previous_smaller(rank, block)
    after = previous_smaller(rank[::-1], block[::-1])[::-1]
    out = np.zeros(n, bool)
    out[position[order]] = (before >= 0) | (after >= 0)
    return out


def _answers(df: DataFrame, length: int) -> DataFrame:
    """``rid, windows``: packed (first window, number) pairs of windows with an earlier copy, one row per rid.

    A task answers by ranges of rids, so its rows do not grow with the documents that it meets.  Its buckets come in order,
    one is held at a time.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def copied(metas: list[bytes], texts: list[bytes]) -> Iterator[np.ndarray]:
        """``rid, first window, number`` of the windows of one bucket with an earlier copy."""
        doc, rid, start, size = np.hstack([unplaned(m).reshape(4, -1) for m in metas])
        sizes = [int(unplaned(m).reshape(4, -1)[3].sum()) for m in metas]
        data = np.frombuffer(b"".join(pa.decompress(t, n, CODEC, asbytes=True) for t, n in zip(texts, sizes)), np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(data, length)
        n = size - length + 1  # windows of each piece
        first, base, total = np.cumsum(n) - n, np.cumsum(size) - size, int(n.sum())

        def placed(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The pieces of windows, by their number in the bucket, and their places there."""
            piece = np.searchsorted(first, window, side="right") - 1
            return piece, window - first[piece]

        # equal windows begin alike, so their first bytes split a large bucket
        parts = -(-total // SORTED)
        part = np.zeros(total, np.uint16 if parts <= 1 << 16 else np.uint32)
        for a in range(0, total if parts > 1 else 0, PLACED):
            piece, place = placed(np.arange(a, min(a + PLACED, total)))
            at = base[piece] + place
            word = sum(data[at + i].astype(np.uint64) << np.uint64(8 * i) for i in range(8))
            part[a : a + len(at)] = mix(word) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=parts))
        del part
        gone = np.zeros(total, bool)
        for a, b in zip(np.r_[0, ends[:-1]], ends):
            mine = order[a:b]
            piece, place = placed(mine)
            gone[mine] = earlier_copies(windows[base[piece] + place], doc[piece])
        del order
        edge = np.zeros(total + 1, bool)
        edge[first] = edge[-1] = True
        head = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]]))
        tail = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False]))
        if len(head):
            piece, place = placed(head)
            yield np.column_stack([rid[piece], start[piece] + place, tail - head + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas, texts, now = [], [], None
        found = []

        def answered() -> Iterator[pa.RecordBatch]:
            got = np.concatenate(found)
            found.clear()
            yield from by_range(got[:, 0], np.ascontiguousarray(got[:, 1:], dtype="<i4").view("<i8").ravel(), partitions)

        for batch in batches:
            for b, echo, meta, raw in rows_of(batch):
                if b != now and metas:
                    found += copied(metas, texts)
                    metas, texts = [], []
                now = b
                if echo:
                    got = np.frombuffer(meta, "<i8").reshape(-1, 3).copy()
                    got[:, 2] -= length - 1
                    found.append(got)
                else:
                    metas.append(meta)
                    texts.append(raw)
                if sum(map(len, found)) >= ANSWERED:
                    yield from answered()
        if metas:
            found += copied(metas, texts)
        if found:
            yield from answered()

    return by_id(df.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, RANGED), partitions, "rid", "windows")


def without(raw: bytes, windows: bytes | None, length: int) -> tuple[bytes, int, int]:
    """``raw`` without the bytes that the packed windows cover, how many those are, and in how many runs."""
    if not windows:
        return raw, 0, 0
    spans = np.frombuffer(windows, "<i4").reshape(-1, 2)
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1] + length - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_copies(docs: DataFrame, length: int = 50, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """``doc_id``, ``carry``, ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``kept`` (binary): a row per row of ``docs``.

    The first copy stays: of equal strings, those in the document with the least doc_id.  Null texts count as empty;
    rows without doc_id lose nothing and are no earlier copy; rows that repeat a doc_id do not shorten each other;
    texts shorter than ``length`` bytes stay whole.  Text is shuffled once, to meet the answers on its fingerprints, and
    once more where it has candidates.  A string in any number of documents is one entry for each batch.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    # no name holds the first plan, so that its shuffle files can go once it is written
    first = cut(_candidates(with_shared(documents(docs, *carry), _prints(length)), length, with_text).withColumn("rid", F.monotonically_increasing_id()), free=True)
    open_ = first.where("runs IS NOT NULL")
    answers = _answers(_pieces(open_, length), length).withColumnRenamed("rid", "of")
    told = open_.join(answers.hint("shuffle_hash"), open_.rid == answers.of, "left").drop("of", "rid", "runs", *[c.split()[0] for c in RESULT.split(", ")])
    kept = ", kept binary" if with_text else ""
    carried = [f for f in told.schema.fields if f.name not in ("text", "windows")]
    schema = StructType(carried + _parse_datatype_string(RESULT + kept).fields)
    target, names = to_arrow_schema(schema), told.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out = []
                for text, windows in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("windows")).to_pylist()):
                    raw = text.encode()
                    rest, gone, runs = without(raw, windows, length)
                    out.append((len(raw), gone, runs, hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
                cols = [batch.column(names.index(f.name)).cast(target.field(f.name).type) for f in carried]
                cols += [pa.array(c, type=target.field(len(carried) + i).type) for i, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(cols, schema=target)

    done = first.where("runs IS NULL")
    if with_text:
        done = done.withColumn("kept", F.encode("text", "UTF-8"))
    return done.select(*schema.fieldNames()).unionByName(told.mapInArrow(finish, schema))


def deduplicate(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with later copies taken out of ``text`` (a character cut in two goes) and ``n_chars`` counted anew.

    Documents of which nothing is left go; the others keep all their columns.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    df = remove_copies(docs.withColumn("was_null__", F.col("text").isNull()), length, (*others, "was_null__"), True)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("kept")
            text = pa.array([x.decode("utf-8", "ignore") for x in batch.column(i).to_pylist()], type=pa.string())
            yield batch.set_column(i, "kept", text)

    df = df.where("n_removed = 0 OR n_removed < n_bytes")
    text = df.mapInArrow(decode, StructType([*[f for f in df.schema.fields if f.name != "kept"], *_parse_datatype_string("kept string").fields]))
    made = {"text": F.when(~F.col("was_null__"), F.col("kept"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return text.withColumns(made).select(*docs.columns)
