"""Which fingerprints of a document also lie in another one: an exchange of packed fingerprints.

Tasks send the distinct fingerprints of each run (what they put in order at a time) as packed arrays dealt by their
leading bits, one entry for a fingerprint and run however many documents hold it, so a frequent fingerprint stays small.
The receiver takes its buckets in order, one at a time, and answers the one document that sent a fingerprint; where
several documents of a run share one, the sender answers them itself.  Fingerprints lose their last bits on the way, so
an answer may name a few too many, never too few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamgrid.llm.base import arrow_schema

#: Bits of a fingerprint that travel beside those of its bucket.
LOW = 32
#: Bytes of text that are worked on at a time.
CHUNK = 1 << 20
#: Fingerprints put in order at a time, beyond those of one chunk.
HELD = 400_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[1]
    h = (h ^ (h >> np.uint64(29))) * ODD[3]
    return h ^ (h >> np.uint64(32))


def bucket_bits(spark) -> int:
    return max(11, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 5)


def short(prints: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints as they travel."""
    return prints >> np.uint64(64 - bits - LOW)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, end row, bytes, row offsets in them`` of runs of rows of about CHUNK bytes (a longer row alone)."""
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def pieces_of(row: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Runs of equal values of the sorted ``row``: the value and the slices of ``columns``."""
    if len(row):
        edges = np.flatnonzero(np.diff(row)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, len(row)]):
            yield int(row[a]), *[c[a:b] for c in columns]


def planes(ids: np.ndarray) -> bytes:
    """64-bit numbers with their bytes of equal weight side by side, which compress well."""
    return ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


#: Answers for one range of documents that go into one row.
PACKED = 1 << 20
RANGED = "part int, ids binary, entries binary"
RANGED_ARROW = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("entries", pa.binary())])


def by_range(ids: np.ndarray, entries: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """``part, ids, entries`` (RANGED): 64-bit entries for ids side by side, a row for each range of hashed ids and PACKED entries."""
    part = (mix(ids.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((ids, part))
    rows = []
    for p, i, e in pieces_of(part[order], ids[order], entries[order]):
        rows += [(p, planes(i[at : at + PACKED]), planes(e[at : at + PACKED])) for at in range(0, len(i), PACKED)]
    for at in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at : at + 1000]), RANGED_ARROW)], schema=RANGED_ARROW)


def by_id(ranged: DataFrame, ranges: int, name: str, entries: str) -> DataFrame:
    """One row per id, with all its entries, from the rows of :func:`by_range`.  Ranges come in order, one is held at a time."""
    ddl = f"{name} long, {entries} binary"
    schema = arrow_schema(ddl)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        now = None

        def told() -> Iterator[pa.RecordBatch]:
            ids, values = (np.concatenate([unplaned(h[k]) for h in held]) for k in (0, 1))
            held.clear()
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            del order
            for some in batched(pieces_of(ids, values), 1000):
                rows = [(i, v.tobytes()) for i, v in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for part, i, e in rows_of(batch, 20):
                if part != now and held:
                    yield from told()
                now = part
                held.append((i, e))
        if held:
            yield from told()

    return ranged.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(unpack, ddl)


def held_prints(column: pa.Array, prints: Prints, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and :func:`short` prints in runs of about HELD; a row's prints stay together."""
    rows, keys, held = [], [], 0
    for r, p in prints(column):
        rows.append(r.astype(np.uint32))
        keys.append(short(p, bits))
        held += len(r)
        if held >= HELD:
            yield np.concatenate(rows), np.concatenate(keys)
            rows, keys, held = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(keys)


Prints = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]


def shared_prints(docs: DataFrame, prints: Prints) -> DataFrame:
    """``doc_id, keys``: for documents with a fingerprint of another one, packed unsigned 64-bit :func:`short` prints.

    ``docs`` has ``doc_id, text`` without nulls; ``prints`` yields (row of the batch, fingerprint) arrays.  A task answers by ranges of documents, so its rows do not grow with the
    documents that it meets; a document gets one row.
    """
    bits = bucket_bits(docs.sparkSession)
    sent = "bucket int, echo boolean, keys binary, docs binary"
    sent_schema = arrow_schema(sent)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        runs = ((batch.column(0).to_numpy(zero_copy_only=False), *run) for batch in batches for run in held_prints(batch.column(1), prints, bits))
        for ids, rows, keys in runs:
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[order], keys[order]
            doc = ids[rows]
            del order, rows
            first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            lead = doc[first][group]
            several = np.zeros(int(first.sum()), bool)
            several[group[doc != lead]] = True
            k, d = keys[first], np.where(several, -1, doc[first])
            flag = several.astype(np.uint8)
            out: list[tuple] = []
            low = np.uint64((1 << LOW) - 1)
            # the ids of a flagged key are sent as zero; the flags are packed behind the keys
            for b, kk, dd, ff in pieces_of((k >> np.uint64(LOW)).astype(np.int64), (k & low).astype("<u4"), np.where(several, 0, d), flag):
                out.append((b, False, kk.tobytes() + np.packbits(ff).tobytes(), planes(dd)))
            echo = several[group]
            for at in range(0, int(echo.sum()), 20_000):
                salt += 1
                kk, dd = keys[echo][at : at + 20_000], doc[echo][at : at + 20_000]
                out.append(((1 << bits) + hash((int(ids[0]), salt)) % (1 << bits), True, kk.astype("<u8").tobytes(), planes(dd)))
            for at in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out[at : at + 2000]), sent_schema)], schema=sent_schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for k, d in asked(batches):
            found.append((k, d))
            size += len(k)
            if size >= HELD:
                yield from answered(found, partitions)
                found, size = [], 0
        yield from answered(found, partitions)

    sent_rows = docs.select("doc_id", "text").mapInArrow(send, sent)
    answers = sent_rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, RANGED)
    return by_id(answers, partitions, "doc_id", "keys")


def answered(found: list[tuple[np.ndarray, np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    if found:
        k, d = (np.concatenate(c) for c in zip(*found))
        yield from by_range(d, k.view("<i8"), ranges)


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and the documents to be told of them, from rows in order of ``bucket``; one bucket is held at a time."""
    held: list[tuple[bytes, bytes]] = []
    now = None
    for batch in batches:
        for b, echo, raw, ids in rows_of(batch):
            if b != now and held:
                yield in_bucket(now, held)
                held = []
            now = b
            if echo:
                yield np.frombuffer(raw, dtype="<u8"), unplaned(ids)
            else:
                held.append((raw, ids))
    if held:
        yield in_bucket(now, held)


def in_bucket(bucket: int, held: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """What the senders of a bucket's rows are told: keys that another run sent too, or one run for several documents."""
    ids = [unplaned(i) for _, i in held]
    k = np.concatenate([np.frombuffer(raw, dtype="<u4", count=len(i)) for (raw, _), i in zip(held, ids)])
    f = np.concatenate([np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=4 * len(i)), count=len(i)) for (raw, _), i in zip(held, ids)])
    d = np.concatenate(ids)
    order = np.argsort(k, kind="stable")
    k, d, f = k[order], d[order], f[order].astype(bool)
    first = np.r_[True, k[1:] != k[:-1]]
    group = np.cumsum(first) - 1
    hit = np.zeros(int(first.sum()), bool)
    hit[group[(d != d[first][group]) | f]] = True
    hit[group[np.r_[False, ~first[1:]]]] = True  # from two runs
    ask = hit[group] & ~f
    return k[ask].astype(np.uint64) | np.uint64(bucket << LOW), d[ask]


def rows_of(batch: pa.RecordBatch, at_once: int = 100) -> Iterator[tuple]:
    """The rows of a batch as Python values, a few at a time."""
    for at in range(0, batch.num_rows, at_once):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, at_once).columns))


def usable(docs: DataFrame) -> DataFrame:
    """What can share a fingerprint."""
    return docs.where("doc_id IS NOT NULL AND text <> ''")


def with_answers(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """``docs`` and ``keys``, the array of their packed prints in the ``answers`` of :func:`shared_prints` (null: none)."""
    found = answers.select(F.col("doc_id").alias("of"), F.array("keys").alias("keys"))
    return docs.join(found.hint("shuffle_hash"), docs.doc_id == found.of, "left").drop("of")


def with_shared(docs: DataFrame, prints: Prints) -> DataFrame:
    """``docs`` and ``keys``, the array of packed :func:`short` prints shared with other documents (null: none)."""
    return with_answers(docs, shared_prints(usable(docs), prints))


def joined_keys(parts: list[bytes] | None) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(parts or []), dtype="<u8"))
