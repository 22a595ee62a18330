"""Decontamination, collocations and resampling against brute-force versions and on hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import collocations, contamination, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, gram string, hit string, rank long"
ITEMS = "item_id long, text string, set_id long, w string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(d, t, r[0] if r else lang, "s", "g", "h", 1) for d, t, *r in rows], DOCS).repartition(3)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 5, "w") for i, t in rows], ITEMS)


# --- decontamination ---


def brute_contamination(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        own = words(text)
        hit, held = set(), set()
        for item, t in items:
            theirs = words(t)
            size = min(n, len(theirs))
            grams = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
            for i in range(len(own) - size + 1):
                if size and tuple(own[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    held.add("" if item is None else str(item))
        out.append((doc_id, len(own), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "Ünder", "𝒳x", "don"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(9, 25)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "... !"), (33, "only three words"), (34, "Solo"), (None, "a null item has these eleven words in it all right now"), (2, items[5][1]), (36, items[4][1])]
    docs = [(None, items[1][1]), (0, None), (1, ""), (2, "  .,;"), (3, items[3][1].upper()), (4, "solo"), (5, "x only, THREE -- words y"), (6, "a null item has these eleven words in it all right now")]
    docs += [(10 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    docs += [(60 + i, "before " + items[i][1].replace(" ", " - ") + " after, " + items[i + 1][1]) for i in range(20)]
    docs += [docs[12], docs[12], (12, "another text of the same id " + items[7][1]), (99, " ".join(items[9][1] for _ in range(400)))]
    return docs, items


@pytest.mark.parametrize("block", [400_000, 60])
def test_contamination_brute(spark, leaks, block):
    docs, items = leaks
    got = contamination.contamination(frame(spark, docs), benchmark(spark, items), block=block)
    rows = Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert rows == brute_contamination(docs, items)


def test_contamination_empty(spark, leaks):
    docs, items = leaks
    got = contamination.contamination(frame(spark, docs), benchmark(spark, [])).collect()
    assert len(got) == len(docs) and not any(r.contaminated for r in got)
    assert contamination.contamination(frame(spark, []), benchmark(spark, items)).count() == 0


def test_decontaminate_spans(spark, leaks):
    docs, items = leaks
    out = contamination.decontaminate(frame(spark, docs), benchmark(spark, items))
    assert out.columns == [f.split()[0] for f in DOCS.split(", ")]
    left = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter()
    for doc_id, text in docs:
        own = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        low = words(text)
        hit = set()
        for _, t in items:
            theirs = words(t)
            size = min(10, len(theirs))
            for i in range(len(low) - size + 1):
                if size and any(low[i : i + size] == theirs[j : j + size] for j in range(len(theirs) - size + 1)):
                    hit.update(range(i, i + size))
        keep, at = "", 0
        for i, m in enumerate(own):
            if i in hit:
                keep += "" if i - 1 in hit else text[at : m.start()]
                at = m.end()
        want[(doc_id, text if not hit else keep + text[at:])] += 1
    assert left == want


def test_decontaminate_documents(spark, leaks):
    docs, items = leaks
    out = contamination.decontaminate(frame(spark, docs), benchmark(spark, items), remove="documents").collect()
    clean = Counter((d, t) for d, t in docs if not next(iter(brute_contamination([(d, t)], items)))[-1])
    assert Counter((r.doc_id, r.text) for r in out) == clean


# --- collocations ---


def brute_collocations(docs, least, longest, top):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(found)
            for k in range(1, longest + 1):
                for i in range(len(found) - k + 1):
                    f[lang, tuple(found[i : i + k])] += 1
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = {(lang, g[i : i + k]) for (lang, g), a in candidates.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if a >= f[lang, g[i : i + k]]}
    rows = []
    for (lang, g), a in candidates.items():
        if (lang, g) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            rows.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]], n[lang]))
    out, at = [], Counter()
    for lang, score, a, phrase, left, right, words in sorted(rows):
        at[lang] += 1
        if at[lang] <= top:
            out.append((lang, at[lang], phrase.decode(), -a, left, right, words, -score))
    return sorted(out)


def phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    vocabulary = ["the", "of", "new", "york", "city", "Hall", "of,", "fame.", "été", "a\tb", "zo\x85o", "im　an"] + [f"r{i}" for i in range(200)]
    docs = []
    for i in range(150):
        text = " ".join(rng.choice(vocabulary[: rng.choice([12, 12, 212])]) for _ in range(rng.randint(0, 60)))
        text += rng.choice(["", " one two three four five six seven eight nine ten eleven", "\nhip hip hip hip hip hip hip hip", " New York City hall"])
        docs.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return [*docs, (None, None, "en"), (7, "", "en"), (8, " \t. ,", None), docs[3], docs[3]]


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (8, 5, 7), (2, 3, 2000), (4, 2, 50)])
def test_collocations_brute(spark, talk, least, longest, top):
    got = phrases(collocations.collocations(frame(spark, talk), least, longest, top))
    assert got == brute_collocations(talk, least, longest, top)
    assert len(got) > 20 or top < 20 or longest == 2


def test_collocations_sieve(spark):
    docs = frame(spark, [(1, "New york, new york. the york new", "en"), (2, "the the", "fr")])
    bits = collocations.sieve(docs, 2, [])
    keys = collocations.hashes("en", pa.array(["new", "york", "the"]))
    assert collocations.listed(bits, keys).tolist() == [True, True, False]
    assert collocations.listed(bits, collocations.hashes("fr", pa.array(["the", "new"]))).tolist() == [True, False]
    pairs = collocations.sieve(docs, 2, [bits])
    assert collocations.listed(pairs, collocations.pair_hashes(keys[[0, 1]], keys[[1, 0]])).tolist() == [True, False]


def test_chunks_of_long_texts(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 40)
    texts = ["a b. " * 30, "x" * 100, "", "y" * 60 + ". c d", "e\tf\ng", "h i"]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 5 + ["fr"], "text": texts})
    found = Counter()
    for lang, text in collocations.chunks([batch, batch]):
        codes, names, joined = collocations.tokens(text)
        names = names.to_pylist()
        found.update((lang, names[c]) for c in codes)
        found.update((lang, names[a], names[b]) for a, b, j in zip(codes, codes[1:], joined) if j)
    assert found == Counter({("en", "a"): 60, ("en", "b"): 60, ("en", "a", "b"): 60, ("en", "x" * 100): 2, ("en", "y" * 60): 2, ("en", "c"): 2, ("en", "d"): 2,
                             ("en", "c", "d"): 2, ("en", "e"): 2, ("en", "f"): 2, ("en", "g"): 2, ("en", "e", "f"): 2, ("fr", "h"): 2, ("fr", "i"): 2, ("fr", "h", "i"): 2})


def test_collocations_none(spark, talk):
    assert collocations.collocations(frame(spark, talk)).count() <= 20  # least 100
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, "a b c", "en")])).count() == 0


def test_paths_rings_and_stretches(spark, monkeypatch):
    """A long path is cut into stretches, a ring's edges stay alone, and each edge is in one path."""
    monkeypatch.setattr(collocations, "STRETCH", 4)
    line = [f"a{i}" for i in range(14)]
    ring = ["x", "y", "z", "u", "v", "t", "s"]
    grams = [" ".join(line[i : i + 5]) for i in range(10)] + [" ".join((ring * 2)[i : i + 5]) for i in range(7)]
    inner = [" ".join(line[i : i + 4]) for i in range(1, 10)] + [" ".join((ring * 2)[i : i + 4]) for i in range(7)]
    edges = spark.createDataFrame([("en", g, 9) for g in grams], "lang string, gram string, n long")
    nodes = spark.createDataFrame([("en", g) for g in inner], "lang string, gram string")
    found = sorted(r.words for r in collocations.unary_paths(edges, nodes, 5).collect())
    runs = [w.split() for w in found]
    assert sorted(" ".join(r[i : i + 5]) for r in runs for i in range(len(r) - 4)) == sorted(grams)
    assert sorted(map(len, runs)) == sorted([5] * 7 + [8, 8, 6])


# --- resampling ---


def brute_resample(docs, items, percent, min_words, buckets, longest, seed):
    def of(text):
        w = words(text)
        runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = Counter(), Counter()
    for rows, c in ((docs, s), (items, t)):
        for _, text in rows:
            c.update(of(text)[1])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, text in docs:
        n, at = of(text)
        weight = sum(gain[b] for b in at) // len(at) if at else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], float("inf") if r[0] is None else r[0]))
    k = percent * len(fit) // 100
    return [(*r[:4], i if i <= k else None) for i, r in enumerate(fit, 1)] + [(*r[:4], None) for r in rows if not r[4]]


@pytest.fixture(scope="module")
def pool():
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)] + ["naïve", "Q9", "日本"]
    docs = [(i * 3, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    items = [(i, " ".join(rng.choice(vocabulary[:20]) for _ in range(25))) for i in range(10)]
    return [*docs, (1, None), (2, ""), (4, "-- ?"), (None, docs[9][1])], [*items, (None, None), (77, "")]


@pytest.mark.parametrize(("percent", "buckets", "longest"), [(25, 10_000, 2), (60, 7, 1), (100, 50, 3), (0, 50, 2)])
def test_resample_brute(spark, pool, percent, buckets, longest, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 17)
    docs, items = pool
    got = resampling.resample(frame(spark, docs), benchmark(spark, items), percent=percent, buckets=buckets, longest=longest)
    rows = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert Counter(rows) == Counter(brute_resample(docs, items, percent, 20, buckets, longest, 7))


def test_cutoff_among_ties(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PROBES", 3)
    rows = [(5, 1), (5, 2**62), (5, -(2**62)), (5, 9), (5, 9), (5, 9), (-10**9, 4), (7, 1), (7, 1)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "least long, id long, row long")
    for n in range(1, len(rows) + 1):
        got = resampling.ranked(df.where(resampling.drawn(df, n)), n)
        want = sorted((a, b, i) for i, (a, b) in enumerate(rows))[:n]
        assert sorted((r.rank, r.least, r.id, r.row) for r in got.collect()) == [(k, *w) for k, w in enumerate(want, 1)]


def test_resample_repeats_and_empty(spark, pool):
    docs, items = pool
    same = [(5, docs[9][1] + " more words so that there are twenty of them " * 3)] * 8 + [(6, "too few")]
    got = resampling.resample(frame(spark, same), benchmark(spark, items)).collect()
    assert len(got) == 9 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert resampling.resample(frame(spark, []), benchmark(spark, items)).count() == 0
    assert resampling.resample(frame(spark, docs), benchmark(spark, [])).count() == len(docs)
    out = resampling.importance_sample(frame(spark, docs), benchmark(spark, items))
    drawn = {r["doc_id"] for r in resampling.resample(frame(spark, docs), benchmark(spark, items)).collect() if r["rank"]}
    assert out.columns[0] == "doc_id" and {r.doc_id for r in out.collect()} == drawn


def test_scores_of_a_hot_bucket_do_not_wrap(spark):
    text = "same " * 20_000
    rows = resampling.scored(frame(spark, [(1, text)]), resampling.gains(*(resampling.bucket_counts(frame(spark, [(1, text)]), 5),) * 2)).select("weight", "n_features").first()
    assert tuple(rows) == (0, 39_999)


def test_words_of_columns_and_bytes_agree(spark):
    text = "".join(map(chr, range(1, 300))) + " ÀÉ ß Ωmega 𝒳 A1b"
    row = spark.createDataFrame([(text,)], "text string").select(contamination.words(F.col("text"))).first()[0]
    assert row == words(text) == [w.decode() for w in text.encode().translate(resampling.FOLD).split()]


def test_chunks_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 60), pa.array(["word " * 20_000] * 60)], names=["lang", "text"])
    sizes = [len(t) for _, t in collocations.chunks([batch])]
    assert sum(sizes) >= 6_000_000 and max(sizes) < 3 << 20


def test_texts_and_rows_go_a_few_at_a_time():
    """A batch of many texts is worked on in small parts, and what a task sends comes in small batches."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5000), pa.array(["word " * 400] * 5000)], names=["lang", "text"])
    sizes = [len(t) for _, t in collocations.chunks([batch])]
    assert sum(sizes) > 9_900_000 and max(sizes) < 3 << 19
    rows = pa.RecordBatch.from_arrays([pa.array(range(50_001))], names=["n"])
    parts = list(collocations._sliced(rows))
    assert max(p.num_rows for p in parts) <= 20_000 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([rows]))
