"""Hard negatives, removal of repeated strings and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sunloom.llm import hardnegatives, importance, substrings


# hard negatives


def mined(rows):
    """Rows of hard negatives by scoring everything."""
    usable = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            moved = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            usable.append((i, [math.floor(256 * float(np.float32(x))) for x in v], moved))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = Counter()
    for k, (a, va, la) in enumerate(usable):
        if a is None or a % 100:
            continue
        scored = [(score(va, v), i, label) for j, (i, v, label) in enumerate(usable) if j != k]
        for ps, p, _ in sorted((t for t in scored if t[2] == la), key=key)[:5]:
            fits = sorted((t for t in scored if t[2] != la and 30 * ps <= 100 * t[0] <= 90 * ps), key=key)
            for rank, (ns, n, _) in enumerate(fits[:10], 1):
                out[a, p, rank, n, ps, ns] += 1
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, anchor string, score long, v long")


@pytest.mark.parametrize(("seed", "block"), [(0, 1 << 20), (1, 64 * 8), (2, 64 * 8)])
def test_hard_negatives(spark, monkeypatch, seed, block):
    rng = random.Random(seed)
    monkeypatch.setattr(hardnegatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hardnegatives, "CHUNK_BYTES", 256)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(4)]
    data = []
    for i in range(320):
        c = rng.choice(centres)
        grid = rng.random() < 0.5  # coarse components, so that many scores tie
        data.append((i * 5, [(round(x * 4) / 4 if grid else x + rng.gauss(0, 0.1)) for x in c], rng.randint(0, 4)))
    data += [(0, [0.5] * 6, 1)] * 3 + [(100, [0.0] * 6, 2), (None, [0.5] * 6, 1), (1, None, 1), (2, [0.5] * 6, None), (3, [float("nan")] * 6, 1)]
    data += [(4, [float("inf")] + [0.1] * 5, 1), (5, [None] * 6, 1), (700, [], 3), (6, [0.4] * 9, 2), (-100, [-0.5] * 6, 1), (None, None, None)]
    got = hardnegatives.hard_negatives(vectors(spark, data))
    assert Counter(tuple(r) for r in got.collect()) == mined(data)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_hard_negatives_of_little_or_nothing(spark):
    for data in ([], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 1)], [(1, [1.0], 1), (2, [0.5], 2)]):
        assert hardnegatives.hard_negatives(vectors(spark, data)).count() == 0


def test_search_stops_early_and_finds_the_best():
    rng = np.random.default_rng(3)
    n = 4_000
    v = rng.integers(-20, 20, (n, 3))
    v[:40] *= 40  # a few long vectors, so that the tops of the lists decide
    block = hardnegatives.Block.of(np.arange(n), np.zeros(n, bool), np.zeros(n, int), v)
    anchors = rng.integers(1, 20, (5, 3))
    found = hardnegatives.Found.empty(5, 1, 3)
    whole = np.full((5, 1), -(1 << 62)), np.full((5, 1), 1 << 62)
    scored = hardnegatives.search(block, anchors, np.zeros(5, int), *whole, True, found)
    assert scored < 5 * n / 2
    scores = anchors @ v.T
    for a in range(5):
        best = np.lexsort((block.ids, -scores[a, block.ids]))[:3]
        assert found.ids[a, 0].tolist() == block.ids[best].tolist()


def test_large_components(spark):
    assert hardnegatives.products(np.array([[1 << 30, 3]]), np.array([[1 << 30, 5]])).tolist() == [[(1 << 60) + 15]]
    with pytest.raises(ValueError, match="64 bits"):
        hardnegatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


# repeated strings


def cut_plain(rows, length=50):
    """(n_bytes, n_removed, n_spans, bytes left) of each row, by looking at every string."""
    key = lambda d: (d is None, d or 0)
    raws = [(t or "").encode() for _, t in rows]
    least = {}
    for (d, _), raw in zip(rows, raws, strict=True):
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            least[s] = min(least.get(s, key(d)), key(d))
    out = []
    for (d, _), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < key(d):
                gone[i : i + length] = b"\x01" * length
        out.append((len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return out


def texts(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", b"k") for r in rows], "doc_id long, text string, id int, tag string, kept binary")


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, common, base = prose(30), prose(14), prose(80)
    out = [(i, prose(rng.choice([0, 3, 20, 60]))) for i in range(40)]
    out += [(100 + i, prose(10) + passage + prose(10) + common) for i in range(12)]
    out += [(200 + i, common[rng.randint(0, 5) :] + prose(rng.randint(0, 8)) + common) for i in range(25)]
    out += [(300 + i, "".join(c if rng.random() > 0.01 else "z" for c in base)) for i in range(8)] + [(320 + i, base) for i in range(4)]
    out += [(400, "and " * 300), (401, "and " * 40), (402, "x" * 49), (403, "x" * 49), (404, "y" * 50), (405, "y" * 50), (406, passage * 3), (407, "and " * 300)]
    out += [(500, None), (501, ""), (None, None), (None, passage), (None, base), (100, base), (100, prose(90)), (320, base), (600, prose(4_000))]
    return out + [(600, out[0][1]), (601, out[-1][1][3_000:])]


@pytest.mark.parametrize("sizes", [{}, {"run_bytes": 900, "bucket_bytes": 500}])
def test_repeated_strings_go(spark, documents, sizes):
    got = substrings.dedup_substrings(texts(spark, documents), **sizes).collect()
    want = Counter((d, *w) for (d, _), w in zip(documents, cut_plain(documents), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    for r in got:
        raw = (r["text"] or "").encode()
        for span in reversed(r["removed"]):
            raw = raw[: span["first"]] + raw[span["first"] + span["size"] :]
        assert raw == bytes(r["kept"]) and (r["id"], r["tag"]) == (1, "x")


def test_common_grams_and_shares_change_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(substrings, "COMMON", 2)
    monkeypatch.setattr(substrings, "PASS_BYTES", 2_000)
    monkeypatch.setattr(substrings, "SORT_BYTES", 300)
    got = substrings.dedup_substrings(texts(spark, documents), length=20).collect()
    want = Counter((d, *w) for (d, _), w in zip(documents, cut_plain(documents, 20), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


@pytest.mark.parametrize("seed", [67, 108, 168])
def test_strings_whose_gram_stands_beside_them_too(seed):
    rng = random.Random(seed)
    word = "".join(rng.choice("abcdefgh") for _ in range(14))
    junk = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = junk(rng.randint(10, 24)) + word + junk(rng.randint(10, 28))
    first, second = ((junk(100) + (word + junk(rng.randint(0, 12))) * rng.randint(0, 1) + shared + junk(100)).encode() for _ in range(2))
    blobs = []
    for i, text in enumerate((first, second)):
        run = substrings.Run(i, np.zeros(1 << substrings._SLOT_BITS, bool), 50, 1)
        run.add(i, i, 0, memoryview(text))
        blobs += [(i, blob) for _, kind, blob in run.rows() if kind == 0]
    number, _, begin, end = substrings.compared(blobs, 50, 0, 1)
    gone = {k for a, b in zip(begin.tolist(), end.tolist(), strict=True) for k in range(a, b)}
    known = {first[k : k + 50] for k in range(len(first) - 49)}
    assert set(number.tolist()) == {1} and gone == {k + i for k in range(len(second) - 49) if second[k : k + 50] in known for i in range(50)}


def test_no_strings(spark):
    assert substrings.dedup_substrings(texts(spark, [])).count() == 0
    assert [tuple(r)[-5:-2] for r in substrings.dedup_substrings(texts(spark, [(1, None)])).collect()] == [(0, 0, 0)]
    with pytest.raises(ValueError, match="above"):
        substrings.dedup_substrings(texts(spark, []), length=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=40), min_size=1, max_size=6), st.sampled_from([9, 12, 16, 17]))
def test_earlier_factors(parts, length):
    starts, doc, at = [], [], 0
    raw = "".join(parts).encode()
    for d, part in enumerate(parts):
        mine = range(at, at + len(part) - length + 1)
        starts += mine
        doc += [d // 2] * len(mine)
        at += len(part)
    if not starts:
        return
    got = substrings.earlier_factors(np.frombuffer(raw, np.uint8), np.array(starts), np.array(doc), length)
    want = [any(raw[t : t + length] == raw[s : s + length] and e < d for t, e in zip(starts, doc, strict=True)) for s, d in zip(starts, doc, strict=True)]
    assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=1, max_size=40))
def test_previous_smaller(pairs):
    value, head = np.array([v for v, _ in pairs]), np.array([h for _, h in pairs])
    head[0] = True
    want = []
    for i in range(len(value)):
        at = i
        while at >= 0 and not value[at] < value[i]:
            at = -1 if head[at] else at - 1
        want.append(at)
    assert substrings.previous_smaller(value, head).tolist() == want


def test_equal_windows_belong_to_the_same_gram():
    rng = random.Random(2)
    common = "".join(rng.choice("abc ") for _ in range(120)).encode()
    last = np.zeros(1 << 22, bool)
    last[substrings.slots(substrings.grams(np.frombuffer(common[:60], np.uint8)))] = True
    kept = []
    for _ in range(3):
        raw = bytes(rng.choice(b"abc ") for _ in range(70)) + common + bytes(rng.choice(b"abc ") for _ in range(70))
        first, windows, at, h = substrings.fragments(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), last, 50)
        assert windows.sum() == len(raw) - 49
        kept.append({raw[f + i : f + i + 50]: g for f, n, g in zip(first, windows, h, strict=True) for i in range(n)})
    shared = set(kept[0]) & set(kept[1]) & set(kept[2])
    assert len(shared) >= 71 and all(kept[0][s] == kept[1][s] == kept[2][s] for s in shared)


# importance resampling


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = lowered(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def resampled(rows, target, per_cent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in side for f in features(text)) for side in ([x for _, x in rows], target))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    scored = []
    for d, text in rows:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(lowered(text))])
    able = sorted((r for r in scored if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[5]))
    for rank, r in enumerate(able[: per_cent * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in scored)


def test_resampling(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcXYé漢9") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n, k=400: " ".join(rng.choice(vocab[:k]) + rng.choice(["", "", ",", "-x", "\n"]) for _ in range(n))
    data = [(i, prose(rng.choice([1, 19, 20, 40, 120]), rng.choice([40, 400]))) for i in range(120)]
    data += [(1000, None), (1001, ""), (1002, " .,;\n"), (1003, "One"), (None, prose(50)), (None, None), (1004, "q" * 3_000 + " w" * 30), (1005, "w" * 3_001)]
    data += [(2000, data[5][1])] * 40 + [(2001, data[6][1]), (2001, data[7][1])]
    data += [(3000, " ".join(rng.choice(vocab) for _ in range(20_000)))]
    target = [prose(30, 40) for _ in range(15)] + [None, ""]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in data], "doc_id long, text string, rank int, bucket string, copies int")
    other = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = importance.resample(docs, other).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == resampled(data, target)
    assert Counter(tuple(r) for r in importance.resample(docs, other.limit(0), 100).select(*got.columns).collect()) == resampled(data, [], 100)
    assert importance.resample(docs.limit(0), other).count() == 0


def test_a_row_with_many_copies_is_told_apart(spark):
    weighed = spark.range(250_003).selectExpr("7L as doc_id", "30L as n_words", "59L as n_features", "11L as weight")
    got = importance.draw(weighed, 50)
    assert got.count() == 250_003
    ranks = [r[0] for r in got.filter("rank is not null").select("rank").collect()]
    assert sorted(ranks) == list(range(1, 125_002))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1é漢 .-\n\0", max_size=20)), max_size=8))
def test_feature_buckets(column):
    row, bucket, counts = importance.feature_buckets(pa.array(column, pa.string()))
    assert counts.tolist() == [len(lowered(t)) for t in column]
    want = Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(column) for f in features(t))
    assert Counter(zip(row.tolist(), bucket.tolist(), strict=True)) == want
