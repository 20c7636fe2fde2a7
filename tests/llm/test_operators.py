"""The operators against plain Python on small tables full of edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sunloom.llm import fingerprint, linededup, mixing, neardup, packing, pii, quality, sharding, tokencounts, toxicity
from sunloom.llm.queries import QUERIES, SQL, vocabulary
from sunloom.llm.words import Steps, Tokens

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, value long, node string, row int, bucket string, size double, _n int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 0.5, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", ".\n"]) for _ in range(n))
    base, passage = prose(120), prose(60)
    out = [(i, prose(rng.choice([1, 3, 8, 40, 150])), rng.choice(["a", "b", "b", None])) for i in range(40)]
    out += [(100 + i, base, "b") for i in range(3)]
    out += [(110 + i, " ".join(w if rng.random() > 0.01 * i else rng.choice(vocab) for w in base.split(" ")), "b") for i in range(12)]
    out += [(130 + i, prose(30) + " " + passage + " " + prose(25), "c") for i in range(6)]
    out += [(200, None, "a"), (201, "", "a"), (202, " \n\t ", None), (203, "short one", "a"), (204, "Short ONE", "a"), (None, base, "a"), (None, None, None), (203, "short one", "a")]
    out += [(300, " ".join(rng.choice(vocab) for _ in range(30_000)), "long")]
    return out


def sets(rows):
    out = []
    for _, text, _ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_near_duplicates(spark, rows):
    shingles = sets(rows)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(shingles[i] & shingles[j])
            if both and 100 * both >= 75 * len(shingles[i] | shingles[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    want = Counter((r[0], len(s), least.get(top(i)), r[0] == least.get(top(i))) for i, (r, s) in enumerate(zip(rows, shingles, strict=True)))
    got = neardup.near_duplicates(table(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_no_link_is_lost_in_a_group_of_many_variants(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if rng.random() > rng.choice([0, 0.01, 0.02, 0.04, 0.1]) else f"x{rng.randint(0, 10**6)}" for w in base) for _ in range(150)]
    data = [(i, t, "s") for i, t in enumerate(texts)]
    shingles, label = sets(data), list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, data)).collect()}
    assert [got[i] for i in range(len(data))] == label


def test_no_link_is_lost_near_the_size_of_the_sketch(spark):
    rng, data = random.Random(8), []
    for n in (767, 768, 800, 850, 909, 1000, 1100):  # shingles; the long sketches hold 1024
        text = [f"{n}w{i}" for i in range(n + 4)]
        data += [text, text[: n * 13 // 16 + 4], text + [f"{n}x{i}" for i in range(n // 3 - 2)]]
        for edits in (n // 40, n // 36, n // 35):
            edited = list(text)
            for i in rng.sample(range(n + 4), edits):
                edited[i] = f"{n}y{edits}.{i}"
            data.append(edited)
    data = [(i, " ".join(t), "s") for i, t in enumerate(data)]
    for group in ([0, 1], [0, 2], [0, 3], [0, 4], [0, 5]):  # the base with one copy at a time
        part = [r for r in data if r[0] % 6 in group]
        shingles = {r[0]: s for r, s in zip(part, sets(part), strict=True)}
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, part)).collect()}
        for base in range(0, len(data), 6):
            a, b = shingles[base], shingles[base + group[1]]
            assert got[base + group[1]] == (base if 100 * len(a & b) >= 75 * len(a | b) else base + group[1])


def test_members_of_two_pivots_components_are_compared(spark):
    rng, members, nodes = random.Random(4), {}, iter(range(120))
    for _ in range(30):  # chains p1, x, y, p2 in which only neighbours are alike, more in one list than is compared at once
        values = [rng.getrandbits(62) for _ in range(130)]
        p1, p2, x, y = (next(nodes) for _ in range(4))
        members |= {v: sorted(values[at : at + 100]) for v, at in zip((p1, x, y, p2), (0, 10, 20, 30), strict=True)}
    lists = spark.createDataFrame([(value, node, 100, 100) for value in (1, 2) for node in members], "value long, node long, n long, most long")
    hashes = spark.createDataFrame(list(members.items()), "node long, hashes array<long>")
    label = {v: v for v in members}
    for a in members:
        for b in range(a):
            both = len(set(members[a]) & set(members[b]))
            if 100 * both >= 75 * (200 - both):
                low, high = sorted((label[a], label[b]))
                label = {v: low if c == high else c for v, c in label.items()}
    got = neardup.linked(lists, hashes, neardup.SKETCH, neardup.LINK, Steps(spark)).collect()
    assert {r["node"]: r["comp"] for r in got} == label and len(set(label.values())) == 30


def test_entries_that_reach_nothing_cost_no_rounds(spark):
    rng, base = random.Random(6), [*range(1, 101)]
    members = {v: base[:99] + [1_000 + v] for v in range(40)} | {v: sorted(rng.sample(range(10_000, 10**9), 100)) for v in range(40, 160)}
    # the others share 76 values at most from here on, too few for two sets of 100
    lists = spark.createDataFrame([(1, v, 100, 100 if v < 40 else 76) for v in members], "value long, node long, n long, most long")
    hashes = spark.createDataFrame(list(members.items()), "node long, hashes array<long>")
    steps = Steps(spark)
    got = neardup.linked(lists, hashes, neardup.SKETCH, neardup.LINK, steps).collect()
    assert {r["node"]: r["comp"] for r in got} == dict.fromkeys(range(40), 0)
    assert steps.n <= 10


def test_size_classes_keep_every_pair_that_may_link(spark):
    rng, k, (a, b) = random.Random(9), 64, neardup.LINK
    rows = {(value, node, n, rng.randint(n * 3 // 4, n)) for value in range(40) for node in rng.sample(range(500), rng.randint(1, 12)) for n in [rng.choice([3, 4, 20, 30, 48, 60, 64, 70, 90, 300])]}

    def fit(x, y):
        most = min(x[2], y[2]) if max(x[2], y[2]) > k else min(x[3], y[3])
        return min(x[2], y[2]) * b >= max(x[2], y[2]) * a and most * (a + b) >= (x[2] + y[2]) * a

    needed = {x for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and fit(x, y)}
    lists = spark.createDataFrame(sorted(rows), "value long, node long, n long, most long")
    got = [tuple(r) for r in neardup.within_reach(lists, k, neardup.LINK).collect()]
    assert len(got) == len(set(got)) < len(rows) and needed <= set(got) <= rows


@pytest.mark.parametrize("numbers", [0, neardup.BROADCAST_NODES])
def test_links_join_components_by_shuffle_and_by_broadcast(spark, monkeypatch, numbers):
    monkeypatch.setattr(neardup, "BROADCAST_NODES", numbers)
    rng, data = random.Random(11), []
    for group in range(6):  # windows over one row of words: only near ones are alike
        words = [f"{group}w{i}" for i in range(180)]
        data += [" ".join(words[at : at + 100]) for at in range(0, 80, 8)]
    data = [(i, t, "s") for i, t in enumerate(rng.sample(data, len(data)))]
    shingles, label = sets(data), list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, data)).collect()}
    assert [got[i] for i in range(len(data))] == label and len(set(label)) == 6


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300, 360)] + [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"), Steps(spark)).collect()
    assert {r["node"]: r["comp"] for r in got} == label


def test_least_shared_keeps_its_promise():
    rng = np.random.default_rng(0)
    assert rng.binomial(128, 0.75, 200_000).min() >= neardup.least_shared(128, 0.75)


def test_line_dedup_removes_later_occurrences(spark, rows):
    got = linededup.dedup_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {"value", "node", "row", "size"} <= set(got[0].asDict())
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    # plain Python: a window is later if a smaller (doc_id, place) has the same words
    seen, later = {}, {}
    column = pa.array([t for _, t, _ in rows], pa.string())
    row, _, first, last = linededup.windows(column)
    found = sorted(((rows[r][0] is None, rows[r][0] or 0, f), r, la) for r, f, la in zip(row.tolist(), first.tolist(), last.tolist(), strict=True))
    for key, r, la in found:
        piece = tuple(words(rows[r][1].encode()[key[2] : la].decode()))
        if seen.setdefault(piece, key) != key:
            later.setdefault((key[0], key[1]), []).append((key[2], la))
    for doc_id, text, _ in rows:
        if doc_id is None:
            continue
        spans = later.get((False, doc_id), [])
        want = linededup.without(text.encode(), sorted(spans))[0].decode() if spans else text
        assert by_id[doc_id]["text"] == want
    assert by_id[100]["removed_words"] == 0 and by_id[101]["text"] == "" and by_id[200]["text"] is None
    for i in range(131, 136):  # of a passage of 60 words little is left in later documents
        assert by_id[i]["removed_words"] >= 25
    assert linededup.dedup_lines(table(spark, [])).count() == 0


def test_windows_do_not_depend_on_their_place():
    text = "alpha beta gamma delta. one two three four five six seven. eight nine ten eleven twelve. thirteen fourteen fifteen sixteen."
    a, b = (linededup.windows(pa.array([t]))[1].tolist() for t in (text, "before it all. " + text + " and after"))
    assert set(a) & set(b)


def test_every_passage_of_fifty_words_holds_a_window():
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passages = [text(rng.randint(50, 60)) for _ in range(300)] + [" ".join(["and"] * 51), " ".join(["the"] * 93), " ".join(f"{w}" for w in sorted(text(51).split()))]
    for passage in passages:
        around = f"{text(20)} {passage}\n{text(20)}", f"{text(33)}. {passage} {text(9)}", passage
        a, b, c = (set(linededup.windows(pa.array([t]))[1].tolist()) for t in around)
        assert a & b and a & c and b & c


def test_windows_do_not_depend_on_neighbouring_rows():
    rng = random.Random(7)
    texts = [rng.choice(["", "\n"]) + " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 60))) for _ in range(80)]
    row, h, *_ = linededup.windows(pa.array(texts))
    for i, text in enumerate(texts):
        assert h[row == i].tolist() == linededup.windows(pa.array([text]))[1].tolist()


def test_mixing(spark, rows):
    got = mixing.mix_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    again = mixing.mix_documents(table(spark, rows[::-1])).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    total = sum(s[1] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(1.5 * total)
    longest = {name: max(r["size"] for r in got if r["source"] == name) for name in by}
    for name, (taken, size, target, stated) in by.items():
        assert size == stated and target <= 2 * size + 1e-9 and abs(taken - target) <= longest[name] / 2 + 1
    assert mixing.mix_documents(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix_documents(table(spark, [(1, None, None)])).collect()] == [0]


def test_water_filling_against_a_loop(spark):
    rng = random.Random(2)
    data = [(f"s{i}", rng.randint(0, 1000), rng.choice([1, 2, 5, 0])) for i in range(30)]
    limit, wanted, open_ = {n: 2.0 * s for n, s, _ in data}, 1.4 * sum(s for _, s, _ in data), {n: w for n, _, w in data}
    target = {}
    while open_ and sum(open_.values()):
        level = (wanted - sum(target.values())) / sum(open_.values())
        over = [n for n, w in open_.items() if level * w > limit[n]]
        if not over:
            target |= {n: level * w for n, w in open_.items()}
            break
        for n in over:
            target[n] = limit[n]
            del open_[n]
    got = mixing.water_fill(spark.createDataFrame(data, "source string, source_size long, weight int"), wanted, 2).collect()
    for r in got:
        assert r["target"] == pytest.approx(target.get(r["source"], 0.0))


def test_packing_round_trip(spark, rows):
    got = packing.pack_documents(table(spark, rows), vocabulary()).collect()
    model = Tokens(vocabulary())
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.append(model.encode(pa.array([text], pa.string()))[0], 1)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096].astype("<u4")
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack_documents(table(spark, []), vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    lengths = np.clip(rng.lognormal(4, 1, 6_000).astype(int) + 1, 1, capacity)
    histogram = np.bincount(lengths, minlength=capacity + 1)
    groups = packing.plan(histogram, capacity)
    held = np.zeros(capacity + 1, int)
    for g in groups:
        assert sum(length * n for length, n in g.items) <= capacity
        for length, n in g.items:
            held[length] += n * g.times
    assert (held == histogram).all()
    assert sum(g.times for g in groups) <= 1.01 * -(-lengths.sum() // capacity) + 1


def test_knapsack_is_exact_when_all_lengths_take_part():
    rng = np.random.default_rng(7)
    lengths, prices, most = np.array([3, 5, 7, 11]), rng.random(4), np.array([4, 2, 3, 1])
    best = max(
        (float(np.dot(c, prices)) for c in np.ndindex(5, 3, 4, 2) if np.dot(c, lengths) <= 24)
    )
    counts = packing.price_knapsack(lengths, prices, most, 24)
    assert np.dot(counts, lengths) <= 24 and np.dot(counts, prices) == pytest.approx(best)


def test_quality(spark, rows):
    got = quality.judge(table(spark, [*rows, (400, "Fine words stand here and end well.\nHome | News | Shop | About\n" * 2, "q"), (401, "one two three four five one two three four five " * 3, "q")]))
    by_id = {}
    for r in got.collect():
        by_id[r["doc_id"]] = r
        w = words(r["text"])
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert by_id[400]["clean_text"] == "Fine words stand here and end well.\nFine words stand here and end well."
    assert by_id[401]["base_failed"] and not by_id[200]["kept"]


NOTICES = ["licensed under", "licence under", "LICENCED Under", "General Public License", "Released under THE", "all rights reserved", "COPYRIGHT", "©", "Cookies", "privacy policy", "Terms of Use", "terms of service", "enable JavaScript", "Powered By", "Lorem ipsum"]
NEAR_NOTICES = ["unlicensed under", "copyrighted", "cook", "terms of usefulness", "terms  of use", "ſervice İstanbul K"]


def test_quality_finds_notices_and_separators_by_their_signs(spark, monkeypatch):
    marked = [f"These words say {n} and go on, {n} at that." for n in NOTICES]
    marked += [f"One {a} two {b} three {c} four, and the line ends well." for a in ("|", "›", "»", "::", ">>", "•", "/") for b in ("|", "::") for c in ("/", "•")]
    plain = [f"These words say {n} and go on, {n} at that." for n in NEAR_NOTICES] + ["One | two :: three four, and the line ends well.", "One/two and three/four/five go on, and the line ends well."]
    docs = table(spark, [(1, "\n".join([*marked, *plain]), "q"), (2, "\n".join(marked), "q"), (3, "These words go on and end well.", "q")])
    judged = lambda: {r["doc_id"]: r for r in quality.judge(docs).collect()}
    got = judged()
    assert got[1]["clean_text"].split("\n") == plain and got[2]["clean_text"] == ""
    assert got[1]["lost_chars"] == got[2]["lost_chars"] == got[2]["word_chars"]
    monkeypatch.setattr(quality, "BOILERPLATE", ".")  # lines without a sign are not searched for the costly patterns
    monkeypatch.setattr(quality, "SEPARATORS", ".")
    assert judged()[3]["clean_text"] == "These words go on and end well."


@pytest.mark.parametrize("width", [1, 2, 3, 7])
def test_repeated_windows_of_any_width(spark, width):
    rng = random.Random(width)
    lists = [[rng.choice("ab") * rng.choice([1, 1, 9]) for _ in range(n)] for n in (*range(12), 60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, _w array<string>")
    for name, step in quality.repeat_words("_w", width):
        df = df.withColumn(name, step)
    for r in df.collect():
        w = r["_w"]
        grams = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
        assert r["n_repeat_words"] == len({i + k for i in range(len(w) - width + 1) if grams[tuple(w[i : i + width])] > 1 for k in range(width)})


def test_fingerprints(spark, rows):
    got = fingerprint.fingerprint_documents(table(spark, rows), rows_a_bucket=7).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = Counter()
    for (doc_id, text, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        parts = [set(fingerprint.digests(pa.array([t], pa.large_string()))[0].tolist()) for t in (text, edited, after)]
        near = [len(parts[0] & p) / len(parts[0] | p) if parts[0] | p else 1.0 for p in parts[1:]]
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == want
    prints = {}
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert prints.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert fingerprint.fingerprint_documents(table(spark, [])).count() == 0


def test_likeness_comes_from_the_stored_fingerprints(spark, rows):
    got = fingerprint.fingerprint_documents(table(spark, rows), rows_a_bucket=7).collect()
    for r in got:
        assert fingerprint.likeness([r["fingerprint"]], [r["edited_fingerprint"]])[0] == r["near_edited"]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    prints = {row[1] or "": fingerprint.encoded(*fingerprint.digests(pa.array([row[1] or ""], pa.large_string())))[0] for row in order}
    assert {r["fingerprint"] for r in got} == set(prints.values())
    want = Counter((a[0], fingerprint.likeness([prints[a[1] or ""]], [prints[b[1] or ""]])[0]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r["doc_id"], r["near_next"]) for r in got) == want


def test_sketches_of_all_sizes_and_of_different_sizes():
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(0, 1 << 63, 9_000).astype(np.uint64))
    sizes = [0, 0, 1, 2, 3, 7, 20, 64, 300, 2_000, 5_000]
    sets = [np.sort(rng.choice(pool[: max(2 * n, 1)], n, replace=False)) for n in sizes for _ in range(2)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    prints = fingerprint.encoded(np.concatenate(sets), bounds)
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    got = fingerprint.likeness([prints[i] for i, _ in pairs], [prints[j] for _, j in pairs])
    plain = [set(x.tolist()) for x in sets]
    assert got.tolist() == [len(plain[i] & plain[j]) / len(plain[i] | plain[j]) if plain[i] | plain[j] else 1.0 for i, j in pairs]


def test_fingerprints_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, None, 5, 6]), " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(12)) + ".", "s") for _ in range(400)]
    docs = table(spark, rows)
    placed = fingerprint.with_next(docs.select("doc_id", "text"), 10)
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 60
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter((a[0], hashlib.sha256((a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprint.fingerprint_documents(docs, rows_a_bucket=10).collect()) == want


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(4)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (500, 9, 14))
    t = fingerprint.Tables(np.array([16]))
    for own, sign in ((np.concatenate([common, a]), 1), (np.concatenate([common, b]), -1)):
        t.add(np.zeros(len(own), int), own, sign)
    _, digest, sign = t.peel()
    assert not len(t.stuck())
    assert set(digest[sign > 0].tolist()) == set(a.tolist()) and set(digest[sign < 0].tolist()) == set(b.tolist())


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "call +1 (939) 555-8456 now", "card 4923437827071911 and 4923-4378-2707-1911, not 4923437827071912", "ip 88.169.244.62. not 999.1.1.1",
        "born 1980-02-29 or 29.02.1980 or 02/29/1980, not 2021-02-30", "ssn 123-45-6789 not 000-11-2222", "mail spgld.59@mail5.example.com, A.B@x.org",
        "none 12 345", None, "", "again 88.169.244.62 spgld.59@mail5.example.com 1980-02-29", "a@b.cc",
    ]
    got = [r for r in pii.pseudonymise(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), "k").orderBy("doc_id").collect()]
    assert [r["n_private"] for r in got] == [1, 2, 1, 3, 1, 2, 0, 0, 0, 3, 1]
    text = [r["text"] for r in got]
    assert text[6:9] == texts[6:9]
    plain, dashed = re.findall(r"(?:\d-?){16}", text[1])[:2]
    assert luhn(plain) and plain == dashed.replace("-", "") and plain != "4923437827071911" and plain[0] == "4" and "4923437827071912" in text[1]
    assert re.fullmatch(r"call \+1 \([1-9]\d\d\) [1-9]\d\d-[1-9]\d{3} now", text[0])
    ip, mail, day = text[9].split(" ")[1:]
    assert ip in text[2] and all(0 <= int(x) <= 255 for x in ip.split(".")) and mail in text[5] and mail.endswith("@mail5.example.com")
    iso, dotted, slashed = re.findall(r"[\d/.-]{10}", text[3])[:3]
    assert day == iso and iso != "1980-02-29" and dotted == ".".join(iso.split("-")[::-1]) and slashed == "/".join((iso[5:7], iso[8:], iso[:4]))
    assert "2021-02-30" in text[3] and "000-11-2222" in text[4] and "123-45-6789" not in text[4]


def test_pseudonyms_are_a_permutation(spark):
    ips = [f"10.20.{i // 256}.{i % 256}" for i in range(600)]
    days = [str(np.datetime64("1999-12-01") + i) for i in range(600)]
    got = pii.pseudonymise(table(spark, [(i, f"{a} on {b}", "s") for i, (a, b) in enumerate(zip(ips, days, strict=True))]), "k").collect()
    assert len({r["text"].split(" ")[0] for r in got}) == len({r["text"].split(" ")[2] for r in got}) == 600


def test_every_address_and_every_day_gets_a_pseudonym(spark):
    ips = ["233.233.171.252", "224.145.138.68", "227.5.221.1", "255.255.255.255", "0.0.0.0", "0.17.3.9", "1.0.0.1", "223.255.255.255"] + [f"240.1.{i}.7" for i in range(200)]
    days = ["0001-01-01", "1066-10-14", "1899-12-31", "1900-01-01", "2099-12-31", "2100-01-01", "9999-12-31", "2400-02-29"] + [str(np.datetime64("1850-01-01") + i) for i in range(100)] + [str(np.datetime64("2150-01-01") + i) for i in range(100)]
    data = list(zip(ips, days, strict=True))
    got = pii.pseudonymise(table(spark, [(i, f"{a} on {b}", "s") for i, (a, b) in enumerate(data)] + [(1000, "256.1.1.1 on 1899-02-29", "s")]), "k").orderBy("doc_id").collect()
    assert [r["n_private"] for r in got] == [2] * len(data) + [0] and got[-1]["text"] == "256.1.1.1 on 1899-02-29"
    new = [r["text"].split(" on ") for r in got[:-1]]
    assert len({a for a, _ in new}) == len({b for _, b in new}) == len(data)
    for (ip, day), (a, b) in zip(data, new, strict=True):
        assert a != ip and b != day and str(np.datetime64(b)) == b and all(0 <= int(x) <= 255 for x in a.split("."))
        kind = lambda v: np.searchsorted([1, 224], int(v.split(".")[0]), "right")
        assert kind(a) == kind(ip) and np.searchsorted([1900, 2100], int(b[:4]), "right") == np.searchsorted([1900, 2100], int(day[:4]), "right")


def test_sharding(spark, rows):
    got = sharding.shard_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    slots, of = {}, {}
    for r in got:
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        assert of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(table(spark, [])).count() == 0


def test_changed_weights_move_only_what_they_must(spark):
    keys = spark.range(3_000).selectExpr("cast(id as string) as k")
    before = sharding.Node("root", 20.0, tuple(sharding.region(f"r{i}", [[10 * i + j for j in range(5)], [10 * i + j for j in range(5, 10)]]) for i in range(2)))
    one = before.children[0].children[0]
    heavier = sharding.Node(one.name, one.weight, (sharding.Node(one.children[0].name, 3.0, shard=0), *one.children[1:]))
    r0 = sharding.Node("r0", before.children[0].weight, (heavier, before.children[0].children[1]))
    after = sharding.Node("root", 20.0, (r0, before.children[1]))
    both = sharding.descend(sharding.descend(keys, "k", before, 1), "k", after, 1, "new_").collect()
    moved = [r for r in both if r["shard"] != r["new_shard"]]
    assert moved and all(r["rack"] == "r0/0" and r["new_shard"] == 0 for r in moved)
    counts = Counter(r["region"] for r in both)
    assert abs(counts["r0"] - 1_500) < 150


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_token_counts(spark, rows, block):
    data = rows if block > 16 else rows[:60]
    got = tokencounts.count_tokens(table(spark, [*data, (900, "an <|endoftext|> inside", "s")]), vocabulary(), 49407, block).collect()
    model = Tokens(vocabulary(), plain_specials=True)
    want = Counter((d, len(model.model.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in [*data, (900, "an <|endoftext|> inside", "s")])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want


def test_token_file_without_a_last_end(spark, tmp_path):
    (tmp_path / "f").write_bytes(np.array([5, 6, 9, 9, 7, 8, 8, 8, 8], "<u2").tobytes())
    files = spark.createDataFrame([("f",)], "file string")
    got = tokencounts.separator_scan(spark, str(tmp_path), files, 9, 2).orderBy("nth").collect()
    assert [(r["nth"], r["start"], r["n_tokens"], r["complete"]) for r in got] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 5, False)]


def test_toxicity_finds_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 4 <> 0")
    scored = toxicity.score(docs, toxicity.fit(docs, seen)).join(labels, "doc_id").collect()
    clean = [r for r in scored if not r["toxic"]]
    toxic = [r for r in scored if r["toxic"]]
    assert sum(r["kept"] for r in clean) == len(clean)
    assert sum(not r["kept"] for r in toxic if r["doc_id"] % 4) >= 0.8 * sum(1 for r in toxic if r["doc_id"] % 4)
    assert sum(not r["kept"] for r in toxic if r["doc_id"] % 4 == 0) >= 0.6 * sum(1 for r in toxic if r["doc_id"] % 4 == 0)


def test_toxicity_with_one_class_or_no_labels(spark, rows):
    docs = table(spark, rows)
    for labels in ([], [(1, 1, 0), (2, 1, 0)], [(None, 1, 1), (1, 0, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(rows) and all(r["kept"] for r in got)


def test_ordinal_fit_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    n, true = 4_000, np.array([2.0, -1.5, 0.0, 1.0])
    x = rng.integers(0, 2, (n, 4)).astype(float)
    y = (x @ true)[:, None] + rng.logistic(size=(n, 1)) > np.array([[0.5, 2.5]])
    row, column = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(row, column, np.ones(len(row)), y.sum(1), 4, l1=0.0, steps=3_000)
    assert np.abs(w - true).max() < 0.3 and np.abs(cuts - [0.5, 2.5]).max() < 0.4 and cuts[0] < cuts[1]


def test_columns_named_like_outputs_and_inner_ones(spark):
    text = "Fine words stand here and end well, call +1 (939) 555-8456 now. " * 3
    taken = {"severity": 1, "grade": 2, "kept": 3, "removed_runs": 4, "removed_words": 5, "_rank": 6, "rank": 7, "_found": 8, "_new": 9, "_text": 10, "_t": 11, "_w": 12, "n_words": 13, "n_private": 14, "sequence_id": 15, "offset": 16, "in1": 17, "c0": 18}
    docs = spark.createDataFrame([(1, text, *taken.values()), (2, None, *taken.values())], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in taken))
    model = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([1.0]))
    pieces = docs.withColumns({"length": F.lit(7).cast("long")})
    for out, added in (
        (toxicity.score(docs, model), {"severity", "grade", "kept"}), (linededup.dedup_lines(docs), {"removed_runs", "removed_words"}),
        (quality.judge(docs), set(quality.JUDGED)), (pii.pseudonymise(docs, "k"), {"n_private"}), (packing.pack(pieces, ["doc_id"]), {"sequence_id", "offset"}),
    ):
        got = {r["doc_id"]: r.asDict() for r in out.collect()}
        assert len(out.columns) == len(set(out.columns)) and added <= set(out.columns) and set(docs.columns) <= set(out.columns)
        for c, v in taken.items():
            assert c in added or (got[1][c] == v and got[2][c] == v), c
    for empty in (quality.judge(docs.limit(0)), pii.pseudonymise(docs.limit(0), "k"), toxicity.score(docs.limit(0), model)):
        assert empty.count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_program_places_nine_tenths(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    lengths = packing.token_pieces(docs, vocabulary()).groupBy("length").count().collect()
    histogram = np.zeros(packing.CAPACITY + 1, np.int64)
    for r in lengths:
        histogram[r["length"]] = r["count"]
    groups, left = packing.programmed(histogram, packing.CAPACITY)
    assert sum(n * g.times for g in groups for _, n in g.items) == histogram.sum() - left.sum() >= 0.9 * histogram.sum()
    sequences = sum(g.times for g in packing.best_fit(left, packing.CAPACITY, groups))
    assert sequences <= 1.01 * -(-int(histogram @ np.arange(len(histogram))) // packing.CAPACITY) + 1


def test_the_fractional_solution_covers_all_lengths_to_its_gap():
    rng = np.random.default_rng(2)
    lengths, capacity = np.sort(rng.choice(np.arange(1, 200), 30, replace=False)), 256
    demand = rng.integers(1, 400, 30)
    known, used, gap = packing.fractional(lengths, demand, capacity)
    assert (known @ lengths <= capacity).all() and (used @ known >= demand * (1 - 1e-9)).all()
    least = float(demand @ lengths) / capacity
    assert gap <= 1.06 and least <= used.sum() + 1e-9


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    index = {d[0]: i for i, d in enumerate(want.description)}
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == columns
    key = lambda t: [str(x) for x in t]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted((tuple(r[index[c]] for c in columns) for r in want.fetchall()), key=key)
