"""The pipeline's stages one by one, each held against its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
from sunloom.llm import mixing
from sunloom.llm.words import Steps

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, steps = spark.read.parquet(f"{SMALL}/documents.parquet"), Steps(spark)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(steps(stage(spark, kept[-1], SMALL)))
    start, civil, cleaned, unique, mixed, packed = ([r.asDict() for r in d.collect()] for d in kept)
    for d in kept[:-1]:
        assert d.columns == docs.columns
    toxic = {i for (i,) in duckdb.sql(f"select doc_id from '{SMALL}/labels.parquet' where toxic = 1").fetchall()}
    clean = {i for (i,) in duckdb.sql(f"select doc_id from '{SMALL}/labels.parquet' where toxic = 0").fetchall()}
    ids = [{r["doc_id"] for r in rows} for rows in (start, civil, cleaned, unique, mixed, packed)]
    assert not ids[1] & toxic and clean <= ids[1]
    assert ids[2] <= ids[1] and all(r["n_chars"] == len(r["text"]) for r in cleaned if r["text"] is not None)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(r["text"]) for r in unique]
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            assert 100 * both < 75 * len(sets[i] | sets[j]) or not sets[i]
    took = Counter(r["doc_id"] for r in mixed)
    want = {r["doc_id"]: r["epochs"] for r in mixing.mix_documents(kept[3]).collect() if r["epochs"]}
    assert took == want
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == took


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hard_rows():
    """Null and repeated ids, exact and near copies, rows that share an id and nothing else, empty texts."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, other, edited = prose(90), prose(70), prose(120)
    out = [(1, base, "a"), (5, base, "b"), (5, prose(80), "b"), (5, prose(60), "a"), (None, base, "c"), (None, prose(50), "c"), (None, prose(55), None)]
    out += [(7, other, "a")] * 4 + [(None, other, "b"), (8, "", "a"), (8, "", "a"), (None, None, None), (9, None, "a"), (9, " \n", "b")]
    for i in range(6):
        words = edited.split(" ")
        words[rng.randrange(120)] = f"new{i}"
        out.append((rng.choice([20, 21, None]), " ".join(words), rng.choice(["a", "b"])))
    out += [(30 + i // 2, prose(rng.randint(1, 40)), rng.choice(["a", "b", None])) for i in range(20)]
    out += [(90, prose(9_000), "b")]
    return [(d, t, "en", s, None if t is None else len(t)) for d, t, s in out]


def read_back(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def test_one_row_of_each_group_stays(spark, tmp_path):
    rows = hard_rows()
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = corpus_pipeline.drop_near_duplicates(spark, read_back(spark, rows, tmp_path / "in"), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = Counter(tuple(r) for r in got.collect())
    groups = {}
    for row, g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append(row)
    for members in groups.values():
        least = min(((d is None, d or 0) for d, *_ in members))
        staying = [m for m in members if (m[0] is None, m[0] or 0) == least and left[m]]
        assert staying
        left[staying[0]] -= 1
    assert not +left


def test_each_row_is_mixed_by_itself(spark, tmp_path):
    rows = hard_rows()
    got = Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, read_back(spark, rows, tmp_path / "in"), "").collect())
    have = Counter(rows)
    assert all(n <= 2 * have[row] for row, n in got.items())
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    total = sum(size(t) for _, t, *_ in rows)
    of = Counter()
    for row in rows:
        of[row[3]] += size(row[1])
    want, open_, left = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(of, key=lambda s: (s is None, s or "")))}, 1.5 * total
    while open_:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * of[s]]
        for s in over or list(open_):
            want[s] = min(2 * of[s], left * open_[s] / sum(open_.values()))
        left -= sum(want[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over} if over else {}
    for source, target in want.items():
        taken = sum(n * size(row[1]) for row, n in got.items() if row[3] == source)
        assert abs(taken - target) <= max(size(t) for _, t, _, s, _ in rows if s == source) / 2 + 1


def test_stages_on_hard_rows_and_on_none(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("hard", hard_rows()), ("none", [])):
        docs = read_back(spark, rows, tmp_path / name)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{name}{i}"))
            after = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            assert i == 4 or after.columns == docs.columns
            if i == 0:
                assert after.count() == len(rows)
            docs, before = after, docs
        assert docs.filter("piece = 0").count() == before.count()
