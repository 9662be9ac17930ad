"""Near copies by similarity, against all pairs."""

from plain_versions import least_of_group

import corpus_pipeline
from kerbline.llm import near_copies


def edited(texts):
    """Texts with words changed in their middle, so near copies of several similarities."""
    out = []
    for i, t in enumerate(texts):
        w = t.split(" ")
        if len(w) > 40:
            for k in (1, 2, 4):
                out.append(" ".join(w[: len(w) // 2] + [f"new{i}x{j}" for j in range(k)] + w[len(w) // 2 + k :]))
    return out


def test_groups_are_those_of_all_pairs(spark, texts):
    texts = [*texts, *edited(texts), "one two", "One  TWO", "two one", None]
    root = least_of_group(texts)
    assert len(set(root)) < len(set(texts)) - 20  # far more than copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(docs).collect()}
    assert got == dict(enumerate(root))


def test_pipeline_stage_drops_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    root = least_of_group([r["text"] for r in rows])
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]


def test_one_row_of_each_group_by_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (5, long), (5, other), (None, long), (7, other + " end"), (None, "alone here"), (9, "same id"), (9, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.keep_one_of_each(docs).collect()
    want = [(1, long), (5, other), (None, "alone here"), (9, "same id")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def family(size, rng):
    """A chain of near copies, each with a word or two of the one before changed."""
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for i in range(size):
        words = list(words)
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(len(words))] = f"n{i}"
        out.append(" ".join(words))
    return out


def test_hot_anchors_are_compared_in_parts(spark, monkeypatch):
    import random

    rng = random.Random(3)
    texts = family(70, rng) + [" ".join(f"u{rng.randrange(900)}" for _ in range(50)) for _ in range(60)]
    root = least_of_group(texts)
    monkeypatch.setattr(near_copies, "MOST", 8)
    monkeypatch.setattr(near_copies, "TOGETHER", 50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(docs).collect()}
    assert got == dict(enumerate(root))


def test_closest_links_span_what_is_near():
    import numpy as np

    rng = np.random.default_rng(1)
    wide = rng.integers(0, 2**63, (5, 8), dtype=np.uint64).repeat(4, axis=0)
    wide[:, 0] ^= np.uint64(1) << rng.integers(0, 60, 20, dtype=np.uint64)
    us, vs = near_copies.closest_links(wide, 20)
    assert {(min(u, v), max(u, v)) for u, v in zip(us, vs)} == {(a, b) for b in range(20) for a in range(b // 4 * 4, b)}


def test_what_samples_pass_over_is_linked(spark):
    """Of texts of five shingles and their first four, one in eighty has no sample in common."""
    words = [[f"w{i}x{k}" for k in range(9)] for i in range(600)]
    texts = [" ".join(w[: 9 - j]) for w in words for j in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def test_parities_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (0, 1, 2, 64, 65, 70, 500, 520, 900, 1100, 3000)]
    sets += [s[: len(s) * 9 // 10] for s in sets]
    bits = near_copies.parities(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert all(8 * len(b) >= max(64, len(s)) and len(b) & (len(b) - 1) == 0 for b, s in zip(bits, sets))
    for x, a in zip(sets, bits):
        for y, b in zip(sets, bits):
            assert near_copies.least_difference(a, b) <= len(np.setxor1d(x, y))
    assert near_copies.least_difference(bits[6], bits[7]) > (len(sets[6]) + len(sets[7])) / 9  # texts of 500 shingles don't meet


def test_possible_links_are_all_that_parities_allow():
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 1100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[: n - n // k], rng.integers(0, 2**64, n // k, dtype=np.uint64)])) for n in (3, 50, 60, 64, 66, 75, 1000, 1024, 1030, 1100) for k in (5, 12, 20)]
    size, root = np.array([len(x) for x in sets]), np.arange(len(sets)) // 2
    bits = near_copies.parities(np.concatenate(sets), size)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and near_copies.least_difference(bits[i], bits[j]) <= (size[i] + size[j]) / 9}
    us, vs = near_copies.possible_links(root, size, bits, 0.8)
    assert len(us) == len(want) > 20 and {(min(u, v), max(u, v)) for u, v in zip(us.tolist(), vs.tolist())} == want
    alike = {(i, j) for i, j in want if near_copies.similar(sets[i], sets[j], 0.8)}
    assert alike == {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and near_copies.similar(sets[i], sets[j], 0.8)}


def test_texts_that_share_lines_make_no_rows_of_pairs(spark, tmp_path, monkeypatch):
    """Nor do sets become tables; the session's setting for shuffle files is as before."""
    import random

    from kerbline.sources import shared

    rng = random.Random(4)
    common = [" ".join(f"c{rng.randrange(10**6)}" for _ in range(9)) for _ in range(30)]
    texts = ["\n".join([*rng.sample(common, 12), " ".join(f"u{rng.randrange(10**6)}" for _ in range(150))]) for _ in range(300)]
    root = least_of_group(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(docs).collect()}
    assert got == dict(enumerate(root))
    tables = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert "near-passed-over" in tables and "near-sets" not in tables
    rows = {k: sum(spark.read.parquet(str(p)).count() for p in tmp_path.glob(f"{k}-*")) for k in ("near-shared", "near-passed-over")}
    assert rows["near-shared"] > 100 and rows["near-passed-over"] < 20  # nearly all pairs of texts have a line in common
    assert spark.conf.get(shared._TIDY) == "false"


def test_empty(empty):
    assert near_copies.near_groups(empty).count() == 0
    assert near_copies.keep_one_of_each(empty).count() == 0
