"""Vector codes, spelling variants and line dedup against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import line_dedup, ngram_model, queries, spelling_variants, toxicity, vector_codes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = [sorted(repr(tuple(r[c] for c in order)) for r in table) for table, order in ((got.collect(), names), (want.fetchall(), [want.columns.index(c) for c in names]))]
    assert rows[0] == rows[1] and rows[0]


# 11 --------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, label, vector); ids are distinct."""
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) and abs(4096 * x) < 2**62 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]
    w = len(first[0][2]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    fit = [(i, lab, cut(v)) for i, lab, v in kept if len(v) == w * parts]
    books = [[cut(r[2])[p] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, _, v in fit:
                mine[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    found = {i: [near(v[p], books[p]) for p in range(parts)] for i, _, v in fit}
    error = {i: sum(d for d, _ in f) for i, f in found.items()}
    by = Counter()
    for i, lab, _ in fit:
        by[lab] += error[i]
    out = [(i, "".join(f"{k:02x}" for _, k in found[i]) if i in found else None, error.get(i), by[lab]) for i, lab, _ in kept]
    return out, books


VECTORS = "embedding array<double>, label int, vec_id long, code string, part int"


def as_vectors(spark, rows):
    return spark.createDataFrame([(v, lab, i, "x", 1) for i, lab, v in rows], VECTORS)


@pytest.mark.parametrize("seed,n,size", [(0, 300, 16), (1, 40, 64), (2, 5, 8), (3, 60, 24)])
def test_vector_codes(spark, seed, n, size):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 3)) if i % 5 else None, (rng.integers(-9, 9, size) / 7).tolist()) for i in rng.permutation(n) * 3]
    rows += [(-1, 1, None), (-2, 1, [None] * size), (-3, 1, [math.nan] * size), (-4, 1, [math.inf] * size)]
    rows += [(5000 + k, 1, rows[0][2]) for k in range(20)] + [(None, None, rows[1][2])]
    want, books = plain_codes(rows)
    found, got = vector_codes.vector_codes(as_vectors(spark, rows).repartition(3))
    assert got == books
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.collect())


def test_vector_codes_of_large_numbers_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (rng.normal(size=8) * 10.0 ** rng.integers(0, 14)).tolist()) for i in range(50)] + [(60, 1, [1.0] * 16), (61, 1, []), (62, 1, [1e300] * 8)]
    want, books = plain_codes(rows)
    found, got = vector_codes.vector_codes(as_vectors(spark, rows))
    assert got == books
    fits = lambda x: x if x is None or x < 2**63 else None
    known = {r[0]: r for r in want}
    for r in found.collect():
        assert (r["code"], r["error"]) == (known[r["vec_id"]][1], fits(known[r["vec_id"]][2]))


def test_vector_codes_of_nothing(spark):
    found, books = vector_codes.vector_codes(as_vectors(spark, [(1, 1, None)]))
    assert found.count() == 0 and books == [] and found.columns == ["vec_id", "code", "error", "label_error"]


@pytest.mark.parametrize("width", [1, 2, 3, 8, 12])
def test_bounds_are_never_above_a_distance(width):
    rng = np.random.default_rng(width)
    for scale in (3, 1000, 1 << 21):
        x, c = rng.integers(-scale, scale, (200, width)), rng.integers(-scale, scale, (16, width))
        x[:30] = c[rng.integers(0, 16, 30)]
        x[30:60] = c[rng.integers(0, 16, 30)] + rng.integers(-1, 2, (30, width))
        far = ((x[:, None] - c) ** 2).sum(2)
        i, k = np.divmod(np.arange(200 * 16), 16)
        for m in vector_codes.block_sizes(width):
            assert (vector_codes._bound(vector_codes._means(x, m), i, vector_codes._means(c, m), k) <= far[i, k]).all()
        at, best, worked = vector_codes.nearest_entries(x, c)
        assert (best == far.min(1)).all() and (at == far.argmin(1)).all()
        assert worked < far.size or width == 1


# 12 --------------------------------------------------------------------------------------


def plain_variants(rows, least=5, ratio=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, out = {}, []
    close = {a: [b for b in words if near(a, b)] for a in words}
    for a, n in words.items():
        best = min(close[a], key=lambda b: (-words[b], b), default=None)
        if best is not None and words[best] >= ratio * n:
            form[a] = best
    for a, n in words.items():
        end = a
        while end in form:
            end = form[end]
        out.append((a, form.get(a), end, n, len(close[a]), words[form[a]] if a in form else None))
    return out


def spelled(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    some = []
    for k, w in enumerate(base):
        some += [w] * (6 ** rng.randint(0, 3))
        at = rng.randrange(len(w))
        for v in (w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :], w[:at] + "zz" + w[at:], w.upper()):
            some += [v] * rng.choice([1, 5, 6, 30])
    some += ["abcabc"] * 900 + ["abcabcd"] * 150 + ["abcabcde"] * 25 + ["abcabcdef"] * 5
    rng.shuffle(some)
    texts = [" ".join(some[k : k + 97]) + rng.choice(["", "\n", "7x×÷ "]) for k in range(0, len(some), 97)]
    return [*enumerate(texts), (None, texts[0]), (3, texts[1]), (9000, None), (9001, ""), (9002, " - 12 "), (9003, "abcabc" * 2000)]


@pytest.mark.parametrize("seed,shard,piece", [(1, 50_000, 1 << 20), (2, 7, 64), (3, 1, 500)])
def test_spelling_variants(spark, monkeypatch, seed, shard, piece):
    monkeypatch.setattr(spelling_variants, "SHARD_WORDS", shard)
    monkeypatch.setattr(spelling_variants, "TEXT_SLICE", piece)
    rows = spelled(seed)
    docs = spark.createDataFrame([(t, i, "w", 1, 2) for i, t in rows], "text string, doc_id long, word string, n long, kind int").repartition(3)
    got = [tuple(r) for r in spelling_variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_variants(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len({r[2] for r in want if r[0].startswith("abcabc") and len(r[0]) > 6}) == 1


def test_a_run_loses_one_letter_at_most(spark):
    """Both a word and what is left of it are chosen in one document."""

    def cut(i, w):
        h = zlib.crc32(f"{i}:{w}".encode())
        return w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else None

    rng, rows = random.Random(4), []
    while len(rows) < 3:
        i, w = rng.randrange(10**6), "".join(rng.choice("abcdefg") for _ in range(9))
        left = cut(i, w)
        if left and cut(i, left):
            rows += [(i, f"{w} " * 6 + f"{left} " * 7), (i, f"{left} " * 5 + f"{w} " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in spelling_variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_variants(rows)))


def test_spelling_variants_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string")
    for table in (docs, docs.limit(0)):
        assert spelling_variants.spelling_variants(table).count() == 0


def test_texts_are_cut_between_words():
    text = "aB, cd" * 50 + "E" * 40 + " f é日Àß×x ÿ" + "Ā"
    want = [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    for size in (1, 3, 10, 1000):
        assert [w.decode() for part in spelling_variants.runs_of(text.encode(), size) for w in part] == want
    assert list(spelling_variants.runs_of(b"")) == []


def test_near_words_differ_by_one_letter():
    rng = random.Random(9)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        one = {a[:k] + c + a[k + j :] for k in range(len(a) + 1) for c in ("", "a", "b") for j in (0, 1)} - {a}
        assert spelling_variants.is_near(a, b) == (b in one)


def test_op12_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op12_spelling_variants(spark, "/root/testdata/sf0.001").collect()
    assert sorted(repr((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in got) == sorted(map(repr, plain_variants(rows)))


# 13 --------------------------------------------------------------------------------------


def plain_lines(rows, least=40, shared=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (len(holders.get(key(x), ())) >= shared and i != max(k for k in holders[key(x)] if k is not None))]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def lined(seed):
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcDEF é ") for _ in range(rng.choice([38, 39, 40, 41, 60]))) for _ in range(8)]
    rows = []
    for i in range(70):
        lines = [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("xyz ") for _ in range(rng.choice([0, 3, 50]))) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(rng.choice(["", " ", "\t\r", "\x0b"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "  ", "\r"]) for x in lines)))
    rows += [(5, rows[5][1]), (5, rows[9][1]), (None, rows[3][1]), (None, common[4] + "\n" + common[4]), (80, None), (81, ""), (82, "\n\n"), (83, common[4]), (84, "\n".join([common[4]] * 400))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = lined(seed)
    docs = spark.createDataFrame([(t, i, 1, "m", 3) for i, t in rows], "text string, doc_id long, at int, mark string, last long").repartition(3)
    got = [tuple(r) for r in line_dedup.line_dedup(docs).collect()]
    want = plain_lines(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[2] for r in want)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_stays_on_the_jvm(spark):
    plan = line_dedup.line_dedup(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_op13_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(rows)]
    got = queries.op13_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", F.col("kept_sha256"))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


# 7 and 9 ---------------------------------------------------------------------------------


def test_all_counts_that_share_a_half_key_are_found(monkeypatch):
    low = np.arange(1, 8, dtype=np.uint16)
    held = {"high": np.array([3] + [5] * 6, np.uint32), "low": low, "few": np.arange(9, 16, dtype=np.uint8), "big_at": np.zeros(0, np.int64), "big_n": np.zeros(0, np.int64)}
    monkeypatch.setattr(ngram_model, "_file", lambda *_: held)
    monkeypatch.setattr(ngram_model, "_pair", lambda u, w: u << np.uint64(16))
    model = ngram_model.NgramModel("", 1, 1, 1, 1, (0, 0, 0), (0, 0, 0), 1.0)
    asked = np.array([(5 << 16) + k for k in range(2, 9)] + [(3 << 16) + 1, (9 << 16) + 1], np.uint64)
    assert ngram_model._Scorer(model).pairs(asked, asked).tolist() == [10, 11, 12, 13, 14, 15, 0, 9, 0]


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    woff = np.array([0, 4, 4, 9, 10])
    x, labels = rng.normal(size=(10, 4)), rng.integers(0, 2, 10)

    def likelihood(w, moves):
        total = 0.0
        for a, b in zip(woff, woff[1:]):
            weigh = lambda y: sum(y[t] * (x[a + t] @ w) for t in range(b - a)) + sum(moves[y[t], y[t + 1]] for t in range(b - a - 1))  # noqa: E731, B023
            if b > a:
                every = [[int(c) for c in f"{k:0{b - a}b}"] for k in range(1 << (b - a))]
                total += weigh(labels[a:b]) - np.logaddexp.reduce([weigh(y) for y in every])
        return total

    w, moves, h = rng.normal(size=4), rng.normal(size=(2, 2)), 1e-5
    got = toxicity.gradient_sums(x, labels, woff, w, moves)
    for k in range(8):
        step = np.eye(8)[k] * h
        up, down = (likelihood(w + sign * step[:4], moves + sign * step[4:].reshape(2, 2)) for sign in (1, -1))
        assert math.isclose((up - down) / (2 * h), got[k], abs_tol=1e-5)
    assert got[8] == 10


@pytest.mark.parametrize("block", [1, 2, 3])
def test_long_texts_pass_through_in_blocks(monkeypatch, block):
    rng = np.random.default_rng(block)
    size = np.array([0, 1, 2, 30, 13, 29, 30, 7])
    woff = np.append(0, size.cumsum())
    s, moves = rng.normal(size=woff[-1]) * 9, rng.normal(size=(2, 2)) * 3
    want, pairs = toxicity.marginals(s, woff, moves, pairs=True)
    monkeypatch.setattr(toxicity, "BLOCK", block)
    got, other = toxicity.marginals(s, woff, moves, pairs=True)
    assert np.allclose(got, want, atol=1e-12) and np.allclose(pairs, other)


def test_field_is_fitted_alike_in_any_slices(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["bad", "worse"] if i % 2 and rng.random() < 0.3 else ["fine", "good", "day", "sun"]) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    one = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "CHAIN_TOKENS", 7)
    monkeypatch.setattr(toxicity, "CHAIN_TASKS", 3)
    two = toxicity.fit(docs, labels)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.moves, two.moves) and one.weights[1] > 1
