"""The pipeline against plain versions of its stages, each on what the one before kept."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain_versions import least_of_group, most_repeated

import corpus_pipeline
from kerbline.llm import mixing, quality_rules, secret_scan
from kerbline.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage got and gave, with the columns of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    return seen


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_stage(spark, sf_dir, stages):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    keep = {r["doc_id"] for r in quality_rules.quality_rules(stages[0], good).collect() if r["kept"]}
    assert set(rows(stages[1])) == keep and 0 < len(keep) < stages[0].count()
    labels = rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    lost = set(rows(stages[0])) - keep
    assert sum(labels[k]["quality"] == 1 for k in lost if k in labels) <= 5  # short ones, by the base rules


def test_near_duplicate_stage(stages):
    before = sorted(rows(stages[1]).values(), key=lambda r: r["doc_id"])
    root = least_of_group([r["text"] for r in before])
    assert set(rows(stages[2])) == {r["doc_id"] for i, r in enumerate(before) if root[i] == i}


def test_secret_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    for k, r in after.items():
        spans = [x for x in secret_scan.candidate_spans(before[k]["text"]) if x[0] <= 2]
        assert all(before[k]["text"][a:b] not in r["text"] or b - a < 12 for _, a, b in spans)
        assert r["n_chars"] == len(r["text"])
        if not secret_scan.candidate_spans(before[k]["text"]):
            assert r["text"] == before[k]["text"]


def test_mixing_stage(stages):
    before, used = rows(stages[3]), Counter(r["doc_id"] for r in stages[4].collect())
    assert set(used) == set(before)
    tokens = defaultdict(int)
    for r in before.values():
        tokens[r["source"]] += len(r["text"].split()) + 1
    shares = [t / sum(tokens.values()) for t in tokens.values()]
    x = mixing.exponent(None, math.log(max(shares) / min(shares)), None, 1.5)
    assert most_repeated(shares, x) <= 1.5 + 1e-9
    assert max(used.values()) <= 2


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    want = Counter()
    for r in stages[4].collect():
        want[zlib.crc32(np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    pieces, sizes = defaultdict(lambda: defaultdict(list)), Counter()
    for r in stages[5].collect():
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"]
        sizes[r["sequence_id"]] += r["length"]
        pieces[r["doc_id"]][r["start"]].append((r["sequence_id"], r["length"], bytes(r["ids"])))
    assert all(n <= 4096 for n in sizes.values())
    assert sum(sizes.values()) == sum(r["length"] for r in stages[5].collect())
    assert sum(n for n in sizes.values() if n & (n - 1)) == 0 or all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())
    texts = {zlib.crc32(np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()): r["doc_id"] for r in stages[4].collect()}
    whole = Counter(zlib.crc32(x[0][2]) for by in pieces.values() for start, x in by.items() if start == 0 for x in [[y] for y in x] if zlib.crc32(x[0][2]) in texts)
    assert not whole - want
