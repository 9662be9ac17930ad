"""A small corpus with nulls, empty and repeated texts, and names that clash."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, bucket int, words string, chunk long, fingerprint string"


def sentence(rng, n):
    return " ".join(rng.choice("the of and a in road stone river walk light".split()) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(1, 220)) for _ in range(60)]
    passage = sentence(rng, 70)
    base[3] = base[3] + " " + passage
    base[4] = passage + "\n" + base[4]
    base[5] = passage + " x " + passage + " y"
    base[6] = base[7] = base[8]
    words = base[9].split()
    base[10] = " ".join(words[:-1] + ["Changed"])
    base[11] = "same same same same same same same same same same same same same same same same same same same same same same same same same same same same same same same same same same same same same"
    base[12] = "Tab\tand\x0bother\x0c spaces\r\n  é ß İ ſ ﬁ 日本 \x1c end"
    base[13] = ""
    base[14] = " \n\t "
    base[15] = sentence(rng, 6000)
    return base


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t), 1, 2, "w", 3, "f") for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None, None, None, None, None, None), (None, texts[0], "en", "s0", 1, 1, 1, "w", 1, "f"), (0, texts[0], "en", "s0", 1, 1, 1, "w", 1, "f")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
