"""Words that differ from a far commoner one by a single letter, by Aho-Corasick halves.

One changed letter leaves one half of a word as it is: its first half at the beginning of
the other word, or its second half at the other's end. Automaton shards hold the two halves
of every word; all words are scanned; hits at another place or in words of another length
are passed over, and the rest is compared letter by letter.

A word is scanned where halves with its own three first (or last) letters are, as no half is
shorter, so the work does not grow with words times shards. Beginnings and ends that more
words share than a shard holds have their halves dealt to several shards, each of which
scans all of these words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, texts_of

#: Maximal runs of letters in UTF-8 with A-Z in lower case; letters beyond ASCII are two bytes.
_ASCII_RUN, _RUN = re.compile(rb"[a-z]+"), re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
#: Letters of a word that say where its halves are looked up; halves of six letters have three.
ENDS = 3
#: Words of which a shard's automaton holds halves, and distinct words counted before they are sent.
SHARD_WORDS, HELD_WORDS = 10_000, 200_000
#: Bytes of a text that are looked at together.
TEXT_SLICE = 1 << 20
FIRST, LAST = 0, 1


def runs_of(text: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The runs of letters of a text, A-Z in lower case, list by list; long texts are cut
    between runs."""
    size, at = size or TEXT_SLICE, 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        piece = text[at:end].lower()  # of bytes, this changes A-Z alone
        yield (_ASCII_RUN if piece.isascii() else _RUN).findall(piece)
        at = end


def _counted(modulus: int, least_length: int):
    """Counts of the words of each row, added up over a batch or ``HELD_WORDS`` words."""

    def send(total: Counter) -> pa.RecordBatch:
        words = pa.array(list(total), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                own: Counter = Counter()
                for runs in runs_of(text.as_py()):
                    own.update(x for x in runs if len(x) >= least_length)  # no shorter word can count
                start = zlib.crc32(b":" if number is None else b"%d:" % number)
                for word, n in own.items():
                    h = zlib.crc32(word, start)
                    if h % modulus == 0:  # once a run: what is left of it is not looked at again
                        letters = word.decode()
                        k = h % len(letters)
                        word = (letters[:k] + letters[k + 1 :]).encode()
                    total[word] += n
                if len(total) >= HELD_WORDS:
                    yield send(total)
                    total = Counter()
        yield send(total)

    return run


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, modulus: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the distinct words of all texts of at least ``least_length`` letters that
    occur at least ``least_count`` times.

    A word is a run of letters, A-Z in lower case. From one in ``modulus`` pairs of a
    document and a word, chosen by the CRC-32 of ``<doc_id>:<word>``, a letter is left out.
    """
    sent = texts_of(docs, id_col, text_col).mapInArrow(_counted(modulus, least_length), "word string, n long")
    return sent.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def is_near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes one word the other."""
    if len(a) < len(b):
        a, b = b, a
    more = len(a) - len(b)
    if more > 1 or a == b:
        return False
    low, high = 0, len(b)  # the length of what both begin with, by halving
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if a[low:k] == b[low:k] else (low, k - 1)
    return a[low + 1 :] == b[low + 1 - more :]


class Shard:
    """An automaton over halves of words, and by half and length the words that have it.

    The other half of a near word holds the changed letter, so of its own two halves one is
    as it was: words are kept by these quarters, and only words that share one are compared."""

    def __init__(self):
        self.words: dict[tuple, list[tuple[str, int]]] = {}
        self.halves: dict[str, int] = {}
        self.automaton = None

    def add(self, kind: int, word: str, n: int) -> None:
        cut = len(word) // 2
        half, rest = (word[:cut], word[cut:]) if kind == FIRST else (word[cut:], word[:cut])
        self.halves[half] = self.halves.get(half, 0) | 1 << kind
        middle = len(rest) // 2
        for side, quarter in ((FIRST, rest[:middle]), (LAST, rest[middle:])):
            self.words.setdefault((kind, half, len(word), side, quarter), []).append((word, n))

    def close(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for half, kinds in self.halves.items():
            self.automaton.add_word(half, (half, kinds))
        if self.halves:
            self.automaton.make_automaton()

    def scan(self, kind: int, word: str) -> Iterator[tuple[str, int]]:
        """The near words of ``word``, each found by one of its halves only."""
        if not self.halves:
            return
        size, get = len(word), self.words.get
        for end, (half, kinds) in self.automaton.iter(word):
            begin = end + 1 - len(half)
            if not kinds >> kind & 1 or (begin != 0 if kind == FIRST else end + 1 != size):
                continue
            rest = word[end + 1 :] if kind == FIRST else word[:begin]
            for other_size in (size - 1, size, size + 1):
                other_rest = other_size - len(half)
                if (other_size // 2 if kind == FIRST else other_size - other_size // 2) != len(half):
                    continue
                middle = other_rest // 2
                first, last = rest[:middle], rest[len(rest) - (other_rest - middle) :]
                for other, n in get((kind, half, other_size, FIRST, first), ()):
                    if is_near(word, other) and not (kind == LAST and word.startswith(other[: other_size // 2])):
                        yield other, n
                for other, n in get((kind, half, other_size, LAST, last), ()):
                    own = other[len(half) :] if kind == FIRST else other[:other_rest]
                    if own[:middle] == first:
                        continue  # found by its first quarter
                    if is_near(word, other) and not (kind == LAST and word.startswith(other[: other_size // 2])):
                        yield other, n


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, halves before the words to scan; only one shard is held."""
    held, shard = None, Shard()
    for batch in batches:
        out: list[tuple] = []
        for number, role, kind, word, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "role", "kind", "word", "n"))):
            if number != held:
                held, shard = number, Shard()
            if role == 0:
                shard.add(kind, word, n)
                continue
            if shard.automaton is None:
                shard.close()
            out += [(word, n, *found) for found in shard.scan(kind, word)]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2)], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame, shard_words: int | None = None) -> DataFrame:
    """``word, n, near, near_n``: both orders of each two near words of ``words(word, n)``,
    which holds no word twice and none shorter than twice ``ENDS`` letters."""
    size = shard_words or SHARD_WORDS
    ends = F.array(F.struct(F.lit(FIRST).alias("kind"), F.left("word", F.lit(ENDS)).alias("ends")), F.struct(F.lit(LAST).alias("kind"), F.right("word", F.lit(ENDS)).alias("ends")))
    both = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.*")
    shares = both.groupBy("kind", "ends").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    total = words.count()
    shards = max(1, -(-2 * total // size))
    met = both.join(shares, ["kind", "ends"])
    # a large share of words is dealt to shards of its own, the others are put together
    place = lambda part: F.when(F.col("parts") > 1, F.xxhash64("kind", "ends", part)).otherwise(F.pmod(F.xxhash64("kind", "ends"), F.lit(shards)))
    halves = met.select(place(F.pmod(F.xxhash64("word"), F.col("parts"))).alias("shard"), F.lit(0).alias("role"), "kind", "word", "n")
    scans = met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    scans = scans.select(place(F.col("part")).alias("shard"), F.lit(1).alias("role"), "kind", "word", "n")
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return halves.union(scans).repartition(tasks, "shard").sortWithinPartitions("shard", "role").mapInArrow(_scanned, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: where following the forms ends, by pointer
    jumping. A form occurs at least several times as often as its word, so there is no cycle
    and chains are as short as the logarithm of the largest count."""
    to = staged(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = staged(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        moved = to.where("moved").limit(1).count()
        to = to.select("word", "root")
        if not moved:
            return to


def spelling_variants(docs: DataFrame, ratio: int = 5, least_length: int = 6, least_count: int = 5, modulus: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary of ``docs``.

    A word's form is its near word of the largest count, the first in order on ties, if it
    occurs at least ``ratio`` (over 1) times as often as the word; else null. The root is
    where forms lead in the end, the word itself without a form. A null text has no words, a
    null id counts as an empty one in the CRC; other columns are ignored; without words
    there are no rows. ``least_length`` is six or more.
    """
    if least_length < 2 * ENDS or ratio <= 1:
        raise ValueError("words need six letters or more, and a ratio over one")
    words = staged(vocabulary(docs, least_length, least_count, modulus, id_col, text_col), "variant-words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.first("n").alias("of"))
    form = (-F.col("best.less")) >= ratio * F.col("of")
    best = staged(best.select("word", "n_near", F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")), "variant-forms")
    ends = roots(best.where("form IS NOT NULL"))
    out = words.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
