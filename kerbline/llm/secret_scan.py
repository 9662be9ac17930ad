"""Secret scan: base patterns, and weak parts reported only where complements meet.

Each text gives candidate spans. The base kinds stand by themselves. Access identifiers,
bare high-entropy strings and endpoints are weak: each alone is common in clean text. They
are joined as intervals within their scope (a block between blank lines): a weak secret
needs an identifier or an endpoint within ``gap`` characters, a weak identifier or an
endpoint needs a secret. The join is a window over the scope in order of position, which
keeps the last part of each role before, and another in reverse order the first after, so no
pairs are listed and no position is looked at twice.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, staged, texts_of

#: Kinds in order of listing; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A name may carry a prefix that ends in a sign or where a capital follows: db_user, dbUser.
_IDENTIFIER = re.compile(r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:(access_?key)|access_?key_?(?:id|name)|client_?id|account_?(?:id|name)|user(?:[_\x20]?(?:name|id))?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.I | re.A)
#: A whole run with a digit; a '=' before it must end a key name (KEY=value), not be padding.
_SECRET = re.compile(r"""(?:(?<![A-Za-z0-9+/_=-])|(?<=[A-Za-z0-9_"'\])\x20:]=))(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}""")
_ENDPOINT = re.compile(r"(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|jdbc:[a-z0-9]+)://[^\s\"'<>]+", re.I | re.A)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

_SPANS = "array<struct<kind:int,start:int,end:int,scope:int>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())]))


class _Spans:
    """Spans that know which of them overlap a given one."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.spans: list[tuple[int, int, int]] = []
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for span in spans:
            self.add(*span)

    def add(self, kind: int, a: int, b: int) -> None:
        self.spans.append((kind, a, b))
        self.ends.setdefault(kind, []).append((b, a))  # spans of one kind are found in order and don't overlap

    def meets(self, a: int, b: int, but: int | None = None) -> bool:
        for kind, held in self.ends.items():
            i = bisect_left(held, (a + 1, -1))  # the first that ends after a
            if kind != but and i < len(held) and held[i][1] < b:
                return True
        return False


def candidate_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all candidates of one text, in order of position."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    weak = [(5, *m.span()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    secrets = [m.span() for m in _SECRET.finditer(text) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    if ":" in text or "=" in text:
        begun = {a for a, _ in secrets}  # what a bare access key names may be the secret itself
        weak += [(3, *m.span()) for m in _IDENTIFIER.finditer(text) if not (m[1] and m.start(2) in begun)]
    weak += [(4, a, b) for a, b in secrets]
    base, others = _Spans(out), _Spans([])
    for kind, a, b in weak:  # a part that lies in another span is no part of its own, but for a secret that an endpoint carries
        carried = kind == 4 and (text[a - 1 : a] == "=" or text[a - 1 : a] == ":" and text[b : b + 1] == "@")
        if not base.meets(a, b) and not others.meets(a, b, 5 if carried else None):
            others.add(kind, a, b)
    taken = out + others.spans
    return sorted(taken, key=lambda x: (x[1], x[0]))


def _found(batches):
    """Passes ``kept`` on, with a number for the row and the candidates of its text."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        for part in slices(batch):
            spans = []
            for text in part.column("text").to_pylist():
                got = candidate_spans(text)
                breaks = [m.start() for m in _BLANK.finditer(text)] if got else []
                spans.append([{"kind": k, "start": a, "end": b, "scope": bisect_left(breaks, a)} for k, a, b in got])
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(row, row + len(spans)), pa.int64()), "kept": part.column("kept"), "spans": pa.array(spans, _SPAN_ARROW)})
            row += len(spans)


def _scanned(kept: DataFrame) -> DataFrame:
    """``row, kept, spans`` of ``kept, text``, as a table in the shared folder."""
    kind = kept.schema["kept"].dataType.simpleString()
    return staged(kept.mapInArrow(_found, f"row long, kept {kind}, spans {_SPANS}"), "secret-spans")


def _linked(found: DataFrame, gap: int) -> DataFrame:
    """``row, linked``: the weak spans of each text that have a complement close by."""
    flat = found.where(F.exists("spans", lambda s: s["kind"] > 2)).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    role = F.element_at(F.array(*[F.lit(_ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    scope = Window.partitionBy("row", "scope")
    # a frame that ends at the row is summed up as it grows; one that begins there is not
    before, after = (scope.orderBy(*[f(c) for c in ("start", "end", "kind")]).rowsBetween(Window.unboundedPreceding, -1) for f in (F.asc, F.desc))
    near = {}
    for part in ("secret", "identifier", "endpoint"):
        last = F.max(F.when(F.col("role") == part, F.col("end"))).over(before)
        first = F.min(F.when(F.col("role") == part, F.col("start"))).over(after)
        near[part] = F.coalesce(F.col("start") - last <= gap, F.lit(False)) | F.coalesce(first - F.col("end") <= gap, F.lit(False))
    met = flat.withColumn("role", role).select("row", "kind", "start", "end", "role", *[c.alias(f"near_{k}") for k, c in near.items()])
    kept = met.where("kind > 2 AND CASE role WHEN 'secret' THEN near_identifier OR near_endpoint ELSE near_secret END")
    return kept.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def secret_spans(docs: DataFrame, gap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, linked``: arrays of (kind number, start, end), ``base`` in order of
    position, offsets in code points, end exclusive.

    One row per input row, also for rows with equal or null ids; a null or empty text has
    no spans; other columns are ignored; an empty table gives no rows.
    """
    found = _scanned(texts_of(docs, id_col, text_col).select(F.struct("doc_id").alias("kept"), "text"))
    rows = found.select("row", "kept.doc_id", _bare(_base("spans")).alias("base"))
    return rows.join(_linked(found, gap), "row", "left").select("doc_id", "base", F.coalesce("linked", _none()).alias("linked"))


def _base(spans):
    return F.filter(spans, lambda s: s["kind"] <= 2)


def _bare(spans):
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _none():
    return F.array().cast("array<struct<kind:int,start:int,end:int>>")


def listed(spans):
    """A column of spans as ``kind:start:end``, by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(mask: str):
    """Passes ``kept`` on, with ``text`` whose ``spans``, in order, are masked."""

    def one(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [text[at : s["start"]], mask]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                new = [one(*x) for x in zip(part.column("text").to_pylist(), part.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(new, pa.string())], names=["kept", "masked"])

    return run


def redacted(docs: DataFrame, mask: str = "[secret]", gap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all base and linked spans of each text replaced by ``mask``.

    Columns and rows stay as they are; a null text stays null. Overlapping spans become one
    mask. Rows with equal ids are masked each by its own spans.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _scanned(docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("kept"), text.alias("text")))
    at = docs.columns.index(text_col)
    clean = found.where(F.size("spans") == 0).select("kept", F.col(f"kept.c{at}").cast("string").alias("masked"))
    some = found.where(F.size("spans") > 0)  # only these rows are shuffled
    some = some.join(_linked(found.select("row", "spans"), gap), "row", "left").withColumn("all", F.concat(_bare(_base("spans")), F.coalesce("linked", _none())))
    kind = found.schema["kept"].dataType.simpleString()
    done = some.select("kept", F.col(f"kept.c{at}").cast("string").alias("text"), F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("spans"))
    done = done.mapInArrow(_masked(mask), f"kept {kind}, masked string")
    both = clean.union(done)
    return both.select(*[(F.col("masked") if i == at else F.col(f"kept.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
