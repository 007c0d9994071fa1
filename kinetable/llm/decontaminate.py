"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 13 consecutive words of the test items (an item of fewer words is one window). Words
of the patterns are numbered; a table of two-word blocks says how far a position can be moved on before any pattern
can end there, a block that ends a pattern selects the bucket of its patterns, and direct comparison confirms.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from kinetable.llm.common import map_arrow, packed, worker_state
from kinetable.session import staged

WINDOW = 13
#: UTF-8 bytes of item texts that are searched for at once; a larger benchmark is taken in so many blocks. The tables of a
#: block take up to 90 times its bytes, in each Python worker.
BLOCK_BYTES = 4 << 20

#: A-Z to lower case, and every other ASCII character but 0-9 and a-z to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class _Group:
    """Search tables for the patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[int, ...], list]]] = defaultdict(list)


class WuManber:
    """Tables for the windows of (item, text) pairs, and the search of one text's words."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.codes: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list] = {}
        for item, text in items:
            seq = [self.codes.setdefault(w, len(self.codes) + 1) for w in words(text)]
            size = min(window, len(seq))
            for i in range(len(seq) - size + 1 if size else 0):
                held = owners.setdefault(tuple(seq[i: i + size]), [])
                if not held or held[-1] != item:
                    held.append(item)
        self.base = len(self.codes) + 1
        groups: dict[int, _Group] = {}
        for pattern, held in owners.items():
            g = groups.setdefault(len(pattern), _Group(len(pattern)))
            last = g.length - g.block
            for i in range(last + 1):
                key = self._key(pattern, i + g.block - 1, g.block)
                g.shift[key] = min(g.shift.get(key, last + 1), last - i)
            g.buckets[self._key(pattern, g.length - 1, g.block)].append((pattern, held))
        self.groups = list(groups.values())

    def _key(self, seq, end: int, block: int) -> int:
        return seq[end] if block == 1 else seq[end - 1] * self.base + seq[end]

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(number of words, spans [start, end) of occurrences in order of their ends, items found)."""
        found = words(text)
        n, get = len(found), self.codes.get
        seq = [get(w, 0) for w in found]
        spans, items = [], set()
        base = self.base
        for g in self.groups:
            m, shift, two = g.length, g.shift, g.block == 2
            default = m - g.block + 1
            at = m - 1
            while at < n:
                key = seq[at - 1] * base + seq[at] if two else seq[at]
                step = shift.get(key, default)
                if step:
                    at += step
                    continue
                here = tuple(seq[at - m + 1: at + 1])
                for pattern, held in g.buckets.get(key, ()):
                    if pattern == here:
                        spans.append((at - m + 1, at + 1))
                        items.update(held)
                at += 1
        return n, spans, items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FIELDS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _searched(rows: DataFrame, at: int, items: list, window: int) -> DataFrame:
    """Columns ``row`` and ``_FIELDS`` with the occurrences of these items added to those already found."""
    schema = StructType([StructField("row", rows.schema["row"].dataType)] + StructType.fromDDL(_FIELDS).fields)
    arrow = to_arrow_schema(schema)
    shared, token = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        # Made once in each worker; a worker keeps the tables of one block only.
        held = worker_state("wu-manber", dict)
        if held.get("token") != token:
            held.clear()
            held.update(token=token, tables=WuManber(shared.value, window))
        tables = held["tables"]
        for batch in batches:
            row = batch.column(0)
            old = batch.select(["spans", "items"]).to_pylist() if batch.num_columns > 1 else [{"spans": [], "items": []}] * batch.num_rows
            n, spans, found = [], [], []
            for text, was in zip(row.field(at).to_pylist(), old):
                count, hit, own = tables.search(text)
                n.append(count)
                spans.append([{"start": a, "end": b} for a, b in united(hit + [(x["start"], x["end"]) for x in was["spans"]])])
                found.append(sorted({*map(str, own), *was["items"]}))
            yield pa.RecordBatch.from_arrays(
                [row, *(pa.array(v, type=f.type) for v, f in zip((n, spans, found), list(arrow)[1:]))], names=arrow.names)

    return map_arrow(rows, run, schema)


def searched(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
             window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``row`` (all of ``df``), ``n_words``, ``spans`` (hit words, as word positions) and ``items`` (ids as strings).

    Words are runs of a-z, 0-9 and non-ASCII characters after A-Z went to lower case. Null and wordless texts have no
    words; null and wordless items have no window, and an item of null id is searched for under the id ''. Items with
    equal windows are all reported; repeated items count once by their id. The items are the query set: their size is
    measured, and what is beyond ``block_bytes`` is searched for in further passes, each with a bounded broadcast.
    """
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows, at = df.select(packed(df)), df.columns.index(text)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = _searched(rows, at, [(r[0], r[1]) for r in part.collect()], window)
        if b + 1 < blocks:
            rows = staged(rows, "searched")
    return rows


def hit_words() -> Column:
    """Number of words in the spans."""
    return F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")


def contaminated() -> Column:
    """At least one hit word, and at least a twentieth of all words hit."""
    n = hit_words()
    return (n > 0) & (20 * n >= F.col("n_words"))


def keep_clean(df: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with the columns of ``df``."""
    return searched(df, items, **names).where(~contaminated()).select("row.*")
