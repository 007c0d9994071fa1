"""Repair of conversation structure by a grammar-compressed dynamic programme.

Each row of a conversation is one of nine symbols: its role's initial and its fault. What a run of symbols does to the
state between rows (nothing yet, after system, after user, after assistant) is a min-plus transfer matrix, whose entries
hold the least cost and a rope of the edits; ropes share their parts and compare by hashes. Re-Pair turns frequent
pairs of symbols into rules, counted over all conversations, so the matrix of a rule is made once, from those of its two
parts, and used wherever the rule stands.

Edits of a segment always end with the edit of a row (inserts go before rows), so of two edit strings of one segment
none is a prefix of the other, and the least string of a whole is made of the least strings of its parts. Long
conversations are therefore cut into segments: costs are folded back over the segments, then states forward.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from kinetable.llm.common import BLANK_CHARS, broadcast_model, map_arrow
from kinetable.operators.ranking import in_ranges
from kinetable.session import staged

#: Rows of one segment at most; rules made in one round, and rounds.
SEGMENT, RULES, ROUNDS = 1 << 16, 16, 8
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the one role that may be inserted, or given to a row, in each state.
FOLLOWING = (USER, USER, ASSISTANT, USER)
#: Cost of the inserts that end a conversation in each state, and how many these are.
ENDING = (0, 2 * INSERT, INSERT, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_PRIME, _BASE, _SHORT, _FIRST_RULE = (1 << 61) - 1, 1_000_003, 48, 0xE000


# --- ropes: (length, hash, base ** length, text or pair of ropes) -------------------------------------------------

def leaf(text: str):
    h = 0
    for c in text:
        h = (h * _BASE + ord(c)) % _PRIME
    return len(text), h, pow(_BASE, len(text), _PRIME), text


def joined(a, b):
    if not a[0]:
        return b
    n = a[0] + b[0]
    parts = a[3] + b[3] if n <= _SHORT and isinstance(a[3], str) and isinstance(b[3], str) else (a, b)
    return n, (a[1] * b[2] + b[1]) % _PRIME, a[2] * b[2] % _PRIME, parts


def less(a, b) -> bool:
    """Whether rope ``a`` comes before ``b``; equal parts are skipped by their hashes."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x[:2] == y[:2]:
            continue
        if not isinstance(x[3], str) and (x[0] >= y[0] or isinstance(y[3], str)):
            left += (x[3][1], x[3][0])
            right.append(y)
        elif not isinstance(y[3], str):
            right += (y[3][1], y[3][0])
            left.append(x)
        else:
            n = min(x[0], y[0])
            if x[3][:n] != y[3][:n]:
                return x[3] < y[3]
            left += [leaf(x[3][n:])] if x[0] > n else []
            right += [leaf(y[3][n:])] if y[0] > n else []
    return bool(right)


def text_of(rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x[3], str):
            out.append(x[3])
        else:
            todo += (x[3][1], x[3][0])
    return "".join(out)


# --- transfer matrices: four rows of four entries, each (cost, rope) or None ---------------------------------------

def better(a, b) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and less(a[1], b[1]))


def advanced(row: list, matrix: list) -> list:
    """A row vector of entries times a matrix."""
    out = [None] * 4
    for done, onward in zip(row, matrix):
        if done is not None:
            for j, step in enumerate(onward):
                if step is not None and (out[j] is None or done[0] + step[0] <= out[j][0]):
                    entry = (done[0] + step[0], joined(done[1], step[1]))
                    if better(entry, out[j]):
                        out[j] = entry
    return out


def start(state: int) -> list:
    return [(0, leaf("")) if j == state else None for j in range(4)]


def symbol_matrix(symbol: str) -> list:
    """What one row can do: some inserts, then keep, rerole or delete it. ``x`` must go, capitals are cut off."""
    out = []
    for i in range(4):
        row: list = [None] * 4
        state, inserts = i, 0
        while True:
            edits = [("D", state, DELETE)]
            if symbol != "x":
                cut = CUT * symbol.isupper()
                edits.append(("R", FOLLOWING[state], REROLE + cut))
                to = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(symbol.lower())
                if to == (SYSTEM if state == EMPTY and to == SYSTEM else FOLLOWING[state]):
                    edits.append(("K", to, cut))
            for letter, to, cost in edits:
                entry = (INSERT * inserts + cost, leaf("I" * inserts + letter))
                if better(entry, row[to]):
                    row[to] = entry
            state, inserts = FOLLOWING[state], inserts + 1
            if inserts > 2:
                break
        out.append(row)
    return out


class Grammar:
    """Rules in the order they were made, and the matrix of every symbol, made bottom-up."""

    def __init__(self):
        self.rules: list[tuple[str, str]] = []
        self.matrices = {s: symbol_matrix(s) for s in "suaoSUAOx"}
        self.known: dict[tuple[str, int], list] = {}

    def add(self, pair: str) -> None:
        name = chr(_FIRST_RULE + len(self.rules))
        self.rules.append((pair, name))
        self.matrices[name] = [advanced(row, self.matrices[pair[1]]) for row in self.matrices[pair[0]]]

    def packed(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def reached(self, symbols: str, state: int) -> list:
        """The best entry for each state after ``symbols``; short runs are remembered."""
        if (symbols, state) in self.known:
            return self.known[symbols, state]
        row = start(state)
        for symbol in self.packed(symbols):
            row = advanced(row, self.matrices[symbol])
        if len(symbols) <= 64 and len(self.known) < 100_000:
            self.known[symbols, state] = row
        return row

    def chosen(self, symbols: str, state: int, after: list[int]) -> tuple[int, int, str]:
        """State after the segment, cost and edits of the best way, where ``after`` is the cost of what follows."""
        options = [(e[0] + a, e[1], j, e[0]) for j, (e, a) in enumerate(zip(self.reached(symbols, state), after)) if e is not None]
        best = options[0]
        for option in options[1:]:
            if better(option, best):
                best = option
        return best[2], best[3], text_of(best[1])


def replayed(symbols: str, state: int, edits: str) -> list[str]:
    """For each row its inserts (``u``, ``a``) and its own edit: K, D, or U, A for a row that becomes user, assistant."""
    out, now, at = [], "", 0
    for edit in edits:
        if edit == "I":
            state = FOLLOWING[state]
            now += "ua"[state == ASSISTANT]
            continue
        if edit == "R":
            state = FOLLOWING[state]
            edit = "UA"[state == ASSISTANT]
        elif edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[symbols[at].lower()]
        out.append(now + edit)
        now, at = "", at + 1
    return out


# --- rows ----------------------------------------------------------------------------------------------------------

def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by crc32 of ``conv_id:turn``; nulls count as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                     (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


class Repair:
    """A cheapest repair of each conversation: :meth:`summaries`, :meth:`rows` and :meth:`digests`.

    Takes ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not read. A null role or text counts as one
    space, a null ``conv_id`` is a conversation of its own, a null turn comes first. Rows of one turn come by role, then
    by a hash of the text, and repeated rows one after the other; they are faults like any other. A role that does not
    start with s, u or a (an empty one too) can be reroled or deleted, never kept. An empty table gives empty results.

    Rows are put in order once, in sampled ranges of even size written to the shared folder, so a conversation of any
    length is dealt out over many tasks; what is gathered of one conversation is a number for each range or segment.
    """

    def __init__(self, df: DataFrame):
        spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        rows = df.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
        rows = rows.withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("copy", F.monotonically_increasing_id())
        self.ordered = in_ranges(rows, self.ORDER)
        self.symbols = staged(self._symbols(), "conversation-symbols")
        self.segments = staged(self._segments(), "conversation-segments")
        self.grammar = learned(self.segments)
        self.solved = staged(self._solved(), "conversation-edits")

    ORDER = ["conv", "turn", "role", "h", "copy"]

    def _symbols(self) -> DataFrame:
        """One row for each row: its number in its conversation's part of a range, fault and symbol."""
        end = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
        rows = self.ordered.select("conv", "turn", "role", "h", "copy", "_range", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
        # At most one conversation crosses a border between ranges, so these are fewer than the ranges.
        crossing = staged(rows.groupBy("conv").agg(F.min("_range").alias("a"), F.max("_range").alias("b")).where("a < b").select("conv"), "conversations-crossing")
        seen = rows.join(crossing, "conv", "left_semi").groupBy("conv", "role", "h", "_range").agg(F.lit(True).alias("late"))
        earlier = Window.partitionBy("conv", "role", "h").orderBy("_range")
        late = staged(seen.withColumn("i", F.row_number().over(earlier)).where("i > 1").drop("i"), "conversation-repeats")
        here = Window.partitionBy("conv", "_range").orderBy("turn", "role", "h", "copy")
        same = Window.partitionBy("conv", "_range", "role", "h").orderBy("turn", "copy")
        initial = F.substring("role", 1, 1)
        rows = rows.join(late, ["conv", "role", "h", "_range"], "left")
        rows = rows.withColumns({"pos": F.row_number().over(here), "initial": initial, "before": F.lag(initial).over(here), "turn_before": F.lag("turn").over(here)})
        rows = rows.withColumn("again", F.coalesce("late", F.lit(False)) | (F.row_number().over(same) > 1))
        fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
        letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
        symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
        rows = rows.withColumn("fault", fault).withColumn("symbol", symbol)
        return rows.select("conv", "_range", "pos", "turn", "turn_before", "initial", "before", "fault", "symbol")

    def _segments(self) -> DataFrame:
        part = F.floor((F.col("pos") - 1) / SEGMENT).alias("part")
        run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "")
        segments = self.symbols.groupBy("conv", "_range", part).agg(run.alias("symbols"))
        order = Window.partitionBy("conv").orderBy("_range", "part")
        whole = Window.partitionBy("conv")
        return segments.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("last", F.row_number().over(order) == F.col("n"))

    def _solved(self) -> DataFrame:
        """Each segment with the state it starts in, its edits and their cost."""
        shared = broadcast_model(self.segments.sparkSession, self.grammar)
        single = self.segments.where("n = 1").withColumns({"state": F.lit(EMPTY), "after": F.array(*map(F.lit, ENDING))})
        several = self.segments.where("n > 1").drop("n")
        costs = _with(several, "costs array<array<int>>", shared, lambda g, s: [[e and e[0] for e in g.reached(s, i)] for i in range(4)], ["symbols"])
        after = _folded(costs.select("conv", "_range", "part", "costs"), "after array<int>", _fold_back)
        several = several.join(after, ["conv", "_range", "part"])
        to = _with(several, "states array<int>", shared, lambda g, s, a: [g.chosen(s, i, a)[0] for i in range(4)], ["symbols", "after"])
        state = _folded(to.select("conv", "_range", "part", "states"), "state int", _fold_forward)
        columns = ["conv", "_range", "part", "symbols", "last", "state", "after"]
        rows = single.select(*columns).union(several.join(state, ["conv", "_range", "part"]).select(*columns))

        def solve(grammar, symbols, state, after, last):
            to, cost, edits = grammar.chosen(symbols, state, after)
            tail = ENDING[to] // INSERT if last else 0
            return {"cost": cost + INSERT * tail, "edits": edits + "I" * tail, "made": replayed(symbols, state, edits), "tail": "ua"[2 - tail:]}

        out = _with(rows, "solved struct<cost: long, edits: string, made: array<string>, tail: string>", shared, solve, ["symbols", "state", "after", "last"])
        return out.select("conv", "_range", "part", "solved.*")

    def summaries(self) -> DataFrame:
        """For each conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
        legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au") & (F.length(a) == 1)
        turn, before = F.col("turn"), F.col("turn_before")
        first = F.col("pos") == 1
        here = self.symbols.groupBy("conv", "_range").agg(
            *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
            F.count(F.when(~first & ~legal(F.col("before"), F.col("initial")), 1)).alias("illegal"),
            F.count(F.when(turn.isNotNull() & (first | ~before.eqNullSafe(turn)), 1)).alias("turns"),
            F.min("turn").alias("low"), F.max("turn").alias("high"),
            *[F.min_by(c, "pos").alias(f"first_{c}") for c in ("initial", "turn")], *[F.max_by(c, "pos").alias(f"last_{c}") for c in ("initial", "turn")])
        # One row for each range of a conversation: what stands on either side of a border.
        order = Window.partitionBy("conv").orderBy("_range")
        here = here.withColumns({"before": F.lag("last_initial").over(order), "turn_before": F.lag("last_turn").over(order)})
        border = F.col("before").isNotNull() & ~legal(F.col("before"), F.col("first_initial"))
        counts = here.groupBy("conv").agg(
            *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.count(F.when(border, 1))).alias("illegal"),
            F.coalesce(F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.count(F.when(F.col("turn_before") == F.col("first_turn"), 1))), F.lit(0)).alias("gaps"))
        edits = self.solved.groupBy("conv").agg(
            F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_range", "part", "edits"))), lambda x: x["edits"]), "").alias("audit"))
        return counts.join(edits, "conv").select("conv.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _streamed(self, by: list[str], emit: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
        """``emit`` over repaired lines (conversation, range, number, edit, role, text) in order, in tasks dealt out by ``by``.

        The edits of a conversation's part of a range come just before its rows, so a task holds only those.
        """
        edits = self.solved.select("conv", "_range", F.lit(0).alias("kind"), "part", "made", "tail")
        rows = self.ordered.select("conv", "_range", F.lit(1).alias("kind"), F.col("copy").alias("part"), "turn", "role", "h", "text")
        both = edits.unionByName(rows, allowMissingColumns=True).repartition(*by)
        order = ["conv", "_range", "kind", "turn", "role", "h", "part"]

        def lines(batches):
            place, made, tail, at, number = None, [], "", 0, 0
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("conv", "_range", "kind", "made", "tail", "role", "text")]
                for conv, where, kind, edits, more, role, text in zip(*cols):
                    if (conv["conv_id"], where) != place:
                        place, made, tail, at, number = (conv["conv_id"], where), [], "", 0, 0
                    if kind == 0:
                        made += edits
                        tail = more or tail
                        continue
                    edit = made[at]
                    at += 1
                    for new in edit[:-1]:
                        yield *place, number, "I", "user" if new == "u" else "assistant", ""
                        number += 1
                    if edit[-1] != "D":
                        yield *place, number, "K" if edit[-1] == "K" else "R", {"K": role, "U": "user", "A": "assistant"}[edit[-1]], text
                        number += 1
                    if at == len(made):
                        for new in tail:
                            yield *place, number, "I", "user" if new == "u" else "assistant", ""
                            number += 1

        return map_arrow(both.sortWithinPartitions(*order), lambda batches: emit(lines(batches)), schema)

    def rows(self) -> DataFrame:
        """The repaired rows: ``conv_id``, ``place`` (their order within it), ``edit`` (K, R or I), ``role`` and ``text``."""
        conv = self.ordered.schema["conv"].dataType["conv_id"].dataType
        schema = StructType([StructField("conv_id", conv), *StructType.fromDDL("place struct<range: long, number: long>, edit string, role string, text string").fields])
        kinds = _kinds(schema)

        def emit(lines):
            out = []
            for conv_id, where, number, edit, role, text in lines:
                out.append({"conv_id": conv_id, "place": {"range": where, "number": number}, "edit": edit, "role": role, "text": text})
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

        return self._streamed(["conv", "_range"], emit, schema)

    def digests(self) -> DataFrame:
        """``conv_id`` and ``sha256`` of the repaired ``role:text`` lines of each conversation that keeps one.

        A digest runs over its lines in order, so one task reads a conversation; it holds a batch of them at a time.
        """
        conv = self.ordered.schema["conv"].dataType["conv_id"].dataType
        schema = StructType([StructField("conv_id", conv), *StructType.fromDDL("sha256 string").fields])
        kinds = _kinds(schema)

        def emit(lines):
            out, now, digest = [], None, None
            for conv_id, _, _, _, role, text in lines:
                line = f"{role}:{text}".encode()
                if digest is None or conv_id != now:
                    if digest is not None:
                        out.append({"conv_id": now, "sha256": digest.hexdigest()})
                    now, digest = conv_id, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
            if digest is not None:
                out.append({"conv_id": now, "sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

        return self._streamed(["conv"], emit, schema)


def learned(segments: DataFrame) -> Grammar:
    """Re-Pair rules of all segments: each round makes rules of the most frequent pairs that share no symbol."""
    grammar, texts = Grammar(), staged(segments.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "conversation-runs")
    for _ in range(ROUNDS):
        rules = list(grammar.rules)

        def tally(batches):
            seen: Counter = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for pair, name in rules:
                        symbols = symbols.replace(pair, name)
                    for pair, found in Counter(a + b for a, b in zip(symbols, symbols[1:])).items():
                        seen[pair] += found * n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])

        pairs = map_arrow(texts, tally, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        taken: set[str] = set()
        for pair, _ in pairs.orderBy(F.desc("n"), "pair").limit(8 * RULES).collect():
            if len(grammar.rules) - len(rules) < RULES and not taken & set(pair):
                taken |= set(pair)
                grammar.add(pair)
        if len(grammar.rules) == len(rules):
            break
    return grammar


def _kinds(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _with(df: DataFrame, field: str, shared, work: Callable, inputs: list[str]) -> DataFrame:
    """``df`` and one more column, which ``work(grammar, *inputs)`` makes of each row."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL(field).fields])
    kind = _kinds(schema).field(len(df.columns))

    def run(batches):
        grammar = pickle.loads(shared.value)
        for batch in batches:
            made = [work(grammar, *values) for values in zip(*(batch.column(c).to_pylist() for c in inputs))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind.type)], names=[*batch.schema.names, kind.name])

    return map_arrow(df, run, schema)


def _folded(df: DataFrame, field: str, fold: Callable[[list], list]) -> DataFrame:
    """``conv, _range, part`` and a value that ``fold`` makes for each segment of a conversation from those of all, in order."""
    value = df.columns[-1]
    lists = df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("_range", "part", value))).alias("parts"))
    name, kind = field.split(" ", 1)
    schema = StructType([lists.schema["conv"], *StructType.fromDDL(f"parts array<struct<_range: long, part: long, {name}: {kind}>>").fields])
    arrow = _kinds(schema)

    def run(batches):
        for batch in batches:
            out = [[{"_range": p["_range"], "part": p["part"], name: v} for p, v in zip(parts, fold([p[value] for p in parts]))] for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow.field(1).type)], names=arrow.names)

    return staged(map_arrow(lists, run, schema).select("conv", F.explode("parts").alias("p")).select("conv", "p.*"), f"conversation-{name}")


def _fold_back(costs: list[list[list[int | None]]]) -> list[list[int]]:
    """Cost of all that follows a segment, for each state it may end in."""
    out, after = [], list(ENDING)
    for matrix in reversed(costs):
        out.append(after)
        after = [min(c + a for c, a in zip(row, after) if c is not None) for row in matrix]
    return out[::-1]


def _fold_forward(states: list[list[int]]) -> list[int]:
    """The state each segment starts in."""
    out, state = [], EMPTY
    for to in states:
        out.append(state)
        state = to[state]
    return out
