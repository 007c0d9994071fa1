"""Conversation repair against a search over all edits, also where conversations are cut into segments."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from messy_tables import SF_DIR
from kinetable.llm import conversation_repair as repair_of
from kinetable.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")
INK = r"[^\x20\x09-\x0D]"


def order(rows):
    text = lambda t: hashlib.md5(t.encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], text(r[2])))


def faults(rows):
    """rows: (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        ink = re.findall(INK, text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_way(rows, marks):
    """All (cost, edits, lines) without more inserts than can help, by plain enumeration."""
    def go(i, made, cost, edits, lines):
        if not re.fullmatch(r"s?(ua)*u?", made):
            return
        if i == len(rows) and LEGAL.fullmatch(made):
            yield cost, edits, lines
        if len(edits) - i < len(rows) + 2 and not edits.endswith("III"):
            for role in ("user", "assistant"):
                yield from go(i, made + role[0], cost + 2, edits + "I", lines + [f"{role}:"])
        if i < len(rows):
            _, role, text = rows[i]
            yield from go(i + 1, made, cost + 3, edits + "D", lines)
            if marks[i] not in ("blank", "duplicate"):
                cut = marks[i] == "truncated"
                if role[:1] in ("s", "u", "a"):
                    yield from go(i + 1, made + role[0], cost + cut, edits + "K", lines + [f"{role}:{text}"])
                for new in ("user", "assistant"):
                    yield from go(i + 1, made + new[0], cost + 2 + cut, edits + "R", lines + [f"{new}:{text}"])

    return min(go(0, "", 0, "", []), key=lambda x: x[:2])


def stepwise(rows, marks):
    """The same by one pass over the rows, keeping whole edit strings; for conversations too long to enumerate."""
    best = {"": (0, "", [])}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(ways):
        todo = list(ways)
        while todo:
            state = todo.pop()
            cost, edits, lines = ways[state]
            new = follow[state]
            way = (cost + 2, edits + "I", lines + [{"u": "user:", "a": "assistant:"}[new]])
            if new not in ways or way[:2] < ways[new][:2]:
                ways[new] = way
                todo.append(new)
        return ways

    for (_, role, text), mark in zip(rows, marks):
        nxt = {}
        for state, (cost, edits, lines) in closed(best).items():
            options = [(state, 3, "D", [])]
            if mark not in ("blank", "duplicate"):
                cut = int(mark == "truncated")
                new = follow[state]
                options.append((new, 2 + cut, "R", [{"u": "user", "a": "assistant"}[new] + ":" + text]))
                if role[:1] == new or (role[:1] == "s" and not state):
                    options.append((role[0], cut, "K", [f"{role}:{text}"]))
            for to, more, edit, line in options:
                way = (cost + more, edits + edit, lines + line)
                if to not in nxt or way[:2] < nxt[to][:2]:
                    nxt[to] = way
        best = nxt
    return min((closed(best)[s] for s in ("", "a") if s in closed(best)), key=lambda x: x[:2])


def brute(table, search):
    """table: (conv_id, turn, role, text). The contract's row of each conversation."""
    groups = defaultdict(list)
    for c, t, r, x in table:
        groups[c].append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, rows in groups.items():
        rows = order(rows)
        marks = faults(rows)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, edits, lines = search(rows, marks)
        counts = Counter(marks)
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, "\n".join(lines))
    return out


def damage(table):
    for c, t, r, x in table:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if d:
            x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
            yield from [(c, t, "user" if d == 4 else r, x)] * (2 if d == 3 else 1)


def compare(spark, table, search, schema="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(table, schema)
    repair = repair_of.Repair(df)
    want = brute([r[:4] for r in table], search)
    got = {r.conv_id: tuple(r)[1:] for r in repair.summaries().collect()}
    assert got == {c: w[:7] for c, w in want.items()}
    lines = defaultdict(list)
    for r in sorted(repair.rows().collect(), key=lambda r: tuple(r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: "\n".join(v) for c, v in lines.items()} == {c: w[7] for c, w in want.items() if w[6].strip("D")}
    digests = {r.conv_id: r.sha256 for r in repair.digests().collect()}
    assert digests == {c: hashlib.sha256(w[7].encode()).hexdigest() for c, w in want.items() if w[6].strip("D")}
    return repair


def random_rows(rnd, conversations, longest):
    texts = ["Yes.", "no", "", " \t", "Maybe? ", "So!", "x", "...", "a b", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u"]
    rows = []
    for c in range(conversations):
        for t in range(rnd.randint(1, longest)):
            turn = None if rnd.random() < 0.1 else t * rnd.choice([1, 1, 1, 2])
            rows.append((c if c else None, turn, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"t{t}."))
    return rows + rows[:5]


def test_small_conversations_against_every_edit(spark):
    compare(spark, random_rows(random.Random(1), 60, 4), every_way)


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(table), stepwise)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, SF_DIR).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", "")
    assert got == {c: (*(w := want.get(c, nothing))[:7], hashlib.sha256(w[7].encode()).hexdigest()) for c in {r[0] for r in table}}


@pytest.mark.parametrize("segment", [1, 3, 1 << 16])
def test_long_conversations_in_segments(spark, monkeypatch, segment):
    """A conversation with more than a third of the rows crosses ranges and segments; texts repeat across them."""
    monkeypatch.setattr(repair_of, "SEGMENT", segment)
    rnd = random.Random(segment)
    rows = random_rows(rnd, 40, 9)
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    rows += [(1000, t // 2 if t % 7 else t, rnd.choice(roles), rnd.choice(["A.", "b", "", f"{t}", f"{t}!", f"{t % 40}."])) for t in range(220)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        repair = compare(spark, rows, stepwise)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert segment == 1 or len(repair.grammar.rules) > 5
    spread = repair.segments.where("conv.conv_id = 1000")
    assert spread.select("_range").distinct().count() > 2


def test_columns_that_clash_and_empty_tables(spark):
    schema = "conv_id string, turn int, role string, text string, conv string, h int, _range int, copy string, symbols string"
    rows = [("a", 0, "user", "Hi.", "r", 1, 2, "x", "y"), ("a", 1, "assistant", "Hello", "r", 1, 2, "x", "y"), (None, None, None, None, None, None, None, None, None)]
    compare(spark, rows, every_way, schema)
    empty = repair_of.Repair(spark.createDataFrame([], schema))
    assert empty.summaries().collect() == empty.rows().collect() == empty.digests().collect() == []


def test_ropes():
    rnd = random.Random(7)
    for _ in range(300):
        parts = ["".join(rnd.choice("DI") for _ in range(rnd.randint(0, 60))) for _ in range(6)]
        a = b = repair_of.leaf("")
        for p in parts:
            a = repair_of.joined(a, repair_of.leaf(p))
        whole = "".join(parts)
        other = whole if rnd.random() < 0.3 else whole[: (cut := rnd.randint(0, len(whole)))] + "".join(rnd.choice("DI") for _ in whole[cut:])
        for k in range(0, len(other), 7):
            b = repair_of.joined(b, repair_of.leaf(other[k: k + 7]))
        assert repair_of.text_of(a) == whole and repair_of.text_of(b) == other
        assert repair_of.less(a, b) == (whole < other) and repair_of.less(b, a) == (other < whole)
