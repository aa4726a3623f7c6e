"""Conversation repair against brute force: every edit script of small conversations, and a string-carrying search of the tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from boxloom.llm import conversations
from boxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SHAPE = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """``cost, audit, roles`` by carrying whole strings: turns are ``(initial, broken, deleted)``."""
    now = {"": (0, "", ())}
    where = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}

    def inserted(layer):
        out = dict(layer)
        for _ in range(2):
            for state, (cost, audit, roles) in list(out.items()):
                for r in "ua":
                    if state in where[r]:
                        new = (cost + 3, audit + "I", (*roles, r))
                        to = where[r][state]
                        out[to] = min(out.get(to, new), new)
        return out

    for initial, broken, deleted in turns:
        layer = {}
        for state, (cost, audit, roles) in inserted(now).items():
            ways = [(state, (cost + 4, audit + "D", roles))]
            if not deleted:
                ways += [(where[r][state], (cost + 3 + 3 * broken, audit + "R", (*roles, r))) for r in "ua" if state in where[r]]
                if state in where.get(initial, {}):
                    ways.append((where[initial][state], (cost + 3 * broken, audit + "K", (*roles, initial))))
            for to, new in ways:
                layer[to] = min(layer.get(to, new), new)
        now = layer
    return min(v for k, v in inserted(now).items() if k in ("", "a"))


def by_enumeration(kinds):
    best = None
    for runs in itertools.product(range(3), repeat=len(kinds) + 1):
        for ops in itertools.product("KRD", repeat=len(kinds)):
            if any(k in "bd" and o != "D" for k, o in zip(kinds, ops)):
                continue
            slots, cost, audit = [], 0, ""
            for run, k, o in itertools.zip_longest(runs, kinds, ops):
                audit += "I" * run + (o or "")
                slots += ["ua"] * run
                cost += 3 * run + {"K": 0, "R": 3, "D": 4, None: 0}[o]
                if o in ("K", "R"):
                    cost += 3 * k.isupper()
                    slots.append(k.lower() if o == "K" else "ua")
            if best is not None and (cost, audit) >= best:
                continue
            if any(SHAPE.fullmatch("".join(x)) for x in itertools.product(*slots)):
                best = (cost, audit)
    return best


def expected(rows):
    """What the contract asks for, of ``(conv, turn, role, text)`` rows before damage."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        one = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        seen, faults, kinds = set(), dict(blank=0, duplicate=0, truncated=0), []
        for _, role, text in turns:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kinds.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost, audit, roles = cheapest(kinds)
        numbers = [t for t, _, _ in turns if t is not None]
        pairs = zip(turns, turns[1:])
        left, roles = iter(turns), iter(roles)
        said = []
        for op in audit:
            _, role, text = ("", "", "") if op == "I" else next(left)
            if op != "D":
                r = next(roles)
                said.append(f"{role if op == 'K' else {'u': 'user', 'a': 'assistant'}[r]}:{text}")
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *faults.values(),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def test_repair_by_enumeration():
    rng = random.Random(3)
    for n in range(5):
        for _ in range(40):
            kinds = "".join(rng.choice("suaxSUAXbd") for _ in range(n))
            cost, audit = by_enumeration(kinds)
            assert conversations.edits(kinds) == audit
            total, now = conversations.forward(kinds, 0)
            state, run = conversations.finish(total, now)
            assert total + now[0][state] + 3 * run == cost


def test_repair_in_chunks():
    rng = random.Random(4)
    for _ in range(200):
        kinds = "".join(rng.choices("suaxSUAXbd", [1, 5, 5, 1, 1, 2, 2, 1, 1, 1], k=rng.randrange(1, 60)))
        cuts = sorted(rng.sample(range(len(kinds) + 1), min(3, len(kinds))))
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)])]
        tables = [conversations.summary(p) for p in parts]
        whole = tables[0]
        for t in tables[1:]:
            whole = conversations.compose(whole, t)
        assert whole == conversations.summary(kinds)
        end, run = conversations.finish(0, (tuple(whole[:4]), tuple(whole[4:8])))
        ways = conversations.between(tables, 0, end)
        pieces = [conversations.edits(p, s, e, run if i == len(parts) - 1 else 0) for i, (p, (s, e)) in enumerate(zip(parts, ways))]
        assert "".join(pieces) == conversations.edits(kinds)
        assert len(conversations.edits(kinds).replace("I", "")) == len(kinds)


def digest(rows):
    return {r["conv_id"]: tuple(r)[1:] for r in rows.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_repair_tables(spark, sf):
    want = expected(duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall())
    assert digest(QUERIES["op11_conversation_repair"](spark, sf)) == want


def odd(rng):
    texts = [None, "", " \t", "Yes.", "yes", "No!", "é?", "a" * 100_000 + ".", "x\ny.", "Hm. \n"]
    roles = [None, "user", "assistant", "system", "tool", "", "user "]
    rows = [(c, t, rng.choice(roles[1:4]), rng.choice(texts)) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, r, x) for t, r, x in zip(range(9), roles, texts)] + [(50, None, "user", "Yes."), (50, 3, "user", "So."), (51, None, None, None), (52, 9, "user", "A."), (52, 1, "assistant", "B.")]
    return rows + [(53, 7, "user", "Again.")] * 5


def test_repair_odd_rows(spark, tmp_path, monkeypatch):
    rows = odd(random.Random(5))
    schema = "conv_id long, turn long, role string, text string, kinds string, seq int"
    given = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    given.write.parquet(f"{tmp_path}/conversations.parquet")
    want = expected(rows)
    assert digest(QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == want
    # Chunks of two turns, composed two at a time: the same.
    monkeypatch.setattr(conversations, "CHUNK", 2)
    monkeypatch.setattr(conversations, "FAN", 2)
    assert digest(QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == want
    got = conversations.repair(conversations.damage(given)).collect()
    for conv in want:
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["place"])
        assert "".join(r["edit"] for r in mine) == want[conv][6]
        said = "\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D")
        assert hashlib.sha256(said.encode()).hexdigest() == want[conv][7]


def test_repair_empty_and_long(spark, tmp_path, monkeypatch):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).count() == 0
    assert conversations.repair(none).count() == 0
    monkeypatch.setattr(conversations, "CHUNK", 64)
    monkeypatch.setattr(conversations, "FAN", 8)
    long = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 7 < 4, "user").otherwise("assistant").alias("role"), F.concat(F.col("id") % 900, F.lit(".")).alias("text"))
    rows = [tuple(r) for r in long.collect()]
    assert digest(conversations.summarise(conversations.damage(long))) == expected(rows)
