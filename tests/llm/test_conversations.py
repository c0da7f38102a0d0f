import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from trawl.llm import conversations as C
from trawl.llm.oracles import ORACLES
from trawl.llm.queries import QUERIES

NAME = "op11_conversation_repair"


def cheapest(rows):
    """(cost, audit) by a plain walk over turns with the least edits for each state, insertions one at a time."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserted(at):
        for _ in range(3):
            for (s, r), t in moves.items():
                if r != "s" and s in at:
                    new = (at[s][0] + 2, at[s][1] + "I")
                    at[t] = min(at.get(t, new), new)
        return at

    at = inserted({0: (0, "")})
    for role, fault in rows:
        new = {}
        for s, (c, a) in at.items():
            ways = [(s, c + 3, "D")]
            if fault not in ("blank", "duplicate"):
                ways += [(moves[s, r], c + (fault == "truncated") + (0 if kind == "K" else 2), kind) for r in "sua" if (s, r) in moves for kind in (["K"] if role[:1] == r else []) + (["R"] if r != "s" else [])]
            for t, cost, letter in ways:
                new[t] = min(new.get(t, (cost, a + letter)), (cost, a + letter))
        at = inserted(new)
    return min(at[s] for s in (0, 3) if s in at)


def brute(rows):
    """The contract's columns for (conv_id, turn, role, text) by plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = set()
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            said = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(t[1], f) for t, f in zip(turns, faults, strict=True)])
        n = [t[0] for t in turns if t[0] is not None]
        gaps = min(max(n) - min(n) + 1 - len(set(n)), 2**63 - 1) if n else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        left, said = iter(turns), []
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            put = "assistant" if said and said[-1][:1] == "u" else "user"
            said.append(f"{put}:" if letter == "I" else f"{put if letter == 'R' else row[1]}:{row[2]}")
        got.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return got


COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    rows = df.select(*COLS).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def odd_rows():
    r = random.Random(7)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "umpire"]
    texts = ["Well.", "Why?", "cut off", "cut off ", " ", "", None, "done!\n", " ", "é.", "x" * 3000 + "."]
    rows = [(c, t if r.random() > 0.1 else None, r.choice(roles[:3] if c % 2 else roles), r.choice(texts)) for c in range(60) for t in range(r.randrange(9))]
    rows += [(None, t, "user", "Hm.") for t in range(3)] + [(None, None, "assistant", "So.")]
    rows += [(100, 5, "user", "Same.")] * 7 + [(101, i // 3, "user", "Same.") for i in range(20)]
    # one conversation is long: it lies in several ranges and has several pieces
    rows += [(102, t, ["user", "assistant"][t % 2] if r.random() > 0.1 else "system", r.choice(texts[:4]) + str(t % 500)) for t in range(1500)]
    rows += [(103, i, "user", "Only dropped.") for i in range(400) if zlib.crc32(f"103:{i}".encode()) % 20 == 0][:3]
    rows += [(104, -(2**63), "user", "Far."), (104, 2**63 - 1, "assistant", "Away.")]
    return rows


@pytest.mark.parametrize("turns,parts", [(4096, 4), (7, 13)])
def test_against_brute_force(spark, monkeypatch, turns, parts):
    monkeypatch.setattr(C, "PIECE_TURNS", turns)
    rows = [(*r, "k", 1) for r in odd_rows()]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, n int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(C.repaired_conversations(df)) == brute([r[:4] for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repaired_conversations(df).collect() == []


def test_turns_are_sound(spark):
    df = spark.createDataFrame([r for r in odd_rows() if r[0] != 102], "conv_id long, turn long, role string, text string")
    got = C.repair(df)
    said = {r.conv_id: [t.role[:1] for t in r.turns] for r in got.turns.collect()}
    assert set(said) == {r.conv_id for r in got.summary.collect()}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(s)) for s in said.values())


def test_products_are_associative():
    for codes in product("suaoSUAOd", repeat=4):
        text = "".join(codes)
        whole = C.turn_matrix(text[0])
        for c in text[1:]:
            whole = C.times(whole, C.turn_matrix(c))
        assert whole == C.block_matrix(text)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = con.execute(ORACLES[NAME])
    at = [[d[0] for d in found.description].index(c) for c in COLS]
    want = {tuple(r[i] for i in at) for r in found.fetchall()}
    got = QUERIES[NAME](spark, sf)
    assert result(got) == want and set(got.columns) == set(COLS)
    assert want == brute(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
