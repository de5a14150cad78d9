import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from opsight.llm import turn_repair
from opsight.llm.turn_repair import Alignment, Turns, align, damaged, repair, repair_digests

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def slow_align(symbols):
    """(cost, audit) by trying every alignment with every grammar string."""
    best = [(2 * len(symbols), "D" * len(symbols))]

    def walk(i, target, cost, audit):
        if cost > best[0][0]:
            return
        if i == len(symbols) and not target:
            best[0] = min(best[0], (cost, audit))
            return
        if i < len(symbols):
            symbol = symbols[i]
            walk(i + 1, target, cost + 2, audit + "D")
            if target and not symbol & 4:
                more = 5 if symbol & 8 else 0
                if "sua?"[symbol & 3] == target[0]:
                    walk(i + 1, target[1:], cost + more, audit + "K")
                elif target[0] in "ua":
                    walk(i + 1, target[1:], cost + more + 1, audit + "R")
        if target and target[0] in "ua":
            walk(i, target[1:], cost + 5, audit + "I")

    for pairs in range(len(symbols) // 2 + 3):
        walk(0, "ua" * pairs, 0, "")
        if pairs:
            walk(0, "s" + "ua" * pairs, 0, "")
    return best[0]


def test_audits_equal_every_alignment_tried():
    rng = random.Random(3)
    kinds = [0, 1, 2, 3, 1, 2, 1 | 8, 2 | 8, 0 | 8, 1 | 4, 2 | 4, 3 | 4]
    for n in range(1, 8):
        for _ in range(150):
            symbols = bytes(rng.choice(kinds) for _ in range(n))
            assert Alignment(Turns.of(symbols)).audit() == slow_align(symbols), symbols


def test_all_short_conversations():
    for n in (1, 2, 3):
        for symbols in itertools.product([0, 1, 2, 3, 9, 10, 5], repeat=n):
            assert align(bytes(symbols)) == slow_align(bytes(symbols))


def test_a_wider_band_changes_nothing(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choice([1, 2, 1, 2, 9, 10, 5, 0, 3]) for _ in range(60)) for _ in range(20)]
    narrow = [Alignment(Turns.of(s)).audit() for s in texts]
    monkeypatch.setattr(turn_repair, "incumbent", lambda turns: 2 * len(turns.role) + 40)
    assert [Alignment(Turns.of(s)).audit() for s in texts] == narrow


def test_the_incumbent_is_never_too_low():
    rng = random.Random(6)
    for _ in range(200):
        turns = Turns.of(bytes(rng.choice([0, 1, 2, 3, 9, 10, 5]) for _ in range(rng.randint(1, 7))))
        assert turn_repair.incumbent(turns) >= Alignment(turns).cost()


def test_long_conversations_keep_few_rows():
    alignment = Alignment(Turns.of(bytes([1, 2] * 3000 + [1] + [1, 2] * 3000)))
    cost, audit = alignment.audit()
    assert cost == 2 and audit.count("D") == 1 and len(audit) == 12001
    assert len(alignment.kept) < 120 and alignment.width < 10


def brute(rows, damage):
    """The whole query in plain Python."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        here = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        here += [(turn, role, text)] * (1 + (fault == 3))
    out = []
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in here:
            core = text.strip(SPACES)
            symbol = "sua".find(role[:1]) if role[:1] else 3
            symbol = symbol if symbol >= 0 else 3
            if not core:
                n["blank"] += 1
                symbol |= 4
            elif (role, text) in seen:
                n["duplicate"] += 1
                symbol |= 4
            elif core[-1] not in ".!?":
                n["truncated"] += 1
                symbol |= 8
            seen.add((role, text))
            symbols.append(symbol)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:]))
        given = [t for t, _, _ in here if t is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        cost, audit = slow_align(bytes(symbols))
        kept, i, left = [], 0, sum(c != "D" for c in audit)
        for letter in audit:
            role = "assistant" if left % 2 else "user"
            left -= letter != "D"
            if letter == "K":
                kept.append(here[i][1:])
            elif letter == "R":
                kept.append((role, here[i][2]))
            elif letter == "I":
                kept.append((role, ""))
            i += letter != "I"
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def whole(spark, rows, damage=True):
    table = spark.createDataFrame(rows, SCHEMA)
    turns = damaged(table)
    if not damage:
        from pyspark.sql import functions as F

        turns = table.select(
            "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("here")
        )
    return result(repair_digests(repair(turns)))


def test_given_conversations(spark):
    from opsight.llm.queries import QUERIES

    got = result(QUERIES["op12_turn_repair"](spark, "/root/testdata/sf0.001"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows, True)
    assert any(r[6] for r in got)


ODD = [
    (1, None, "user", "Hi."), (1, None, "assistant", "Yes."), (1, 4, "user", "Hi."), (1, 4, "user", "Hi."), (1, 9, "tool", "x"),
    (2, 0, None, None), (2, 1, "", "Empty role."), (2, 2, "User", "Upper!"),
    (None, 0, "system", "Be brief."), (None, 1, "user", "No"), (None, 2, "assistant", "So? "),
    (3, None, None, None),
    (4, 0, "system", "One."), (4, 1, "system", "Two."), (4, 2, "assistant", "Three."),
    (5, 0, "user", "word " * 20000 + "."), (5, 1, "assistant", "\n.\t"),
    (6, 0, "user", "Same."), (6, 0, "user", "Same."), (6, 0, "user", "Other."),
]


@pytest.mark.parametrize("damage", [True, False])
def test_nulls_ties_repeats_and_long_texts(spark, damage):
    assert whole(spark, ODD, damage) == brute(ODD, damage)


def test_dropped_conversations_are_told_of(spark):
    conv = next(c for c in range(10**4) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert whole(spark, [(conv, 0, "user", "Gone.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", empty)]


def test_empty_table_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert whole(spark, []) == []
    table = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("part", "symbol", "here", "_digest", "audit", "edit")})
    assert result(repair_digests(repair(damaged(table)))) == brute(ODD, True)


def test_repaired_turns_follow_the_grammar(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = repair(damaged(table)).collect()
    by = defaultdict(list)
    for r in rows:
        if r["place"] >= 0 and r["role"] is not None:
            by[r["conv_id"]].append((r["place"], r["role"][:1]))
    assert len(by) > 50
    for turns in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(role for _, role in sorted(turns)))


def test_long_random_audit_reaches_its_cost():
    rng = np.random.default_rng(1)
    symbols = bytes(rng.choice([1, 2, 1, 2, 9, 5], size=3000).astype(np.uint8).tolist())
    cost, audit = align(symbols)
    spent, i, roles = 0, 0, ""
    left = sum(c != "D" for c in audit)
    for letter in audit:
        if letter == "I":
            spent, left = spent + 5, left - 1
            continue
        spent += {"D": 2, "K": 0, "R": 1}[letter]
        if letter != "D":
            spent += 5 * bool(symbols[i] & 8)
            assert not symbols[i] & 4
            roles += "ua"[left % 2] if letter == "R" else "sua"[symbols[i] & 3]
            left -= 1
        i += 1
    assert i == len(symbols) and spent == cost
