"""Conversation repair against all repairs of short conversations, a walk over states, and the SQL check's cases."""

import hashlib
import itertools
import random
import re

import pytest

from lintlake.llm import conversations as C

SHAPE = re.compile(r"(s?(ua)+)?")


def letter(role, fault):
    return chr(65 + 4 * C.ROLES.index(role if role in "sua" and role else " ") + C.FAULTS.index(fault))


def all_repairs(rows):
    """(cost, audit) of every repair of up to four rows; two insertions cost more than deleting all of them."""
    ways = []
    for role, fault in rows:
        own = [("", 2, "D")]
        if fault in "kt":
            extra = 5 if fault == "t" else 0
            own += [(role if role in "sua" else "?", extra, "K"), ("u", 1 + extra, "R"), ("a", 1 + extra, "R")]
        ways.append(own)
    for chosen in itertools.product(*ways):
        for added in [None, *itertools.product(range(len(rows) + 1), "ua")]:
            steps = list(chosen)
            if added:
                steps.insert(added[0], (added[1], 5, "I"))
            if SHAPE.fullmatch("".join(s[0] for s in steps)):
                yield sum(s[1] for s in steps), "".join(s[2] for s in steps)


def walked(rows):
    """The same by going from row to row over the states, without spans."""
    best = {0: (0, "")}

    def insert(best):
        for role, pairs in (("u", C.INTO["u"]), ("a", C.INTO["a"])) * 2:
            for p, q in pairs:
                if p in best:
                    best[q] = min(best.get(q, (10**9, "")), (best[p][0] + 5, best[p][1] + "I"))
        return best

    for role, fault in rows:
        after = {}
        for p, (cost, audit) in insert(dict(best)).items():
            moves = [(p, 2, "D")]
            if fault in "kt":
                extra = 5 if fault == "t" else 0
                moves += [(q, extra, "K") for a, q in C.INTO.get(role, ()) if a == p]
                moves += [(q, 1 + extra, "R") for to in "ua" for a, q in C.INTO[to] if a == p]
            for q, more, mark in moves:
                after[q] = min(after.get(q, (10**9, "")), (cost + more, audit + mark))
        best = after
    best = insert(dict(best))
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("seed", range(4))
def test_repair_is_the_cheapest_of_all(seed):
    rng = random.Random(seed)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.choice("kkkbdt")) for _ in range(rng.randint(0, 4))]
        assert C.repair("".join(letter(*r) for r in rows)) == min(all_repairs(rows))


def test_long_conversations():
    rng = random.Random(5)
    for n in (5, 15, 16, 17, 33, 100, 1000):
        rows = [(rng.choice("suuaaax"), rng.choice("kkkkkbdt")) for _ in range(n)]
        assert C.repair("".join(letter(*r) for r in rows)) == walked(rows)
    rows = [("ua"[n % 2], "k") for n in range(50_000)]
    assert C.repair("".join(letter(*r) for r in rows)) == (0, "K" * 50_000)


def test_cells_may_be_cut_anywhere():
    rng = random.Random(6)
    letters = "".join(letter(rng.choice("suax"), rng.choice("kkbdt")) for _ in range(12))
    for cut in range(13):
        assert C.joined(C.parse(letters[:cut]), C.parse(letters[cut:])) == C.parse_block(letters)


def brute(rows):
    """(conv_id, turn, role, text, copies) to result rows, by the contract's words."""
    out = {}
    for conv in {r[0] for r in rows}:
        given = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in rows if c == conv for _ in range(n)]
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in given:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "k")
            seen.add((role, text))
        initials = [r[1][:1] for r in given]
        cost, audit = walked([(i if i and i in "sua" else "x", f) for i, f in zip(initials, faults, strict=True)])
        turns = [r[0] for r in given if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        repaired, at = [], 0
        for mark in audit:
            _, role, text = given[at] if mark != "I" else (None, None, "")
            system = bool(repaired) and repaired[0][0][:1] == "s"
            turned = ("user", "assistant")[(len(repaired) - system) % 2]
            if mark != "D":
                repaired.append((role if mark == "K" else turned, text))
            at += mark != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, copies int, part string, letters int").repartition(5)
    found = C.repair_conversations(df).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r[0]: tuple(r)[1:] for r in found}


def test_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be brief.", 1), (1, 1, "user", "Hi!", 1), (1, 2, "assistant", "Yes?", 1), (1, 2, "assistant", "Yes?", 2),
        (2, None, "user", "a.", 1), (2, None, None, None, 1), (2, 7, "assistant", "cut", 1), (2, 3, "tool", "Result.", 1),
        (None, 5, "assistant", "Without id.", 1), (None, None, "user", "So.", 1), (3, 1, "user", "dropped", 0), (4, -2**62, "User", "\t\x0b", 1),
        (5, 1, "", "No role.", 1), (5, 2, "", "No role.", 1), (6, 1, "user", "é" * 300_000 + ".", 1), (6, 2, "assistant", "🙂?\n\n", 1),
        (7, 1, "system", "One.", 1), (7, 2, "system", "Two.", 1), (7, 3, "sam", "Three.", 1), (7, 4, "assistant", "Four.", 3),
    ]
    assert repaired(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert repaired(spark, []) == {}


def test_hot_conversation_over_many_parts(spark):
    rng = random.Random(8)
    rows = [(1, n // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No!", "cut", "", f"Text {n}."]), 1) for n in range(3000)]
    rows += [(c, n, ("user", "assistant")[n % 2], f"Turn {n}.", 1) for c in range(2, 300) for n in range(4)]
    assert repaired(spark, rows) == brute(rows)


def test_damage(spark):
    rows = [(c, t, None if t == 3 else "assistant", None if t == 5 else "One. Two? Three!") for c in (1, None) for t in [*range(60), None]]
    found = {(r.conv_id, r.turn): r for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    from zlib import crc32

    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, {0: 0, 3: 2}.get(kind, 1))
        assert tuple(found[conv, turn])[2:] == want
