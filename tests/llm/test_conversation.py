import itertools
import random
import re
import zlib
from hashlib import sha256

import pytest

from ledgerloom.llm import conversation
from ledgerloom.llm.conversation import AFTER, DUPLICATE, NEXT, STATES, cheapest, damaged, repair_conversations, repair_report

GOOD = re.compile(r"(s?(ua)+)?")


def brute_audit(rows):
    """All edit strings, shortest inserts first, judged by the role initials that they give."""
    best = None
    choices = []
    for fault, initial in rows:
        choices.append([("D", 3, "")] + ([("K", fault == 3, initial), ("R", 2 + (fault == 3), "u"), ("R", 2 + (fault == 3), "a")] if fault in (0, 3) else []))
    inserts = ["", "u", "a", "ua", "au"]
    for picked in itertools.product(*choices):
        if best and sum(c for _, c, _ in picked) > best[0]:
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles = gaps[0] + "".join(r + g for (_, _, r), g in zip(picked, gaps[1:]))
            if GOOD.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(e + "I" * len(g) for (e, _, _), g in zip(picked, gaps[1:]))
                cost = sum(c for _, c, _ in picked) + 2 * sum(map(len, gaps))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_least_audit():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice([0, 0, 1, 2, 3]), rng.choice("suax")) for _ in range(rng.randint(0, 4))]
        assert cheapest(rows, 0, (0, 3)) == brute_audit(rows), rows


def plain_damage(rows):
    s = lambda v: " " if v is None else v
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1 if kind else 0)
    return out


def plain_report(rows):
    """The report by dynamic programming over whole conversations."""
    out = []
    hurt = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], sha256((f"{len(r[2])}:" + r[2] + r[3]).encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            ends = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append(1 if not ends else 2 if (role, text) in seen else 3 if ends not in ".!?" else 0)
            seen.add((role, text))
        best = {0: (0, ""), 2: (2, "I"), 3: (4, "II")}
        for f, (_, _, role, _) in zip(faults, mine):
            new: dict = {}
            for q, (c, a) in best.items():
                ways = [("D", 3, q)] + ([("R", 2 + (f == 3), NEXT[q])] if f in (0, 3) else []) + ([("K", f == 3, AFTER[q, role[:1]])] if f in (0, 3) and (q, role[:1]) in AFTER else [])
                for e, w, to in ways:
                    way = (c + w, a + e)
                    for _ in range(3):
                        new[to] = min(new.get(to, way), way)
                        way, to = (way[0] + 2, way[1] + "I"), NEXT[to]
            best = new
        cost, audit = min(best[q] for q in (0, 3) if q in best)
        lines, at, roles = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else mine[at][2:]
            at += e != "I"
            if e in "RI":
                role = "assistant" if roles.endswith("u") else "user"
            if e != "D":
                roles += role[:1]
                lines.append(f"{role}:{text}")
        assert GOOD.fullmatch(roles)
        turns = [r[1] for r in mine if r[1] is not None]
        first = [r[2][:1] for r in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(n, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No", "", " \n", "Why?  ", "Long " * 30, "Ünï!", None, "a.\tb"])
    rows = []
    for c in [*range(n), None]:
        turns = [rng.choice([None, *range(8)]) if c and c % 3 == 0 else t for t in range(rng.randint(1, 9))]
        rows += [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "u"]) if c != 4 else ("user", "assistant")[t % 2], text()) for t in turns]
    rows += [(9_999, t, ("user", "assistant")[t % 2], f"Turn {t % 50}.") for t in range(700)]
    rows += [(9_998, 3, "user", "The same.")] * 200
    return rows


@pytest.mark.parametrize("run_rows", [512, 3])
def test_report(spark, monkeypatch, run_rows):
    monkeypatch.setattr(conversation, "RUN_ROWS", run_rows)
    rows = made(60, run_rows)
    frame = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, part string, ways int, mark boolean").repartition(4)
    got = repair_report(repair_conversations(damaged(frame), "is_row")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_report(rows)


def test_runs_in_workers(spark):
    """Conversations longer than a run, and one that many tasks share."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"Line {t}" + "." * (t % 2)) for t in range(4000)] + [(c, 0, "user", "Hi.") for c in range(2, 50)]
    parts = repair_conversations(damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "is_row")
    assert parts.filter("conv_id = 1").count() > 4
    got = repair_report(parts).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_report(rows)


def test_parts_and_empty(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hello there"), (1, 1, "user", "Hello there"), (1, 2, "assistant", "Hi.")], "conv_id long, turn long, role string, text string")
    (part,) = repair_conversations(frame).collect()
    assert part.audit == "KDK" and part.cost == 4 and [tuple(t) for t in part.turns] == [("user", "Hello there"), ("assistant", "Hi.")]
    assert repair_report(repair_conversations(damaged(frame.limit(0)), "is_row")).count() == 0


def test_bounds_keep_long_runs_short():
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1, DUPLICATE, 3]), rng.choice("su")) for _ in range(2000)]
    assert all(cheapest(rows, s, [g]) for s in STATES for g in (2, 3))
