"""Conversation structure repair: the cheapest edits that make the roles alternate, proved by branch and bound.

Rows are dealt by ranges of (conversation, turn), so a conversation that holds a third of all rows is spread over many
tasks.  A task reads its rows in order, a run of at most RUN_ROWS rows of a conversation at a time.  A conversation that lies in one run
is repaired there and then.  Of any other, each run is solved from every state that it may be entered in to every state
that it may be left in; a fold over the runs' costs (without texts) picks the states, and each run then applies its own
edits.  Rows that repeat an earlier row of their conversation are found by an aggregation over digests and marked before
they are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.common import Scratch, ship_package

#: What each edit costs, and what keeping a truncated row adds.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Pairs of role initials that may follow each other.
LEGAL = ("su", "ua", "au")
#: Rows and characters of a run; a longer text is a run of its own.
RUN_ROWS, RUN_CHARS = 512, 1 << 20

#: Role initials so far: none, one system turn, or a last user or assistant turn.  Repaired ones end in none or assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES, GOALS = range(4), (NONE, ASSISTANT)
AFTER = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only state that an inserted or reroled turn can lead to.
NEXT = (USER, USER, ASSISTANT, USER)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


def steps(fault: int, initial: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, what it costs, state after it) of one row."""
    out = [("D", DELETE, state)]
    if fault in (SOUND, TRUNCATED):
        extra = CUT_OFF if fault == TRUNCATED else 0
        out.append(("R", REROLE + extra, NEXT[state]))
        if (state, initial) in AFTER:
            out.append(("K", extra, AFTER[state, initial]))
    return out


def least_to_come(rows: list[tuple[int, str]], goals: frozenset[int]) -> list[list[float]]:
    """For each number of rows done and state, a bound from below on what any end costs, whatever its audit."""

    def with_inserts(now: list[float]) -> list[float]:
        for _ in range(2):  # no end has use for three inserted turns in a row
            now = [min(now[state], INSERT + now[NEXT[state]]) for state in STATES]
        return now

    need = [with_inserts([0.0 if state in goals else math.inf for state in STATES])]
    for fault, initial in reversed(rows):
        need.append(with_inserts([min(cost + need[-1][to] for _, cost, to in steps(fault, initial, state)) for state in STATES]))
    return need[::-1]


def cheapest(rows: list[tuple[int, str]], start: int, goals: Iterable[int]) -> tuple[int, str] | None:
    """The least (cost, audit) that leads (fault, role initial) rows from ``start`` to one of ``goals``, or None.

    Depth first on an explicit stack: a node is (rows done, state).  A prefix goes when its cost and the least to come
    exceed the incumbent's, when they equal it and no end of the prefix has a smaller audit, or when its node was reached
    as cheaply by an audit that is no larger.  (Of two prefixes of one node and cost, neither audit begins with the other,
    so the smaller stays the smaller whatever follows.)  What is left when the stack is empty is proved the least.
    """
    n, goals = len(rows), frozenset(goals)
    need = least_to_come(rows, goals)
    best: tuple[float, str] = (need[0][start], "~")  # "~" is above every audit: a cost that some end reaches
    seen: dict = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + need[i][state]
        if least > best[0] or least == math.inf or (least == best[0] and audit > best[1][: len(audit)]):
            continue
        if (i, state) in seen and seen[i, state] <= (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == n and state in goals:
            best = min(best, (cost, audit))
        ways = [(edit, price, i + 1, to) for edit, price, to in (steps(*rows[i], state) if i < n else [])]
        # the smallest letter is tried first
        for edit, price, j, to in sorted([*ways, ("I", INSERT, i, NEXT[state])], reverse=True):
            stack.append((j, to, cost + price, audit + edit))
    return (int(best[0]), best[1]) if best[0] < math.inf else None


def repaired(turns: list[tuple[str, str]], audit: str, start: int) -> list[dict]:
    """The (role, text) rows that an audit makes of ``turns``, entered in ``start``."""
    out, at, state = [], 0, start
    for edit in audit:
        role, text = ("", "") if edit == "I" else turns[at]
        at += edit != "I"
        if edit == "K":
            state = AFTER[state, role[:1]]
        elif edit in "RI":
            state = NEXT[state]
            role = "user" if state == USER else "assistant"
        if edit != "D":
            out.append({"role": role, "text": text})
    return out


_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_WAYS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("goal", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "lowest", "highest", "distinct")


def _schema(docs: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", docs.schema["conv_id"].dataType), *(T.StructField(n, t) for n, t in fields)])


def _counts(run: list[dict]) -> dict:
    turns = [r["turn"] for r in run if r["turn"] is not None]
    first = [r["role"][:1] for r in run]
    faults = [r["fault"] for r in run]
    return {
        "rows": len(run), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in zip(first, first[1:])), "lowest": min(turns, default=None), "highest": max(turns, default=None),
        "distinct": len(set(turns)), "lead": first[0] if first else None, "last": first[-1] if first else None,
    }


def _run(conv, part: int, run: list[dict], whole: bool) -> dict:
    """What is known of a run of rows: its repair if it is a whole conversation, else all its ways from state to state."""
    rows, turns = [(r["fault"], r["role"][:1]) for r in run], [(r["role"], r["text"]) for r in run]
    if whole:
        cost, audit = cheapest(rows, NONE, GOALS)
        ways, turns = [{"start": NONE, "goal": NONE, "cost": cost, "audit": audit}], repaired(turns, audit, NONE)
    else:
        found = {(s, g): cheapest(rows, s, [g]) for s in STATES for g in STATES if g != NONE or s == NONE}
        ways = [{"start": s, "goal": g, "cost": x[0], "audit": x[1]} for (s, g), x in found.items() if x]
        turns = [{"role": r, "text": t} for r, t in turns]
    return {"conv_id": conv, "part": part, "whole": whole, **_counts(run), "ways": ways, "turns": turns}


def _solve(schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from batch.slice(at, 256).to_pylist()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # a task's first and last conversations may go on in its neighbours
        task, part, conv, run, chars, whole, marked, any_row = TaskContext.get().partitionId(), 0, None, [], 0, False, False, False
        for row in rows_of(batches):
            if any_row and row["conv_id"] != conv:
                yield _run(conv, (task << 32) + part, run, whole)
                part, run, chars, whole = part + 1, [], 0, True
            elif run and (len(run) >= RUN_ROWS or chars + len(row["text"] or "") > RUN_CHARS) and not row["mark"] and row["is_row"]:
                yield _run(conv, (task << 32) + part, run, False)
                part, run, chars, whole = part + 1, [], 0, False
            conv, any_row = row["conv_id"], True
            if row["mark"]:
                marked = True
            elif row["is_row"]:
                fault = DUPLICATE if marked and row["fault"] != BLANK else row["fault"]
                run.append({"turn": row["turn"], "role": row["role"], "text": None if fault == DUPLICATE else row["text"], "fault": fault})
                chars, marked = chars + len(row["text"]), False
        if any_row:
            yield _run(conv, (task << 32) + part, run, False)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for x in runs(batches):
            done.append(x)
            size += 200 + sum(len(t["text"] or "") for t in x["turns"])
            if size > RUN_CHARS:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    return solve


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, ways) sorted by conversation and part -> the states in which each part is entered and left.

    Of a conversation it holds four states a part.  Audits matter only where they differ, so what all begin with goes.
    """
    conv, first, at, back, parts = None, True, {NONE: (0, "")}, [], []

    def chosen() -> pa.RecordBatch:
        goal = min((at[g], g) for g in GOALS if g in at)[1]
        out = []
        for part, came in zip(reversed(parts), reversed(back)):
            out.append((part, came[goal], goal))
            goal = came[goal]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], ["part", "start", "goal"])

    for batch in batches:
        for name, part, ways in zip(*(c.to_pylist() for c in batch.columns)):
            if first or name != conv:
                if not first:
                    yield chosen()
                conv, first, at, back, parts = name, False, {NONE: (0, "")}, [], []
            new: dict = {}
            for w in ways:
                if w["start"] in at:
                    cost, audit = at[w["start"]]
                    way = (cost + w["cost"], audit + w["audit"], w["start"])
                    new[w["goal"]] = min(new.get(w["goal"], way), way)
            audits = [a for _, a, _ in new.values()]
            low, high = min(audits), max(audits)
            same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
            at = {g: (c, a[same:]) for g, (c, a, _) in new.items()}
            back.append({g: s for g, (_, _, s) in new.items()}), parts.append(part)
    if not first:
        yield chosen()


def _apply(schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                way = next(w for w in row["ways"] if (w["start"], w["goal"]) == (row["start"], row["goal"]))
                row["turns"] = repaired([(t["role"], t["text"]) for t in row["turns"]], way["audit"], way["start"])
                yield pa.RecordBatch.from_pylist([{**row, "cost": way["cost"], "audit": way["audit"]}], arrow)

    return run


def repair_conversations(rows: DataFrame, row_col: str | None = None) -> DataFrame:
    """The repaired turns of (conv_id, turn, role, text) rows, in parts: most conversations are one part (``whole``), a long
    one or one that two tasks met is several, ordered by ``part``.

    A part has ``turns`` (repaired role and text), ``cost``, ``audit`` (K keep, R rerole, D delete, I insert), its faults
    before the repair (rows, blank, duplicate, truncated, illegal neighbours, lowest, highest and distinct turn) and the
    first and last role initials.  Null roles and texts count as one space.  Rows go by turn (nulls first), rows of one
    turn by role, then by the text's first 64 characters and digest.  A null conv_id is a conversation like others.
    A role's initial is its first character; an empty role has none and can't be kept.  Where ``row_col`` is given, rows in
    which it isn't true only name a conversation, which may come out empty; an empty table gives no parts.  Other columns are not read.
    A text longer than RUN_CHARS is a run of its own.
    """
    spark = rows.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "conversations")
    is_row = F.coalesce(F.col(row_col), F.lit(False)) if row_col else F.lit(True)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    base = rows.select("conv_id", "turn", is_row.alias("is_row"), F.when(is_row, role).alias("role"), F.when(is_row, text).alias("text"))
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(ends == "", BLANK).when(~ends.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    base = base.select("*", fault.alias("fault"), F.substring("text", 1, 64).alias("head"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    base = scratch.cut(base, "rows", "zstd")

    order = ["turn", "role", "head", "digest", "row"]
    place = F.struct(*order)
    seen = base.filter("is_row").select("conv_id", place.alias("place"))
    firsts = seen.groupBy("conv_id", "place.digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = scratch.cut(firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first"), "firsts")
    later = seen.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place.digest") == F.col("d"))).filter("place <> first")
    later = later.select("conv_id", "place.*", F.lit(True).alias("mark"))

    keys = ["conv_id", *order]
    stream = base.withColumn("mark", F.lit(False)).unionByName(later, allowMissingColumns=True).repartitionByRange(*keys).sortWithinPartitions(*keys, F.desc("mark"))
    schema = _schema(
        base, ("part", T.LongType()), ("whole", T.BooleanType()), *((n, base.schema["turn"].dataType if n in ("lowest", "highest") else T.LongType()) for n in _COUNTS),
        ("lead", T.StringType()), ("last", T.StringType()), ("ways", _WAYS), ("turns", _TURNS),
    )
    parts = scratch.cut(stream.select("conv_id", "turn", "role", "text", "is_row", "fault", "mark").mapInArrow(_solve(schema), schema), "parts", "zstd")
    scratch.drop("rows")

    out = ["conv_id", "part", "whole", *_COUNTS, "lead", "last", "cost", "audit", "turns"]
    done = parts.filter("whole").select("*", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit")).select(*out)
    open_ = parts.filter("not whole")
    ways = open_.select("conv_id", "part", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    chosen = scratch.cut(ways.mapInArrow(_choose, "part long, start int, goal int"), "chosen")
    made = T.StructType([f for f in done.schema.fields])
    joined = open_.join(chosen, "part").select("conv_id", "part", "whole", *_COUNTS, "lead", "last", "ways", "turns", "start", "goal")
    return done.unionByName(joined.mapInArrow(_apply(made), made))


def _fold(schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None

        def out() -> pa.RecordBatch:
            gaps = 0 if now["lo"] is None else now["hi"] - now["lo"] + 1 - now["distinct"]
            row = {"conv_id": conv, "gaps": gaps, **{k: now[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")}}
            return pa.RecordBatch.from_pylist([{**row, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}], arrow)

        for batch in batches:
            for at in range(batch.num_rows):
                (p,) = batch.slice(at, 1).to_pylist()
                if now is None or p["conv_id"] != conv:
                    if now is not None:
                        yield out()
                    conv = p["conv_id"]
                    now = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "distinct": 0, "lo": None, "hi": None, "last": None, "audit": [], "hash": hashlib.sha256(), "lines": 0}
                for k in ("blank", "duplicate", "truncated", "illegal", "cost", "distinct"):
                    now[k] += p[k]
                if p["rows"]:
                    now["illegal"] += now["last"] is not None and now["last"] + p["lead"] not in LEGAL
                    now["last"] = p["last"]
                if p["lowest"] is not None:
                    now["distinct"] -= now["hi"] == p["lowest"]
                    now["lo"], now["hi"] = p["lowest"] if now["lo"] is None else now["lo"], p["highest"]
                now["audit"].append(p["audit"])
                for t in p["turns"]:
                    now["hash"].update((("\n" if now["lines"] else "") + f"{t['role']}:{t['text']}").encode())
                    now["lines"] += 1
        if now is not None:
            yield out()

    return run


def repair_report(parts: DataFrame) -> DataFrame:
    """One row per conversation of ``repair_conversations``: gaps, faults, cost, audit and the digest of the repaired text.

    A digest reads its conversation from one end to the other; only conversations of several parts are shuffled for it, a
    part at a time, and nothing but the running digest and the audit is held.
    """
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    gaps = F.coalesce(F.col("highest") - F.col("lowest") + 1 - F.col("distinct"), F.lit(0)).cast("long")
    one = parts.filter("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    several = parts.filter("not whole").select("conv_id", "part", "rows", "lead", "last", "lowest", "highest", "distinct", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns")
    several = several.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return one.unionByName(several.mapInArrow(_fold(one.schema), one.schema))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` damaged by the checksum of ``conv_id:turn``: dropped (``is_row`` false), emptied, without stops, repeated or
    made a user's.  Nulls count as one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind != 0).alias("is_row"), copies.alias("copy"))
    return out.drop("copy")
