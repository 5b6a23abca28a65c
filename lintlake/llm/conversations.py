"""Repair of conversation structure by weighted CYK over spans of rows.

The roles that stay must spell (s?(ua)+)?. Its four states (nothing yet, after s, after u, after a) give a grammar in Chomsky normal
form with a nonterminal (p, q) for "these rows lead from p to q": (p, q) -> (p, m) (m, q), terminals for a row that is kept, given
another role or deleted, and insertions, under which every cell is closed. A cell is the least (cost, audit) of each nonterminal.
Cells of equal cost over the same rows never have audits of which one begins the other (it would hold fewer insertions, hence cost
less), so least audits stay least when they are joined, and cells may be combined in any bracketing: all splits of all spans inside
a block of rows, then neighbouring blocks, doubling the span length.

Rows are one letter each from the first step on, so a conversation of any length is cut over tasks; texts move once, to be hashed in
a sorted stream that holds one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import ranged

SPACES = " \t\n\x0b\x0c\r"
BLOCK = 16
CELLS_KEPT = 100_000
# A row's letter is 4 x role + fault, from A on.
ROLES, FAULTS = "sua ", "kbdt"  # system, user, assistant, other; kept, blank, duplicate, truncated
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
INTO = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
PAIRS = [(p, q) for p in range(4) for q in range(4) if p <= q or (p, q) == (ASSISTANT, USER)]
LEGAL = ("su", "ua", "au")

Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell) -> Cell:
    """The least (cost, audit) of every (p, q) -> (p, m) (m, q)."""
    out: Cell = {}
    for (p, m), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((m, q))
            if more is not None:
                both = (cost + more[0], audit + more[1])
                if (p, q) not in out or both < out[p, q]:
                    out[p, q] = both
    return out


def least(cells: Iterator[Cell]) -> Cell:
    out: Cell = {}
    for cell in cells:
        for key, value in cell.items():
            if key not in out or value < out[key]:
                out[key] = value
    return out


def _insertions() -> Cell:
    """What insertions alone do between two rows."""
    once: Cell = {(p, p): (0, "") for p in range(4)}
    for role in "ua":
        once |= {pair: (INSERT, "I") for pair in INTO[role]}
    return joined(joined(once, once), once)


NOTHING = _insertions()


def row_cell(letter: str) -> Cell:
    """One row, closed under insertions on both sides."""
    role, fault = ROLES[(ord(letter) - 65) // 4], FAULTS[(ord(letter) - 65) % 4]
    ways: list[Cell] = [{(p, p): (DELETE, "D")} for p in range(4)]
    if fault in "kt":
        extra = CUT_OFF if fault == "t" else 0
        ways += [{pair: (REROLE + extra, "R")} for to in "ua" for pair in INTO[to]]
        ways += [{pair: (KEEP + extra, "K")} for pair in INTO.get(role, ())]
    return joined(joined(NOTHING, least(iter(ways))), NOTHING)


_cells: dict[str, Cell] = {"": NOTHING}


def parse_block(letters: str) -> Cell:
    """CYK: cells of all spans by growing length, each the least over all splits. Spans seen before are kept, up to a number."""
    if letters not in _cells:
        if len(_cells) > CELLS_KEPT:
            _cells.clear()
            _cells[""] = NOTHING
        for length in range(1, len(letters) + 1):
            for start in range(len(letters) - length + 1):
                span = letters[start:start + length]
                if span not in _cells:
                    _cells[span] = row_cell(span) if length == 1 else least(
                        joined(_cells[span[:k]], _cells[span[k:]]) for k in range(1, length))
    return _cells[letters]


def combined(cells: list[Cell]) -> Cell:
    """Neighbouring spans, doubling the span length until one is left."""
    while len(cells) > 1:
        cells = [joined(*cells[n:n + 2]) if n + 1 < len(cells) else cells[n] for n in range(0, len(cells), 2)]
    return cells[0] if cells else NOTHING


def parse(letters: str) -> Cell:
    return combined([parse_block(letters[n:n + BLOCK]) for n in range(0, len(letters), BLOCK)])


def illegal_pairs(letters: str) -> int:
    roles = [ROLES[(ord(c) - 65) // 4] for c in letters]
    return sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def repair(letters: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; of equal costs the audit that is least in ASCII."""
    cell = parse(letters)
    return min(cell[START, START], cell[START, ASSISTANT])


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the registered query: conv_id, turn, role, text and ``copies``, 0 for a dropped row, 2 for a repeated one.

    Nulls read as one space, in the text that is hashed too. Damage depends on conv_id and turn alone.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.encode(F.concat(shown[0], F.lit(":"), shown[1]), "UTF-8")) % 20
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown[2]).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.translate(shown[3], ".!?", "")).otherwise(shown[3]).alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _letter(role: Column, fault: str) -> Column:
    at = F.coalesce(F.nullif(F.instr(F.lit(ROLES[:3]), F.substring(role, 1, 1)) * F.when(role == "", 0).otherwise(1), F.lit(0)), F.lit(4))
    return F.substring(F.lit("ABCDEFGHIJKLMNOP"), (at - 1) * 4 + F.lit(FAULTS.index(fault) + 1), F.lit(1))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation of (conv_id, turn, role, text, optionally copies).

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows go by turn, nulls first; rows of
    one turn by role, then by the SHA-256 of their text, so equal rows are neighbours. ``copies`` repeats a row; 0 leaves the row out
    but keeps its conversation in the result. Null roles and texts read as one space; a role whose first letter is not s, u or a can't
    be kept as it is. Rows without conv_id are one conversation. A conversation without rows has zeros, no audit and the empty hash;
    an empty table gives no row. Other columns are ignored. A conversation's audit, one letter a row, is the longest thing held; the
    cells that lead to it are 11 such strings.
    """
    dtype = rows.schema["conv_id"].dataType.simpleString()
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text"), F.lit(" ")).alias("text"), copies.cast("int").alias("copies")).withColumn(
        "digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    ends = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    slim = rows.select("conv_id", "turn", "role", "digest", "copies", F.when(ends == "", "b").when(ends.isin(".", "!", "?"), "k").otherwise(
        "t").alias("fault")).groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    # The first turn of equal rows, from minima per key: no group of equal rows meets in a task.
    instant = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = slim.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(instant).alias("first"))
    slim = slim.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    role, n = F.col("role"), F.col("copies").cast("int")
    own = F.when(F.col("fault") == "k", _letter(role, "k")).otherwise(_letter(role, "t"))
    again = _letter(role, "d")
    piece = F.when(n == 0, "").when(F.col("fault") == "b", F.repeat(_letter(role, "b"), n)).when(
        F.col("first") == instant, F.concat(own, F.repeat(again, n - 1))).otherwise(F.repeat(again, n))
    slim = ranged(slim.select("conv_id", "turn", "role", "digest", n.alias("copies"), piece.alias("piece")), "turns", "conv_id", "turn", "role", "digest")
    there = F.when(F.col("copies") > 0, F.col("turn"))
    chunks = slim.groupBy("conv_id", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "digest", "piece"))),
            lambda x: x["piece"]), "").alias("letters"),
        F.min(there).alias("low"), F.max(there).alias("high"), F.size(F.collect_set(there)).alias("turns"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for letters in batch.column("letters").to_pylist():
                cell = parse(letters)
                faults = [FAULTS[(ord(c) - 65) % 4] for c in letters]
                found.append((letters[:1], letters[-1:], illegal_pairs(letters), *[faults.count(f) for f in "bdt"],
                              [cell.get(p, (None,))[0] for p in PAIRS], [cell.get(p, (0, None))[1] for p in PAIRS]))
            kinds = (pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.string()))
            names = ["head", "tail", "illegal", "blank", "duplicate", "truncated", "costs", "audits"]
            columns = [pa.array([f[n] for f in found], kind) for n, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "part", "low", "high", "turns")], *columns],
                                             names=["conv_id", "part", "low", "high", "turns", *names])

    settled = chunks.mapInArrow(settle, f"conv_id {dtype}, part int, low long, high long, turns int, head string, tail string, illegal long, "
                                "blank long, duplicate long, truncated long, costs array<long>, audits array<string>")
    by_part = settled.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in settled.columns if c != "conv_id"]))).alias("parts"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts in batch.column("parts").to_pylist():
                cell = combined([{p: v for p, *v in ((p, c, a) for p, c, a in zip(PAIRS, x["costs"], x["audits"], strict=True) if c is not None)}
                                 for x in parts]) if len(parts) > 1 else dict(zip(PAIRS, zip(parts[0]["costs"], parts[0]["audits"], strict=True), strict=True))
                cost, audit = min(tuple(cell[START, START]), tuple(cell[START, ASSISTANT]))
                seams = [x for x in parts if x["head"]]
                illegal = sum(x["illegal"] for x in parts) + sum(illegal_pairs(a["tail"] + b["head"]) for a, b in zip(seams, seams[1:], strict=False))
                known = [x for x in parts if x["turns"]]
                turns = sum(x["turns"] for x in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
                gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
                found.append((min(gaps, 2**63 - 1), *[sum(x[c] for x in parts) for c in counts[1:4]], illegal, cost, audit))
            columns = [pa.array([f[n] for f in found], pa.int64()) for n in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, pa.array([f[6] for f in found], pa.string())],
                                             names=["conv_id", *counts, "audit"])

    result = ", ".join([f"conv_id {dtype}", *[f"{c} long" for c in counts], "audit string"])
    repaired = by_part.mapInArrow(finish, result)
    return _hashed(rows, repaired, counts, result)


def _hashed(rows: DataFrame, repaired: DataFrame, counts: list[str], result: str) -> DataFrame:
    """The audit of each conversation, then its rows in order, through one sorted stream: the repaired text is hashed as it passes."""
    plan = repaired.withColumn("copies", F.lit(0))
    stream = plan.unionByName(rows.where("copies > 0"), allowMissingColumns=True).withColumn("known", F.col("turn").isNotNull())
    order = ["conv_id", F.col("audit").isNull(), "known", "turn", "role", "digest"]
    stream = stream.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", *counts, "audit", "role", "text", "copies")
    names = ["conv_id", *counts, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, schema, done = None, None, []
        hashed, audit, at, spelt, system = hashlib.sha256(), "", 0, 0, 0

        def emit(role: str | None, text: str) -> None:
            nonlocal spelt
            role = role if role is not None else ("user", "assistant")[(spelt - system) % 2]
            hashed.update(f"{'' if not spelt else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            spelt += 1

        def insertions() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                emit(None, "")
                at += 1

        def close() -> None:
            if head is not None:
                insertions()
                done.append((*head, hashed.hexdigest()))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            schema = schema or pa.schema([*[batch.schema.field(c) for c in names], pa.field("repaired_sha256", pa.string())])
            for *own, role, text, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own[-1] is not None:
                    close()
                    head, audit, hashed, at, spelt, system = own, own[-1], hashlib.sha256(), 0, 0, 0
                    continue
                for _ in range(copies):
                    insertions()
                    action = audit[at]
                    at += 1
                    if action == "K":
                        system = int(role[:1] == "s") if not spelt else system
                        emit(role, text)
                    elif action == "R":
                        emit(None, text)
            if len(done) >= 5000:
                yield flush()
        close()
        if done:
            yield flush()

    return stream.mapInArrow(run, result + ", repaired_sha256 string")
