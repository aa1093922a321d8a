"""Repair of conversations whose turns don't alternate, by the cheapest edits, found once for each distinct signature.

A conversation's rows become one character each (first letter of the role, and the row's first fault), its signature. However many conversations share a
signature, it is solved once; the solution (the audit: one initial for each edit) is joined back, and the edits are replayed over the rows.

Defined cases: null roles, texts and turns are one space; rows of one turn (nulls first) are ordered by role and text, and a repeated row stands beside its
copy; rows that are equal in all are rows of their own; rows with a null conv_id are one conversation, the null one; an empty table gives no rows; other
columns, whatever their names, are ignored. A conversation is never gathered: its signature is put together from pieces and its rows stream by. What is held is the audit
that a result row has anyway, a byte for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import Memo, Work, only, read_table, spread_join, written
from skeinwork.llm.turns import digest_of, numbered

# Fixed values of the rule: what is a character of a text, what ends a sentence, costs, and what may follow what.
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}

#: A signature's characters: CODES[4 * role + fault] with roles s, u, a, other and faults none, blank, duplicate, truncated.
ROLES, CODES = "sua", "ABCDEFGHIJKLMNOP"
#: Rows of a piece of a signature; rows up to which suffixes are memoised.
PIECE, STEP = 4096, 64
#: A conversation with a null number, inside.
NOBODY = -(1 << 63)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; conv_id is never null."""
    c = only(conversations, ("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))
    return c.withColumns({"conv_id": F.coalesce("conv_id", F.lit(NOBODY)), "role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults put in by crc32 of `conv_id:turn`: a row goes, loses its text, its sentence ends or its role, or stands there twice (copy 0 and 1)."""
    name = F.when(F.col("conv_id") != NOBODY, F.col("conv_id").cast("string")).otherwise(" ")
    kind = F.crc32(F.concat(name, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    d = turns.withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    d = d.select("conv_id", "turn", F.col("role").alias("_role"), F.col("text").alias("_text"), F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy"))
    return d


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, pos and code, a character of the signature, of rows (conv_id, pos, role, text)."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)  # empty: a blank row
    r = rows.select("conv_id", "pos", F.substring("role", 1, 1).alias("_r"), last.alias("_last"), digest_of(F.col("role"), F.col("text")).alias("_digest"))
    firsts = r.groupBy("conv_id", "_digest").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("_first"))
    fault = F.when(F.col("_last") == "", 1).when(F.col("_first").isNull(), 2).when(~F.col("_last").isin(*ENDS), 3).otherwise(0)
    role = F.when(F.col("_r").isin(*ROLES), F.instr(F.lit(ROLES), F.col("_r")) - 1).otherwise(len(ROLES))
    return r.join(firsts, ["conv_id", "pos"], "left").select("conv_id", "pos", F.substring(F.lit(CODES), 4 * role + fault + 1, F.lit(1)).alias("code"))


def signatures(codes: DataFrame) -> DataFrame:
    """conv_id and signature: rows become pieces of PIECE characters, pieces the whole."""

    def joined(at: str, item: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, item))), lambda x: x[item]), "")

    pieces = codes.groupBy("conv_id", F.floor((F.col("pos") - 1) / PIECE).alias("piece")).agg(joined("pos", "code").alias("part"))
    return pieces.groupBy("conv_id").agg(joined("piece", "part").alias("signature"))


# -- one signature

#: States of the output: nothing yet, behind s, behind u, behind a. What may be put out in each, and where that leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
WANTED = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
TO = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}


def _better(a, b):
    return b if a is None or (b is not None and b < a) else a


def _with_inserts(best: list) -> list:
    """best (cost, audit) of each state with insertions before it; two more change nothing, as they lead back at a cost."""
    for _ in range(2):
        best = [_better(b, None if (n := best[TO[WANTED[s]]]) is None else (n[0] + INSERT, "I" + n[1])) for s, b in enumerate(best)]
    return best


def _row(code: str, after: list) -> list:
    """The cheapest way from before a row, for each state."""
    role, fault = divmod(CODES.index(code), 4)
    best = []
    for s in range(4):
        ways = [(DELETE, "D", s)]
        if fault not in (1, 2):
            extra = TRUNCATED if fault == 3 else 0
            ways.append((REROLE + extra, "R", TO[WANTED[s]]))
            if role < 3 and (ROLES[role] == WANTED[s] or (s == START and ROLES[role] == "s")):
                ways.append((extra, "K", TO[ROLES[role]]))
        found = None
        for cost, initial, to in ways:
            if after[to] is not None:
                found = _better(found, (cost + after[to][0], initial, to))
        best.append(None if found is None else (found[0], found[1] + after[found[2]][1]))
    return _with_inserts(best)


class Solver:
    """Signatures to audits by a recursion over their suffixes, with a memo of bounded size that all signatures share."""

    def __init__(self):
        self.memo = Memo(50_000)

    def suffix(self, signature: str) -> list:
        """For each state the cheapest edits of a signature of at most STEP rows, which bounds the recursion."""
        if not signature:
            return _with_inserts([(0, ""), None, None, (0, "")])
        known = self.memo.get(signature)
        if known is None:
            known = _row(signature[0], self.suffix(signature[1:]))
            self.memo.room(set())
            self.memo[signature] = known
        return known

    def long(self, signature: str) -> list:
        """Beyond STEP rows strings would be copied for each row, so costs and choices are kept, and the audit is read off them."""
        tail = self.suffix(signature[-STEP:])
        costs, choices = [None if b is None else b[0] for b in tail], []
        for code in reversed(signature[:-STEP]):
            step = _row(code, [None if c is None else (c, f"\0{s}") for s, c in enumerate(costs)])
            costs = [None if b is None else b[0] for b in step]
            choices.append([None if b is None else b[1] for b in step])
        choices.reverse()
        out = []
        for s in range(4):
            if costs[s] is None:
                out.append(None)
                continue
            audit, at = [], s
            for c in choices:
                edits, to = c[at].split("\0")
                audit.append(edits)
                at = int(to)
            out.append((costs[s], "".join(audit) + tail[at][1]))
        return out

    def solve(self, signature: str) -> tuple[int, int, int, int, int, str]:
        """Blank, duplicate, truncated, illegal, cost, audit."""
        cost, audit = (self.long if len(signature) > STEP else self.suffix)(signature)[START]
        faults = [sum(map(signature.count, CODES[f::4])) for f in (1, 2, 3)]
        initials = "".join((ROLES + "?")[CODES.index(c) // 4] for c in signature)
        legal = sum(a + b in LEGAL for a, b in zip(initials, initials[1:]))
        return (*faults, max(0, len(initials) - 1) - legal, cost, audit)


SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solver, kinds = Solver(), [pa.string(), *[pa.int64()] * 5, pa.string()]
    for b in batches:
        rows = [(s, *solver.solve(s)) for s in b.column(0).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SOLVED.split(", ")])


def audits(signed: DataFrame, work: Work) -> DataFrame:
    """signed (conv_id, signature) with the faults, cost and audit of the signature; each distinct one is solved once."""
    signed = work.put(signed, "repair-signatures")
    key = F.sha2("signature", 256)
    solved = work.put(signed.select("signature").distinct().mapInArrow(_solved, SOLVED), "repair-audits")
    return spread_join(signed.select("conv_id", key.alias("key")), solved.withColumn("key", key).drop("signature"), "key", "conv_id").drop("key")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, pos), at pos 0 the audit: the repaired rows' lines, one output row for each row that leaves lines and one for lines behind the last."""
    conv, audit, i, state, out = None, "", 0, START, []

    def lines_until_row(role: str | None, text: str | None) -> list[str]:
        """The lines of the insertions up to the next row's edit, and its own; without a row, of the rest."""
        nonlocal i, state
        lines = []
        while i < len(audit):
            edit, i = audit[i], i + 1
            if edit == "D":
                break
            name = {"u": "user", "a": "assistant"}[WANTED[state]] if edit in "IR" else role
            state = TO[name[0]]
            lines.append(f"{name}:{'' if edit == 'I' else text}")
            if edit != "I":
                break
        return lines

    def put(pos: int, lines: list[str]) -> None:
        if lines:
            out.append((conv, pos, "\n".join(lines)))

    names, kinds = ["conv_id", "pos", "lines"], (pa.int64(), pa.int64(), pa.string())
    held = 0
    for b in batches:
        for c, pos, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "pos", "role", "text"))):
            if c != conv:
                if conv is not None:
                    put(1 << 62, lines_until_row(None, None))
                conv, audit, i, state = c, text, 0, START
                continue
            put(pos, lines_until_row(role, text))
            held += len(text)
            if held > 1 << 20 and out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                out, held = [], 0
    if conv is not None:
        put(1 << 62, lines_until_row(None, None))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)


def _with_audits(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows sorted by (conv_id, pos), each conversation's audit before them, at pos 0."""
    first = audited.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return rows.select("conv_id", "pos", "role", "text").unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def replayed(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, pos, lines (`role:text`, newline-joined, of a row and of what is put in before it) of rows repaired by their conversation's audit."""
    return _with_audits(rows, audited).mapInArrow(_replayed, "conv_id long, pos long, lines string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, pos, lines) to one digest for each conversation."""
    at, h, out, names = None, None, [], ["conv_id", "repaired_sha256"]
    for b in batches:
        for c, lines in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist()):
            if c != at:
                if at is not None:
                    out.append((at, h.hexdigest()))
                at, h = c, hashlib.sha256(lines.encode())
            else:
                h.update(b"\n" + lines.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
            out = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([h.hexdigest()])], names)


def repaired_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of what replayed() gives, while its rows are sorted, so that they are moved once."""
    return _with_audits(rows, audited).mapInArrow(lambda b: _hashed(_replayed(b)), "conv_id long, repaired_sha256 string")


def gaps_of(rows: DataFrame) -> DataFrame:
    """conv_id and gaps, the turns that are missing between the first and the last."""
    t = rows.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    return t.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def repaired(turns: DataFrame, rows: DataFrame, work: Work) -> DataFrame:
    """For every conversation of turns: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its rows (conv_id, turn, pos, role, text)."""
    audited = work.put(audits(signatures(coded(rows)), work), "repair-audited")
    every = turns.select("conv_id").distinct()
    out = every.join(audited, "conv_id", "left").join(gaps_of(rows), "conv_id", "left").join(repaired_digests(rows, audited), "conv_id", "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conv = F.when(F.col("conv_id") != NOBODY, F.col("conv_id")).alias("conv_id")
    return out.select(conv, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with faults put in, and the cheapest edits that make them alternate again."""
    with Work(spark) as work:
        turns = turns_of(read_table(spark, sf_dir, "conversations"))
        rows = numbered(damaged(turns), "conv_id", ["turn", "_role", "_text", "_copy"], work, "repair-rows").select("conv_id", "turn", "pos", "role", "text")
        return written(repaired(turns, rows, work), "repaired")
