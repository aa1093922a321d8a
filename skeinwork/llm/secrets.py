"""Secret scans with one deterministic automaton for all rules.

All rules are compiled together (subset construction, minimisation, transition arrays) and every byte of a text is
read once by that automaton, which tells where matches of which rules end. Each match's begin comes from the rule's
reversed automaton, its last end from the rule's own one, and matches of a rule are leftmost, longest and apart.
Where a rule's beginning is found without the rest, one more pass, from the text's end, tells where whole matches of the rule begin, and
only there the rule's own automaton runs: the time is linear in the text's length for any text.

Matches consume their text first, and those that are too short are dropped then. No match of a rule may begin inside
another whose pattern isn't complete yet, which holds for the rules here.

Defined cases: null and empty texts have no spans; an empty table gives no rows; other columns, whatever their names, are ignored by the scan and
kept by masked(); spans that overlap are masked as one; spans are in code points, end exclusive, so a text with characters
of several bytes has the same spans as Python's ``re`` gives; repeated rows are each scanned; bytes that aren't UTF-8
count as characters wherever they aren't continuation bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.automaton import Automaton
from skeinwork.llm.common import docs_of, read_table, text_slices


@dataclass(frozen=True)
class Rule:
    """pattern + rest is what a match is. The automaton of all rules looks for `pattern`, the rule's own one goes on to the longest match.

    least: characters that the match, or the part of it after `part` (a byte regex), must have.
    """

    kind: str
    pattern: str
    rest: str = ""
    least: int = 0
    fold: bool = False
    part: bytes = b""
    base: bool = False


#: In the order in which kinds are listed. The first three are the base kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]""", r"+", 12, fold=True, part=rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", base=True),
    Rule("access", r"AKIA[A-Z0-9]", r"+", 18, base=True),
    Rule("hex", r"[0-9a-f]{16}", r"[0-9a-f]*", 16, base=True),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]\-", r"[A-Za-z0-9\-]+", 15),
    Rule("google", r"AIza", r"[A-Za-z0-9_\-]+", 39),
    Rule("stripe", r"[sr]k_(live|test)_", r"[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 40),
    Rule("pem", r"\-\-\-\-\-BEGIN ", r"([A-Z]+ )*PRIVATE KEY\-\-\-\-\-"),
    Rule("login", r"://", r"[A-Za-z0-9_.\-]+:[A-Za-z0-9_.!%\-]+@", 12),
)


class Scanner:
    """Rules compiled for scans of many texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules], [r.fold for r in rules])
        self.ahead = [Automaton([r.pattern + r.rest], [r.fold], search=False) for r in rules]
        self.back = [Automaton([r.pattern], [r.fold], search=False, reverse=True) for r in rules]
        self.whole = [Automaton([r.pattern + r.rest], [r.fold], reverse=True) for r in rules]
        self.part = [re.compile(r.part) if r.part else None for r in rules]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (begin, end, number of the rule) in code points, sorted by begin, then rule."""
        ends, masks = self.all.scan(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not len(ends):
            return out
        bases = np.cumsum([0, *map(len, texts)])
        of = np.searchsorted(bases, ends - 1, side="right") - 1
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
            i = int(of[lo])
            found = self._resolve(texts[i], (ends[lo:hi] - bases[i]), masks[lo:hi])
            if found:
                out[i] = self._in_code_points(texts[i], found)
        return out

    def _resolve(self, text: bytes, ends: np.ndarray, masks: np.ndarray) -> list[tuple[int, int, int]]:
        found = []
        seen = int(np.bitwise_or.reduce(masks))
        for k, rule in enumerate(self.rules):
            if seen >> k & 1:
                mine, bound, at, whole = ends[(masks >> np.uint32(k) & np.uint32(1)).astype(bool)], 0, 0, None
                while at < len(mine):
                    begin = self.back[k].leftmost(text, bound, int(mine[at]))
                    if begin < 0 or (whole is not None and not whole[begin]):  # it began before the last match's end, or its rest isn't there
                        at += 1
                        continue
                    end = self.ahead[k].longest(text, begin, len(text))
                    if end < 0:  # the pattern is there, its rest isn't
                        whole = self._begins(k, text)
                        at += 1
                        continue
                    bound = end
                    found.append((begin, bound, k))
                    at = int(np.searchsorted(mine, bound, side="right"))
        return sorted(((a, b, k) for a, b, k in found if self._kept(text, a, b, k)), key=lambda x: (x[0], x[2]))

    def _begins(self, k: int, text: bytes) -> np.ndarray:
        """Whether a match of rule k, rest included, begins at each byte."""
        out = np.zeros(len(text), dtype=bool)
        out[len(text) - self.whole[k].scan([text[::-1]])[0]] = True
        return out

    def _kept(self, text: bytes, begin: int, end: int, k: int) -> bool:
        if self.part[k]:
            begin = self.part[k].match(text, begin, end).end()
        return end - begin >= self.rules[k].least

    @staticmethod
    def _in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if text.isascii():
            return found
        before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        return [(int(before[a]), int(before[b]), k) for a, b, k in found]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One compiled scanner for each worker process and set of rules."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans array<struct<begin, end, kind>> of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for part, raw in text_slices(batch):
                spans = [[{"begin": a, "end": b, "kind": rules[k].kind} for a, b, k in found] for found in s.spans(raw)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs_of(docs).mapInArrow(run, "doc_id long, spans array<struct<begin:long,end:long,kind:string>>")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by [kind]; spans that overlap go together, and the first of them names the replacement."""
    out, at = [], 0
    for begin, end, kind in sorted(spans):
        if begin >= at:
            out += [text[at:begin], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns; secrets in text are replaced by their kinds, and n_chars, where there is one, follows. A null text stays null."""

    @F.pandas_udf("string")
    def cleaned(texts):
        import pandas as pd

        s, out = scanner(rules), []
        for i in range(0, len(texts), 256):
            some = [None if x is None else x for x in texts.iloc[i : i + 256]]
            for x, found in zip(some, s.spans([(x or "").encode() for x in some])):
                out.append(mask(x, [(a, b, rules[k].kind) for a, b, k in found]) if found else x)
        return pd.Series(out, dtype=object)

    done = docs.withColumn("text", cleaned(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans of every document."""
    rules = RULES
    base = {r.kind for r in rules if r.base}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, digests, listed = batch.column(0), {k: [] for k in ("assign", "access", "hex")}, [], []
            for spans in batch.column(1).to_pylist():
                text = [(x["kind"], f"{x['kind']}:{x['begin']}:{x['end']}") for x in spans]
                for k, v in counts.items():
                    v.append(sum(kind == k for kind, _ in text))
                digests.append(hashlib.sha256(",".join(x for kind, x in text if kind in base).encode()).hexdigest())
                listed.append(",".join(x for _, x in text))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}, "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(listed, pa.string())})

    return find_secrets(read_table(spark, sf_dir, "documents"), rules).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
