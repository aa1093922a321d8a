"""Byte automata: a small regex syntax to an NFA, subset construction, minimisation, transition arrays, and scans with them.

Patterns know literals, escapes (\\xHH, \\n, \\t and escaped punctuation), classes with ranges, groups, |, ?, *, + and {m} or
{m,}. They match bytes; characters beyond ASCII can be in a text and in no pattern.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a text that are scanned as one lane of a scan.
LANE = 256
#: Lanes to run again that are too few to be worth a round of all of them.
FEW = 16


class _Parser:
    """Thompson's construction. State s goes to eps[s] without a byte and by moves[s] = [(set of bytes, state)]."""

    def __init__(self, fold: bool = False):
        self.eps: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.fold = fold

    def state(self) -> int:
        self.eps.append([])
        self.moves.append([])
        return len(self.eps) - 1

    def parse(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.fold, self.text, self.at = fold, pattern, 0
        part = self._either()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        return part

    def _either(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.eps[start].append(a)
            self.eps[b].append(end)
            if self.text[self.at : self.at + 1] != "|":
                return start, end
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            a, b = self._repeated()
            self.eps[end].append(a)
            end = b
        return start, end

    def _repeated(self) -> tuple[int, int]:
        at = self.at
        a, b = self._atom()
        after, sign = self.at, self.text[self.at : self.at + 1]
        if sign not in ("?", "*", "+", "{"):
            return a, b
        if sign == "{":
            close = self.text.index("}", after)
            least, _, more = self.text[after + 1 : close].partition(",")
            if more or ("," not in self.text[after:close] and not least):
                raise ValueError("only {m} and {m,} are known")
            n, open_ended, after = int(least), "," in self.text[after:close], close
        else:
            n, open_ended = (1 if sign == "+" else 0), sign != "?"
        end = after + 1
        start = last = self.state()
        for _ in range(n):
            self.at = at
            a, b = self._atom()
            self.eps[last].append(a)
            last = b
        if open_ended or sign == "?":
            self.at = at
            a, b = self._atom()
            out = self.state()
            self.eps[last] += [a, out]
            self.eps[b].append(out)
            if open_ended:
                self.eps[b].append(a)
            last = out
        self.at = end
        return start, last

    def _atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            part = self._either()
            if self.text[self.at : self.at + 1] != ")":
                raise ValueError("missing )")
            self.at += 1
            return part
        found = self._class() if c == "[" else {self._byte()}
        if self.fold:
            found |= {x ^ 32 for x in found if chr(x).isalpha()}
        a, b = self.state(), self.state()
        self.moves[a].append((frozenset(found), b))
        return a, b

    def _byte(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            e = self.text[self.at]
            self.at += 1
            if e == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            c = {"n": "\n", "t": "\t"}.get(e, e)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def _class(self) -> set[int]:
        self.at += 1
        out: set[int] = set()
        while self.text[self.at] != "]":
            lo = self._byte()
            hi = lo
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                hi = self._byte()
            out |= set(range(lo, hi + 1))
        self.at += 1
        return out


class Automaton:
    """A minimal deterministic automaton over bytes. State 0 is the start; accept[s] has a bit for each rule.

    ``table[s * classes + byte_class[b]]`` is the next state.
    """

    def __init__(self, patterns: list[str], fold: list[bool] | None = None, search: bool = True, reverse: bool = False):
        p = _Parser()
        parts = [p.parse(x, bool(fold and fold[i])) for i, x in enumerate(patterns)]
        if reverse:
            eps = [[] for _ in p.eps]
            moves = [[] for _ in p.eps]
            for s, (es, ms) in enumerate(zip(p.eps, p.moves)):
                for t in es:
                    eps[t].append(s)
                for found, t in ms:
                    moves[t].append((found, s))
            p.eps, p.moves, parts = eps, moves, [(b, a) for a, b in parts]
        starts = [a for a, _ in parts]
        ends: dict[int, int] = {}
        for i, (_, b) in enumerate(parts):
            ends[b] = ends.get(b, 0) | 1 << i

        sets = sorted({found for ms in p.moves for found, _ in ms}, key=sorted)
        names: dict[tuple, int] = {}
        self.byte_class = np.array([names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)], dtype=np.uint8)
        self.classes = len(names)
        member = [next(b for b in range(256) if self.byte_class[b] == c) for c in range(self.classes)]

        def closed(states: set[int]) -> frozenset[int]:
            stack = list(states)
            while stack:
                for t in p.eps[stack.pop()]:
                    if t not in states:
                        states.add(t)
                        stack.append(t)
            return frozenset(s for s in states if p.moves[s] or s in ends)

        first = closed(set(starts))
        known, rows = {first: 0}, []
        order = [first]
        for states in order:
            row = []
            for b in member:
                to = {t for s in states for found, t in p.moves[s] if b in found}
                to = closed(to | set(starts)) if search else closed(to)
                if to not in known:
                    known[to] = len(order)
                    order.append(to)
                row.append(known[to])
            rows.append(row)
        accept = []
        for states in order:
            mask = 0
            for s in states:
                mask |= ends.get(s, 0)
            accept.append(mask)
        self._minimise(rows, accept)
        self.dead = {s for s in range(self.states) if not self.accept[s] and all(t == s for t in self.rows[s])}
        self.accepts = self.accept.tolist()
        self.class_of = self.byte_class.tolist()

    def _minimise(self, rows: list[list[int]], accept: list[int]) -> None:
        """Partition refinement from the acceptance masks; parts are numbered by their first state, so the start stays 0."""
        names: dict = {}
        part = [names.setdefault(m, len(names)) for m in accept]
        while True:
            names = {}
            new = [names.setdefault((part[s], *(part[t] for t in row)), len(names)) for s, row in enumerate(rows)]
            done, part = len(names) == len(set(part)), new
            if done:
                break
        self.states = len(set(part))
        lead = [part.index(k) for k in range(self.states)]
        self.rows = [[part[t] for t in rows[s]] for s in lead]
        self.accept = np.array([accept[s] for s in lead], dtype=np.uint32)
        self.table = np.array(self.rows, dtype=np.uint16 if self.states < 1 << 16 else np.uint32).ravel()

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions after which some rule accepts, over the texts put together, and the masks there.

        Each text is cut into lanes that advance together, a byte of all of them at a time. Lanes begin in the start
        state; a lane whose predecessor in its text ended in another state is run again from that, until no end changes. A few
        lanes are run again byte by byte, on into the lanes behind them, so that a state which lasts for a whole text costs one pass.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        bases = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n_lanes = -(-sizes // LANE)
        of = np.repeat(np.arange(len(texts)), n_lanes)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        start = bases[of] + k * LANE
        length = np.minimum(sizes[of] - k * LANE, LANE)
        order = np.argsort(-length, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        classes = self.byte_class[data]
        states = np.zeros((LANE, len(order)), dtype=self.table.dtype)
        begin = np.zeros(len(order), dtype=np.int64)
        self._advance(classes, start[order], length[order], begin, states, np.arange(len(order)))
        follows = np.flatnonzero(k > 0)  # lanes with one before them in the same text
        while len(follows):
            final = states[length[order] - 1, np.arange(len(order))].astype(np.int64)
            now = final[rank[follows - 1]]
            wrong = follows[now != begin[rank[follows]]]
            if not len(wrong):
                break
            if len(wrong) <= FEW:
                for lane in wrong.tolist():
                    self._run_on(classes, lane, start, length, rank, k, begin, states)
                continue
            at = np.sort(rank[wrong])
            begin[at] = final[rank[order[at] - 1]]
            self._advance(classes, start[order[at]], length[order[at]], begin[at], states, at)
        mask = self.accept[states]
        col, row = np.nonzero(mask.T)
        inside = row < length[order[col]]
        col, row = col[inside], row[inside]
        ends = start[order[col]] + row + 1
        by = np.argsort(ends, kind="stable")
        return ends[by], mask[row, col][by]

    def _advance(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray, begin: np.ndarray, states: np.ndarray, columns: np.ndarray) -> None:
        """Run lanes, given by falling length, and keep the state after each byte. A lane stops when it meets a state that it had there before."""
        table, n = self.table, self.classes
        live, cur = len(start), begin
        whole = len(columns) == states.shape[1]
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, side="left"))
            if not live:
                break
            cur = table[cur[:live].astype(np.int64) * n + classes[start[:live] + i]]
            if whole:
                states[i, :live] = cur
            else:
                same = states[i, columns[:live]] == cur
                states[i, columns[:live]] = cur
                if same.any():
                    keep = np.flatnonzero(~same)
                    if not len(keep):
                        break
                    start, length, columns, cur = start[keep], length[keep], columns[keep], cur[keep]

    def _run_on(self, classes: np.ndarray, lane: int, start: np.ndarray, length: np.ndarray, rank: np.ndarray, k: np.ndarray, begin: np.ndarray, states: np.ndarray) -> None:
        """Run a lane from its predecessor's last state, and the lanes of the same text behind it, until a state is met that was there before."""
        rows, before = self.rows, rank[lane - 1]
        s = int(states[length[lane - 1] - 1, before])
        while True:
            c, n = rank[lane], int(length[lane])
            begin[c] = s
            old = states[:n, c].tolist()
            new = []
            for b, was in zip(classes[start[lane] : start[lane] + n].tolist(), old):
                s = rows[s][b]
                if s == was:
                    break
                new.append(s)
            states[: len(new), c] = new
            lane += 1
            if len(new) < n or lane >= len(k) or not k[lane]:
                return

    def longest(self, data: bytes, at: int, end: int) -> int:
        """The end of the longest match that begins at `at`, or -1."""
        s, rows, cls, accept, best = 0, self.rows, self.class_of, self.accepts, -1
        for i in range(at, end):
            s = rows[s][cls[data[i]]]
            if accept[s]:
                best = i + 1
            elif s in self.dead:
                break
        return best

    def leftmost(self, data: bytes, at: int, end: int) -> int:
        """For an automaton of reversed patterns: the smallest begin, not before `at`, of a match that ends at `end`, or -1."""
        s, rows, cls, accept, best = 0, self.rows, self.class_of, self.accepts, -1
        for i in range(end - 1, at - 1, -1):
            s = rows[s][cls[data[i]]]
            if accept[s]:
                best = i
            elif s in self.dead:
                break
        return best
