"""Token counts by a deterministic transducer whose transitions emit numbers of tokens.

BPE with a finite vocabulary is finite-state: what a next character does to the segmentation depends on the pieces
that can still grow and on the tokens before them. A state lists, oldest first, each position from which some piece can still
grow: that piece's trie node, the tokens counted up to the position less those up to now, and the token that ends there.
The last token after a character is the longest piece that ends there and is compatible with the token before it, where
two pieces are compatible if BPE leaves their concatenation as those two. A transition emits the change of the count,
so the sum over a text's characters is its number of tokens. States are built when a text first needs them, and a state
that has been built is found by its list, so texts that differ only in what can't matter any more share states.

Spaces are characters like others. A run of them is cut into the longest pieces of spaces and a rest, as their scores tie below all others, and its last
space begins the word behind it, if some piece goes on from it there; a state in a run knows the run's length modulo the longest piece.

A text is cut into chunks of one length, in the midst of words too. A chunk's state map has, for the states in which the chunk can begin, the state in which it ends and
the tokens that it emits. It is made without the chunk before: at the first space behind another character all states become one, so what differs is the few characters
up to there, which are run from each state that can come of the characters left of the cut (a state that wasn't foreseen is run when it is asked for). Maps are composed
pairwise, neighbour with neighbour, and a prefix scan of log2(chunks) rounds up and down gives the tokens up to each chunk's end.

Defined cases: null and empty texts have no tokens; a character that is in no piece counts its UTF-8 bytes (byte
fallback); U+2581 in a text counts as a space, as in the library; repeated rows are each counted; texts of any length are counted whole; an
empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm.common import Memo, docs_of, read_table, text_slices
from skeinwork.llm.pieces import MARK, WORD, Vocabulary

LIMIT = 4096
#: Characters of a chunk of a text.
CHUNK = 1 << 12
#: Characters before a chunk from which it guesses the states in which it can begin, and places among them at which a beginning is supposed.
LEFT, BEGINNINGS = 32, 6
#: A space behind another character: whatever stands before, from here on a text's states are the same.
SYNC = re.compile(r"[^ ] ")
#: States that are held; beyond, the transducer is built anew.
STATES = 300_000
UNKNOWN = -1


class BPE:
    """Merges of the best scored neighbours, leftmost first among equals: the definition that the transducer is compiled from."""

    def __init__(self, score: dict[str, float]):
        self.score = score

    def __call__(self, text: str) -> list[str]:
        if len(text) > 48:
            return self._long(text)
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _long(self, text: str) -> list[str]:
        """The same with a heap over linked symbols."""
        part: list[str | None] = list(text)
        left, right = [i - 1 for i in range(len(part))], [i + 1 for i in range(len(part))]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(part):
                both = part[i] + part[j]
                s = self.score.get(both)
                if s is not None:
                    heapq.heappush(heap, (-s, i, j, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or part[j] is None or right[i] != j or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in part if p is not None]


class Transducer:
    """States 0, 1, ...; step[s][character] = (next state, tokens emitted). State 0 is before a text. Spaces are read as MARK."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.bpe = vocabulary, BPE(vocabulary.score)
        runs = {p: s for p, s in vocabulary.score.items() if len(p) > 1 and not p.strip(MARK)}
        #: Spaces of the longest piece of spaces alone, and the tokens of runs of up to so many.
        self.run_length = max(map(len, runs), default=1)
        self.run_tokens = [len(self.bpe(MARK * n)) for n in range(self.run_length + 1)]
        others = [(p, s) for p, s in vocabulary.score.items() if len(p) > 1 and p.strip(MARK)]
        if any(p.startswith(MARK * 2) or s <= max(runs.values(), default=s - 1) for p, s in others):
            raise ValueError("pieces of spaces come before others")
        if any(len(self.bpe(MARK * n)) != n // self.run_length + self.run_tokens[n % self.run_length] for n in range(4 * self.run_length)):
            raise ValueError("runs of spaces aren't cut into longest pieces")
        self.known = {c for p in vocabulary.score for c in p}
        self.child: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in vocabulary.score:
            node = 0
            for c in p:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.piece.append(None)
                node = self.child[node][c]
            self.piece[node] = p
        self.compatible_pairs: dict[tuple, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.step: list[dict[str, tuple[int, int]]] = []
        self._state(((0, 0, None),))

    def _state(self, live: tuple) -> int:
        found = self.number.get(live)
        if found is None:
            found = self.number[live] = len(self.states)
            self.states.append(live)
            self.step.append({})
        return found

    def compatible(self, before: str | int | None, piece: str) -> bool:
        """Whether BPE leaves `before` followed by `piece` as they are; None: `piece` begins the word; UNKNOWN: nothing merges with it."""
        key = (before, piece)
        known = self.compatible_pairs.get(key)
        if known is None:
            if isinstance(before, str):
                known = self.bpe(before + piece) == [before, piece]
            else:
                known = self.bpe(piece) == [piece]
            if len(self.compatible_pairs) > 2_000_000:
                self.compatible_pairs.clear()
            self.compatible_pairs[key] = known
        return known

    def _spaces(self, s: int) -> int:
        """How many spaces of a run state s has read, modulo the longest piece of them (1 to run_length); 0: it isn't in a run."""
        live = self.states[s]
        return live[0] if isinstance(live[0], int) else 0

    def compile(self, s: int, c: str) -> tuple[int, int]:
        """Build the transition of state s by the character c."""
        spaces = self._spaces(s)
        if c == MARK:
            now = spaces % self.run_length + 1
            out = self.step[s][c] = (self._state((now,)), self.run_tokens[now] - self.run_tokens[now - 1])
            return out
        live = self.states[s]
        if spaces:
            # a word's first piece can begin with the run's last space, which then isn't in the run
            live = ((self.child[0][MARK], self.run_tokens[spaces - 1] - self.run_tokens[spaces], None), (0, 0, MARK)) if MARK in self.child[0] else ((0, 0, UNKNOWN),)
        grown, token, emitted = [], None, 0
        for node, count, before in live:
            node = self.child[node].get(c)
            if node is not None:
                piece = self.piece[node]
                if token is None and piece is not None and self.compatible(before, piece):
                    token, emitted = piece, count + 1
                grown.append((node, count, before))
        if token is None:
            token, emitted = (c if c in self.known else UNKNOWN), len(c.encode())
        live = (*((node, count - emitted, before) for node, count, before in grown), (0, 0, token))
        out = self.step[s][c] = (self._state(live), emitted)
        return out

    def run(self, s: int, text: str) -> tuple[int, int]:
        """The state and the tokens emitted when text is read in state s."""
        step, total = self.step, 0
        for c in text:
            try:
                s, n = step[s][c]
            except KeyError:
                s, n = self.compile(s, c)
            total += n
        return s, total


class ChunkMap:
    """What a piece of text does to any state in which it can begin: the state in which it ends, and the tokens emitted.

    `head` (parts of a text) runs up to the first space that stands behind another character; from there on all states are one, so the rest is one entry, `tail`, which
    is None if there is no such space. `table` has the states that were tabulated; others that are asked for are run through the head and tabulated then.
    """

    __slots__ = ("transducer", "head", "tail", "table")

    def __init__(self, transducer: Transducer, head: tuple[str, ...], tail: tuple[int, int] | None, states: Iterable[int] = ()):
        self.transducer, self.head, self.tail, self.table = transducer, head, tail, {}
        for s in states:
            self(s)

    def __call__(self, s: int) -> tuple[int, int]:
        found = self.table.get(s)
        if found is None:
            t, total = s, 0
            for part in self.head:
                t, n = self.transducer.run(t, part)
                total += n
            found = self.table[s] = (t, total) if self.tail is None else (self.tail[0], total + self.tail[1])
        return found

    def then(self, b: ChunkMap) -> ChunkMap:
        """The map of this piece followed by b. Associative; every state of this table is in the new one."""
        if self.tail is None:
            out = ChunkMap(self.transducer, self.head + b.head, b.tail)
        else:
            t, n = b(self.tail[0])
            out = ChunkMap(self.transducer, self.head, (t, self.tail[1] + n))
        for s, (t, n) in self.table.items():
            end, more = b(t)
            out.table[s] = (end, n + more)
        return out


def chunks(text: str, size: int) -> list[str]:
    """A text in parts of `size` characters, wherever that cuts words."""
    return [text[i : i + size] for i in range(0, len(text), size)]


class Counter:
    """Counts of texts, with a memo of the words' counts."""

    def __init__(self, vocabulary: Vocabulary):
        self.transducer = Transducer(vocabulary)
        self.memo = Memo()

    def word(self, word: str) -> int:
        """Tokens of a word that begins with a space, from any state that isn't in a run of spaces."""
        return self.transducer.run(0, word.replace(" ", MARK))[1]

    def words(self, words: list[str]) -> int:
        wanted = set(words)
        self.memo.room(wanted)
        for w in self.memo.missing(wanted):
            self.memo[w] = self.word(w)
        return sum(map(self.memo.__getitem__, words))

    def begins(self, left: str) -> set[int]:
        """States in which a chunk can begin behind the characters `left`: those that come of a beginning at each of some places in them."""
        return {self.transducer.run(0, left[i:].replace(" ", MARK))[0] for i in range(0, len(left), max(1, len(left) // BEGINNINGS))}

    def chunk(self, text: str, left: str = "") -> ChunkMap:
        """The state map of a chunk, from itself and the few characters before it alone; without these it is a text's first, which begins in state 0."""
        if text[0] == " " and left[-1:] != " ":
            first = 0
        else:
            m = SYNC.search(text)
            first = m.start() + 1 if m else len(text)
        head = (text[:first].replace(" ", MARK),) if first else ()
        tail = None
        if first < len(text):
            *words, last = WORD.findall(text[first:])
            end, n = self.transducer.run(0, last.replace(" ", MARK))
            tail = (end, n + self.words(words))
        return ChunkMap(self.transducer, head, tail, self.begins(left) if left else (0,))

    def maps(self, text: str) -> list[ChunkMap]:
        """A map for each chunk. None needs another, so they can be made in any order."""
        return [self.chunk(part, text[max(0, i * CHUNK - LEFT) : i * CHUNK]) for i, part in enumerate(chunks(text, CHUNK))]

    @staticmethod
    def scan(maps: list[ChunkMap], start: int = 0) -> list[tuple[int, int]]:
        """The state and the tokens so far behind every chunk, by a prefix scan: neighbours' maps are composed in log2(chunks) rounds, then what holds before a
        composed pair is handed down to its halves in as many."""
        rounds = [maps]
        while len(rounds[-1]) > 1:
            m = rounds[-1]
            rounds.append([m[i].then(m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
        before = [(start, 0)]
        for m in reversed(rounds[:-1]):
            down: list[tuple[int, int]] = []
            for i, (s, n) in enumerate(before):
                down.append((s, n))
                if 2 * i + 1 < len(m):
                    t, more = m[2 * i](s)
                    down.append((t, n + more))
            before = down
        return [(m(s)[0], n + m(s)[1]) for m, (s, n) in zip(maps, before)]

    def many(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.transducer.states) > STATES:
            self.transducer._reset()
        return [self.scan(self.maps(" " + t.replace(MARK, " ")))[-1][1] if t else 0 for t in texts]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each worker process and model file."""
    if path not in _counters:
        _counters[path] = Counter(Vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            for part, raw in text_slices(batch):
                n = c.many([x.decode("utf-8", "replace") for x in raw])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_bytes": pa.array(map(len, raw), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return docs_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
