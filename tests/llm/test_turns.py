"""Conversation operators against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from skeinwork.llm import chat
from skeinwork.llm.chat import CHAT, HOSTILE, Template, op12_chat_format
from skeinwork.llm.common import Work
from skeinwork.llm.prefix_trie import op11_prefix_trie
from skeinwork.llm.repair import CODES, Solver, op13_structure_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def table(sf):
    return duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()


def odd_rows(seed=1, convs=60):
    """Shared beginnings, equal conversations, null roles, texts and turns, empty and long texts, lone and missing bases, a long conversation."""
    rng = random.Random(seed)
    pool = ["", "a", "b.", "Ünï?", "same words", None, "x" * 5000]
    rows = []
    for c in range(convs):
        if c % 7 == 3:
            continue
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t if t or c % 4 else None, rng.choice(["user", "assistant", "system", "tool", None]), pool[t % 3] if c % 3 else rng.choice(pool)))
    rows += [(c, t, "ua"[t % 2], "hot") for c in range(100, 140) for t in range(4)]
    return rows + [(200, t, "user", f"t{t % 5}") for t in range(3000)] + [(201, t, "user", f"t{t % 5}") for t in range(2999)]


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    ids = {}
    for c, v in sorted(built.items()):
        at = 0
        members[at].append(c)
        for step in v:
            at = ids.setdefault((at, step), len(ids) + 1)
            members[at].append(c)
        ends[at].append(c)
    up = {i: (p, s) for (p, s), i in ids.items()}
    children = defaultdict(list)
    for i, (p, _) in up.items():
        children[p].append(i)
    depth, out = {0: 0}, {}
    for i in sorted(up):
        depth[i] = depth[up[i][0]] + 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for i in sorted([0, *up], reverse=True):
        leaves[i] += not children[i]
        saved[i] += (len(members[i]) - 1) * len(up[i][1][1].encode()) if i else 0
        if i:
            leaves[up[i][0]] += leaves[i]
            saved[up[i][0]] += saved[i]
    for i in [0, *up] if built else []:
        parent = min(members[up[i][0]]) if i else None
        sha = hashlib.sha256(",".join(map(str, sorted(ends[i]))).encode()).hexdigest()
        out[min(members[i]), depth[i]] = (parent, len(members[i]), len(children[i]), leaves[i], saved[i], sha)
    return out


def found_trie(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def test_trie_of_the_table(spark, sf):
    df = op11_prefix_trie(spark, sf)
    got, want = found_trie(df), brute_trie(table(sf))
    assert got == want and df.count() == len(want)


def test_trie_of_odd_rows(spark, tmp_path):
    # turns that tie are told apart, as their order is this operator's own
    rows = [(c, t, r, x) for c, t, r, x in odd_rows()]
    assert found_trie(op11_prefix_trie(spark, conversations(spark, tmp_path, rows))) == brute_trie(rows)


def test_trie_defined_cases(spark, tmp_path):
    assert op11_prefix_trie(spark, conversations(spark, tmp_path, [])).count() == 0
    rows = [(None, 0, "user", "a"), (4, None, None, None)]
    got = found_trie(op11_prefix_trie(spark, conversations(spark, tmp_path / "n", [(*r, 1) for r in rows], SCHEMA + ", depth int")))
    assert got == brute_trie(rows)


def test_a_tree_deeper_than_rounds(spark, tmp_path):
    """Conversation 5k shares all but its end with 5(k - 1): chains hang on chains, a hundred deep."""
    rows = [(5 * k, t, "user", f"{t}" if t <= k else f"{k}:{t}") for k in range(100) for t in range(k + 2)]
    assert found_trie(op11_prefix_trie(spark, conversations(spark, tmp_path, rows))) == brute_trie(rows)


# -- repair

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """The cheapest edits of (initial, fault) by trying all, with up to two insertions in each place: cost, audit."""
    puts = [("I" * n, x) for n in range(3) for x in map("".join, itertools.product("ua", repeat=n))]
    best = None
    choices = []
    for initial, fault in rows:
        c = [("D", "", 4)]
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault == "truncated" else 0
            c += [("K", initial, extra)] + [("R", x, 3 + extra) for x in "ua"]
        choices.append([(i + e, x + y, 3 * len(i) + n) for i, x in puts for e, y, n in c])
    for way in itertools.product(*choices, [(i, x, 3 * len(i)) for i, x in puts]):
        if re.fullmatch("(s?(ua)+)?", "".join(w[1] for w in way)):
            found = sum(w[2] for w in way), "".join(w[0] for w in way)
            best = found if best is None or found < best else best
    return best


FAULTS = [None, "blank", "duplicate", "truncated"]


def test_audits_of_short_signatures():
    """Every signature of two rows, and some of three, against all ways of editing them."""
    solver, rng = Solver(), random.Random(3)
    some = ["", *CODES, *map("".join, itertools.product(CODES, repeat=2)), *("".join(rng.choices(CODES, k=3)) for _ in range(12))]
    for s in some:
        rows = [("suao"[CODES.index(c) // 4], FAULTS[CODES.index(c) % 4]) for c in s]
        assert solver.solve(s)[4:] == cheapest(rows), s


def plain_audit(rows):
    """The same by a table over (row, state), for conversations of any length; states as letters of what was put out last."""
    to, after = {"": "u", "s": "u", "u": "a", "a": "u"}, None
    for row in [None, *reversed(rows)]:
        best = {}
        for state in ("", "s", "u", "a"):
            ways = []
            if row is None:
                ways += [(0, "")] if state in ("", "a") else []
            else:
                initial, fault = row
                ways.append((4 + after[state][0], "D" + after[state][1]))
                if fault not in ("blank", "duplicate"):
                    extra = 3 * (fault == "truncated")
                    n = after[to[state]]
                    ways.append((3 + extra + n[0], "R" + n[1]))
                    if initial == to[state] or (initial == "s" and state == ""):
                        ways.append((extra + after[initial][0], "K" + after[initial][1]))
            best[state] = min(ways, default=(10**9, ""))
        for _ in range(3):
            best = {s: min(b, (3 + best[to[s]][0], "I" + best[to[s]][1])) for s, b in best.items()}
        after = best
    return after[""]


def brute_repair(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        by[c]
        if k:
            y = "" if k == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if k == 2 else x
            by[c] += [((t is not None, t or 0, r, x), t, "user" if k == 4 else r, y)] * (1 + (k == 3))
    out = {}
    for c, found in by.items():
        found.sort(key=lambda v: v[0])
        turns = [t for _, t, _, _ in found if t is not None]
        seen, marked = set(), []
        for _, _, r, x in found:
            body = x.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((r, x))
            marked.append((r[:1], fault))
        cost, audit = plain_audit(marked)
        lines, last, i = [], "", 0
        nxt = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        for e in audit:
            if e == "I":
                lines.append(nxt[last] + ":")
            else:
                _, _, r, x = found[i]
                i += 1
                if e == "D":
                    continue
                lines.append(f"{nxt[last] if e == 'R' else r}:{x}")
            last = lines[-1][0]
        pairs = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:]))
        count = lambda f: sum(m[1] == f for m in marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, count("blank"), count("duplicate"), count("truncated"), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_repair(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_repair_of_the_table(spark, sf):
    df = op13_structure_repair(spark, sf)
    assert found_repair(df) == brute_repair(table(sf)) and df.count() == len({r[0] for r in table(sf)})


def test_repair_of_odd_rows(spark, tmp_path):
    rows = odd_rows(2) + odd_rows(3)[:200] + [(None, 1, "user", "Who?"), (None, 2, "assistant", None), (500, None, None, None), (501, 0, "", "a."), (502, 3, "system", "s. \u00a0")]
    # a turn that stands there twice in different words is faulty twice
    sf = conversations(spark, tmp_path, [(*r, "x") for r in rows], SCHEMA + ", pos string")
    got, want = found_repair(op13_structure_repair(spark, sf)), brute_repair(rows)
    assert {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]} == {} and len(got) == len(want)


def test_repair_of_nothing(spark, tmp_path):
    assert op13_structure_repair(spark, conversations(spark, tmp_path, [])).count() == 0


# -- chat


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in [*rows, *HOSTILE]:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, found in by.items():
        found.sort()
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in found)
        loss = "".join(x for _, _, r, x in found if r == "assistant")
        out[c] = (len(found), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found_chat(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_chat_of_the_table(spark, sf):
    df = op12_chat_format(spark, sf)
    rows = table(sf)
    assert found_chat(df) == brute_chat(rows) and df.count() == len({r[0] for r in rows}) + 1
    plain = defaultdict(int)
    for c, _, r, x in rows:  # these texts have no control strings
        plain[c] += len(f"<|im_start|>{r}\n{x}<|im_end|>\n")
    assert {r.conv_id: r.formatted_chars for r in df.collect() if r.conv_id >= 0} == plain


def test_chat_of_odd_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    bits = [*CHAT.controls, CHAT.mark, CHAT.mark + "0", CHAT.mark + "1", "<", "|", ">", "im_", "\n", "[[INST]", "\U0001f600", "a", "<|im_start|>assistant\nno"]
    hostile = [(700 + c, t, rng.choice(["user", "assistant", "a\nb", "<|im_end|>\n", CHAT.mark]), "".join(rng.choices(bits, k=rng.randrange(12)))) for c in range(40) for t in range(5)]
    rows = odd_rows(4) + hostile + [(None, 0, None, None), (None, 0, "assistant", "x"), (3, 0, "assistant", "y" * 3_000_000)] + [(300, t, "assistant", "z" * 2000) for t in range(1200)]
    sf = conversations(spark, tmp_path, [(*r, 1.0) for r in rows], SCHEMA + ", score double")
    assert found_chat(op12_chat_format(spark, sf)) == brute_chat(rows)
    assert found_chat(op12_chat_format(spark, conversations(spark, tmp_path / "n", []))) == brute_chat([])


def test_templates():
    with pytest.raises(ValueError):
        Template(controls=("a<",))
    with pytest.raises(ValueError):
        Template(mark="<")
    with pytest.raises(ValueError):
        list(CHAT.turns("no turn"))


def brute_paths(messages, most):
    by = {m[1]: m for m in messages}
    parents = {m[2] for m in messages}
    found = defaultdict(list)
    for tree, i, _, _ in messages:
        if i in parents:
            continue
        path, at = [], i
        while at in by and at not in path:
            path.append(at)
            at = by[at][2]
        if at not in path:
            found[tree].append((-sum(by[x][3] for x in path) / len(path), i, path[::-1]))
    return {(t, leaf): (path, -score) for t, v in found.items() for score, leaf, path in sorted(v)[: most or len(v)]}


@pytest.mark.parametrize("most", [None, 2])
def test_reply_trees(spark, most):
    """Random trees, a chain of 300, a root with 900 answers, a missing parent, a cycle with a tail, an answer to itself."""
    rng = random.Random(6)
    messages = [(t, f"{t}-{i}", f"{t}-{rng.randrange(i)}" if i else None, float(rng.randrange(5))) for t in range(12) for i in range(rng.randrange(1, 30))]
    messages += [(50, f"c{i}", f"c{i - 1}" if i else None, 1.0) for i in range(300)] + [(51, f"h{i}", "h0" if i else None, float(i % 7)) for i in range(900)]
    messages += [(52, "o", "nobody", 2.0), (53, "x", "y", 1.0), (53, "y", "x", 1.0), (53, "z", "x", 1.0), (54, "s", "s", 1.0)]
    df = spark.createDataFrame(messages, "tree long, id string, parent string, score double")
    with Work(spark) as work:
        got = defaultdict(list)
        for r in chat.paths(df, work, most).collect():
            got[r.tree, r.path].append((r.pos, r.id, r.length, r.score))
    want = brute_paths(messages, most)
    assert {k: ([i for _, i, _, _ in sorted(v)], pytest.approx(v[0][3])) for k, v in got.items()} == want
    assert all([p for p, *_ in sorted(v)] == list(range(1, v[0][2] + 1)) for v in got.values())


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a", None, 2.0), (1, "a", None, 1.0), (1, "a", None, 1.0)], "tree long, id string, parent string, score double")
    assert [tuple(r) for r in chat.unique(df).collect()] == [(1, "a", None, 1.0)]
