"""The conversation trie against plain rules, with many ranges and open paths."""

import hashlib
import math
import random
import zlib

import pytest

from sonolake.llm.prefix_trie import common, prefix_trie

from .common import SPACED

SCHEMA = "conv_id long, turn long, role string, text string, n long, p long"


def rule(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [turn for _, turn in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    rebuilt = {c: own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    members, children, out = {}, {}, []
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)

    def walk(k):
        below = [walk(x) for x in children.get(k, [])]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + ((len(members[k]) - 1) * len(SPACED.findall(k[-1][1])) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(rebuilt[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if rebuilt:
        walk(())
    return sorted(out, key=repr)


def awkward(n, kinds, seed=2):
    rnd, rows = random.Random(seed), []
    for c in range(-25, n):
        for t in range(rnd.choice([0, 1, 2, 3, 4, 8]) if c % 7 != 3 else 0):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice([f"hi  {rnd.randrange(kinds)}", "the same text", "", None]), 1, 2))
    return rows + [(None, 1, "user", "x", 1, 2)] + rows[20:30]


@pytest.mark.parametrize("n, kinds, turns", [(0, 2, 5), (300, 3, 40), (300, 40, 300), (200, 2, 3), (60, 2, 50_000)])
def test_nodes(spark, n, kinds, turns):
    rows = awkward(n, kinds)
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), turns).collect()
    assert sorted(map(tuple, got), key=repr) == rule(rows)


def test_copies_and_long_conversations(spark):
    """One conversation that thousands repeat (three runs of members), and two long ones that part late."""
    long_ = [(c, t, "user", f"t{t} a b", 0, 0) for c, n in ((9_107, 400), (9_108, 390)) for t in range(n)]
    rows = [(c, 0, "user", "hello there", 0, 0) for c in range(9_100)] + long_
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), 500).collect()
    assert sorted(map(tuple, got), key=repr) == rule(rows)


def test_common():
    a, b, c = b"a" * 16, b"b" * 16, b"c" * 16
    assert [common(x, y) for x, y in ((b"", a), (a, a), (a + b, a + c), (a + b, a), (b + b, a + b), (a * 7 + b + a, a * 7 + c + a))] == [0, 1, 1, 1, 0, 7]


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
