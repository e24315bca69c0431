"""The trie against one built from whole sequences, and the radix tree against a dictionary."""

import hashlib
import random
import zlib
from collections import defaultdict

from tidemark.llm.prefix_trie import prefix_trie
from tidemark.llm.radix_tree import TURN, TurnNodes, build, post_order


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, told, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members, ends, size = defaultdict(list), defaultdict(list), {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = own.get(lead, [])[:h] + mine[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below = [size[k] for k in kids[node]]
        size[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + own_saved)
    out = []
    for node, who in members.items():
        told = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), *size[node], told))
    return sorted(out, key=repr)


def result(df):
    assert [t for c, t in df.dtypes if c != "ends_sha256"] == ["bigint"] * 7
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    clash = ["'k' AS id", "'p' AS point", "1 AS depth", "2 AS at", "3 AS block", "4 AS place", "'x' AS path"]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *clash).repartition(5)


def rows_of(r):
    rows = []
    start = [("user", f"common {i}") for i in range(12)]
    for c in range(-3, 420):
        kind = r.randrange(6)
        if kind < 3:
            seq = start[: r.randrange(12)] + [(r.choice("ab"), f"w{r.randrange(3)}") for _ in range(r.randrange(5))]
        elif kind == 3:
            seq = [("user", "same"), ("assistant", "same")] * 4
        else:
            seq = [(r.choice(["user", None, ""]), r.choice([None, "", "é", "hi"])) for _ in range(r.randrange(9))]
        numbers = [r.choice([i, i, i, None, 3]) for i in range(len(seq))]
        rows += [(c, n, *t) for n, t in zip(numbers, seq, strict=True)]
    long = [("user", f"t{i}") for i in range(700)]
    rows += [(c, i, *t) for c in (700, 701, 702) for i, t in enumerate(long + [("user", f"own {c}")] * (c % 3) + long[: c % 2])]
    rows += [(1001, i, "user", f"unlike {i}") for i in range(2000)]
    rows += rows[:20] + [(None, 0, "user", "none"), (None, None, None, None), (10**15, 0, "x", "y"), (-250, 1, "x", "y" * 100_000)]
    return rows


def test_conversations(spark):
    rows = rows_of(random.Random(5))
    got, want = result(prefix_trie(frame(spark, rows))), brute(rows)
    assert got == want
    assert sum(r[3] > 1 for r in want) > 50


def test_one_task_or_many(spark):
    """The same rows from a single tree and from a tree for nearly every sequence."""
    rows = rows_of(random.Random(6))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "97"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert result(prefix_trie(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_few(spark):
    assert prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
    for rows in ([(7, None, None, None)], [(100, i, "a", "b") for i in range(3)], [(5, 0, "u", "x"), (5, 0, "u", "x"), (6, 0, "u", "x")]):
        assert result(prefix_trie(frame(spark, rows))) == brute(rows)


def test_radix_tree():
    r = random.Random(1)
    keys = {bytes(r.choices(range(2 if i % 2 else 256), k=TURN * r.randrange(0, 4))) for i in range(3000)}
    keys |= {bytes([i]) + bytes(TURN - 1) for i in range(256)}
    keys |= {bytes(TURN) + bytes([i]) + bytes(TURN - 1) for i in range(30)}
    keys = list(keys)
    root = build(keys)
    assert {n.room for n, _ in post_order(root)} == {4, 16, 48, 256}
    for place, key in enumerate(keys):
        node, at = root, 0
        while at < len(key):
            node = node.child(key[at])
            assert key[at : at + len(node.path)] == node.path
            at += len(node.path)
        assert node.end == place
    for node, _ in post_order(root):
        below = node.below()
        assert [n for n in below if node.child(n.path[0]) is not n] == []
        assert node is root or node.end >= 0 or len(below) > 1
    t = TurnNodes(keys, [1] * len(keys), list(range(len(keys))), [[1] * (len(k) // TURN) for k in keys], [False] * len(keys))
    begins = defaultdict(list)
    for place, key in enumerate(keys):
        for at in range(0, len(key) + 1, TURN):
            begins[key[:at]].append(place)
    assert sorted(zip(t.n, t.conv, t.depth, strict=True)) == sorted((len(p), min(p), len(k) // TURN) for k, p in begins.items())
