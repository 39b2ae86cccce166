"""The prefix trie against one built of dictionaries."""

import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from matchloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent string, depth string, seq string"


def turns_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}


def brute(rows):
    convs, nodes = turns_of(rows), {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 4
        whole = tuple(convs.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members, ends = nodes.setdefault(whole[:d], ([], []))
            members.append(c)
            if d == len(whole):
                ends.append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[x] for x in children.get(p, [])]
        sums[p] = (sum(b[0] for b in below) or 1, (len(nodes[p][0]) - 1) * words + sum(b[1] for b in below))
    return sorted(
        ((min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), len(children.get(p, [])), *sums[p], sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for p, (m, e) in nodes.items()), key=str
    )


def result(spark, rows, levels):
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    return sorted(map(tuple, trie.prefix_trie(trie.rebuilt(trie.numbered_turns(table)), levels).collect()), key=str)


def conversations(n, longest, seed):
    rng, rows = random.Random(seed), []
    for c in range(n):
        say = rng.randrange(4)
        for t in range(rng.randrange(longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t % 3 == 2 else "user", "same words here" if say else f"w {rng.randrange(3)} x\x0by"))
    return rows


HARD = [
    (None, 0, "user", "no conversation"),
    (100, None, "user", "first"),
    (100, None, "user", "first"),
    (100, 0, None, None),
    (100, 0, None, "tie"),
    (100, 0, "a", "bc"),
    (100, 0, "ab", "c"),
    (101, 7, "user", "long " * 50_000),
    (-3, 1, "user", "negative"),
    (0, 1, "user", "zero"),
    (9_000_000_000, 1, "user", ""),
]


@pytest.mark.parametrize("levels", [2, 3, 32])
def test_trie_equals_one_of_dictionaries(spark, levels):
    rows = conversations(150, 14, 1) + HARD
    assert result(spark, rows, levels) == brute(rows)


def test_many_ends_at_one_node_come_in_runs(spark):
    ends = spark.createDataFrame([(b"a", c) for c in range(700)] + [(b"b", c) for c in range(-5, 40, 3)], "node binary, conv_id long")
    got = {bytes(r["node"]): r["ends_sha256"] for r in trie.end_digests(ends.repartition(7), 16).collect()}
    assert got == {n: sha256(",".join(map(str, ids)).encode()).hexdigest() for n, ids in ((b"a", range(700)), (b"b", range(-5, 40, 3)))}


def test_empty_table(spark):
    assert result(spark, [], 32) == []
