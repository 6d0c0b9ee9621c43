import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from lapsewise.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, seg int, n1 string"


def plain_trie(table, rebuilt):
    """Every prefix of every conversation in a dictionary."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        convs[c] = tuple((own.get(c - int(math.fmod(c, 100)), [])[:h] if rebuilt else []) + turns[h:])
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if convs[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(found):
    return sorted(map(tuple, found.collect()), key=str)


def talk(seed, convs, kinds=3, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rnd.randrange(1, longest)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "ccc é", "日本"][:kinds]), 1, "x"))
    rnd.shuffle(rows)
    return rows


def odd_rows():
    rows = talk(1, range(330))
    rows += [(500 + i, t, "user", f"same {t}", 1, "x") for i in range(60) for t in range(4)]  # copies
    rows += [(None, 1, "user", "lost", 1, "x"), (700, None, None, None, 1, "x"), (700, 3, "user", None, 1, "x"), (700, None, "a", "", 1, "x")]
    rows += [(801, 0, "user", "only", 1, "x"), (-7, 0, "user", "below zero", 1, "x")]
    return rows


@pytest.mark.parametrize("rebuilt", [False, True])
@pytest.mark.parametrize("width, shard", [(64, 50_000), (2, 7), (3, 20)])
def test_nodes_are_those_of_a_plain_trie(spark, rebuilt, width, shard):
    """Also with narrow segments and small shards, so that nodes reach over many borders."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    found = (prefixes.rebuilt_trie if rebuilt else prefixes.conversation_trie)(df, width=width, shard_rows=shard)
    assert rows_of(found) == sorted(plain_trie(rows, rebuilt), key=str)


def test_long_conversations(spark):
    """One conversation holds most rows; others share hundreds of its turns."""
    rows = [(3, t, "user", f"t{t}", 1, "x") for t in range(1500)]
    rows += [(c, t, "user", f"t{t}" if t < 60 * (c - 9) else f"own {c}", 1, "x") for c in range(10, 16) for t in range(200)]
    rows += [(20, t, "user", f"t{t}", 1, "x") for t in range(128)] + [(21, t, "user", f"t{t}", 1, "x") for t in range(128)]
    found = prefixes.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(found) == sorted(plain_trie(rows, False), key=str)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "u", "a", 1, "x")] * 3 + [(2, 0, "u", "a", 1, "x")]
    assert rows_of(prefixes.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == sorted(plain_trie(rows, False), key=str)
    found = prefixes.rebuilt_trie(spark.createDataFrame([], SCHEMA))
    assert found.collect() == []
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
