"""The conversation trie against plain dictionaries, with containers that burst and that do not."""

import hashlib
import math
import random
import zlib

import pytest

from talkmill.llm.prefix_trie import BurstTrie, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    def digest(r):
        role, text = r[2] or "", r[3] or ""
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    convs = {}
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r)[:32])):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return convs


def plain_rebuilt(rows):
    convs = ordered(rows)
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        weight = len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * weight)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])),
                    *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(trie_nodes):
    return sorted((tuple(r) for r in trie_nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ).collect()), key=str)


def sample():
    rng = random.Random(9)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b", "é", None, "long " * 300]))
    rows = []
    for c in [*range(-7, 90), 10**12]:
        if c % 13:
            rows += [(c, k if k else None, *turn()) for k in range(rng.choice([1, 2, 3, 9, 14]))]
    chain = [turn() for _ in range(40)]  # a long common beginning that branches late
    for c in range(200, 230):
        rows += [(c, k, *x) for k, x in enumerate(chain[: rng.choice([38, 39, 40])] + [turn()] * rng.choice([0, 1]))]
    for c in range(300, 340):
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "same")]
    rows += [(400, 1, "user", "x"), (400, 1, "user", "y"), (400, 1, "assistant", "x"), (400, 1, "user", "x"), (None, 0, "user", "lost")]
    rows += [(401, k, "user", "u") for k in range(500)]  # one long conversation
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("container_turns", [1, 30, 400, 20_000])
def test_rebuilt_trie_is_the_plain_one(spark, container_turns):
    rows = sample()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", seq string, level int").repartition(5)
    trie = BurstTrie(rebuilt(frame), container_turns)
    assert found(trie.nodes()) == plain_nodes(plain_rebuilt(rows))
    assert bool(trie.bursts) == (container_turns < 20_000)


def test_conversations_as_they_are(spark):
    rows = sample()[:300]
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA), 50)) == plain_nodes(ordered(rows))


def test_empty_table_and_turnless_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # 7 begins with conversation 5, which is absent, and has no turn of its own after its first h
    rows = [(7, 0, "user", "a")]
    assert plain_rebuilt(rows) == {7: []}
    assert found(BurstTrie(rebuilt(spark.createDataFrame(rows, SCHEMA))).nodes()) == plain_nodes({7: []})
