"""The prefix trie against a plain version, with shards, queues and chunks small enough to be crossed."""

import hashlib
import random
import zlib

import pytest

from logsieve.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, k1 string, digest string, of string"
EXTRA = ("x",) * 4


def plain(chats):
    """Rows of the result from conversation: [(role, text), ...]."""
    members = {}
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def totals(path):
        leaves, saved = 0, (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        for child in children.get(path, ()):
            a, b = totals(child)
            leaves, saved = leaves + a, saved + b
        return leaves or 1, saved

    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(chats[c]) == len(path))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children.get(path, ())), *totals(path),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table_of(spark, chats):
    rows = [(c, k, *turn, *EXTRA) for c, turns in chats.items() for k, turn in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(c,) for c in chats], "conv_id bigint")


def random_chats(n, seed):
    rng = random.Random(seed)
    chats = {}
    for c in range(n):
        turns = list(rng.choice(list(chats.values()))) if chats and rng.random() < 0.8 else []
        turns = turns[:rng.randint(0, len(turns))] if rng.random() < 0.4 else turns
        chats[rng.randint(-10 ** 12, 10 ** 12)] = turns + [(rng.choice("ua"), rng.choice(["", "é", "long " * 9, "x"])) for _ in range(rng.randint(0, 3))]
    return chats


@pytest.mark.parametrize("light, queue, chunk", [(64, 1 << 17, 1 << 16), (1, 1, 2), (4, 3, 1), (10 ** 6, 2, 3)])
def test_against_a_plain_version(spark, monkeypatch, light, queue, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    chats = random_chats(150, light)
    got = trie.prefix_trie(*table_of(spark, chats), light=light, queue=queue).collect()
    assert sorted(map(tuple, got), key=repr) == plain(chats)


def test_hot_copies_and_a_long_conversation(spark):
    chats = {c: [("u", "hi"), ("a", "there")] for c in range(400)} | {1000 + c: [("u", "hi"), ("a", str(c))] for c in range(100)}
    chats[5000] = [("u", str(k % 7)) for k in range(800)]
    chats[5001] = chats[5000][:700] + [("a", "z")]
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(*table_of(spark, chats), light=8, queue=16).collect()}
    assert got[0, 2].n_convs == 400 and got[0, 2].ends_sha256 == hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()
    assert (got[0, 1].n_children, got[0, 1].n_leaves, got[0, 0].n_leaves) == (101, 101, 103)
    assert got[5000, 1].n_leaves == 2 and got[5000, 1].saved_tokens == 700 and got[5001, 701].parent_conv_id == 5000


def test_the_bound_on_heavy_nodes_raises_the_shards(spark):
    chats = random_chats(60, 9)
    got = trie.prefix_trie(*table_of(spark, chats), light=1, heavy_nodes=3).collect()
    assert sorted(map(tuple, got), key=repr) == plain(chats)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, None, None, "a"), (1, 0, "u", None), (2, None, "", "a"), (2, 0, "u", ""), (2, 0, "u", ""), (None, 0, "u", "lost"), (3, 5, "u", "b"), (3, 5, "a", "c")]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(df).collect()}
    assert got[1, 2].n_convs == 2 and got[2, 3].n_convs == 1 and got[2, 3].parent_conv_id == 1
    assert got[1, 0].n_convs == 3 and (3, 2) in got and len(got) == 6
    again = {(r.conv_id, r.depth): r for r in trie.prefix_trie(df.orderBy("text")).collect()}
    assert got == again
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    only = trie.prefix_trie(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(7,), (7,), (9,), (None,)], "conv_id bigint")).collect()
    assert [tuple(r) for r in only] == [(7, 0, None, 2, 0, 1, 0, hashlib.sha256(b"7,9").hexdigest())]


def test_queue_is_a_priority_queue():
    rng = random.Random(2)
    queue, held = trie.SpillingQueue(5), []
    for _ in range(3_000):
        if held and rng.random() < 0.45:
            assert queue.head() == min(held)
            held.remove(queue.pop())
        else:
            held.append(tuple(rng.randint(-9, 9) for _ in range(5)))
            queue.push(held[-1])
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.head() is None
    queue.close()


def test_heads_exchanged(spark):
    rng = random.Random(3)
    chats = {c: [(rng.choice("ua"), f"{c}-{k}") for k in range(rng.randint(1, 12))] for c in [*range(0, 40), 52, 53, -1, -7, -5]}
    turns, conversations = trie.heads_exchanged(table_of(spark, chats)[0])
    want = {}
    for c, own in chats.items():
        base, h = c - int(c / 5) * 5, zlib.crc32(str(c).encode()) % 9
        want[c] = (chats.get(c - base, [])[:h] if base else own[:h]) + own[h:]
    got = {r.conv_id: [] for r in conversations.collect()}
    for r in sorted(turns.collect()):
        got[r.conv_id].append((r.role, r.text))
    assert got == want
