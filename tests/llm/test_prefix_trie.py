"""The prefix trie against nested dictionaries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place string, a long, below string"


def made_rows():
    rng = random.Random(7)
    texts = ["", "hello", "how are you", "été", "a,b", None]
    rows = []
    for c in [*range(40), 77, 103, 104]:
        for t in range(rng.randint(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts[: 1 + c % 6])))
    rows += [(200 + i, t, "user", "same") for i in range(30) for t in range(3)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(150)] + [(301, t, "user", f"long {t}") for t in range(120)]
    rows += [(302, None, "user", "first"), (302, 5, None, None), (302, 5, None, None), (302, -1, "x", "y")]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def conversations_of(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0), role, sha, text))
    return {c: [(role, text) for _, role, _, text in sorted(x)] for c, x in turns.items()}


def regrouped(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    rows = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(k)))
        parent = min(members[k[:-1]]) if k else None
        rows.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(rows)


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [(*r, "x", 1, "y") for r in made_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


# all light, all but the leaves heavy, tops at many depths
@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 1, 25])
def test_trie_equals_nested_dictionaries(conversations, limit):
    convs = conversations_of(made_rows())
    assert any(not t for t in regrouped(convs).values())
    got = prefix_trie.regrouped_trie(conversations, limit)
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(regrouped(convs))
    got = prefix_trie.prefix_trie(conversations, limit)
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(convs)


def test_empty_table(conversations):
    assert prefix_trie.regrouped_trie(conversations.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(conversations.where("conv_id IS NULL")).count() == 0


def test_running_values_over_task_borders(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, 9]), i, rng.randint(-5, 5), rng.getrandbits(62)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, at long, s long, x long").repartition(3)
    got = {(r.g, r.at): (r.s, r.x) for r in prefix_trie.running(df, "g", ["at"], ["s"], ["x"]).collect()}
    sums, xors = Counter(), Counter()
    for g, at, s, x in sorted(rows):
        sums[g], xors[g] = sums[g] + s, xors[g] ^ x
        assert got[g, at] == (sums[g], xors[g])
    assert len(got) == len(rows)


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(-(2**63), 2**63, (2, n))
        table = prefix_trie.SlotTable(a, b)
        assert sorted(table.slots(a, b).tolist()) == list(range(n))
        foreign = rng.integers(-(2**63), 2**63, (2, 1000))
        assert (table.slots(*foreign) == -1).all() and (table.slots(a, b + 1) == -1).all()
    with pytest.raises(ValueError, match="twice"):
        prefix_trie.SlotTable(np.array([1, 1]), np.array([2, 2]))


def test_colliding_digests_are_an_error(spark):
    rows = [(1, 0, "s1", 1), (2, 0, "s2", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, place long, turn_sha string, bytes long")
    real = prefix_trie.prefixes

    def collided(turns, known):
        made = real(turns, known)
        return made.selectExpr(*[f"IF(depth > 0, 5, {c}) AS {c}" if c in ("a", "b") else c for c in made.columns])

    with pytest.MonkeyPatch.context() as patch, pytest.raises(Exception, match="share a digest"):
        patch.setattr(prefix_trie, "prefixes", collided)
        prefix_trie.build(turns, prefix_trie.sizes(turns)).collect()
