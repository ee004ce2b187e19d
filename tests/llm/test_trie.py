import hashlib
import random
import re
import zlib

from linkloom.llm import prefix_trie

CHATS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(table):
    own = {}
    for conv, turn, role, text in table:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for rows in own.values():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()[:16]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
    plain = {c: [r[1:] for r in rows] for c, rows in own.items()}
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = plain.get(base, [])[:h] + turns[h:]
    return out


def brute(table):
    convs = rebuilt(table)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_chats(n, seed, words=3):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randrange(1, 8)):
            out.append((c + r.choice([0, 0, 0, 500]), t if r.random() < 0.95 else None, r.choice(["user", "user", "assistant", None]), r.choice(["a", "a b", " a\tb\x0bc d", "", None, "été x"][:words])))
    return out


def test_trie_equals_brute_force(spark):
    for seed, n, words in ((1, 60, 2), (3, 200, 1)):
        table = some_chats(n, seed, words) + [(None, 0, "user", "nobody")]
        df = spark.createDataFrame(table, CHATS).selectExpr("*", "1 AS depth", "'x' AS p", "3 AS s", "4 AS row").repartition(5)
        assert got(prefix_trie.trie(df)) == brute(table)


def test_copies_long_paths_and_turnless(spark):
    r = random.Random(4)
    same = [(c, t, "user" if t % 2 else "assistant", f"turn {t} of many") for c in range(0, 300) for t in range(5)]
    long = [(1000 + c, t, "user", f"step {t if t < 90 else (t, c // 3)}") for c in range(9) for t in range(100 + c % 3)]
    short = [(c, 0, "user", "only") for c in range(4001, 4060) if c % 20]  # their families' first ones are absent, many keep no turn
    negative = [(-c, t, "user", r.choice("xy")) for c in range(1, 45) for t in range(3)]
    table = same + long + short + negative
    assert any(not turns for turns in rebuilt(table).values())
    assert got(prefix_trie.trie(spark.createDataFrame(table, CHATS))) == brute(table)


def test_one_and_none(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CHATS)).count() == 0
    for table in ([(20, 0, "user", "hi you")], [(20, None, None, None)], [(c, 0, "user", "x") for c in range(1, 20)]):
        assert got(prefix_trie.trie(spark.createDataFrame(table, CHATS))) == brute(table)


def test_long_texts(spark):
    table = [(40, 0, "user", "word " * 500_000), (41, 0, "user", "word " * 500_000 + "end"), (42, 0, "user", "x" * 3_000_000)]
    assert got(prefix_trie.trie(spark.createDataFrame(table, CHATS))) == brute(table)


def test_edges_are_compressed(spark):
    """Points are branches, ends and leaves alone; unshared tails meet no other row."""
    table = [(1000 + c, t, "user", f"step {t if t < 90 else (t, c)}") for c in range(0, 80, 20) for t in range(200)]
    rows = prefix_trie.sequences(prefix_trie.rebuilt(spark.createDataFrame(table, CHATS)))
    rows = prefix_trie.neighbours(rows.join(prefix_trie.classes(rows).select("conv_id", "m"), "conv_id"))
    _, tree = prefix_trie._edges(rows)
    assert sorted(r.depth for r in tree.collect()) == [90, 200, 200, 200, 200]
