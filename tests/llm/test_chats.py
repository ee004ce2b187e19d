import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from linkloom.llm import chat_repair

CHATS = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute(rows):
    """(cost, audit, repaired lines): all edits of small conversations; rows are (role, text, fault)."""

    @lru_cache(maxsize=None)
    def least(k, state, inserts):
        found = [(0, "", ())] if k == len(rows) and state in (0, 3) else []
        for role in ("user", "assistant"):
            if inserts < 3 and (state, role[0]) in NEXT:
                c, a, t = least(k, NEXT[state, role[0]], inserts + 1)
                found.append((c + 2, "I" + a, (f"{role}:", *t)))
        if k < len(rows):
            role, text, fault = rows[k]
            c, a, t = least(k + 1, state, 0)
            found.append((c + 3, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                for new, cost, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if (state, new[:1]) in NEXT:
                        c, a, t = least(k + 1, NEXT[state, new[:1]], 0)
                        found.append((c + cost + late, letter + a, (f"{new}:{text}", *t)))
        return min(found) if found else (10**9, "", ())

    return least(0, 0, 0)


def damage(table):
    out = []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def expected(table):
    found, rows = {}, damage(table)
    for conv in {r[0] for r in table}:
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16]))
        turns = [t for t, _, _ in own if t is not None]
        judged, seen = [], set()
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, lines = brute(tuple(judged))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
        faults = [sum(f == name for _, _, f in judged) for name in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def some_chats(n, seed, long=0):
    r = random.Random(seed)
    out = []
    for c in range(n):
        turn = r.randrange(3)
        for _ in range(r.randrange(9) + (long if c == 0 else 0)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = r.choice(["Yes.", "No", "What then?", "Go on! ", "", " \t", None, "a.\x0b\x0c", f"only {r.randrange(99)}.", "été ", "\U0001f600!"])
            out.append((c, turn if r.random() < 0.9 else None, role, text))
            turn += r.choice([0, 1, 1, 1, 1, 2, 5])
    return out


def test_repair_equals_all_edits(spark):
    table = some_chats(160, 1) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (-7, -3, "system", "Be."), (-7, 5, "assistant", "I am")]
    table += [(1000, t, "assistant" if t % 2 else "user", f"Fine {t}.") for t in range(8)]
    df = spark.createDataFrame(table, CHATS).selectExpr("*", "1 AS block", "'x' AS audit", "2 AS k")
    want = expected(table)
    assert got(chat_repair.digests(df.repartition(5))) == want
    assert any(w[-2].count("R") for w in want.values()) and any("I" in w[-2] for w in want.values())


def test_the_repaired_rows_are_those_that_are_hashed(spark):
    df = spark.createDataFrame(some_chats(60, 2), CHATS)
    rows = {}
    for r in chat_repair.repair(df).orderBy("conv_id", "position").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, w in got(chat_repair.digests(df)).items():
        lines = [f"{a}:{b}" for a, b in rows.get(conv, [])]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == w[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in rows.get(conv, [])))


def test_dp_against_all_edits():
    r = random.Random(3)
    for _ in range(3000):
        rows = [(r.choice(["system", "user", "assistant", "x"]), "t", r.choice(["", "", "truncated", "blank"])) for _ in range(r.randrange(8))]
        codes = "".join(chr(48 + 3 * "suax".index(role[0]) + {"": 0, "truncated": 1, "blank": 2}[f]) for role, _, f in rows)
        assert chat_repair.cheapest(codes) == brute(tuple(rows))[:2], rows


def test_long_conversations_and_texts(spark, monkeypatch):
    """Several blocks and chunks of one conversation; a text of some MB; copies far apart and next to each other."""
    monkeypatch.setattr(chat_repair, "CHUNK", 7)
    table = [(5, 40 * t, "user" if t % 2 else "assistant", f"{t % 50}.") for t in range(150)] + [(5, 80, "user", "twice.")] * 3
    table += [(6, 0, "user", "word " * 600_000 + "."), (6, 1, "assistant", " " * 2_000_000)]
    assert got(chat_repair.digests(spark.createDataFrame(table, CHATS))) == expected(table)


def test_no_conversations(spark):
    df = spark.createDataFrame([], CHATS)
    assert chat_repair.digests(df).count() == 0 and chat_repair.repair(df).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(chat_repair.digests(spark.createDataFrame([(gone, 0, "user", "x")], CHATS))) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


def test_a_long_conversation_is_split_before_it_is_solved(spark):
    """Rows of one conversation are put in order by many tasks."""
    rows = chat_repair.marked(spark.range(50_000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('m', id, '.') AS text"))
    parts = rows.repartition(8, "conv_id", F.shiftright("turn", chat_repair.BLOCK_BITS)).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 4
