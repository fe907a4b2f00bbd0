import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from boardwise.llm import conversations as C
from boardwise.llm import queries

from .cases import clashing

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        code, role, text = zlib.crc32(":".join(shown).encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_report(turns):
    """gaps, faults, illegal, cost, audit and hash of one conversation's turns, in order: all cheapest ways, kept by state."""
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(SPACES)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = lambda done, r: done + r in ("s", "u") or (done + r)[-2:] in ("su", "ua", "au")
    ways = {"": (0, "", [])}  # by all that matters of the roles so far: nothing, s, or the last of u and a

    def better(into, key, way):
        if key not in into or way[:2] < into[key][:2]:
            into[key] = way

    def inserts(ways):
        for _ in range(3):
            new = dict(ways)
            for done, (cost, audit, out) in ways.items():
                for role in ("user", "assistant"):
                    if follows(done, role[0]):
                        better(new, role[0], (cost + 3, audit + "I", [*out, (role, "")]))
            ways = new
        return ways

    for (_, role, text), fault in zip(turns, faults):
        ways, new = inserts(ways), {}
        for done, (cost, audit, out) in ways.items():
            better(new, done, (cost + 4, audit + "D", out))
            if fault in ("", "t"):
                more = 3 if fault else 0
                if role and follows(done, role[0]):
                    better(new, role[0], (cost + more, audit + "K", [*out, (role, text)]))
                for other in ("user", "assistant"):
                    if follows(done, other[0]):
                        better(new, other[0], (cost + 3 + more, audit + "R", [*out, (other, text)]))
        ways = new
    ways = inserts(ways)
    cost, audit, out = min((ways[k] for k in ("", "a") if k in ways), key=lambda w: w[:2])
    known = [t for t, *_ in turns if t is not None]
    roles = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, sha), out


def plain(rows, damage=False):
    turns, convs = plain_damage(rows) if damage else rows, {r[0] for r in rows}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest())
    return {c: plain_report([r[1:] for r in sorted((t for t in turns if t[0] == c), key=order)]) for c in convs}


def reports(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


def random_turns(r, conv, n, roles=("user", "assistant", "user", "assistant", "system", "User", "", "?")):
    texts = ["Yes.", "No", "", " \n", "Why?", "So it is!", "and then", "x.\t", "é."]
    return [(conv, r.choice([None, *range(n)]) if r.random() < 0.1 else i, r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{i} {r.choice('.!?,')}") for i in range(n)]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows, damage=True)
    assert reports(queries.op12_conversation_repair(spark, SF)) == {c: w[0] for c, w in want.items()}


def test_random_conversations_equal_brute_force(spark):
    r = random.Random(5)
    rows = [t for c in range(300) for t in random_turns(r, c, r.choice([1, 2, 3, 5, 8, 12]))]
    turns, want = C.given_turns(spark.createDataFrame(rows, SCHEMA)), plain(rows)
    plan = C.repair_plan(turns)
    assert reports(C.repair_report(turns, plan)) == {c: w[0] for c, w in want.items()}
    got = {}
    for x in sorted(C.repaired_turns(turns, plan).collect(), key=lambda x: (x.conv_id, x.place)):
        got.setdefault(x.conv_id, []).append((x.role, x.text))
    assert got == {c: w[1] for c, w in want.items() if w[1]}


@pytest.mark.parametrize("fan", [2, 8])
def test_a_long_conversation_goes_over_many_partitions(spark, monkeypatch, fan):
    monkeypatch.setattr(C, "FAN", fan)
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(6)
        rows = random_turns(r, 7, 3000) + random_turns(r, 8, 3) + random_turns(r, 9, 40) + [(7, 5, "user", "again and again.")] * 50
        turns = C.given_turns(spark.createDataFrame(rows, SCHEMA))
        assert C.runs(turns).where("conv_id = 7").count() > 8
        assert reports(C.repair_report(turns)) == {c: w[0] for c, w in plain(rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_products_are_associative():
    r, roles = random.Random(2), ["s", "u", "a", "x", ""]
    pick = lambda: list(C.turn_matrix(r.choice(roles), r.randrange(4)))
    for _ in range(300):
        a, b, c, d = pick(), pick(), pick(), pick()
        left = C.times(C.times(C.times(a, b), c), d)
        assert left == C.times(C.times(a, b), C.times(c, d)) == C.times(a, C.times(C.times(b, c), d))


def test_nulls_ties_copies_and_tables(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 3, None, "x."), (2, 0, "system", None),
        (3, 4, "user", "one."), (3, 4, "assistant", "two."), (3, 4, "assistant", "two."), (3, 9, "assistant", "long " * 50000 + "."),
    ]
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {c: w[0] for c, w in plain(filled).items()}
    assert reports(C.repair_report(C.given_turns(clashing(df)))) == want
    assert reports(C.repair_report(C.damaged(clashing(df)))) == {c: w[0] for c, w in plain(rows, damage=True).items()}
    gone = C.repair_report(C.given_turns(df.where("conv_id = 2")).withColumn("copies", F.lit(0)))
    assert reports(gone) == {2: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair_report(C.damaged(df.limit(0))).count() == 0
