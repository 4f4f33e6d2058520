import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm import conversation_repair as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not shown.strip(" \t\n\v\f\r") else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(initials, of):
    """(cost, audit) by plain dynamic programming over whole strings."""
    best = {(0, ""): (0, "")}  # (turns read, roles so far reduced to their state) -> way
    following = {"": "su", "s": "u", "u": "a", "a": "u"}

    def offer(to, state, way):
        key = (to, state)
        if key not in best or way < best[key]:
            best[key] = way
            return True
        return False

    for n in range(len(initials) + 1):
        changed = True
        while changed:
            changed = False
            for state in ("", "s", "u", "a"):
                if (n, state) in best:
                    cost, audit = best[n, state]
                    for r in following[state].replace("s", ""):
                        changed |= offer(n, r, (cost + 5, audit + "I"))
        if n == len(initials):
            break
        for state in ("", "s", "u", "a"):
            if (n, state) not in best:
                continue
            cost, audit = best[n, state]
            offer(n + 1, state, (cost + 2, audit + "D"))
            if of[n] in ("blank", "duplicate"):
                continue
            extra = 5 * (of[n] == "truncated")
            for r in following[state]:
                if initials[n] == r:
                    offer(n + 1, r, (cost + extra, audit + "K"))
                if r != "s":
                    offer(n + 1, r, (cost + extra + 1, audit + "R"))
    return min(best[len(initials), s] for s in ("", "a") if (len(initials), s) in best)


def follow(audit, turns):
    out, state, at = [], "", 0
    for edit in audit:
        nxt = "a" if state == "u" else "u"
        if edit == "I":
            out.append(({"u": "user", "a": "assistant"}[nxt], ""))
            state = nxt
            continue
        _, role, text = turns[at]
        at += 1
        if edit == "D":
            continue
        state = "s" if edit == "K" and role[:1] == "s" else nxt
        out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[nxt], text))
    return out


def plain(rows):
    convs = {}
    for conv, *_ in rows:
        convs.setdefault(conv, [])
    for conv, turn, role, text in damage(rows):
        convs[conv].append((turn, role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        of, initials = faults(turns), [t[1][:1] for t in turns]
        cost, audit = cheapest(initials, of)
        known = [t[0] for t in turns if t[0] is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        said = "\n".join(f"{r}:{t}" for r, t in follow(audit, turns))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *(of.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def made(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "student"])
            text = rnd.choice(["Yes.", "No! \n", "so it is", "", " \t", None, f"Turn {turn}?", "漢字。", "x" * 300 + "."])
            rows.append((conv, rnd.choice([None, turn, turn, turn, turn // 2, turn + 5]), role, text))
    return rows


@pytest.mark.parametrize("seed,longest,piece", [(1, 6, 10_000), (2, 40, 7), (3, 90, 10_000)])
def test_repairs_equal_the_plain_programme(spark, monkeypatch, seed, longest, piece):
    monkeypatch.setattr(c, "PIECE_TURNS", piece)
    rows = made(seed, 30, longest)
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA).repartition(5)
    got = {r["conv"]: tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in c.repairs(c.damaged(df)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert got == want, next((k, got[k], want[k]) for k in want if got[k] != want[k])


def test_repaired_turns_alternate(spark):
    rows = made(7, 12, 12)
    turns = c.repaired_turns(c.damaged(spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA))).collect()
    by = {}
    for t in sorted(turns, key=lambda t: (t["conv"] is not None, t["conv"] or 0, t["place"])):
        by.setdefault(t["conv"], []).append((t["place"], t["role"], t["text"]))
    want = plain(rows)
    for conv, of in by.items():
        assert [p for p, _, _ in of] == list(range(len(of)))
        assert re.fullmatch("s?(ua)+", "".join(r[:1] for _, r, _ in of))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in of).encode()).hexdigest() == want[conv][-1]
    assert all(want[conv][-1] == hashlib.sha256(b"").hexdigest() for conv in want.keys() - by.keys())


def test_lost_conversations_and_empty_tables(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.", "")], SCHEMA)
    row = c.repairs(c.damaged(df)).collect()[0]
    assert row["conv"] == lost and row["audit"] == "" and row["cost"] == 0 and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert c.repairs(c.damaged(df.limit(0))).count() == 0
    named = spark.createDataFrame([("a2", "x", "user", "Hi.")], "conv_id string, turn string, role string, text string")
    assert c.repairs(c.damaged(named)).first()["conv"] == "a2"


def test_audits_compare_like_texts_even_if_hashes_collide(monkeypatch):
    def node(text):
        n = c.Node()
        for e in text:
            n = c.Node(e, n)
        return n

    texts = ["".join(t) for k in (1, 3, 5) for t in itertools.islice(itertools.product("DIK", repeat=k), 40)]
    for base in (c._BASE, 0, 1):
        monkeypatch.setattr(c, "_BASE", base)
        nodes = [(t, node(t)) for t in texts]
        assert all(c.before(x, y) == (a < b) for a, x in nodes for b, y in nodes)


def test_query_equals_its_sql(spark):
    from conftest import SF
    from oracle import compare, duck

    from panelspark.llm import queries

    for name in ("op11_vector_codes", "op12_conversation_repair", "op13_resharding"):
        assert compare(spark, duck(SF), SF, queries.QUERIES[name], queries.SQL[name]) is None
