"""Repair of conversations against exhaustive search, and the query against a plain version of its contract."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

from defectlake.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def prefix(roles: str) -> bool:
    body = roles[1:] if roles[:1] == "s" else roles
    return body == ("ua" * len(body))[: len(body)]


def whole(roles: str) -> bool:
    body = roles[1:] if roles[:1] == "s" else roles
    return prefix(roles) and len(body) % 2 == 0 and (len(body) > 0 or roles == "")


def slow_repair(turns: list[tuple[str, str, int]]) -> tuple[int, str, str]:
    """Least (cost, audit) by best-first search over all edits, with the digest of its lines."""
    heap, found, limit = [(0, "", 0, "", ())], [], None
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if limit is not None and cost > limit:
            break
        if i == len(turns) and whole(roles):
            found.append((cost, audit, lines))
            limit = cost
        moves = [(2, "I", i, x, f"{NAMES[x]}:") for x in "ua" if len(roles) < 2 * len(turns) + 3]
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if fault not in (1, 2):
                more = int(fault == 3)
                moves += [(more, "K", i + 1, role[0], f"{role}:{text}")] if role else []
                moves += [(2 + more, "R", i + 1, x, f"{NAMES[x]}:{text}") for x in "ua"]
        for price, letter, at, x, line in moves:
            if prefix(roles + x):
                heapq.heappush(heap, (cost + price, audit + letter, at, roles + x, (*lines, line)))
    cost, audit, lines = min(found)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        for _ in range((1, 0)[code == 0] + (code == 3)):
            yield conv, turn, role, text


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        letters = text.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not letters else 2 if (role, text) in seen else 3 if letters[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def slow_query(rows, repair=slow_repair):
    out, left = {}, {}
    for conv, turn, role, text in damage(rows):
        left.setdefault(conv, []).append((turn, role, text))
    for conv in {r[0] for r in rows}:
        turns = sorted(left.get(conv, []), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        faults = faults_of(turns)
        numbers = {t[0] for t in turns} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(i) for i in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), *repair([(r, t, f) for (_, r, t), f in zip(turns, faults)]))
    return out


def odd_rows(count: int = 150, longest: int = 6):
    rng = random.Random(11)
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "âme"])
            text = rng.choice(["Yes.", "Yes.", "no", "What?!", "  ", "", None, "fin.\n", "x", "…", "ok. "]) if rng.random() < 0.6 else f"t{turn} {conv}."
            rows.append((conv if conv % 10 else None if conv == 40 else conv, turn + rng.choice([0, 0, 0, 3]) if rng.random() < 0.95 else None, role, text))
    return rows


def as_dict(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_parser_equals_exhaustive_search():
    rng, parser = random.Random(1), conversations.Parser(conversations.Automaton())
    for _ in range(600):
        turns = [(rng.choice(["system", "user", "assistant", "user", "assistant", "x", " ", ""]), str(i), rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(0, 5))]
        for role, text, fault in turns:
            parser.turn(role.encode(), text.encode(), fault)
        assert parser.close() == slow_repair(turns), turns


def chained(turns):
    """The same by strings over four states, for long conversations."""
    best = {"": (0, "", ())}
    for role, text, fault in turns:
        new = {}

        def put(roles, cost, audit, lines):
            state = roles if len(roles) < 2 else ("ua" if roles[-1] == "a" else "u")
            state = {"su": "u"}.get(state, state)
            if prefix(roles) and (state not in new or (cost, audit) < new[state][:2]):
                new[state] = (cost, audit, lines)

        for roles, (cost, audit, lines) in best.items():
            put(roles, cost + 3, audit + "D", lines)
            if fault in (1, 2):
                continue
            more = int(fault == 3)
            for x in ["", "u", "a"]:
                if x and not prefix(roles + x):
                    continue
                base = (roles + x, cost + 2 * bool(x), audit + "I" * bool(x), lines + ((f"{NAMES[x]}:",) if x else ()))
                if role:
                    put(base[0] + role[0], base[1] + more, base[2] + "K", (*base[3], f"{role}:{text}"))
                for y in "ua":
                    put(base[0] + y, base[1] + 2 + more, base[2] + "R", (*base[3], f"{NAMES[y]}:{text}"))
        best = new
    ends = []
    for roles, (cost, audit, lines) in best.items():
        for tail in ("", "a", "ua"):
            if whole(roles + tail):
                ends.append((cost + 2 * len(tail), audit + "I" * len(tail), (*lines, *(f"{NAMES[x]}:" for x in tail))))
                break
    cost, audit, lines = min(ends)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_long_conversations():
    rng, parser = random.Random(2), conversations.Parser(conversations.Automaton())
    for size in (10, 900, 3000):
        for roles in (["user", "assistant"], ["x"], ["system", "user", "assistant", "tool"]):
            turns = [(rng.choice(roles), str(i), rng.choice([0, 0, 0, 3, 1])) for i in range(size)]
            for role, text, fault in turns:
                parser.turn(role.encode(), text.encode(), fault)
            assert parser.close() == chained(turns)


def test_query_equals_plain_version(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    assert as_dict(got) == slow_query(rows, chained)
    small = odd_rows(40, 4)
    assert slow_query(small, chained) == slow_query(small)


def test_all_dropped_copies_and_extra_columns(spark):
    gone = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows = [(gone, 0, "user", "Hi.")] + [(-5, 7, "user", "Same.")] * 50 + [(-6, i, "assistant", "Same.") for i in range(60)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", fault string, same int, audit int").repartition(5)
    got = as_dict(conversations.repair_conversations(conversations.damaged(table)))
    assert got == slow_query(rows, chained)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns_are_whole_conversations(spark):
    rows = [r for r in odd_rows(80)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    repairs = conversations.repair_conversations(table)
    turns = conversations.repaired_turns(table, repairs).collect()
    for r in repairs.collect():
        own = sorted((t for t in turns if t["conv_id"] == r["conv_id"]), key=lambda t: t["place"])
        assert [t["place"] for t in own] == list(range(len(own)))
        assert whole("".join(t["role"][0] for t in own))
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in own).encode()).hexdigest() == r["repaired_sha256"]
        assert [t["edit"] for t in own] == [e for e in r["audit"] if e != "D"]
