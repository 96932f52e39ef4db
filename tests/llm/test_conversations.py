"""Conversation repair against an exhaustive search, node counts of the automaton, and odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from shroud.llm import conversations
from shroud.llm.queries import op11_conversations

FITS = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) of the best repair of (role, text, fault) rows: Dijkstra over (row, roles so far), audits compared as strings."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if k == len(rows) and FITS.fullmatch(roles):
            return cost, audit, list(lines)
        if (k, roles) in seen or len(roles) > 2 * len(rows) + 4:
            continue
        seen.add((k, roles))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", k, roles + role[0], (*lines, role + ":")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, roles + new[0], (*lines, f"{new}:{text}")))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    out = {}
    left = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_against_search(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert got(op11_conversations(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "sys"], ["Fine.", "open", "", None, " \t", "Why?  \n", "é!", "wörter ohne", "long. " * 20_000, "x" * 100_000]
    rows = [(conv, rng.choice([None, 1, 2, 3, 5, 8, 13]), rng.choice(roles), rng.choice(texts)) for conv in (None, 1, 2, 3, 4, 5, 6, 7, 8) for _ in range(rng.randint(1, 7))]
    rows += [(9, t, "user", "same words.") for t in range(9)] + [(11, 3, "user", "Twice."), (11, 3, "user", "Twice.")]
    # every row of conversation c is dropped
    lost = next(c for c in itertools.count(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lost, 0, "user", "Gone.")]
    df = spark.createDataFrame([(c, t, r, x, "z", 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, digest string, signature int")
    found = got(conversations.repair(conversations.damage(df)))
    assert found == brute(rows)
    assert found[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got(conversations.repair(conversations.damage(df.limit(0)))) == {}


def test_real_rows_come_out(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "How?"), (1, 3, "user", "How?"), (1, 4, "assistant", "So."), (2, 0, "assistant", "Alone.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = conversations.repaired(df, conversations.plans(conversations.signatures(df))).collect()
    assert [(r.conv_id, r.place, r.edit, r.role, r.text) for r in sorted(out)] == [(1, 0, "R", "user", "Be brief."), (1, 1, "K", "assistant", "Hello."), (1, 2, "K", "user", "How?"), (1, 3, "K", "assistant", "So.")]


@pytest.mark.parametrize("length", [4])
def test_nodes_are_shared(length):
    """One node for each distinct rest of all words, and its costs equal a search of each word alone."""
    letters = "suaxSUAX-"
    words = ["".join(w) for w in itertools.product(letters, repeat=length)] + ["".join(w) for w in itertools.product(letters, repeat=2)] + ["", "", "ua", "ua"]
    words.sort(key=lambda w: w[::-1])
    automaton = conversations.Automaton()
    found = {w: automaton.read(w) for w in words}
    assert automaton.made == len({w[k:] for w in words for k in range(len(w) + 1)})
    fault = lambda x: "blank" if x == "-" else "truncated" if x.isupper() else ""
    for w in random.Random(1).sample(words, 300):
        assert found[w] == cheapest([(x.lower(), "t", fault(x)) for x in w])[:2]


def test_long_word():
    automaton = conversations.Automaton()
    cost, audit = automaton.read("ua" * 200_000 + "u")
    assert (cost, len(audit), automaton.made) == (2, 400_001, 400_002)
