"""Conversation repair against a search over all edits of each conversation."""
import hashlib
import heapq
import random
import re
import zlib

import pytest

from trialweave.llm import catalogue, conversations

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, cost long, _conv_id string"
SPACE = " \t\n\v\f\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role,
                   "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _cheapest(rows, faults, insert=5):
    """Cost, audit and repaired rows by uniform-cost search over (cost, audit) from the front."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], {}
    ends = []
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if ends and cost > ends[0][0]:
            break
        if done.get((at, state), cost) < cost or len(audit) > 4 * len(rows) + 4:
            continue
        done.setdefault((at, state), cost)
        if at == len(rows) and state in ("", "a"):
            ends.append((cost, audit, out))
        for initial in set(after[state]) & set("ua"):
            heapq.heappush(heap, (cost + insert, audit + "I", at, initial, out + ((names[initial], ""),)))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
            if faults[at] not in ("blank", "duplicate"):
                extra = 5 * (faults[at] == "truncated")
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[0], out + ((role, text),)))
                for initial in set(after[state]) & set("ua"):
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", at + 1, initial,
                                          out + ((names[initial], text),)))
    return min(ends)


def _brute(rows):
    damaged, out = _damaged(rows), {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = _faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = _cheapest(own, faults)
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Sam", "s", "u"]
    texts = ["Yes.", "No!", "Why?", "no end", " ", "", None, "é.\n", "x 　", "A?\t", "\x85", "2.5 "]
    out = []
    for conv in range(400):
        for turn in range(rng.randrange(7)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {conv} {turn}."
            out.append((conv, rng.choice([turn, turn, turn, 2 * turn, None, -turn]), role, text))
    out += rng.choices(out, k=60) + [(None, t, "user", f"{t}.") for t in (None, None, 1, 2, 9)]
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(5)


def _got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_against_search(spark, rows):
    df = _frame(spark, rows)
    got, want = _got(conversations.report(df, conversations.damage(df))), _brute(rows)
    assert got == want
    assert {e for w in want.values() for e in w[6]} == set("DKR")  # at these costs no insert is cheapest
    assert any(w[6] == "" and w[5] == 0 for w in want.values())


def test_a_conversation_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(conversations, "RUN", 3)
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t % 90}.") for t in range(300)]
    rows += [(2, 0, "user", "same.")] * 200 + [(3, t, "user", "a third of all.") for t in range(200)]
    df = _frame(spark, rows)
    got, want = _got(conversations.report(df, df)), {}
    for conv, count in ((1, 210), (2, 199), (3, 199)):
        want[conv] = (0, 0, count)
    assert {c: g[:3] for c, g in got.items()} == want
    assert got[1][5:7] == (420, "K" * 90 + "D" * 210)
    assert got[2][5:7] == got[3][5:7] == (400, "D" * 200)


def test_nodes_are_shared():
    nodes, made = conversations.Endings(), []
    grow = nodes._grow
    nodes._grow = lambda mark: made.append(mark) or grow(mark)
    words = sorted(("".join(random.Random(i).choices("uaUAsb", k=9)) + "uauaua" for i in range(50)),
                   key=lambda w: w[::-1])
    alone = [conversations.Endings().read(w) for w in words]
    assert [nodes.read(w) for w in words] == alone
    assert len(made) == len({w[i:] for w in words for i in range(len(w))})


def test_inserts_where_they_are_cheap(monkeypatch):
    monkeypatch.setattr(conversations, "INSERT", 1)
    rng, seen = random.Random(5), set()
    for _ in range(300):
        rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"{t}.", f"{t}", "", "a."]))
                for t in range(rng.randrange(6))]
        faults = _faults(rows)
        word = "".join(conversations.letter(r[2], ("", "blank", "duplicate", "truncated").index(f))
                       for r, f in zip(rows, faults))
        got = conversations.Endings().read(word)
        assert got[4:] == _cheapest(rows, faults, insert=1)[:2]
        seen |= set(got[5])
    assert seen == set("DIKR")


def test_repaired_rows(spark, rows):
    df = _frame(spark, rows)
    cells = conversations.counted(df)
    repaired = conversations.repair(cells, conversations.plan(cells)).collect()
    by = {}
    for r in sorted(repaired, key=lambda r: (str(r["conv_id"]), r["place"])):
        by.setdefault(r["conv_id"], []).append(r)
    for own in by.values():
        assert re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in own))
        assert [r["place"] for r in own] == list(range(len(own)))
        assert all(r["text"].strip(SPACE) or r["edit"] == "I" for r in own)


def test_empty_table(spark, rows):
    df = _frame(spark, rows).where("conv_id < -1")
    assert conversations.report(df, conversations.damage(df)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = catalogue.op12_conversations(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"]
    assert _got(got) == _brute(rows)
