"""Conversation repair against plain enumeration of all cheapest edits."""
import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

SPACE = " \t\n\x0b\x0c\r"
ORDER = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}


def plain_damage(rows):
    """(conv, turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        c, t = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Cost, ASCII-least audit and output of all cheapest edit lists: every one is kept."""
    best = {(0): (0, {("", ())})}

    def put(d, state, cost, found):
        if state not in d or cost < d[state][0]:
            d[state] = (cost, set(found))
        elif cost == d[state][0]:
            d[state][1].update(found)

    def insert(d):
        for _ in range(3):
            for s, (cost, found) in list(d.items()):
                name, to = ORDER[s]
                put(d, to, cost + 5, {(a + "I", o + ((name, None),)) for a, o in found if len(a) - len(a.rstrip("I")) < 2})
    insert(best)
    for i, ((_, _, role, _), fault) in enumerate(zip(rows, faults)):
        after = {}
        for s, (cost, found) in best.items():
            put(after, s, cost + 2, {(a + "D", o) for a, o in found})
            if fault in ("b", "d"):
                continue
            late = 5 if fault == "t" else 0
            name, to = ORDER[s]
            if role[:1] == "s" and s == 0:
                put(after, 1, cost + late, {(a + "K", o + ((None, i),)) for a, o in found})
            if role[:1] == name:
                put(after, to, cost + late, {(a + "K", o + ((None, i),)) for a, o in found})
            put(after, to, cost + late + 1, {(a + "R", o + ((name, i),)) for a, o in found})
        best = after
        insert(best)
    least = min(best[s][0] for s in (0, 3) if s in best)
    audit, made = min((a, o) for s in (0, 3) if s in best and best[s][0] == least for a, o in best[s][1])
    names = {"u": "user", "a": "assistant", None: None}
    lines = [f"{names[n] or rows[i][2]}:{rows[i][3] if i is not None else ''}" for n, i in made]
    return least, audit, "\n".join(lines)


def plain_report(rows):
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    out = []
    for conv, mine in of.items():
        d = plain_damage(mine)
        if not d:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        f = plain_faults(d)
        turns = {r[1] for r in d if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(d, d[1:]))
        cost, audit, text = cheapest(d, f)
        out.append((conv, gaps, f.count("b"), f.count("d"), f.count("t"), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def random_rows(seed, convs, longest=9):
    rng = np.random.default_rng(seed)
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["Hello there.", "And so on", "What?", " \n", "", None, "Fine!", "cut. off", "Yes. \t"]
    rows = []
    for c in range(convs):
        conv = None if c == 0 else c
        for t in range(int(rng.integers(1, longest))):
            turn = None if rng.random() < 0.05 else t + int(rng.random() < 0.1)
            role = roles[int(rng.integers(8))] if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((conv, turn, role, texts[int(rng.integers(9))] if rng.random() < 0.5 else f"t{t}."))
    return rows


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_all_short_symbol_strings():
    """Every string of up to four symbols, and random long ones, against the enumeration."""
    from sluice.llm.conversations import repair, tables
    roles = {1: "s", 2: "u", 3: "a", 4: "o"}
    cases = [c for n in range(5) for c in itertools.product(range(9), repeat=n)]
    rng = np.random.default_rng(4)
    cases += [tuple(rng.integers(0, 9, int(n))) for n in rng.integers(5, 14, 300)]
    letters = [a for a, _ in tables().pieces]
    for block in (1, 4):
        for case, (cost, pieces, end) in zip(cases, repair([np.array(c, np.uint8) for c in cases], block)):
            rows = [(0, 0, roles.get((s - 1) % 4 + 1, "o") if s else "u", "x") for s in case]
            faults = ["b" if s == 0 else "t" if s > 4 else "" for s in case]
            want = cheapest(rows, faults)
            assert (cost, "".join(letters[p] for p in pieces) + letters[end]) == want[:2], case


def test_long_conversation_equals_its_blocks():
    """A conversation of 20,000 rows: the cost of the audit is the cost found, and roles come out in order."""
    from sluice.llm.conversations import repair, tables
    symbols = np.random.default_rng(5).integers(0, 9, 20_000).astype(np.uint8)
    (cost, pieces, end), = repair([symbols])
    (other, _, _), = repair([symbols], 1)
    made = "".join(tables().pieces[p][1].replace("k", "suao"[(s - 1) % 4] if s else "") for p, s in zip(pieces, symbols.tolist()))
    audit = "".join(tables().pieces[p][0] for p in pieces)
    assert re.fullmatch("(s?(ua)+)?", (made + tables().pieces[end][1]).lower())
    spent = {"D": 2, "I": 5, "K": 0, "R": 1}
    late = sum(5 for p, s in zip(pieces, symbols.tolist()) if s > 4 and tables().pieces[p][0][-1] in "KR")
    assert cost == other == sum(spent[c] for c in audit) + late


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_enumeration(spark, seed):
    from sluice.llm.conversations import repair_conversations
    rows = random_rows(seed, 150)
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows],
                               "conv_id long, turn long, role string, text string, ord long, ck string, stretch string")
    got = [tuple(r[c] for c in COLUMNS) for r in repair_conversations(df.repartition(3)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == sorted(plain_report(rows), key=key)


def test_repeated_rows_and_very_long_texts(spark):
    """Rows that repeat (ties of every key) and texts of a million characters."""
    from sluice.llm.conversations import repair_conversations
    rows = [(3, 1, "user", "So.")] * 9 + [(3, 2, "assistant", "é" * 1_000_000 + ".")] + [(4, None, None, None)] * 3
    rows += [(5, t, ("user", "assistant")[t % 2], f"{t} " * 50 + "!") for t in range(6000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in repair_conversations(df).collect()}
    assert set(got) == {3, 4, 5}
    for want in plain_report([r for r in rows if r[0] != 5]):
        assert tuple(got[want[0]][c] for c in COLUMNS) == want
    assert re.fullmatch("[DKR]*", got[5]["audit"]) and got[5]["gaps"] > 200


def test_empty_table(spark):
    from sluice.llm.conversations import repair_conversations
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(none).collect() == []
