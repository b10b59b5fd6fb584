"""Conversation repair against a search over all edits, and op13 against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import pytest

from helixmill.llm import conversation_repair as cr

COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def cheapest(rows):
    """(cost, letters) by whole strings: for each state the least (cost, letters) of all ways there, without ranks or a tree."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def put(d, state, x):
        if state not in d or x < d[state]:
            d[state] = x

    def inserts(d):
        for _ in range(3):
            for state, (c, s, o) in list(d.items()):
                for r in step[state].replace("s", ""):
                    put(d, r, (c + 3, s + "I", o + (r,)))
        return d

    for initial, fault in rows:
        new = {}
        for state, (c, s, o) in inserts(best).items():
            put(new, state, (c + 4, s + "D", o))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            for r in step[state]:
                if r == initial:
                    put(new, r, (c + more, s + "K", o + (r,)))
                elif r != "s":
                    put(new, r, (c + 3 + more, s + "R", o + (r,)))
        best = new
    return min(x for state, x in inserts(best).items() if state in ("", "a"))


def searched(rows):
    search, out = cr.Repair(), b""
    for initial, fault in rows:
        out += search.step(initial, fault)
    cost, rest = search.end()
    return cost, out + rest


@pytest.mark.parametrize("seed", range(400))
def test_search_is_the_whole_search(seed):
    rng = random.Random(seed)
    weights = rng.choice([(1, 4, 4, 1), (4, 1, 1, 1), (0, 1, 0, 0), (1, 1, 1, 6), (1, 3, 3, 0)])
    faults = rng.choice([[None], [None, "truncated"], [None, "blank", "duplicate", "truncated"], ["blank"], [None] * 9 + ["blank"]])
    rows = [(rng.choices("suax", weights)[0], rng.choice(faults)) for _ in range(rng.randint(0, 40))]
    cost, letters, roles = cheapest(rows)
    got_cost, edits = searched(rows)
    assert (got_cost, edits.translate(cr.LETTERS).decode()) == (cost, letters)
    assert re.fullmatch("(s?(ua)+)?", "".join(roles))


def test_decided_edits_leave_memory():
    search = cr.Repair()
    for i in range(50_000):
        search.step("ua"[i % 2] if i % 7 else "s", "truncated" if i % 11 == 0 else None)
        assert search.unresolved() < 50


def test_unresolved_ties_stay_whole():
    """Rows of unknown roles: two survivors of equal cost part at the first row and are both needed to the end."""
    search = cr.Repair()
    out = b"".join(search.step("x", None) for _ in range(2_001))
    cost, rest = search.end()
    assert cheapest([("x", None)] * 2_001)[:2] == (cost, (out + rest).translate(cr.LETTERS).decode())


def plain(rows):
    """op13 by its contract, a conversation at a time."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, role, text in own:
            inner = re.findall(r"[^\x20\x09-\x0D]", text)
            f = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(f)
            count[f] += 1
        turns = [t for t, _, _ in own if t is not None]
        cost, letters, roles = cheapest([(r[:1], f) for (_, r, _), f in zip(own, faults)])
        said, rest, place = [], iter(own), 0
        for e in letters:
            row = next(rest) if e != "I" else None
            if e == "D":
                continue
            new = {"u": "user", "a": "assistant", "s": "system"}[roles[place]]
            said.append(f"{row[1]}:{row[2]}" if e == "K" else f"{new}:{row[2] if row else ''}")
            place += 1
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_op13_is_its_contract(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Yes.", "No", " \t\n", "", "Why? ", None, "So it is!\n", "long words go on " * 3_000 + ".", " "]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice([None, "", "user", "assistant", "system", "tool"]), rng.choice(texts)) for _ in range(700)]
    rows += [(c, 5, "user", "Only one.") for c in range(1_000, 1_060)] + [(7, 3, "user", "No")] * 3
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in cr.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain(rows)
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for c, v in got.items() if c and c >= 1_000)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_on_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in cr.op13_conversation_repair(spark, f"/root/testdata/{sf}").collect()}
    assert got == plain(rows)


def test_edit_rows(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, fault int, place int, was int"
    rows = [(1, 0, "user", "Hello.", "x", 1, 1, 1), (1, 1, "user", "Again?", "x", 1, 1, 1), (1, 2, "assistant", "Yes.", "x", 1, 1, 1), (2, None, None, None, None, None, None, None)]
    got = cr.repair_conversations(spark.createDataFrame(rows, schema)).orderBy("conv", "place").collect()
    assert [(r.conv, r.place, r.edit, r.was, r.role, r.text, r.fault) for r in got] == [
        (1, 0, "K", "user", "user", "Hello.", None), (1, 1, "I", None, "assistant", "", None), (1, 2, "K", "user", "user", "Again?", None), (1, 3, "K", "assistant", "assistant", "Yes.", None), (2, 0, "D", " ", " ", " ", "blank"),
    ]


def test_empty_table(spark):
    assert cr.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
