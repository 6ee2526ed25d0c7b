"""Repair of conversations against plain Python that tries states row by row, and over several blocks."""

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from idsieve.llm import conversation_repair as C
from idsieve.llm import queries
from tests.llm.tables import write

GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string, place string, block string, cost string"


def cheapest(rows):
    """(cost, edits, output) of all ways, by least cost and then least edits: rows are (role, text, must go, truncated)."""
    best = {0: (0, "", [])}

    def put(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def insert(ways):
        for _ in range(4):
            for s, (c, e, o) in list(ways.items()):
                for role in ("user", "assistant"):
                    if (s, role[0]) in GRAMMAR:
                        put(ways, GRAMMAR[s, role[0]], (c + 5, e + "I", [*o, (role, "")]))

    for role, text, gone, cut in rows:
        insert(best)
        to = {}
        for s, (c, e, o) in best.items():
            put(to, s, (c + 2, e + "D", o))
            if not gone:
                if (s, role[:1]) in GRAMMAR:
                    put(to, GRAMMAR[s, role[:1]], (c + 5 * cut, e + "K", [*o, (role, text)]))
                for r in ("user", "assistant"):
                    if (s, r[0]) in GRAMMAR:
                        put(to, GRAMMAR[s, r[0]], (c + 1 + 5 * cut, e + "R", [*o, (r, text)]))
        best = to
    insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def plain(rows):
    """The query's rows from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            after += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen, marked = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in after:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in after if t is not None]
        cost, audit, output = cheapest(marked)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in output).encode()).hexdigest()
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}
    return out


def got(spark, folder):
    rows = queries.QUERIES["op11_conversation_repair"](spark, folder).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in rows}


def noise(r, conversations):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No!", "so", None, "", " \n", "What?", "x.\t", "it is", "é。", "ok. ", "\x0b"]
    return [(c, r.choice([None, t, t, t, t + r.randrange(3)]), r.choice(roles), r.choice(texts)) for c in conversations for t in range(r.randrange(1, 14))]


def test_given_conversations(spark, small_dir):
    frame = pd.read_parquet(f"{small_dir}/conversations.parquet")
    assert got(spark, small_dir) == plain(list(frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize(("bits", "seed"), [(18, 1), (0, 2), (1, 3), (2, 4)])
def test_odd_rows_in_one_block_or_many(spark, tmp_path, monkeypatch, bits, seed):
    """Blocks of 1, 2 and 4 rows have the answers of whole conversations."""
    monkeypatch.setattr(C, "BLOCK", bits)
    rows = noise(random.Random(seed), [None, *range(150)])
    write(spark, tmp_path, "conversations", [(*x, "x", "y", "z") for x in rows], SCHEMA)
    assert got(spark, str(tmp_path)) == plain(rows)


def test_empty_table_and_all_dropped(spark, tmp_path):
    write(spark, tmp_path / "a", "conversations", [], SCHEMA)
    assert got(spark, str(tmp_path / "a")) == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    write(spark, tmp_path / "b", "conversations", [(7, dropped, "user", "Hi.", "", "", "")], SCHEMA)
    assert got(spark, str(tmp_path / "b")) == plain([(7, dropped, "user", "Hi.")])
    assert got(spark, str(tmp_path / "b"))[7]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repaired_rows(spark, monkeypatch):
    """The operator gives the repaired rows themselves."""
    monkeypatch.setattr(C, "BLOCK", 1)
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Well?"), (1, 3, "user", " "), (2, 0, "user", "A."), (2, 1, "user", "A.")]
    faults, texts = C.faulty(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plans = C.planned(C.in_blocks(faults))
    made = C.repaired(plans, texts).orderBy("conv_id", "place", "nth").collect()
    assert [(r.conv_id, r.role, r.text) for r in made] == [(1, "system", "Be kind."), (1, "user", "Hello."), (1, "assistant", "Well?")]
    assert {r.conv_id: r.cost for r in plans.groupBy("conv_id").sum("cost").withColumnRenamed("sum(cost)", "cost").collect()} == {1: 3, 2: 4}


def test_layers_of_shared_prefixes_are_made_once(monkeypatch):
    walk, made = C.Walk(), []
    step = C.Layers.step
    monkeypatch.setattr(C.Layers, "step", lambda self, number, symbol: made.append(symbol) or step(self, number, symbol))
    for signature in sorted(["suaua", "suauo", "suauoU", "uaua", "uauax"]):
        walk.below(signature, [0])
    assert len(made) == 5 + 1 + 1 + 4 + 1


def test_a_long_conversation_takes_linear_time():
    walk, r = C.Walk(), random.Random(9)
    signature = "".join(r.choices("suaoUAxSO", k=200_000))
    walk.below(signature, [0])
    cost, _, edits, becomes, inserts = walk.answer(0, C.AT_END)
    assert len(becomes) == len(inserts) == 200_000 and len(edits) == 200_000 + sum(map(len, inserts))
    output = re.sub("-", "", "".join(i + (s.lower() if b == "=" else b) for i, b, s in zip(inserts, becomes, signature, strict=True)))
    assert re.fullmatch("(s?(ua)*)u?", output)
