"""Repair of the structure of conversations: the cheapest edits that make roles alternate.

Each row of a conversation becomes one character of a signature: its role and fault. Many conversations have the same
signature, and more begin alike. So distinct signatures are sorted, which puts them in the order of a depth-first
walk through their prefix trie; the layers of the dynamic programme (the least cost of every state of the role grammar) are
computed once for each shared prefix and kept while the walk stays below it, and at each terminal node the answer
is traced back through them.

A long conversation is cut into blocks, so that no task needs all of it: the walk gives for each block the least cost from
every state to every state, such tables are added up from the last block to the first, and then each block is answered
for each state that it may be entered in, by itself. Rows are put in order by ranges of conversation and turn, which
splits a conversation of any size over many tasks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT is what a truncated row costs unless it is deleted
BLOCK = 18  # a block has up to 2 ** BLOCK rows
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

# The grammar of role initials, (s?(ua)+)?, as states: nothing yet; after s; after u; after a. Moves by role, and the ends.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
MOVE = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: What a user or assistant role leads to; from each state just one of them is allowed.
ONWARD = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
#: What is still to be inserted at the end: costs by state.
AT_END = (0, 2 * INSERT, INSERT, 0)
MUST_GO = "x"  # a row that has to be deleted; others have their role's initial (o: neither), in capitals if truncated


class Layers:
    """Layers of the dynamic programme, as numbers of distinct cost vectors; what follows from them is computed once."""

    MOST = 200_000

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.backs: dict[tuple[int, str, int], int] = {}
        self.moves: dict[tuple[int, str, int, int], tuple[str, str, str, int]] = {}

    def number(self, vector: tuple[int, ...]) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    @staticmethod
    def inserted(vector: tuple[int, ...]) -> list[int]:
        """Costs by state when up to two rows may be inserted at this place."""
        out = list(vector)
        for _ in range(2):
            for state in range(4):
                out[ONWARD[state]] = min(out[ONWARD[state]], out[state] + INSERT)
        return out

    @staticmethod
    def edits(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, next state) for a row met in a state, in the order of the edits' initials without inserting."""
        yield "D", DELETE, state
        if symbol != MUST_GO:
            cut = CUT if symbol.isupper() else 0
            kept = MOVE.get(symbol.lower(), (None,) * 4)[state]
            if kept is not None:
                yield "K", KEEP + cut, kept
            yield "R", REROLE + cut, ONWARD[state]

    def step(self, number: int, symbol: str) -> tuple[int, int]:
        """The layer after one more row, and what its costs are more than the vector says."""
        out = self.steps.get((number, symbol))
        if out is None:
            to = [NEVER] * 4
            for state, cost in enumerate(self.inserted(self.vectors[number])):
                if cost < NEVER:
                    for _, more, then in self.edits(symbol, state):
                        to[then] = min(to[then], cost + more)
            least = min(to)
            out = self.steps[number, symbol] = self.number(tuple(min(c - least, NEVER) if c < NEVER else NEVER for c in to)), least
        return out

    def back(self, number: int, symbol: str, states: int) -> int:
        """The states (as bits) of a layer that lead to some of ``states`` in the next one at the least cost."""
        out = self.backs.get((number, symbol, states))
        if out is None:
            vector, (after, least) = self.vectors[number], self.step(number, symbol)
            costs, target = self.inserted(vector), self.vectors[after]
            good = {s for s in range(4) if costs[s] < NEVER and any(states >> then & 1 and costs[s] + more == target[then] + least for _, more, then in self.edits(symbol, s))}
            for _ in range(2):
                good |= {s for s in range(4) if costs[s] < NEVER and ONWARD[s] in good and costs[s] + INSERT == costs[ONWARD[s]]}
            out = self.backs[number, symbol, states] = sum(1 << s for s in good if vector[s] == costs[s])
        return out

    def move(self, number: int, symbol: str, states: int, state: int) -> tuple[str, str, str, int]:
        """(edits for the next row, initials of rows inserted before it, what becomes of it, next state) of the least edits that stay
        on a cheapest path to ``states``. Of a row become "-" (deleted), "=" (kept), or a role's initial."""
        out = self.moves.get((number, symbol, states, state))
        if out is None:
            after, least = self.step(number, symbol)
            costs, target = self.inserted(self.vectors[number]), self.vectors[after]

            def least_edits(at: int, left: int) -> tuple[str, str, str, int] | None:
                found = []
                for edit, more, then in self.edits(symbol, at):
                    if states >> then & 1 and costs[at] + more == target[then] + least:
                        found.append((edit, "", {"D": "-", "K": "="}.get(edit) or ROLE[then][0], then))
                on = ONWARD[at]
                if left and costs[at] + INSERT == costs[on] and (rest := least_edits(on, left - 1)):
                    found.append(("I" + rest[0], ROLE[on][0] + rest[1], *rest[2:]))
                return min(found, default=None)

            out = self.moves[number, symbol, states, state] = least_edits(state, 2)
        return out


class Walk:
    """Answers signatures in sorted order; the layers of the prefix shared with the signature before stay."""

    def __init__(self):
        self.layers = Layers()
        self.before = ""
        self.stacks: dict[int, tuple[list[int], list[int]]] = {}  # by entry state: layers, and the costs that they are above

    def below(self, signature: str, entries: list[int]) -> None:
        """Make the layers of a signature from some entry states."""
        if len(self.layers.vectors) > Layers.MOST:
            self.layers.forget()
            self.before, self.stacks = "", {}
        shared = next((n for n, (a, b) in enumerate(zip(self.before, signature, strict=False)) if a != b), min(len(self.before), len(signature)))
        for entry, (numbers, above) in list(self.stacks.items()):
            del numbers[shared + 1 :], above[shared + 1 :]
        for entry in entries:
            if entry not in self.stacks:
                self.stacks[entry] = [self.layers.number(tuple(0 if s == entry else NEVER for s in range(4)))], [0]
            numbers, above = self.stacks[entry]
            for symbol in signature[len(numbers) - 1 :]:
                number, more = self.layers.step(numbers[-1], symbol)
                numbers.append(number)
                above.append(above[-1] + more)
        self.before = signature

    def costs(self, entry: int) -> list[int]:
        """The least costs by state at the end of the current signature."""
        numbers, above = self.stacks[entry]
        return [min(NEVER, c + above[-1]) for c in self.layers.vectors[numbers[-1]]]

    def answer(self, entry: int, at_end: tuple[int, ...]) -> tuple[int, int, str, str, list[str]]:
        """(cost, state at the end, edits, what becomes of each row, what is inserted before each) from a state, when the rest of the
        conversation costs ``at_end`` by state; of the cheapest edits the least in ASCII."""
        numbers, _ = self.stacks[entry]
        totals = [min(NEVER, a + b) for a, b in zip(self.costs(entry), at_end, strict=True)]
        total = min(totals)
        states = [sum(1 << s for s in range(4) if totals[s] == total)]
        for number, symbol in zip(reversed(numbers[:-1]), reversed(self.before), strict=True):
            states.append(self.layers.back(number, symbol, states[-1]))
        states.reverse()
        state, edits, becomes, inserts = entry, [], [], []
        for n, symbol in enumerate(self.before):
            made, put, to, state = self.layers.move(numbers[n], symbol, states[n + 1], state)
            edits.append(made)
            inserts.append(put)
            becomes.append(to)
        return total, state, "".join(edits), "".join(becomes), inserts


def faulty(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of conversations (conv_id, turn, role, text; null roles and texts count as one space) in order, in two written tables:
    conv_id, turn, place, block, initial, fault; and conv_id, block, place, role, text.

    ``place`` rises with conversation, turn (null first), role and text; ``block`` is a part of a conversation; ``initial`` that of the
    role; ``fault`` the first of blank, duplicate (role and text of an earlier row of the conversation), truncated, or null.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "own"]
    # equal rows are dealt out by their places in the input
    ordered = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    seen = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = ordered.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place"), F.substring("role", 1, 1).alias("initial"),
        F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).alias("own_fault"), F.unhex(seen).alias("seen"),
    )
    path = scratch.path(spark, "conversations")
    placed.write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    repeated = placed.groupBy("conv_id", "seen").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.seen") == F.col("r.seen"))
    found = placed.drop("text", "role").alias("l").join(repeated.alias("r"), same, "left")
    fault = F.when(F.col("own_fault") == BLANK, BLANK).when(F.col("place") > F.col("first"), DUPLICATE).otherwise(F.col("own_fault"))
    narrow = scratch.saved(found.select("l.conv_id", "turn", "place", F.shiftright("place", BLOCK).alias("block"), "initial", fault.alias("fault")), "faults")
    return narrow, placed.select("conv_id", F.shiftright("place", BLOCK).alias("block"), "place", "role", "text")


def symbol(initial: Column, fault: Column) -> Column:
    """The character of a row in a signature."""
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin(BLANK, DUPLICATE), MUST_GO).when(fault == TRUNCATED, F.upper(known)).otherwise(known)


def in_blocks(faults: DataFrame) -> DataFrame:
    """A row for each block of a conversation: its signature, counts of faults, turns and neighbours that are out of order."""
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    rows = F.sort_array(F.collect_list(F.struct("place", symbol(F.col("initial"), F.col("fault")).alias("symbol"), initial.alias("initial"))))
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
    out = faults.groupBy("conv_id", "block").agg(rows.alias("rows"), F.min("place").alias("first"), F.min("turn").alias("least"), F.max("turn").alias("most"), F.countDistinct("turn").alias("turns"), *counts)
    initials = F.array_join(F.col("rows.initial"), "")
    return out.select(
        "conv_id", "block", "first", "least", "most", "turns", BLANK, DUPLICATE, TRUNCATED, F.array_join(F.col("rows.symbol"), "").alias("signature"),
        (F.size("rows") - 1 - F.regexp_count(initials, F.lit("(?=su|ua|au)"))).alias("illegal"),
        F.substring(initials, 1, 1).alias("begins"), F.substring(initials, -1, 1).alias("ends"),
    )


def summed(blocks: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated and illegal of each conversation; blocks that meet share a turn or not."""
    parts = F.sort_array(F.collect_list(F.struct("block", "least", "most", "begins", "ends")))
    out = blocks.groupBy("conv_id").agg(parts.alias("parts"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("turns").alias("turns"), *(F.sum(c).alias(c) for c in (BLANK, DUPLICATE, TRUNCATED, "illegal")))
    seams = F.arrays_zip(F.slice("parts", 1, F.size("parts") - 1).alias("l"), F.slice("parts", 2, F.size("parts")).alias("r"))
    shared = F.size(F.filter(seams, lambda x: x["l"]["most"] == x["r"]["least"]))
    wrong = F.size(F.filter(seams, lambda x: ~F.concat(x["l"]["ends"], x["r"]["begins"]).isin("su", "ua", "au")))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - (F.col("turns") - shared), F.lit(0)).cast("long")
    return out.select("conv_id", gaps.alias("gaps"), BLANK, DUPLICATE, TRUNCATED, (F.col("illegal") + wrong).alias("illegal"))


ANSWER = "signature string, at_end array<long>, entry int, cost long, leaves int, edits string, becomes string, inserts array<string>"


def _walked(requests: DataFrame, tables: bool) -> DataFrame:
    """Distinct signatures in sorted order through the trie: tables of costs from state to state, or answers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = Walk()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                entries = [e for e in range(4) if row.entries >> e & 1]
                walk.below(row.signature, entries)
                if tables:
                    out.append((row.signature, [c for e in entries for c in walk.costs(e)]))
                else:
                    at_end = tuple(map(int, row.at_end))
                    for e in entries:
                        if min(a + b for a, b in zip(walk.costs(e), at_end, strict=True)) < NEVER:
                            out.append((row.signature, list(at_end), e, *walk.answer(e, at_end)))
            yield pd.DataFrame(out, columns=names)

    schema = "signature string, costs array<long>" if tables else ANSWER
    names = [c.split()[0] for c in schema.split(", ")]
    keys = [c for c in requests.columns if c != "entries"]
    return requests.groupBy(*keys).agg(F.bit_or("entries").alias("entries")).repartitionByRange("signature").sortWithinPartitions("signature").mapInPandas(run, schema)


def _costs_behind(blocks: list) -> list[tuple[int, ...]]:
    """What the rest of a conversation costs by state at the end of each block, from the blocks' tables in order."""
    behind = [AT_END]
    for block in reversed(blocks[1:]):
        costs, last = list(block), behind[-1]
        behind.append(tuple(min(NEVER, *(costs[4 * e + x] + last[x] for x in range(4))) for e in range(4)))
    return behind[::-1]


def planned(blocks: DataFrame) -> DataFrame:
    """conv_id, block, first, cost (of the whole conversation, in its first block), edits, becomes (a character for each row: deleted,
    kept or the initial of a new role), inserts (initials before each row) and tail (initials of rows inserted at the end)."""
    several = blocks.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("block").alias("head"), F.max("block").alias("foot"))
    blocks = scratch.saved(blocks.alias("b").join(several.alias("s"), F.col("b.conv_id").eqNullSafe(F.col("s.conv_id"))).select("b.conv_id", "block", "first", "signature", "n", "head", "foot"), "blocks")
    end = F.array(*(F.lit(c).cast("long") for c in AT_END))
    whole = blocks.where("n = 1").withColumns({"at_end": end, "entries": F.lit(1)})
    parts = blocks.where("n > 1")

    # of conversations in several blocks: tables of the blocks, then costs behind each
    tables = _walked(parts.select("signature", F.lit(15).alias("entries")), tables=True)
    listed = parts.join(tables, "signature").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("blocks"))

    def behind(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, found = frame["conv_id"].tolist(), frame["blocks"].tolist()
            rows = [(None if i is None or i != i else int(i), b["block"], list(c)) for i, own in zip(ids, found, strict=True) for b, c in zip(own, _costs_behind([x["costs"] for x in own]), strict=True)]
            yield pd.DataFrame(rows, columns=["conv_id", "block", "at_end"]).astype({"conv_id": "Int64"})

    ends = listed.mapInPandas(behind, "conv_id long, block long, at_end array<long>")
    parts = parts.alias("p").join(ends.alias("e"), F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("p.block") == F.col("e.block"))).select("p.*", "at_end", F.when(F.col("p.block") == F.col("head"), 1).otherwise(15).alias("entries"))
    asked = scratch.saved(whole.unionByName(parts), "requests")
    answers = scratch.saved(_walked(asked.select("signature", "at_end", "entries"), tables=False), "answers")

    # the state in which each block is entered follows from the one before
    exits = asked.where("n > 1").join(answers.select("signature", "at_end", "entry", "leaves").distinct(), ["signature", "at_end"])
    steps = exits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "entry", "leaves"))).alias("blocks"))

    def entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, own in zip(frame["conv_id"].tolist(), frame["blocks"].tolist(), strict=True):
                state = EMPTY
                for block, choices in itertools.groupby(own, key=lambda x: x["block"]):
                    rows.append((None if i is None or i != i else int(i), block, state))
                    state = {x["entry"]: x["leaves"] for x in choices}[state]
            yield pd.DataFrame(rows, columns=["conv_id", "block", "entry"]).astype({"conv_id": "Int64"})

    entries = steps.mapInPandas(entered, "conv_id long, block long, entry int")
    entered_parts = asked.where("n > 1").alias("p").join(entries.alias("e"), F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("p.block") == F.col("e.block"))).select("p.*", "entry")
    chosen = asked.where("n = 1").withColumn("entry", F.lit(EMPTY)).unionByName(entered_parts).join(answers, ["signature", "at_end", "entry"])
    is_last = F.col("block") == F.col("foot")
    tail = F.when(is_last & (F.col("leaves") == USER), "a").when(is_last & (F.col("leaves") == SYSTEM), "ua").otherwise("")
    out = chosen.select("conv_id", "block", "first", F.when(F.col("block") == F.col("head"), F.col("cost")).alias("cost"), "edits", "becomes", "inserts", tail.alias("tail"))
    return scratch.saved(out.withColumn("edits", F.concat("edits", F.repeat(F.lit("I"), F.length("tail")))), "plans")


def _with_plans(plans: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts and plans in one table; a plan stands before the rows of its block."""
    own = plans.select("conv_id", "block", F.col("first").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "becomes", "inserts", "tail")
    empty = {"becomes": F.lit(None).cast("string"), "inserts": F.lit(None).cast("array<string>"), "tail": F.lit(None).cast("string")}
    return own.unionByName(texts.withColumns({"kind": F.lit(1), **empty}))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, int | None, str, str]]]:
    """(conv_id, place, role, text) of the repaired rows, as far as each batch goes; a row without role says that a conversation is there.

    Inserted rows have the place of the row that they stand before, or of the last one.
    """
    names = {"s": "system", "u": "user", "a": "assistant"}
    becomes, inserts, tail, n = "", [], "", 0
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "place", "kind", "role", "text", "becomes", "inserts", "tail")]
        for conv, place, kind, role, text, b, i, t in zip(*columns, strict=True):
            if not kind:
                becomes, inserts, tail, n = b, i, t, 0
                out.append((conv, place, None, ""))
                continue
            out.extend((conv, place, names[x], "") for x in inserts[n])
            to = becomes[n]
            if to != "-":
                out.append((conv, place, role if to == "=" else names[to], text))
            n += 1
            if n == len(becomes):
                out.extend((conv, place, names[x], "") for x in tail)
        yield out


def repaired(plans: DataFrame, texts: DataFrame) -> DataFrame:
    """conv_id, place, nth (from 0, among rows of one place), role and text of the repaired conversations; a block is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _applied(batches):
            rows = [r for r in rows if r[2] is not None]
            nth = [k for _, same in itertools.groupby(rows, key=lambda r: r[:2]) for k, _ in enumerate(same)]
            conv, place, role, text = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(place, pa.int64()), pa.array(nth, pa.int32()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "place", "nth", "role", "text"])

    together = _with_plans(plans, texts).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "place")
    return together.mapInArrow(run, "conv_id long, place long, nth int, role string, text string")


def digests(plans: DataFrame, texts: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of ``role:text`` of the repaired rows, joined by line ends.

    A digest takes its bytes in order, so a conversation streams through one task, which holds a batch of its rows and one block's plan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, lines = (), None, 0
        for rows in _applied(batches):
            done = []
            for conv, _, role, text in rows:
                if (conv,) != current:
                    if state:
                        done.append((*current, state.hexdigest()))
                    current, state, lines = (conv,), hashlib.sha256(), 0
                if role is not None:
                    state.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            yield table(done)
        if state:
            yield table([(*current, state.hexdigest())])

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])

    together = _with_plans(plans, texts).repartition("conv_id").sortWithinPartitions("conv_id", "block", "kind", "place")
    return together.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops a row, 1 empties its text, 2 takes its
    full stops and question and exclamation marks, 3 repeats it, 4 makes its role user."""
    spelt = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelt[0], F.lit(":"), spelt[1]).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, measured and repaired.

    Rows of one turn are taken by role and text, as bytes. A role that begins with none of s, u, a, or is empty, can only be changed or
    deleted; null roles and texts count as one space, and a null conv_id as a conversation. Repeated rows are duplicates. A
    conversation without rows after the damage: zeros, no edits, and the digest of nothing. An empty table gives no rows.
    """
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    faults, texts = faulty(damaged(conversations))
    blocks = scratch.saved(in_blocks(faults), "signatures")
    plans = planned(blocks)
    edits = plans.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("block", "edits"))).getField("edits"), "").alias("audit"))
    out = conversations.select(F.col("conv_id").cast("long")).distinct()
    for more in (summed(blocks), edits, digests(plans, texts)):
        renamed = more.withColumnRenamed("conv_id", "own")
        out = out.join(renamed, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    nothing = {c: 0 for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")}
    return out.na.fill({**nothing, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
