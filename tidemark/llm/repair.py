"""Repair of conversation structure as a shortest path.

Edits turn the roles of a conversation into `(system? (user assistant)+)?`. Nodes are (row, state); an edge takes the edits at one row: some inserts, then
Keep, Rerole or Delete. Its weight is one integer: the cost in the high digits, the edits' letters in a slot of three low digits
that stands at the row's place, filled up with zeros at its end. No slot is the beginning of another, so the least integer has the least cost and, among
those, the audit that comes first in ASCII. What a run of rows does is a 4 x 4 matrix of such integers, and matrices of
neighbouring runs multiply by minimum and sum; very long conversations are cut into chunks and joined that way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays. Fixed values.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = " DIKR"  # a letter's digit is its place; 0 fills up
DIGIT, SLOT = 3, 9  # bits of a digit, and of a slot of two inserts and a row's letter
#: States: nothing yet, after system, after user, after assistant. The last and the first may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the only role that may be put next
KEPT = {("s", START): SYSTEM, **{("u", s): USER for s in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Conversations that weigh more (bytes of text, and ROW_WEIGHT for each row) are cut into chunks of at most so many rows and about so many bytes.
LONG_WEIGHT, ROW_WEIGHT = 8 << 20, 256
CHUNK_ROWS, CHUNK_BYTES = 512, 1 << 20
#: Up to so many rows go one by one; a longer run is multiplied up from halves, as the integers get long.
ROW_BY_ROW = 64

Matrix = list[list[int | None]]


def _slot(letters: str) -> int:
    return sum(LETTERS.index(c) << (SLOT - DIGIT * (k + 1)) for k, c in enumerate(letters))


def _edges() -> dict[str, Matrix]:
    """For each kind of row the least weight between two states. Kinds: s, u, a, o (another role), in capitals if truncated; X must go; . is the end."""
    out = {}
    for kind in "suaoSUAOX.":
        least: Matrix = [[None] * 4 for _ in range(4)]
        for first in range(4):
            state, before, cost = first, "", 0
            for _ in range(3):  # two inserts reach every state that inserts reach
                if kind == ".":
                    moves = [(state, "", 0)] if state in (START, ASSISTANT) else []
                else:
                    moves, more = [(state, "D", DELETE)], TRUNCATED if kind.isupper() else 0
                    if kind != "X":
                        moves.append((FORCED[state], "R", REROLE + more))
                        if (kind.lower(), state) in KEPT:
                            moves.append((KEPT[kind.lower(), state], "K", KEEP + more))
                for to, letter, price in moves:
                    weight = (cost + price) << SLOT | _slot(before + letter)
                    if least[first][to] is None or weight < least[first][to]:
                        least[first][to] = weight
                state, before, cost = FORCED[state], before + "I", cost + INSERT
        out[kind] = least
    return out


EDGES = _edges()


def times(a: Matrix, n: int, b: Matrix, m: int) -> Matrix:
    """The matrix of n rows and then m rows."""
    low_a, low_b, up = (1 << SLOT * n) - 1, (1 << SLOT * m) - 1, SLOT * (n + m)
    left = [[None if x is None else ((x >> SLOT * n) << up) + ((x & low_a) << SLOT * m) for x in row] for row in a]
    right = [[None if x is None else ((x >> SLOT * m) << up) + (x & low_b) for x in row] for row in b]
    return [[min((x + right[k][j] for k, x in enumerate(row) if x is not None and right[k][j] is not None), default=None)
             for j in range(4)] for row in left]


def product(kinds: str) -> Matrix:
    """The matrix of a run of rows, multiplied pair by pair so that integers grow as slowly as they can."""
    if len(kinds) == 1:
        return EDGES[kinds]
    half = len(kinds) // 2
    return times(product(kinds[:half]), half, product(kinds[half:]), len(kinds) - half)


def letters_of(weight: int, n: int) -> str:
    """The edits' letters in the slots of n rows."""
    low = weight & ((1 << SLOT * n) - 1)
    return "".join(LETTERS[low >> k & 7] for k in range(SLOT * n - DIGIT, -1, -DIGIT) if low >> k & 7)


def cheapest(kinds: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of all rows."""
    if len(kinds) <= ROW_BY_ROW:
        return _by_rows(kinds)
    best = min(x for x in product(kinds + ".")[START] if x is not None)
    return best >> SLOT * (len(kinds) + 1), letters_of(best, len(kinds) + 1)


@lru_cache(maxsize=100_000)
def _by_rows(kinds: str) -> tuple[int, str]:
    """The least integer at every node, row by row."""
    n = len(kinds) + 1
    at: list[int | None] = [0, None, None, None]
    for k, kind in enumerate(kinds + "."):
        place = SLOT * (n - 1 - k)
        after: list[int | None] = [None] * 4
        for value, row in zip(at, EDGES[kind], strict=True):
            if value is None:
                continue
            for to, edge in enumerate(row):
                if edge is not None:
                    weight = value + ((edge >> SLOT) << SLOT * n) + ((edge & 0x1FF) << place)
                    if after[to] is None or weight < after[to]:
                        after[to] = weight
        at = after
    best = min(x for x in at if x is not None)
    return best >> SLOT * n, letters_of(best, n)


def kinds_of(rows: list[tuple], repeated: Callable[[tuple], bool]) -> tuple[str, int, int, int]:
    """The kind of each (turn, role, text), and how many are blank, duplicate and truncated; a row's first fault counts."""
    kinds, blank, duplicate, truncated = [], 0, 0, 0
    for row in rows:
        body, again = row[2].rstrip(BLANKS), repeated(row)
        kind = row[1][:1] if row[1][:1] in ("s", "u", "a") else "o"
        if not body:
            blank += 1
            kind = "X"
        elif again:
            duplicate += 1
            kind = "X"
        elif body[-1] not in ".!?":
            truncated += 1
            kind = kind.upper()
        kinds.append(kind)
    return "".join(kinds), blank, duplicate, truncated


def apply_edits(rows: list[tuple], audit: str, state: int = START) -> tuple[list[str], int]:
    """The repaired lines `role:text`, and the state after them."""
    lines, k = [], 0
    for letter in audit:
        if letter == "I":
            state = FORCED[state]
            lines.append(ROLE[state] + ":")
            continue
        _, role, text = rows[k][:3]
        k += 1
        if letter == "K":
            state = KEPT[role[0], state]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            state = FORCED[state]
            lines.append(f"{ROLE[state]}:{text}")
    return lines, state


def broken_pairs(initials: list[str]) -> int:
    return sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_one(rows: list[tuple]) -> tuple:
    """The columns of ``FOUND`` for the ordered rows (turn, role, text) of one conversation."""
    seen: set = set()

    def repeated(row: tuple) -> bool:
        again = row[1:3] in seen
        seen.add(row[1:3])
        return again

    kinds, blank, duplicate, truncated = kinds_of(rows, repeated)
    cost, audit = cheapest(kinds)
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    lines, _ = apply_edits(rows, audit)
    return (gaps, blank, duplicate, truncated, broken_pairs([r[1][:1] for r in rows]), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
             "array<binary>": pa.list_(pa.binary())}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def _batch(rows: list[tuple], key: pa.DataType, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (1 + len(schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key, *_types(schema)], strict=True)],
                                      names=["conv", *[c.split()[0] for c in schema.split(", ")]])


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        for at in range(0, part.num_rows, 2000):
            yield from zip(*[c.to_pylist() for c in part.slice(at, 2000).columns], strict=True)


def _run_by_key(rows: DataFrame, schema: str, one: Callable[[object, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Streams sorted rows through ``one``, conversation by conversation; ``rows`` start with the column conv and have all of one in one task."""
    key = rows.schema["conv"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out = [], []

        def noted() -> Iterator[pa.RecordBatch]:
            for part in parts:
                kind[:] = [part.schema.field(0).type]
                yield part

        for conv, own in groupby(_rows(noted()), key=lambda r: r[0]):
            out.extend((conv, *x) for x in one(conv, own))
            if len(out) >= 2000:
                yield _batch(out, kind[0], schema)
                out = []
        if out:
            yield _batch(out, kind[0], schema)

    return rows.mapInArrow(run, f"conv {key}, {schema}")


def _ordered(rows: DataFrame) -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


CHUNK = ("part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, "
         "distinct long, first_turn long, last_turn long, kinds string, weights array<binary>, turns array<long>, roles array<string>, texts array<string>")


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks of neighbouring rows of the long conversations, each with the matrix of its rows, in the order (part, seq).

    Rows equal in turn, role and text come as one with their number. Ranges over (conversation, turn, role, text) cut even a
    single conversation into many tasks, so its rows are never together in one.
    """
    same = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    same = same.withColumn("digest", digest).withColumn("whole", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn")))
    first = same.groupBy("conv", "digest").agg(F.min("whole").alias("least"))
    marked = same.alias("a").join(first.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.digest") == F.col("b.digest")))
    marked = marked.select("a.conv", "a.turn", "a.role", "a.text", "a.copies", (~F.col("a.whole").eqNullSafe(F.col("b.least"))).alias("again"))
    dealt = marked.repartitionByRange(*_ordered(marked)).sortWithinPartitions(*_ordered(marked))

    def one(conv, own: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> tuple:
            kinds, blank, duplicate, truncated = kinds_of(held, lambda r: r[3])
            turns = [r[0] for r in held if r[0] is not None]
            initials = [r[1][:1] for r in held]
            matrix = product(kinds)
            flat = [None if x is None else x.to_bytes(x.bit_length() // 8 + 1, "big") for row in matrix for x in row]
            return (part, seq, len(held), blank, duplicate, truncated, broken_pairs(initials), initials[0], initials[-1],
                    min(turns, default=None), max(turns, default=None), len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None,
                    kinds, flat, [r[0] for r in held], [r[1] for r in held], [r[2] for r in held])

        for _, turn, role, text, copies, again in own:
            for k in range(copies):
                held.append((turn, role, text, again or k > 0))
                size += len(text)
                if len(held) >= CHUNK_ROWS or size >= CHUNK_BYTES:
                    yield close()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield close()

    return _run_by_key(dealt, CHUNK, one)


CHOSEN = "part int, seq long, into int, out int"
SUMMED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, tail long, state long, " + CHOSEN


def _choose(chunks: DataFrame) -> DataFrame:
    """For each chunk the states before and after it on the cheapest path; the sums of the conversation stand in each of its rows.

    Chunks pass one by one. Of the paths to each state only cost, order among the four and the state before are held, a few bytes a chunk.
    """
    slim = chunks.drop("kinds", "turns", "roles", "texts")
    dealt = slim.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "seq")

    def one(conv, own: Iterator[tuple]) -> Iterator[tuple]:
        at: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: cost, place in the order of the audits so far
        back, names = [], []
        blank = duplicate = truncated = illegal = distinct = 0
        low = high = last = last_turn = None
        for (_, part, seq, n, b, d, t, i, first, end, lo, hi, some, first_turn, end_turn, weights) in own:
            blank, duplicate, truncated, illegal = blank + b, duplicate + d, truncated + t, illegal + i
            illegal += last is not None and last + first not in LEGAL
            distinct += some - (last_turn is not None and last_turn == first_turn)
            low, high = (lo if low is None else low), (high if hi is None else hi)
            last, last_turn = end, last_turn if end_turn is None else end_turn
            mask, found = (1 << SLOT * n) - 1, {}
            for state, (cost, place) in at.items():
                for to in range(4):
                    if (raw := weights[4 * state + to]) is not None:
                        weight = int.from_bytes(raw, "big")
                        found.setdefault(to, []).append((cost + (weight >> SLOT * n), place, weight & mask, state))
            best = {to: min(x) for to, x in found.items()}
            order = {key: k for k, key in enumerate(sorted({x[1:3] for x in best.values()}))}
            at = {to: (x[0], order[x[1:3]]) for to, x in best.items()}
            back.append([best[to][3] if to in best else -1 for to in range(4)])
            names.append((part, seq))
        ends = []
        for state, (cost, place) in at.items():
            for to in (START, ASSISTANT):
                if (edge := EDGES["."][state][to]) is not None:
                    ends.append((cost + (edge >> SLOT), place, edge & 0x1FF, state))
        cost, _, tail, state = min(ends)
        gaps = high - low + 1 - distinct if low is not None else 0
        summed = (gaps, blank, duplicate, truncated, illegal, cost, len(letters_of(tail, 1)), state)
        for name, before in zip(reversed(names), reversed(back), strict=True):
            yield (*summed, *name, before[state], state)
            state = before[state]

    return _run_by_key(dealt, SUMMED, one)


def _repair_long(rows: DataFrame) -> DataFrame:
    """Very long conversations. A hash over a whole conversation needs its text in order in one task; it streams through, a chunk at a time."""
    chunks = materialize(_chunks(rows), "chunks")
    chosen = materialize(_choose(chunks), "chosen")
    same = [F.col("a.conv").eqNullSafe(F.col("b.conv")), F.col("a.part") == F.col("b.part"), F.col("a.seq") == F.col("b.seq")]
    both = chunks.alias("a").join(chosen.alias("b"), same[0] & same[1] & same[2])
    names = [c.split()[0] for c in SUMMED.split(", ")[:8]]
    slim = both.select("a.conv", "a.part", "a.seq", *[f"b.{c}" for c in names], "b.into", "b.out", "a.n", "a.weights", "a.turns", "a.roles", "a.texts")
    dealt = slim.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "seq")

    def one(conv, own: Iterator[tuple]) -> Iterator[tuple]:
        digest, audit, begun = hashlib.sha256(), [], False

        def put(lines: list[str]) -> None:
            nonlocal begun
            for line in lines:
                digest.update((("\n" if begun else "") + line).encode())
                begun = True

        for (_, _, _, gaps, blank, duplicate, truncated, illegal, cost, tail, state, into, out, n, weights, turns, roles, texts) in own:
            some = letters_of(int.from_bytes(weights[4 * into + out], "big"), n)
            audit.append(some)
            put(apply_edits(list(zip(turns, roles, texts, strict=True)), some, into)[0])
        audit.append("I" * tail)
        put(apply_edits([], audit[-1], state)[0])
        yield gaps, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()

    return _run_by_key(dealt, FOUND, one)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           long_weight: int = LONG_WEIGHT) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (null first), then role and text. A null role or text is one space; rows without a conversation id are one
    conversation. Conversations of ordinary weight are streamed one by one; heavier ones go through chunks. Read ``turns`` from storage, as weights are counted first. An
    empty table gives no row; other columns are ignored.
    """
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    heavy = rows.groupBy("conv").agg(F.sum(F.octet_length("text") + ROW_WEIGHT).alias("weight")).filter(F.col("weight") > long_weight).select("conv")
    plain, found = rows, []
    if heavy.take(1):
        heavy = materialize(heavy, "heavy")
        same = F.col("a.conv").eqNullSafe(F.col("b.conv"))
        plain = rows.alias("a").join(heavy.alias("b"), same, "left_anti")
        found = [_repair_long(rows.alias("a").join(heavy.alias("b"), same, "left_semi"))]
    dealt = plain.repartition("conv").sortWithinPartitions(*_ordered(plain))
    found.append(_run_by_key(dealt, FOUND, lambda conv, own: iter([repair_one([r[1:] for r in own])])))
    whole = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return whole.withColumnRenamed("conv", conv_id)


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows harmed by the CRC-32 of `conv_id:turn` (null: a space) modulo 20: 0 drops one, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it the user's. A null role or text becomes a space. Other columns go."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    harm = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    said, by = F.coalesce(F.col(text).cast("string"), F.lit(" ")), F.coalesce(F.col(role).cast("string"), F.lit(" "))
    harmed = turns.select(F.col(conv_id).alias(conv_id), F.col(turn).alias(turn), F.when(harm == 4, "user").otherwise(by).alias(role),
                          F.when(harm == 1, "").when(harm == 2, F.translate(said, ".!?", "")).otherwise(said).alias(text),
                          F.explode(F.array_repeat(F.lit(0), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).cast("int"))).alias("_copy"))
    return harmed.select(conv_id, turn, role, text)


def damage_and_repair(turns: DataFrame, conv_id: str = "conv_id", **names) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conversation of ``turns``; one that lost all its rows has zeros, no audit and the hash of nothing."""
    repaired = repair(damage(turns, conv_id, **names), conv_id, **names)
    ids = turns.select(F.col(conv_id).alias(conv_id)).distinct()
    both = ids.alias("a").join(repaired.alias("b"), F.col(f"a.{conv_id}").eqNullSafe(F.col(f"b.{conv_id}")), "left")
    zeros = [F.coalesce(F.col(f"b.{c}"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col(f"a.{conv_id}").alias(conv_id), *zeros, F.coalesce("b.audit", F.lit("")).alias("audit"),
                       F.coalesce("b.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
