"""Repairs against all edit sequences, and against rows of plain Python for whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import queries, repair

RNG = random.Random(12)
GOOD = re.compile("(s?(ua)+)?")


def all_edits(rows):
    """Cost and audit by trying every sequence of edits with at most two inserts in each gap. Rows are (initial, fault)."""
    inserts = [(), *itertools.product("ua"), *itertools.product("ua", "ua")]

    def edits(initial, fault):
        out = [("D", 4, "")]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            out += [("K", more, initial), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        return out

    best = None
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for chosen in itertools.product(*[edits(*r) for r in rows]):
            roles, audit, cost = "".join(gaps[0]), "I" * len(gaps[0]), 3 * len(gaps[0])
            for (letter, price, role), gap in zip(chosen, gaps[1:], strict=True):
                roles, audit, cost = roles + role + "".join(gap), audit + letter + "I" * len(gap), cost + price + 3 * len(gap)
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_strings(rows):
    """The same for many rows: the least (cost, audit) of every state, with audits as text."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(at):
        for _ in range(3):
            for state, (cost, audit) in list(at.items()):
                for role in "ua":
                    if (to := after[state].get(role)) is not None:
                        at[to] = min(at.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return at

    at = {0: (0, "")}
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in inserted(at).items():
            moves = [(state, cost + 4, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                moves += [(after[state][r], cost + 3 + more, audit + "R") for r in "ua" if r in after[state]]
                moves += [(after[state][initial], cost + more, audit + "K")] if initial in after[state] else []
            for to, price, letters in moves:
                new[to] = min(new.get(to, (10**9, "")), (price, letters))
        at = new
    return min(x for state, x in inserted(at).items() if state in (0, 3))


KINDS = {(i, f): k for k, (i, f) in zip("suaoSUAOX", [*itertools.product(["s", "u", "a", "x"], ["fine", "truncated"])][::2]
                                        + [*itertools.product(["s", "u", "a", "x"], ["fine", "truncated"])][1::2] + [("u", "blank")], strict=True)}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_edit_sequences(n):
    for rows in itertools.product(KINDS, repeat=n):
        assert repair.cheapest("".join(KINDS[r] for r in rows)) == all_edits(rows) == by_strings(rows), rows


@pytest.mark.parametrize("n", [3, 5, 12, 64, 65, 200, 1500])
def test_long_runs(n):
    for _ in range(40 if n < 100 else 3):
        rows = [RNG.choice([*KINDS]) for _ in range(n)]
        kinds = "".join(KINDS[r] for r in rows)
        cost, audit = by_strings(rows)
        assert repair.cheapest(kinds) == (cost, audit)
        best = min(x for x in repair.product(kinds + ".")[repair.START] if x is not None)
        assert (best >> repair.SLOT * (n + 1), repair.letters_of(best, n + 1)) == (cost, audit)


WHITE = " \t\n\x0b\x0c\r"
ROLES = ["user", "assistant", "system", "tool", "", "User", None, "user"]
SAID = ["Fine.", "Why?", "cut", "", " \t", None, "Ok! ", "a\xa0", "No.\n", "é。", "x" * 3000 + "."]
SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies int, _copy int, kinds string"


def made():
    rows = []
    for conv in [*range(60), None]:
        for k in range(RNG.randrange(1, 9)):
            turn = None if RNG.random() < 0.05 else k + RNG.randrange(3) * (RNG.random() < 0.2)
            role = ["user", "assistant"][k % 2] if RNG.random() < 0.7 else RNG.choice(ROLES)
            rows.append((conv, turn, role, RNG.choice(SAID)))
    rows += [(500, k, ["user", "assistant"][k % 2], f"Turn {k % 150}.") for k in range(400)]
    rows += [(501, 7, "user", "All the same.")] * 90 + [(502, None, "assistant", f"{k}") for k in range(30)]
    rows += [(600 + k, 0, "user", "Hi.") for k in range(200)]
    return [(*r, "a", 1, 2, "b") for r in rows]


ROWS = made()


def harmed(rows):
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)


def expected(rows, ids):
    out = []
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "fine" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = by_strings([(r[1][:1] if r[1][:1] in [*"sua"] else "x", f) for r, f in zip(own, faults, strict=True)])
        lines, k = [], 0
        for letter in audit:
            begins = bool(lines) and lines[0].startswith("s")
            forced = ["user", "assistant"][(len(lines) - begins) % 2]
            if letter == "I":
                lines.append(forced + ":")
            else:
                _, role, text = own[k]
                k += 1
                if letter != "D":
                    lines.append(f"{role if letter == 'K' else forced}:{text}")
        turns = {r[0] for r in own} - {None}
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_damaged_rows(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    rows = got(repair.damage_and_repair(turns))
    assert rows == expected([*harmed(ROWS)], {r[0] for r in ROWS})
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for r in rows)


@pytest.mark.parametrize("weight, most", [(600, 512), (600, 3), (0, 1), (1500, 40)])
def test_heavy_conversations_in_chunks(spark, monkeypatch, weight, most):
    """Chunks of a single row, of a few, and of whole conversations, in several ranges, give what whole conversations give."""
    monkeypatch.setattr(repair, "CHUNK_ROWS", most)
    turns = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, *_ in ROWS]
    assert got(repair.repair(turns, long_weight=weight)) == expected(plain, {r[0] for r in ROWS})


def test_other_ids_and_empty_tables(spark):
    turns = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), ("b", 5, "tool", "x.")], "k string, t int, r string, x string")
    rows = sorted(tuple(r)[:8] for r in repair.repair(turns, "k", "t", "r", "x").collect())
    assert rows == [("a", 0, 0, 0, 0, 0, 0, "KK"), ("b", 0, 0, 0, 0, 0, 4, "D")]
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.damage_and_repair(empty).count() == 0 and repair.repair(empty).count() == 0


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op12_conversation_repair"](spark, sf_dir)) == expected([*harmed(rows)], {r[0] for r in rows})
