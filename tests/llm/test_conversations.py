"""Conversation repair against exhaustive search, on odd tables and on a conversation that does not fit its memory."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from salvage.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost long, there string"
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}


def damaged(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        yield from [(conv_id, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)


def judged(rows):
    """Every row's role, text and fault, in order."""
    seen, found = set(), []
    for _, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role, text, fault))
    return found


def all_edits(rows):
    """Every sequence of edits with up to two inserts in one place: cost, letters, what is written."""
    if not rows:
        yield 0, "", []
        yield 6, "II", ["user:", "assistant:"]
        yield 3, "I", ["user:"]
        yield 3, "I", ["assistant:"]
        return
    role, text, fault = rows[0]
    own = [(4, "D", [])]
    if fault not in ("blank", "duplicate"):
        extra = 3 * (fault == "truncated")
        own.append((extra, "K", [f"{role}:{text}"]))
        own += [(3 + extra, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
    rest = list(all_edits(rows[1:]))
    before = [(0, "", []), *((3, "I", [f"{r}:"]) for r in ("user", "assistant"))]
    before += [(6, "II", ["user:", "assistant:"]), (6, "II", ["assistant:", "user:"])]
    for a in before:
        for b in own:
            for c in rest:
                yield a[0] + b[0] + c[0], a[1] + b[1] + c[1], a[2] + b[2] + c[2]


def cheapest(rows):
    legal = (e for e in all_edits(rows) if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in e[2])))
    cost, letters, written = min(legal, key=lambda e: e[:2])
    return cost, letters, "\n".join(written)


def stepwise(rows):
    """The same for long conversations, with whole strings for every state."""
    follows = {"-": "su", "s": "u", "u": "a", "a": "u"}
    states = {"-": (0, "")}
    for role, _, fault in rows:
        after = {}

        def put(state, cost, letters):
            after[state] = min(after.get(state, (cost, letters)), (cost, letters))

        # An insert before the row is tried from every state by itself: its letters come first.
        for state, (cost, letters) in states.items():
            for n in range(3):
                put(state, cost + 4, letters + "D")
                if fault not in ("blank", "duplicate"):
                    extra = 3 * (fault == "truncated")
                    for s in follows[state]:
                        if s == role[:1]:
                            put(s, cost + extra, letters + "K")
                        if s != "s":
                            put(s, cost + 3 + extra, letters + "R")
                state, cost, letters = follows[state][-1], cost + 3, letters + "I"
        states = after
    ends = []
    for state, (cost, letters) in states.items():
        for n in range(3):
            if state in "-a":
                ends.append((cost, letters))
            state, cost, letters = follows[state][-1], cost + 3, letters + "I"
    return min(ends)


def expected(rows, solve):
    by_id = defaultdict(list)
    for conv_id in {r[0] for r in rows}:
        by_id[conv_id] = []
    for row in damaged(rows):
        by_id[row[0]].append(row)
    found = []
    for conv_id, own in by_id.items():
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        ordered = judged(own)
        faults = Counter(f for _, _, f in ordered)
        initials = [r[:1] for r, _, _ in ordered]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        found.append((conv_id, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *solve(ordered)))
    return sorted(found, key=repr)


def exhaustive(ordered):
    cost, letters, written = cheapest(ordered)
    return cost, letters, hashlib.sha256(written.encode()).hexdigest()


def found_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def repaired(spark, rows, **options):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    return conversations.repaired(conversations.damaged(table.repartition(3)), "there", **options)


def test_short_conversations_by_exhaustive_search(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", None, "", "User", "sage"]
    texts = ["Yes.", "No!", "Why?", "open end", "", None, " \n", "a. ", "ünï", "x\x00y."]
    rows = []
    for conv_id in range(150):
        weights = [6, 6, 3, 1, 1, 1, 1, 1]
        for turn in range(rng.randrange(1, 4)):
            rows.append((conv_id, rng.choice([turn, turn, turn, 2 * turn, None]), rng.choices(roles, weights)[0], rng.choice(texts)))
    rows = [r for r in rows if sum(x[0] == r[0] for x in rows) <= 3]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (2**62 + 1, 2**61, "system", "S."), (-5, -3, "user", "Q?"), (-5, 4, "assistant", "A.")]
    short = {i for i, n in Counter(r[0] for r in damaged(rows)).items() if n <= 3} | ({r[0] for r in rows} - {r[0] for r in damaged(rows)})
    rows = [r for r in rows if r[0] in short]
    assert found_rows(repaired(spark, rows)) == expected(rows, exhaustive)
    assert len(short) > 100


def test_rows_as_they_are_and_empty_tables(spark):
    rows = [(1, 0, "user", "Q?"), (1, 1, "assistant", "A."), (2, 0, "assistant", "A.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in conversations.repaired(table).collect()}
    assert (found[1].cost, found[1].audit) == (0, "KK") and (found[2].cost, found[2].audit) == (3, "IK")
    assert conversations.repaired(table.where("false")).count() == 0
    assert conversations.damaged(table.where("false")).count() == 0


def test_a_conversation_without_rows_is_empty(spark):
    conv_id = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = repaired(spark, [(conv_id, 0, "user", "gone")]).collect()
    assert [tuple(r) for r in found] == [(conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_giant_conversation_is_spilled_and_carried_over_batches(spark):
    rng = random.Random(9)
    rows = [
        (1, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["Yes.", "end", f"t{turn}.", f"t{turn}", ""]))
        for turn in range(2500)
    ] + [(2, 0, "user", "Q?")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        found = {r.conv_id: r for r in repaired(spark, rows, held=500).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {r.conv_id: r for r in repaired(spark, rows).collect()}
    assert found == whole
    ordered = judged([r for r in damaged(rows) if r[0] == 1])
    assert (found[1].cost, found[1].audit) == stepwise(ordered)
    written, k, state = [], 0, None
    for letter in found[1].audit:
        if letter in "IR":
            state = "assistant" if state == "user" else "user"
        if letter == "I":
            written.append(f"{state}:")
            continue
        role, text, _ = ordered[k]
        k += 1
        if letter == "K":
            state = role
        if letter in "KR":
            written.append(f"{state}:{text}")
    assert k == len(ordered)
    assert re.fullmatch("(s?(ua)+)?", "".join(w[:1] for w in written))
    assert found[1].repaired_sha256 == hashlib.sha256("\n".join(written).encode()).hexdigest()


def test_steps_agree_with_exhaustive_search():
    rng = random.Random(4)
    for _ in range(60):
        ordered = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice(["", "", "blank", "truncated"])) for _ in range(rng.randrange(4))]
        assert stepwise(ordered) == cheapest(ordered)[:2]
