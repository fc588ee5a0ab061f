"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from helpers_llm import multiset

from faultscope.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, k_conv string, part long, no long, digest string, symbol int, copies int"
SPACED = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def allowed(state, initial):
    """Where keeping a row with this initial leads, if it is allowed."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))


def cheapest(rows, faults):
    """(cost, audit) from every place and state, the least of all edits, ties by the string."""
    best = {s: ((0, "") if s in ("", "a") else (10**9, "")) for s in NEXT}

    def with_inserts(best):
        for _ in range(3):
            best = {s: min(b, (3 + best[NEXT[s]][0], "I" + best[NEXT[s]][1])) for s, b in best.items()}
        return best

    ways = [best := with_inserts(best)]
    for (_, role, _), fault in zip(reversed(rows), reversed(faults)):
        new = {}
        for s in NEXT:
            options = [(4 + best[s][0], "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                to = allowed(s, role[:1])
                if to:
                    options.append((more + best[to][0], "K" + best[to][1]))
                options.append((3 + more + best[NEXT[s]][0], "R" + best[NEXT[s]][1]))
            new[s] = min(options)
        ways.append(best := with_inserts(new))
    return best[""]


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        got = damaged([r for r in rows if r[0] == conv])
        seen, faults = set(), []
        for _, role, text in got:
            marks = SPACED.findall(text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in got if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        cost, audit = cheapest(got, faults)
        state, lines, i = "", [], 0
        for letter in audit:
            if letter == "D":
                i += 1
            elif letter == "K":
                state = allowed(state, got[i][1][:1])
                lines.append(got[i][1] + ":" + got[i][2])
                i += 1
            else:
                state = NEXT[state]
                lines.append(FULL[state] + ":" + ("" if letter == "I" else got[i][2]))
                i += letter == "R"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "d", 3, 4) for r in rows], SCHEMA)


def talk(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        turn = rng.randint(-2, 3)
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", "", None, "assistant", "user", "Sys", "super"]])
        for i in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "No", " \n", None, "", "Why?  ", "é!", "long " * 50 + ".", f"own {i} {rng.random()}.", f"own {i}!"])
            rows.append((c, None if rng.random() < 0.05 else turn, roles[i % 2] if rng.random() < 0.6 else rng.choice(roles), text))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    rows += rng.sample(rows, len(rows) // 20)
    rng.shuffle(rows)
    return rows


def test_edits_against_search():
    """Symbols alone: costs and audits of all short and of random long conversations."""
    machine, rng = cv.automaton(), random.Random(1)
    names = {0: ("user", "blank")} | {1 + 2 * k + t: (r, "truncated" * t) for k, r in enumerate(["system", "user", "assistant", "tool"]) for t in (0, 1)}
    cases = [[a, b, c] for a in range(9) for b in range(9) for c in range(9)] + [[]] + [[rng.randrange(9) for _ in range(rng.randint(1, 40))] for _ in range(400)]
    for case in cases:
        codes = machine.codes(case)
        _, vector, total = machine.backward(codes, 0)
        letters, state = machine.edits(codes, 0, cv.START)
        want = cheapest([(0, names[s][0], "") for s in case], [names[s][1] for s in case])
        assert (total + machine.vectors[vector][cv.START], letters + machine.ending(state)) == want, case


@pytest.mark.parametrize("piece_rows", [5, 4096])
def test_repair(spark, piece_rows):
    rows = talk(2, [*range(120), None, 10**15], 9) + talk(3, [500, 501], 260)
    got = cv.repair(frame(spark, rows).repartition(5), piece_rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert multiset(got.collect()) == multiset(expected(rows))


def test_hot_conversation(spark):
    """One conversation over many tasks, one turn and text of it very often."""
    rows = talk(4, [7], 1500) + [(7, 40, "user", "Again.")] * 300 + talk(5, range(20, 50), 6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        landed = cv.pieces(frame(spark, rows), 100)
        assert landed.where("open and k_conv = '=7'").select("part").distinct().count() > 3
        assert multiset(cv.repair(frame(spark, rows), 100).collect()) == multiset(expected(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_edges(spark):
    assert cv.repair(frame(spark, [])).count() == 0
    dropped = [(c, t) for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = [(c, t, "user", "gone") for c, t in dropped[:5]] + [(None, None, None, None), (1000, None, "user", "x" * 300_000 + "."), (1000, None, "assistant", None)]
    assert multiset(cv.repair(frame(spark, rows)).collect()) == multiset(expected(rows))
