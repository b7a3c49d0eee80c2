import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from runqc.llm import conversations as C

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def edits(code):
    """(letter, cost, said initial or None for the place's own)."""
    out = [("D", 2, "")]
    if code not in "bd":
        late = 5 if code.isupper() else 0
        out += [("R", 1 + late, "u"), ("R", 1 + late, "a"), ("K", late, code.lower())]
    return out


def exhaustive(codes, spare):
    """All edit sequences with up to ``spare`` insertions: the least (cost, audit) whose roles are well formed."""
    best = None
    for n in range(spare + 1):
        for gaps in product(range(len(codes) + 1), repeat=n):
            if list(gaps) != sorted(gaps):
                continue
            choices = []
            for i in range(len(codes) + 1):
                choices += [[("I", 5, "u"), ("I", 5, "a")]] * gaps.count(i)
                if i < len(codes):
                    choices.append(edits(codes[i]))
            for way in product(*choices):
                if re.fullmatch("(s?(ua)+)?", "".join(w[2] for w in way)):
                    found = (sum(w[1] for w in way), "".join(w[0] for w in way))
                    best = found if best is None else min(best, found)
    return best


def walked(codes):
    """The same by carrying the best (cost, audit, roles) of every state through all rows; no splitting."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", "")}

    def add(to, state, cost, audit, said):
        to[state] = min(to.get(state, (10**9, "", "")), (cost, audit, said))

    def insert(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a, r) in list(out.items()):
                add(out, after[s], c + 5, a + "I", r + after[s])
        return out

    for code in codes:
        now = {}
        for s, (c, a, r) in insert(states).items():
            for letter, cost, said in edits(code):
                if said == "":
                    add(now, s, c + cost, a + letter, r)
                elif said == after[s] or said == "s" and s == "":
                    add(now, said, c + cost, a + letter, r + said)
        states = now
    return min(v for s, v in insert(states).items() if s in ("", "a"))


def plain(rows):
    """The whole contract row by row. ``rows``: (conv_id, turn, role, text), ties in turn already in order."""
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        luck = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if luck == 0:
            continue
        text = "" if luck == 1 else re.sub("[.!?]", "", text) if luck == 2 else text
        convs[conv] += [(turn, "user" if luck == 4 else role, text)] * (2 if luck == 3 else 1)
    out = []
    for conv, said in convs.items():
        said.sort(key=lambda r: -1 if r[0] is None else r[0])
        codes, seen = "", set()
        for _, role, text in said:
            end = text.strip(SPACES)[-1:]
            code = "b" if not end else "d" if (role, text) in seen else (role[:1] if role[:1] in "sua" and role else "o")
            codes += code.upper() if code not in "bd" and end not in ".!?" else code
            seen.add((role, text))
        turns = {t for t, _, _ in said if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:])]
        cost, audit, roles = walked(codes)
        lines, rest, roles = [], iter(said), iter(roles)
        for letter in audit:
            row = next(rest) if letter != "I" else (None, None, "")
            if letter != "D":
                name = {"u": "user", "a": "assistant"}.get(next(roles))
                lines.append((row[1] if letter == "K" else name) + ":" + row[2])
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, codes.count("b"), codes.count("d"), sum(c.isupper() for c in codes),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_all_sequences():
    rng = random.Random(1)
    for n in range(1, 5):
        for _ in range(12):
            codes = "".join(rng.choice("suaoUAObd") for _ in range(n))
            cost, audit, _ = walked(codes)
            assert exhaustive(codes, 2 if n > 2 else 3)[:2] == (cost, audit)
            assert C._solve(codes) == (audit, cost)


def test_long_conversations_and_pieces():
    rng = random.Random(2)
    for n in [5, 17, 64, 200, 333]:
        codes = "".join(rng.choice("suaoUAObd" if n % 2 else "uuaaUA") for _ in range(n))
        cost, audit, _ = walked(codes)
        assert C._solve(codes) == (audit, cost)
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(6))})
        parts = [C.Segment(codes[a:b]) for a, b in zip(cuts, cuts[1:])]
        costs = [p.costs() for p in parts]
        audits = [[p.audit(a, b) if m[a, b] < C.FAR else None for a in range(4) for b in range(4)] for p, m in zip(parts, costs)]
        total, chosen = C.joined(costs, audits)
        assert (total, "".join(chosen)) == (cost, audit)


@pytest.mark.parametrize("piece", [3, 1024])
def test_damage_and_repair(spark, piece):
    """One conversation has a third of the rows; NULLs, empty and long texts, repeated rows, other roles, extra columns."""
    rng = random.Random(piece)
    texts = ["Yes.", "No!", "why", "Is it?\n ", " \t\n", "", None, "a long text " * 500 + ".", "é?", "Yes.", "half a sent"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = [(conv, turn, rng.choice(roles[:4 + conv % 5]), rng.choice(texts)) for conv in range(60) for turn in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += [(1000, turn, rng.choice(roles), rng.choice(texts) or "x.") for turn in range(0, 400, 2)]
    rows += [(None, None, "user", "Lost."), (None, 4, "assistant", "Found."), (2000, None, "user", "Hm."), (2001, 7, "user", None)]
    rows += [(3000, 5, "user", "same.")] * 3
    df = spark.createDataFrame([r + (1, "x", "y", 2) for r in rows], "conv_id long, turn long, role string, text string, place int, codes string, audit string, own int")
    got = C.damaged_and_repaired(df, piece)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty_and_all_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.damaged_and_repaired(spark.createDataFrame([], schema)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = C.damaged_and_repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repair_without_damage(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi there"), (1, 3, "user", "Hi there"), (1, 5, "assistant", "Well.")]
    got = C.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert tuple(got[0])[:8] == (1, 1, 0, 1, 1, 2, 5, "KRDDK")
    assert got[0].repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hello.\nassistant:Well.").hexdigest()
