"""Turn repair, periodic runs and sharding against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textward.llm import periods, sharding, turn_repair

TURN = "conv_id long, turn long, role string, text string, audit string"  # the last clashes with an output
GRAMMAR = re.compile(r"(s?(ua)+)?")


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TURN)


def faults_of(rows):
    """fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def options(role, fault):
    if fault in ("blank", "duplicate"):
        return [("D", 4, None)]
    more = 3 if fault == "truncated" else 0
    return [("K", more, role), ("R", 3 + more, "user"), ("R", 3 + more, "assistant"), ("D", 4, None)]


def exhaustive(rows):
    """The least (cost, audit, repaired) over all scripts with up to three inserts at each place."""
    faults = faults_of(rows)
    gaps = [list(x) for n in range(4) for x in itertools.product(["user", "assistant"], repeat=n)]
    best = None
    for edits in itertools.product(*[options(r[0], f) for r, f in zip(rows, faults, strict=True)]):
        for places in itertools.product(gaps, repeat=len(rows) + 1):
            audit, cost, out = "", 0, []
            for k, own in enumerate(places):
                audit += "I" * len(own)
                cost += 3 * len(own)
                out += [(r, "") for r in own]
                if k < len(rows):
                    audit += edits[k][0]
                    cost += edits[k][1]
                    out += [(edits[k][2], rows[k][1])] if edits[k][2] is not None else []
            if (best is None or (cost, audit) < best[:2]) and GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def strings(rows):
    """The same by whole strings: (cost, audit, repaired) at each state after each row."""
    def offer(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def closing(table):
        for _ in range(4):
            for state, (c, a, out) in list(table.items()):
                to, role = turn_repair.NEXT[state]
                offer(table, to, (c + 3, a + "I", [*out, (role, "")]))
        return table

    at = closing({0: (0, "", [])})
    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        after = {}
        for state, (c, a, out) in at.items():
            for edit, cost, new in options(role, fault):
                if edit == "D":
                    offer(after, state, (c + cost, a + "D", out))
                    continue
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((new[:1], state))
                if to is not None:
                    offer(after, to, (c + cost, a + edit, [*out, (new, text)]))
        at = closing(after)
    c, a, out = min(at[s] for s in (0, 3) if s in at)
    return c, a, "\n".join(f"{r}:{t}" for r, t in out)


SAID = ["Hello there.", "Yes", " \t", "", "No!", "Why?\n", "cut, here \x0b", "é."]
ROLES = ["system", "user", "assistant", "tool", "", "umpire"]


def test_string_version_is_the_exhaustive_one():
    rng = random.Random(5)
    for _ in range(25):
        rows = [(rng.choice(ROLES), rng.choice(SAID)) for _ in range(rng.randrange(3))]
        assert strings(rows) == exhaustive(rows), rows


def whole(rows):
    """The operator's columns for rows of one conversation (turn, role, text), in order."""
    said = [(r, t) for _, r, t in rows]
    faults = Counter(faults_of(said))
    own = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for r, _ in said]
    cost, audit, text = strings(said)
    return {
        "gaps": max(own) - min(own) + 1 - len(set(own)) if own else 0, **{f: faults[f] for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_repairs_are_the_cheapest(spark):
    rng = random.Random(6)
    talks = {k: [(rng.choice([None, 0, 1, 2, 3, 9]) if k % 5 == 0 else t, rng.choice([*ROLES, None] if k % 2 else ["user", "assistant"]), rng.choice([*SAID, None] if k % 3 else [f"Line {t}.", f"line {t}"])) for t in range(rng.randrange(1, 40))] for k in range(120)}
    talks[None] = [(0, "user", "Hi."), (0, "user", "Hi."), (None, "assistant", "Oh.")]
    talks[-1] = [(t, "x", f"{t}.") for t in range(3000)]
    talks[-2] = [(7, "user", "Same.")] * 500
    flat = [(k, *r) for k, rows in talks.items() for r in rows]
    rng.shuffle(flat)
    got = {r["conv_id"]: r.asDict() for r in turn_repair.repairs(turns_of(spark, flat)).collect()}
    assert set(got) == set(talks)
    for k, rows in talks.items():
        want = {"conv_id": k, "rows": len(rows), **whole(in_order(rows))}
        assert got[k] == want, k
    out = defaultdict(list)
    for r in turn_repair.repaired_turns(turns_of(spark, flat)).orderBy("conv_id", "place").collect():
        out[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {k: hashlib.sha256("\n".join(out[k]).encode()).hexdigest() for k in talks} == {k: r["repaired_sha256"] for k, r in got.items()}


def test_damaged_conversations(spark):
    rng = random.Random(7)
    table = [(k, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*SAID, None])) for k in range(400) for t in range(rng.randrange(1, 9))] + [(None, None, None, None), (5000, None, "user", "x.")]
    talks = defaultdict(list)
    for c, t, r, x in table:
        part = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if part == 1 else re.sub("[.!?]", "", x) if part == 2 else x
        talks[c] += [(t, "user" if part == 4 else r, x)] * {0: 0, 3: 2}.get(part, 1)
    got = {r["conv_id"]: r.asDict() for r in turn_repair.report(turns_of(spark, table)).collect()}
    assert len(got) == 402 and any(not rows for rows in talks.values())
    assert got == {k: {"conv_id": k, **whole(in_order(rows))} for k, rows in talks.items()}
    assert turn_repair.report(turns_of(spark, [])).count() == 0


def test_nothing_left_of_a_conversation(spark):
    c = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = turn_repair.report(turns_of(spark, [(c, 0, "user", "Hi.")])).first().asDict()
    assert row == {"conv_id": c, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def slow_runs(words, least=12):
    n = len(words)
    found = {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def word_lists():
    rng = random.Random(8)
    for n in [0, 1, 2, 11, 12, 13, 24, 50, 120, 300]:
        for letters in ("a", "ab", "abc", "abcdefghij"):
            yield [rng.choice(letters) for _ in range(n)]
    for n, p in ((100, 7), (200, 40), (333, 111), (61, 30), (24, 12), (23, 12)):
        base = [f"w{k}" for k in range(p)]
        yield [f"x{k}" for k in range(9)] + (base * n)[:n] + ["y"] * 12 + base[::-1] * 2
    a, b = ["a"], ["a", "b"]
    for _ in range(10):
        a, b = b, b + a
    yield b  # a Fibonacci word, full of runs
    yield ["a", "b"] * 3 + ["c"] * 12 + ["a", "b"] * 8
    for _ in range(30):
        words = []
        while len(words) < 150:
            words += [rng.choice("abcd") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 8)
        yield words


def test_runs_are_the_slow_ones(spark):
    lists = list(word_lists())
    texts = [" \n\t".join(w) for w in lists] + [None, "  ", " a  " * 20]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "a " * 12, 1)] * 2, "doc_id long, text string, runs int").repartition(3)
    got = {}
    for r in periods.periodic_runs(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[None]) == 2 and all([tuple(x) for x in r["runs"]] == [(0, 12, 1)] for r in got[None])
    for k, text in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        runs = slow_runs(words)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        (row,) = got[k]
        assert [tuple(x) for x in row["runs"]] == runs and row["n_words"] == len(words), words
        assert row["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_do_not_depend_on_blocks(monkeypatch):
    words = [w for w in word_lists()]
    ids = np.concatenate([np.append(np.array([ord(x[0]) * 1000 + int(x[1:] or 0) for x in w], np.int64), 500_000 + k) for k, w in enumerate(words)])
    lengths = np.array([len(w) for w in words])
    begins = np.cumsum(lengths + 1) - lengths - 1
    once = periods.runs_of(ids, begins, lengths)
    monkeypatch.setattr(periods, "PAIRS", 37)
    assert all((a == b).all() for a, b in zip(once, periods.runs_of(ids, begins, lengths), strict=True)) and len(once[0]) > 100


def test_report_of_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = periods.report(docs).collect()
    assert len(rows) == len(texts) and sum(r["n_runs"] > 0 for r in rows) > len(rows) / 20
    for r in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", texts[r["doc_id"]] or "") if w]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = slow_runs(words)
        gone = {i for a, m, q in runs for i in range(a + q, a + m)}
        best = min(((-m, a, q) for a, m, q in runs), default=None)
        want = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
        assert tuple(r)[1:8] == want


DOC = "doc_id long, text string, shard int"


def shard_docs(spark, n, more=()):
    return spark.createDataFrame([(k, "x" * (k % 50) + "é", 7) for k in range(n)] + list(more), DOC)


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 4999])
def test_shards_are_even_and_slots_gapless(spark, n):
    rows = sharding.report(shard_docs(spark, n)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        text = ("x" * (r["doc_id"] % 50) + "é").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_do_not_depend_on_partitions_and_take_repeats(spark):
    more = [(None, None, 1), (None, "a", 1), *[(3, f"copy {k % 7}", 1) for k in range(300)]]
    docs = shard_docs(spark, 2000, more)
    once = sorted(map(tuple, sharding.report(docs.repartition(3)).collect()), key=repr)
    assert once == sorted(map(tuple, sharding.report(docs.repartition(11).orderBy(docs.text.desc())).collect()), key=repr) and len(once) == 2302
    sizes = Counter(r[4] for r in once)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def slow_plan(counts, owner, room):
    """Row by row: own shard first, then what is left walks on."""
    room, out = list(room), defaultdict(list)
    left = []
    for arc, n in enumerate(counts):
        for r in range(n):
            if room[owner[arc]]:
                room[owner[arc]] -= 1
                out[owner[arc]].append((arc, r))
            else:
                left.append((arc, r))
    for arc, r in left:
        k = arc
        while not room[owner[k]]:
            k = (k + 1) % len(owner)
        room[owner[k]] -= 1
        out[owner[k]].append((arc, r))
    return out


def test_overflow_goes_clockwise():
    rng = random.Random(9)
    for _ in range(50):
        shards, virtual = rng.randrange(1, 6), rng.randrange(1, 5)
        owner = [k % shards for k in range(shards * virtual)]
        rng.shuffle(owner)
        counts = [rng.randrange(9) * rng.randrange(5) for _ in owner]
        for slack in (0.0, 0.25):
            room = sharding.bounds(sum(counts), shards, slack)
            out = defaultdict(dict)
            for arc, a, b, shard, slot in sharding.plan(counts, owner, room):
                for r in range(a, b):
                    out[shard][slot + r - a] = (arc, r)
            want = slow_plan(counts, owner, room)
            assert {s: [rows[k] for k in range(len(rows))] for s, rows in out.items()} == {s: v for s, v in want.items() if v}


def test_little_moves_where_shards_have_slack(spark):
    docs = shard_docs(spark, 20_000)
    of = lambda n, slack: {r["doc_id"]: (r["shard"], r["home"]) for r in sharding.assign(docs, shards=n, slack=slack).collect()}
    a, b = of(24, 0.25), of(25, 0.25)
    assert max(Counter(s for s, _ in a.values()).values()) <= 1 + 1.25 * 20_000 / 24
    moved = sum(a[k][0] != b[k][0] for k in a)
    assert 20_000 / 25 * 0.5 < moved < 20_000 / 25 * 2.5
    assert all(b[k][1] in (a[k][1], 24) for k in a)  # the ring alone moves rows into the new shard only
    even = of(24, 0.0)
    assert sum(s == h for s, h in even.values()) > 0.85 * 20_000
