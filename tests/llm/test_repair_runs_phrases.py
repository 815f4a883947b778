"""Conversation repair, periodic runs and repeated phrases against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import phrases, repair, runs

LEGAL = re.compile(r"(s?(ua)+)?\Z")


# ---- conversation repair ---------------------------------------------------------------------------------

def slow_best(symbols):
    """Cheapest (cost, audit) by trying all edits, with up to three insertions in each gap."""
    found = []
    options = []
    for s in symbols:
        edits = [("D", "", 3)]
        if s != "d":
            extra = int(s.isupper())
            if s != "x":
                edits.append(("K", s.lower(), extra))
            edits += [("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        options.append(edits)
    gaps = [("", "", 0)] + [("I" * n, "".join(t), 2 * n) for n in (1, 2) for t in itertools.product("ua", repeat=n)]
    for chosen in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(symbols) + 1):
            parts = [x for pair in zip(ins, [*chosen, ("", "", 0)]) for x in pair]
            if LEGAL.match("".join(p[1] for p in parts)):
                found.append((sum(p[2] for p in parts), "".join(p[0] for p in parts)))
    return min(found)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_chart_equals_all_edits(n):
    for symbols in itertools.product("dsuaxSUAX", repeat=n):
        assert repair.best(repair.span_cells("".join(symbols))) == slow_best(symbols)


def test_chart_equals_all_edits_of_three_rows():
    rng = random.Random(3)
    for _ in range(25):
        symbols = "".join(rng.choice("dsuaxSUAX") for _ in range(3))
        assert repair.best(repair.span_cells(symbols)) == slow_best(symbols)


def walked(symbols):
    """Cheapest (cost, audit) by a walk over the places, row by row."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(cells):
        todo = list(cells)
        while todo:
            p = todo.pop()
            for c in "ua":
                if (p, c) in step:
                    q, new = step[p, c], (cells[p][0] + 2, cells[p][1] + "I")
                    if q not in cells or new < cells[q]:
                        cells[q] = new
                        todo.append(q)
        return cells

    cells = inserted({0: (0, "")})
    for s in symbols:
        new = {}

        def put(q, cost, audit):
            if q not in new or (cost, audit) < new[q]:
                new[q] = (cost, audit)

        for p, (cost, audit) in cells.items():
            put(p, cost + 3, audit + "D")
            if s != "d":
                extra = int(s.isupper())
                if (p, s.lower()) in step:
                    put(step[p, s.lower()], cost + extra, audit + "K")
                for c in "ua":
                    if (p, c) in step:
                        put(step[p, c], cost + 2 + extra, audit + "R")
        cells = inserted(new)
    return min(cells[q] for q in (0, 3) if q in cells)


def test_blocks_of_any_length_equal_the_walk():
    rng = random.Random(4)
    for n in [*range(0, 60), 200, 500]:
        symbols = "".join(rng.choices("dsuaxSUAX", weights=[2, 1, 8, 8, 1, 1, 3, 3, 1], k=n))
        assert repair.best(repair.span_cells(symbols)) == walked(symbols), symbols


def slow_repair(rows):
    """conv -> report, from (conv, turn, role, text) after damage."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults, symbols = set(), [], ""
        for _, _, role, text in turns:
            said = text.strip(" \t\n\r\x0b\x0c")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            h = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "d" if fault in ("blank", "duplicate") else h.upper() if fault else h
        cost, audit = walked(symbols)
        left, i, place = [], 0, "a"
        for e in audit:
            if e != "D":
                role = turns[i][2] if e == "K" else "assistant" if place == "u" else "user"
                left.append(f"{role}:{'' if e == 'I' else turns[i][3]}")
                place = role[0]
            i += e != "I"
        assert LEGAL.match("".join(x[0] for x in left))
        ids = [r[1] for r in turns if r[0]]
        heads = [r[2][:1] for r in turns]
        out[c] = (len(turns), max(ids) - min(ids) + 1 - len(set(ids)) if ids else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", " \t", "Why?", "Été!", "a\nb.", "…", "x" * 3000 + ".", None, "No."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, rng.choice([None, 0, 1, 2, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts)) for c in range(150) for _ in range(rng.randint(1, 9))]
    rows += [(None, t, "user", "Hm.") for t in (1, None, 1)] + [(-7, 4, "user", "Again.")] * 40
    # one conversation of half of all rows, over many pieces and tasks
    rows += [(1000, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randrange(4000)}{rng.choice(['.', '', '?'])}") for t in range(0, 9000, 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cells", F.lit(1)).withColumn("Part", F.lit("x"))
    done = repair.repair(df.repartition(7))
    names = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[c] for c in names) for r in done.report.collect()}
    want = slow_repair(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c
    turns = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r["part"] is None, r["part"] or 0, r["seq"] or 0)):
        turns.setdefault(r["conv_id"], []).extend(f"{t['role']}:{t['text']}" for t in r["repaired"])
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in turns.items()} == {c: want[c][-1] for c in want}


def test_repair_of_nothing(spark):
    empty = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.report.count() == 0 and empty.turns.count() == 0


# ---- periodic runs ---------------------------------------------------------------------------------------

def slow_lyndon(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:
            j += 1
        out.append(j - i)
    return out


def slow_runs(words, least):
    """Stretches of each period by comparing all words with those a period on; the smallest period of equal stretches counts."""
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words])
    found = {}
    for q in range(1, len(x) // 2 + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e + q - s >= max(least, 2 * q):
                found.setdefault((s, e + q - s), q)
    return sorted([(s, m, q) for (s, m), q in found.items()], key=lambda r: (r[0], r[2]))


def random_words(rng):
    x = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(0, 45))]
    if rng.random() < 0.5:
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        x = x[:rng.randrange(0, 12)] + root * rng.randrange(2, 7) + x[:5] + root * 2
    return x


def test_lyndon_lengths_and_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(1500):
        x, least = random_words(rng), rng.choice([2, 3, 4, 6, 12])
        assert runs.lyndon_lengths(x) == slow_lyndon(x)
        assert runs.runs_of(x, least) == slow_runs(x, least)


def test_runs_of_whole_texts(spark, docs_of):
    rng = random.Random(7)
    texts = [rng.choice([" ", "\n", "\t\x0b "]).join(f"w{c}" for c in random_words(rng)) for _ in range(120)]
    texts += [None, "", " \n", "a " * 5000, "Tag x " * 30, "ab cd " * 6, "p q r " * 4 + "p", " ".join("zz" for _ in range(40))]
    texts.append(" ".join(str(rng.randrange(9000)) for _ in range(6000)) + " " + " ".join(str(i) for i in range(700)) * 3)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts + texts[:20])]
    got = runs.periodic_runs(docs_of(rows).repartition(3), keep=["doc_id", "text", "spans"]).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r["row"]["text"] or "").encode().split()
        want = slow_runs(words, 12)
        assert [tuple(x) for x in r["runs"]] == want and r["n_words"] == len(words)
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert r["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert runs.periodic_runs(docs_of([])).count() == 0


# ---- repeated phrases ------------------------------------------------------------------------------------

def slow_phrases(rows, size):
    docs = sorted({((d is None, d or 0), phrases.text_key((t or "").encode()), (t or "").encode()) for d, t in rows})
    first, gone = {}, {}
    for d, k, t in docs:
        words = t.split()
        cut = gone[d, t] = set()
        for i in range(len(words) - size + 1):
            if first.setdefault(tuple(words[i:i + size]), (d, k, i)) != (d, k, i):
                cut.update(range(i, i + size))
    out = []
    for d, t in rows:
        words, cut = (t or "").encode().split(), gone[(d is None, d or 0), (t or "").encode()]
        out.append((d, len(words), len(cut), b" ".join(w for i, w in enumerate(words) if i not in cut).decode()))
    return out


def phrase_rows(rng):
    base = [" ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(0, 120))) for _ in range(40)]
    passages = [" ".join(f"p{j}.{rng.randrange(9)}" for _ in range(rng.randrange(4, 60))) for j in range(6)]
    texts = []
    for _ in range(150):
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            at = rng.randrange(len(words) + 1)
            words[at:at] = (rng.choice(passages) + " ").split() * rng.choice([1, 1, 2])
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "changed"
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    texts += [None, "", "one", " ".join("la" for _ in range(300)), " ".join("la" for _ in range(25)), " ".join("x" for _ in range(60))] + texts[:5]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(None if i % 17 == 0 else i // 2 if i % 11 == 0 else i, t) for i, t in zip(ids, texts)]
    return rows + rows[:15]


@pytest.mark.parametrize("size,gram,hot,shard", [(20, 8, 5000, 30_000), (6, 3, 3, 40), (20, 8, 2, 50), (4, 4, 5000, 1)])
def test_phrases_equal_brute_force(spark, docs_of, monkeypatch, size, gram, hot, shard):
    monkeypatch.setattr(phrases, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(phrases, "SHARD_WINDOWS", shard)
    rows = phrase_rows(random.Random(size + hot))
    out = phrases.without_later_phrases(docs_of(rows).repartition(5), size, gram)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r) for r in out.collect()], key=order) == sorted(slow_phrases(rows, size), key=order)


def test_phrases_of_nothing(spark, docs_of):
    assert phrases.without_later_phrases(docs_of([])).count() == 0
    assert [tuple(r) for r in phrases.without_later_phrases(docs_of([(1, None), (2, "")])).collect()] == [(1, 0, 0, ""), (2, 0, 0, "")]


def test_a_phrase_in_a_third_of_all_documents_is_kept_once(spark, docs_of):
    word = itertools.count()
    phrase = " ".join(f"common{i}" for i in range(30))
    own = lambda: " ".join(f"o{next(word)}" for _ in range(25))
    rows = [(i, f"{own()} {phrase} {own()}" if i % 3 == 0 else own()) for i in range(900)]
    out = {r["doc_id"]: r["n_removed"] for r in phrases.without_later_phrases(docs_of(rows)).collect()}
    assert out == {i: 30 if i % 3 == 0 and i else 0 for i in range(900)}
