"""Vector near duplicates, lexical search and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, label int, kept string, n_links int"


def vector_rows() -> list[tuple]:
    """Copies, a tight group, a loose chain, pairs near the threshold, vectors that link with nothing, clashing columns."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x)
    out = [unit(rng.normal(size=24)) for _ in range(60)]
    base = unit(rng.normal(size=24))
    out += [unit(base + 0.02 * rng.normal(size=24)) for _ in range(40)] + [base] * 6
    step = unit(rng.normal(size=24))
    for k in range(12):  # each is like its neighbours only
        out.append(unit(step + 0.3 * k * unit(out[k])))
    for cos in np.linspace(0.9, 0.96, 25):
        x, z = unit(rng.normal(size=24)), rng.normal(size=24)
        z = unit(z - (z @ x) * x)
        out += [x, 3.5 * (cos * x + math.sqrt(1 - cos * cos) * z)]
    rows = [(k, [float(np.float32(c)) for c in v], k % 2 if k < 60 else 7, "clash", 9) for k, v in enumerate(out)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 0.0], [1.0, 0.1], [1.0]]
    rows += [(1000 + k, v, 7, None, None) for k, v in enumerate(odd)]
    rows += [(2000, rows[61][1], None, "x", 1), (2001, rows[61][1], 3, "x", 1), (None, rows[61][1], 7, "x", 1), (61, rows[61][1], 7, "x", 1)]
    return rows


def brute_vectors(rows: list[tuple], threshold: float = 0.93) -> list[tuple]:
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) and lab is not None for _, v, lab, *_ in rows]
    near = [set() for _ in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                near[a].add(b)
                near[b].add(a)
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((row[0], len(near[k]), least, row[0] is not None and row[0] == least))
    return out


@pytest.mark.parametrize("block", [4096, 12])
def test_vector_links_against_all_pairs(spark, block):
    from quillspark.llm.vector_dedup import near_duplicate_vectors

    rows = vector_rows()
    got = near_duplicate_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), block=block)
    assert {"kept_", "n_links_", "label"} <= set(got.columns)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=key) == sorted(brute_vectors(rows), key=key)


def test_vector_edges(spark):
    from quillspark.llm.vector_dedup import near_duplicate_vectors

    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    none = near_duplicate_vectors(spark.createDataFrame([(1, None, 2, None, None), (None, [0.0], 2, None, None)], VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in none) == [(0, 0, None, False), (1, 0, 1, True)]


def test_estimates_are_unbiased_within_their_bounds():
    from quillspark.llm import vector_dedup as vd

    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for cos in (0.0, 0.5, 0.93):
        y = cos * x + math.sqrt(1 - cos * cos) * z
        a, b = x @ vd.rotation(64, 0).T, y @ vd.rotation(64, 0).T
        code = np.packbits(a > 0, axis=1).view(np.uint64)
        got, bound = vd.estimates(code, np.abs(a).sum(1) / 8, *vd._quantised(b))
        assert abs(got.mean() - cos) < 0.01
        assert (np.abs(got - cos) <= bound).mean() > 0.999


def test_recall_of_buckets_at_the_threshold():
    from quillspark.llm import vector_dedup as vd

    for bits in (8, 20, 34):
        n = vd.rounds(bits, 64, 0.93)
        rng = np.random.default_rng(9)
        x, z = rng.normal(size=(2, 3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        met = np.zeros(3000, bool)
        for r in range(n):
            (a, am), (b, bm) = vd._keys(x @ vd.rotation(64, r).T, bits), vd._keys(y @ vd.rotation(64, r).T, bits)
            met |= ((a ^ b) & ~(am | bm)) == 0
        assert met.mean() >= 0.98


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    fold = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(k, Counter(fold(t))) for k, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            n = sum(bag.values())
            if not n:
                continue
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in fold(text) if bag[w])
            if score:
                found.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(found)[:top], 1)]
    return out


def search_rows() -> tuple[list[tuple], list[tuple]]:
    r = random.Random(8)
    vocabulary = [*"abcdefgh", "École", "ÉCOLE", "naïve", "Zebra", "x1", "日本", "end"]
    docs = [(k, " ".join(r.choice(vocabulary) + r.choice(["", ".", "_", "-A"]) for _ in range(r.randint(1, 12)))) for k in range(80)]
    docs += [(100 + k, "a b zebra") for k in range(30)] + [(None, "a b zebra"), (5, "a b zebra"), (5, None), (200, ""), (201, "... --"), (202, "a " * 40_000), (203, "zebra x1\x00x1\x7fx1")]
    items = [(1, "Zebra a a x1"), (2, "b École"), (2, "naïve ÉCOLE"), (3, None), (4, "nothing_here"), (None, "日本 end a"), (5, "zebra")]
    return docs, items


@pytest.mark.parametrize("item_bytes", [4 << 20, 40])
def test_search_against_every_document(spark, item_bytes):
    from quillspark.llm.lexical_search import ranked_search

    docs, items = search_rows()
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, score int, bag string").repartition(4)
    q = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, rank string")
    got = ranked_search(d, q, item_bytes=item_bytes).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_search(docs, items, 10)))


def test_search_edges(spark):
    from quillspark.llm import lexical_search as ls

    empty_d, empty_q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs, items = search_rows()
    some_d, some_q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ls.ranked_search(empty_d, some_q).count() == ls.ranked_search(some_d, empty_q).count() == ls.ranked_search(spark.createDataFrame([(1, None)], "doc_id long, text string"), some_q).count() == 0


TURNS = "conv_id long, turn long, role string, text string, audit string"
SPACES = " \t\n\x0b\f\r"


def brute_repair(rows: list[tuple]) -> tuple:
    """All edits of one conversation's rows (turn, role, text) tried; at most two insertions in a row can be cheap."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(SPACES)
        faults.append("blank" if not body.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None

    def go(at: int, cost: int, audit: str, out: list[tuple[str, str]], inserted: int) -> None:
        nonlocal best
        roles = "".join(r[:1] for r, _ in out)
        if best is not None and cost > best[0] or not re.fullmatch("s?(ua)*u?", roles):
            return
        if inserted < 2:
            for role in ("user", "assistant"):
                go(at, cost + 5, audit + "I", [*out, (role, "")], inserted + 1)
        if at == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
            return
        _, role, text = rows[at]
        go(at + 1, cost + 2, audit + "D", out, 0)
        if faults[at] not in ("blank", "duplicate"):
            more = 5 if faults[at] == "truncated" else 0
            go(at + 1, cost + more, audit + "K", [*out, (role, text)], 0)
            for to in ("user", "assistant"):
                go(at + 1, cost + 1 + more, audit + "R", [*out, (to, text)], 0)

    go(0, 0, "", [], 0)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        best[0], best[1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest(),
    )


def damage(rows: list[tuple]) -> dict:
    out: dict = {}
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def conversations(most: int) -> list[tuple]:
    r = random.Random(11)
    rows = []
    for conv in range(120):
        for turn in range(r.randint(1, most)):
            rows.append((conv, turn * r.choice([1, 1, 1, 2]), r.choice(["system", "user", "assistant", "user", "assistant", None, "tool", "a"]), r.choice(["Yes.", "No!", "Why?", "cut off", "Fine. \n", " \t", "", None, f"Text {turn}.", f"Text {turn}"]), "clash"))
    rows += [(None, 1, "user", "Hi.", ""), (None, None, "assistant", "Hi.", ""), (500, None, None, None, ""), (501, 7, "user", "Ok?", ""), (501, 7, "user", "Ok?", ""), (501, 7, "assistant", "Ok?", "")]
    gone = next(k for k in itertools.count(600) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "All gone.", "")]


def test_repairs_against_all_edits(spark):
    from quillspark.llm.conversation_repair import repaired

    rows = conversations(5)
    want = {conv: brute_repair(left) for conv, left in damage(rows).items()}
    got = {r.conv_id: tuple(r)[1:] for r in repaired(spark.createDataFrame(rows, TURNS).repartition(5)).collect()}
    assert got == want
    assert any(v[6] == "" for v in want.values())
    assert {*"".join(v[6] for v in want.values())} >= {*"DKR"}
    assert repaired(spark.createDataFrame([], TURNS)).count() == 0


def test_insertions_and_ties():
    """Rows that are worth keeping with an empty row beside them, and equal costs."""
    from quillspark.llm.conversation_repair import Repair

    r = random.Random(1)
    for trial in range(60):
        rows = [(k, r.choice(["user", "assistant", "system", "user"]), f"T{k}{r.choice(['.', '', '.'])}") for k in range(r.randint(1, 6))]
        if trial == 0:
            rows = [(k, "user", f"T{k}.") for k in range(4)]
        work, seen = Repair(), set()
        for t, role, text in rows:
            work.add(t, role, text, not text.strip(), (role, text) in seen, text[-1] not in ".!?")
            seen.add((role, text))
        assert work.result() == brute_repair(rows)


def test_long_conversations_stay_small(monkeypatch):
    """The undecided tail is short however long the conversation is, and sweeping changes nothing."""
    from quillspark.llm import conversation_repair as cr

    def run(sweep: int) -> tuple:
        monkeypatch.setattr(cr, "SWEEP", sweep)
        r, work, depth = random.Random(4), cr.Repair(), 0
        for k in range(3000):
            work.add(k, r.choice(["user", "assistant", "assistant", "user", "tool"]), f"text {k}.", r.random() < 0.05, r.random() < 0.05, r.random() < 0.2)
            depth = max(depth, max(n.depth for _, n in work.best.values()))
        return work.result(), depth

    (often, shallow), (never, deep) = run(64), run(1 << 30)
    assert often == never and deep >= 3000 and shallow < 400


def test_hash_collisions_are_seen_through(monkeypatch):
    from quillspark.llm import conversation_repair as cr

    monkeypatch.setattr(cr, "_PRIME", 1)  # all paths have one hash
    rng = random.Random(3)
    root = cr.Node(None, "", -1, None)
    nodes = [(root, "")]
    for _ in range(400):
        parent, said = rng.choice(nodes)
        edit = rng.choice("DIKR")
        nodes.append((cr.Node(parent, edit, 0, None), said + edit))
    for _ in range(2000):
        (a, x), (b, y) = rng.choice(nodes), rng.choice(nodes)
        assert cr.less(a, b) == (x < y)
