"""Operators 11 to 13 against brute-force versions, on odd rows and on hot groups."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

import cambium.llm.prefix_trie as trie_module
from cambium.llm import exact_topk, filter_audit, prefix_trie

# -- 11 -----------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = {}
    size = lambda s: len((s or "").encode())
    for c, turn, role, text in rows:
        if c is not None:
            sha = hashlib.sha256(f"{size(role)}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, (role or "").encode(), sha), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(members[node]) - 1) * (size(node[-1][1]) if node else 0)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted(map(tuple, df.collect()), key=str)


def odd_turns():
    rng = random.Random(3)
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, None, None, None), (5, 1, "user", "é" * 5000), (6, 3, "a", "b"), (6, 3, "b", "a"), (6, 3, "ab", ""), (6, 3, "", "ab")]
    rows += [(-7, 1, "u", "hello"), (-5, 1, "u", "hello"), (-5, 2, "v", None), (2**62, 1, "u", "far"), (404, 2, "u", "no base")]
    for c in range(40, 90):  # forks of a few beginnings
        rows += [(c, t, "u" if t % 2 else "a", f"{t if rng.random() < 0.8 else rng.randint(0, 3)}") for t in range(rng.randint(1, 12))]
    rows += [(c, t, "u", f"revision {t}") for c in range(100, 160) for t in range(c - 99)]  # each goes on with the one before
    rows += [(c, t, "u", f"same {t}") for c in range(200, 500) for t in range(3)]
    rng.shuffle(rows)
    return rows


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(trie_module, "BLOCK", 4)  # conversations of many blocks
    monkeypatch.setattr(trie_module, "PIECE", 7)
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    for name in ("depth", "sha", "size", "part", "block", "digest", "up"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    assert nodes(prefix_trie.conversation_trie(df)) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).isEmpty()
    rows = [(7, 1, "u", "t")]  # nothing is left of its turns, its base is absent
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_a_long_conversation_is_cut(spark):
    """A third of all rows in one conversation: no part has it whole, and its turns are counted right."""
    rows = [(1, t, "u", str(t)) for t in range(600)] + [(c, 0, "u", "x") for c in range(2, 1200)]
    placed = prefix_trie.numbered(spark.createDataFrame(rows, TURNS), rows_per_part=100)
    got = {(r["conv_id"], r["pos"]): r["sha"] for r in placed.collect()}
    assert len(got) == len(rows) and all(bytes(got[1, t + 1]) == hashlib.sha256(f"1:u{t}".encode()).digest() for t in range(600))


# -- 12 -----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def brute_top(rows, k=20, every=20):
    known = set()
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.add((i, tuple(math.floor(64 * x) for x in v)))
    out = []
    for i, q in known:
        if i % every == 0:
            others = [(-max(-exact_topk.MOST, min(exact_topk.MOST, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in known if len(v) == len(q) and (i, q) != (j, v)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def as_float(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("bits, chunk", [(1, 8192), (3, 5), (6, 3)])
def test_exact_top_k(spark, bits, chunk):
    rng = random.Random(bits)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.1, -0.2, 0.3, -0.0, 0.0, 0.5]) for i in range(400, 700)]  # one vector holds a third
    rows += [(i, [rng.choice((-0.5, 0.5)) for _ in range(6)]) for i in range(700, 800)]  # ties
    rows += [rows[0], rows[20], (20, [9.0] * 6), (20, [8.0] * 6), (None, [9.0] * 6), (800, None), (820, [None] + [1.0] * 5), (840, [float("nan")] * 6), (860, [float("inf")] + [0.0] * 5)]
    rows += [(900, []), (901, []), (920, [1.0, 2.0]), (921, [2.0, 1.0]), (940, [7.0])]  # other lengths
    rows = as_float(rows)
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", *(f"'clash' AS {c}" for c in ("cid", "h", "v", "ids", "best", "rank"))).repartition(5)
    got = sorted(map(tuple, exact_topk.exact_top_k(df, bits=bits, chunk=chunk, rows_per_part=100).collect()))
    assert got == brute_top(rows)


def test_exact_top_k_of_large_numbers(spark):
    """Beyond what doubles hold, and beyond long."""
    rng = random.Random(9)
    rows = as_float([(i, [rng.choice((-1, 1)) * 2.0 ** rng.randint(0, 30) * rng.random() for _ in range(4)]) for i in range(150)] + [(i, [rng.choice((-1, 1)) * 1e38, rng.random(), 0.0, 1e30]) for i in range(150, 200)])
    got = sorted(map(tuple, exact_topk.exact_top_k(spark.createDataFrame(rows, VECTORS), k=30).collect()))
    assert got == brute_top(rows, 30)


def test_exact_top_k_of_nothing(spark):
    assert exact_topk.exact_top_k(spark.createDataFrame([], VECTORS)).isEmpty()
    assert exact_topk.exact_top_k(spark.createDataFrame([(1, [1.0]), (40, None)], VECTORS)).isEmpty()


def test_best_entries_as_they_come():
    rng = random.Random(3)
    best, every = exact_topk.Best(20, 4), []
    import numpy as np

    for _ in range(60):
        new = [(rng.randrange(20), rng.randint(-5, 5), rng.randint(0, 50), len(every) + k) for k in range(rng.randint(0, 25))]
        every += new
        best.add(*(np.array([x[k] for x in new], np.int64) for k in range(4)))
    for r in best.lists(np.arange(20)).to_pylist():
        want = sorted((-s, low, c) for q, s, low, c in every if q == r["qcid"])[:4]
        assert [(e["less"], e["low"], e["cid"]) for e in r["best"]] == want and best.kth[r["qcid"]] == (-want[3][0] if len(want) == 4 else -exact_topk.MOST - 1)


def test_bounds_hold_and_prune():
    import numpy as np

    rng = np.random.default_rng(5)
    v, q = np.floor(rng.normal(0, 8, (3000, 16))), np.floor(rng.normal(0, 8, (40, 16)))
    exact, reads = q @ v.T, []
    for bits in (1, 2, 4, 6):
        cells = exact_topk.Cells(v[:500], v.min(0), v.max(0), bits)
        upper = cells.upper(cells.codes(v), q)
        assert (upper >= exact).all()
        reads.append((upper >= np.sort(exact, 1)[:, -20:-19]).mean())
    assert reads == sorted(reads, reverse=True) and reads[-1] < 0.02  # finer cells, fewer exact vectors


# -- 13 -----------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        docs = []
        for i, text, lang in rows:
            if (lang or "") == part:
                text = text or ""
                w = re.findall(r"[^\x20\x09-\x0D]+", text)
                f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
                docs.append((f, i in good, i in toxic))
        for order in map("".join, itertools.permutations("ABCDE")):
            firsts = [next((s for s, c in enumerate(order, 1) if f[c]), 9) for f, *_ in docs]
            for step, c in enumerate(order, 1):
                both = list(zip(docs, firsts, strict=True))
                out[part, order, step] = [
                    sum(s > step for s in firsts), sum(s == step for s in firsts), sum(f[c] and s < step for (f, *_), s in both),
                    sum(f[c] and sum(f.values()) == 1 for f, *_ in docs), sum(s == step and g for (_, g, _), s in both), sum(s == step and t for (_, _, t), s in both),
                ]
        for c in "ABCDE":
            mine = [k for k in out if k[0] == part and k[1][k[2] - 1] == c]
            shapley = sum(out[k][1] for k in mine)
            for k in mine:
                out[k].append(shapley)
    return sorted((*k, *v) for k, v in out.items())


def test_filter_audit(spark):
    rng = random.Random(4)
    many = " ".join(f"word{i}" for i in range(250))
    texts = [None, "", " \n\t", many, many + " #", many.upper(), "same " * 300, "same\x0bword\r" * 200, "É ñ 漢字 🙂\x00\x1c", many.replace(" ", "\n") * 40, "A B C", "a$", "*"]
    rows = [(rng.choice([None, i, i // 2]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for i in range(300)]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [None, *range(0, 300, 2), *range(0, 50, 2)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *(f"'clash' AS {c}" for c in ("part", "sha", "A", "good", "toxic", "words", "n", "first")))
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r)[:-1] for r in got.collect()) == brute_audit(rows, labels)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got.collect())


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).isEmpty()
