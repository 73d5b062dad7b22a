"""Line dedup, the conversation trie and ranked search against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import lines, ranking, tries

DOCS = "doc_id bigint, text string, h1 bigint, top string, rank int, lines int"
TURNS = "conv_id bigint, turn bigint, role string, text string, key string, depth int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", 1, 2) for i, t in rows], DOCS).repartition(3)


# --- lines


def plain_lines(rows):
    """doc_id, kept text: rows that share a doc_id are one document, null ids the smallest."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(low)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    gone = {k: max(ids, key=order) for k, ids in holders.items() if len(ids) >= 3}
    return [(i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in gone or gone[key(x)] == i)) for i, t in rows]


def line_rows():
    rng = random.Random(3)
    common = [f"This Line Number {k} is repeated by many" for k in range(12)]
    rows = []
    for i in range(200):
        own = [rng.choice(["", "short", f"own line of document {i} {j}", rng.choice(common), f"  {rng.choice(common).upper()}\t\r", "É" + "é" * 20, "x" * 19, "x" * 20]) for j in range(rng.randint(0, 9))]
        rows.append((i * 7 - 300, "\n".join(own)))
    rows += [(None, common[0]), (None, common[0]), (5, common[1]), (5, f"{common[1]}\n{common[2]}"), (6, None), (7, ""), (8, "\n\n"), (9, "\n".join([common[3]] * 5000)), rows[0], rows[0], (10**15, f"{common[4]}\r")]
    return rows


@pytest.mark.parametrize("batches", [1, 2, 5, 9])
def test_lines_by_counting(spark, batches):
    rows = line_rows()
    got = lines.kept_lines(docs_of(spark, rows), batches=batches).select("row.doc_id", "n_lines", "n_kept", "kept").collect()
    want = plain_lines(rows)
    same = lambda r: (str(r[0]), r[1], r[-1])
    assert sorted(map(same, got)) == sorted(map(same, want))
    assert all(r["n_kept"] == len(r["kept"].split("\n")) or not r["kept"] for r in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_runs_merge_by_levels_and_settled_keys_come_no_more(spark):
    runs = lines.LineRuns(spark, 3)
    batch = lambda ids, keys: spark.createDataFrame([(k, k, i) for i in ids for k in keys], "h1 bigint, h2 bigint, doc_id bigint")
    runs.add(batch([99, 98, 97], [1, 2]))
    assert [len(x) for x in runs.levels] == [1]
    later = batch([90, 89], [1, 2, 3, 4])
    plan = runs.unsettled(later)._jdf.queryExecution().executedPlan().toString()
    assert {(r["h1"], r["n"], r["top"]) for r in runs.unsettled(later).collect()} == {(3, 2, 90), (4, 2, 90)}
    assert plan.count("Exchange hashpartitioning") == 1 and "LeftAnti" in plan
    runs.add(later)
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add(batch([80], [3, 5]))
    assert [len(x) for x in runs.levels] == [1, 1]
    assert {tuple(r) for r in runs.settled().collect()} == {(1, 1, 99), (2, 2, 99), (3, 3, 90)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_drop_lines_keeps_columns(spark):
    docs = docs_of(spark, [(1, "a line that is in three documents\nown"), (2, "A line that is in three documents"), (3, " a line that is in three documents"), (4, None)])
    out = lines.drop_lines(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, "own"), (2, ""), (3, " a line that is in three documents"), (4, None)}
    assert lines.drop_lines(docs.limit(0)).collect() == []


# --- tries


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h, f = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        built[c] = own.get(f, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()
    )


def trie_rows():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(95, 130), 250, -3, -100, 10**12, 10**12 + 7]:
        for turn in range(rng.choice([1, 2, 3, 6, 9, 30])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else ("user", "assistant")[turn % 2], rng.choice(["a", "b", "ß€🙂"]) if turn else "hello"))
    rows += [(c, t, "user", f"same {t}") for c in range(5000, 9200) for t in range(3)]  # one conversation of very many, in several blocks of ids
    rows += [(300, None, "user", "first"), (300, None, None, None), (300, 1, "user", "tie"), (300, 1, "user", "tie"), (300, 1, "user", "other"), (None, 1, "user", "nobody"), (301, 5, None, None)]
    rows += [(400, t, "user", f"deep {t}") for t in range(700)] + [(403, t, "user", f"deep {t}" if t < 650 else "else") for t in range(660)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie_by_walking(spark, height):
    rows = trie_rows()
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], TURNS).repartition(3)
    got = tries.prefix_trie(tries.rebuilt(tries.numbered_turns(frame).cache()), height).collect()
    assert sorted(tuple(r) for r in got) == plain_trie(rows)


def test_bands_bound_what_a_node_makes(spark):
    nodes = spark.createDataFrame([(bytes([d + 1]) * 16, d, b"".join(bytes([a]) * 16 for a in range(d, d - (d % 4 or 4) if d else d, -1)), 1, 0) for d in range(9)], "key binary, depth bigint, up binary, leaves bigint, saved bigint")
    made = tries._to_ancestors(nodes, 0, 4)
    assert made.count() == sum((d % 4 or 4) for d in range(1, 9))


def test_empty_conversations(spark):
    assert tries.prefix_trie(tries.rebuilt(tries.numbered_turns(spark.createDataFrame([], TURNS)))).collect() == []


def test_turnless_conversation(spark):
    """A conversation with no more turns than it borrows, of a family without a first, ends at the root."""
    c = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 >= 2)
    frame = spark.createDataFrame([(c, 0, "user", "x", "", 0)], TURNS)
    (root,) = tries.prefix_trie(tries.rebuilt(tries.numbered_turns(frame))).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


# --- ranking


def plain_terms(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))


def plain_ranking(docs, items, k=10):
    tf = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    tf = [x for x in tf if x[2]]
    n, total = len(tf), sum(x[2] for x in tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in tf:
            m = 100 - 90 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(plain_terms(text)) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranking_rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé0") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    text = lambda n: rng.choice([" ", "-", ". ", "\x00"]).join(rng.choice(words[: rng.choice([15, 150])]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 120])).upper() if i % 5 == 0 else text(rng.choice([1, 5, 40]))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (None, "abc"), (2000, None), (2001, ""), (2002, "?!"), (3, docs[3][1]), (2003, "abc " * 30_000), (2004, "É é ÉÉ")]
    items = [(i, text(rng.choice([1, 3, 20]))) for i in range(60)] + [(60, None), (61, ""), (62, "nowhereword"), (7, "abc"), (63, docs[3][1]), (64, " ".join(words)), (None, words[0]), (65, "É")]
    return docs, items


@pytest.mark.parametrize(("group", "first"), [(1 << 20, 100), (600, 100_000)])
def test_ranking_by_full_scan(spark, group, first):
    docs, items = ranking_rows()
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = ranking.ranked_documents(docs_of(spark, docs), asked, group_bytes=group, first_round=first).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_ranking(docs, items)


def test_empty_sides(spark):
    docs, items = ranking_rows()
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert ranking.ranked_documents(docs_of(spark, docs), none).collect() == []
    assert ranking.ranked_documents(docs_of(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).collect() == []


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    weights = rng.integers(1, 9000, 400)
    groups = [np.arange(g * 40, g * 40 + 40) for g in range(10)]
    items = [(i, np.sort(rng.choice(groups[i % 10], 12, replace=False))) for i in range(50)]
    own = [np.sort(rng.choice(groups[g], 15, replace=False)) for g in rng.integers(0, 10, 6000)]
    values = [rng.integers(1, 900_000, len(t)) for t in own]
    search = ranking.Search(items, weights, np.zeros(50, np.int64))
    for at in range(0, 6000, 2000):
        part = slice(at, at + 2000)
        rows = ranking.Rows(np.cumsum([0, *(len(t) for t in own[part])]), np.concatenate(own[part]), np.concatenate(values[part]))
        search.add(rows, np.arange(at, at + 2000), np.ones(2000, bool))
    assert search.scored < search.seen / 2
    dense = np.zeros((6000, 400), np.int64)
    for i, (t, v) in enumerate(zip(own, values, strict=True)):
        dense[i, t] = v
    for number, terms in items:
        score = dense[:, terms] @ weights[terms]
        best = np.lexsort((np.arange(6000), -score))[:10]
        assert search.doc[number].tolist() == best.tolist() and search.score[number].tolist() == score[best].tolist()


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    from lexspark.llm import tokens

    vocabulary = ranking.Vocabulary([b"alpha", b"beta"])
    words = tokens.Words([b"alphx ALPHA beta"], True, ranking.GAP)
    words.hashes[0] = words.hashes[1]
    place, term = vocabulary.find(words)
    assert sorted(zip(place.tolist(), term.tolist(), strict=True)) == [(1, 0), (2, 1)]
