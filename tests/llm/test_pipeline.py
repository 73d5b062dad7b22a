"""Every stage of the pipeline against a plain version, row by row, each on what its predecessor kept."""

import random
import re
from collections import Counter, defaultdict

import brute
import pytest

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ENGLISH = "the of and to in that was with for on are this from have not which but they were had one all would there their what so up out if about who get".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um".split()


def rows_of() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(9)
    say = lambda words, n: " ".join(rng.choice(words) + str(rng.choice(["", "", "ing", "en"])) for _ in range(n))
    passage = say(ENGLISH, 40)
    rows = []
    for i in range(220):
        words, lang = (ENGLISH, "en") if i % 3 else (GERMAN, "de")
        rows.append((i, say(words, rng.randint(30, 90)), rng.choice([lang, lang, None]), rng.choice(["a", "b", "c", None]), i))
    for i in range(220, 260):  # near copies
        words = rows[i - 220][1].split()
        words[rng.randrange(len(words))] = "other"
        rows.append((i, " ".join(words), rows[i - 220][2], "a", i))
    for i in range(260, 275):  # contaminated, and with a mere mention
        rows.append((i, f"{say(ENGLISH, 20)} {passage if i < 270 else ' '.join(passage.split()[:8])} {say(ENGLISH, 20)}", "en", "b", i))
    rows += [(280, "12 345 !?", "en", "a", 0), (281, None, "en", "a", 0), (282, "", "de", "b", 0)]
    rows += [(290 + k, "".join(rng.choice("абвгдежзик ") for _ in range(200)), None, "c", 0) for k in range(8)]  # like neither language
    return rows, [(1, passage), (2, None)]


def low_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def contaminated(text, items):
    w = low_words(text)
    hit = set()
    for _, item in items:
        q = low_words(item)
        m = min(len(q), 13)
        grams = {tuple(q[i : i + m]) for i in range(len(q) - m + 1)} if m else set()
        hit |= {j for i in range(len(w) - m + 1) if m and tuple(w[i : i + m]) in grams for j in range(i, i + m)}
    return bool(hit) and 20 * len(hit) >= len(w)


def targets(sizes: dict) -> dict:
    """Shares of 150 % of all words by weights 3, 1, 2, none over twice its source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returned."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, items = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {"documents": rows}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = [tuple(r) for r in docs.collect()]
    return out, items


def test_language_rejects_what_is_like_no_language(kept):
    rows, _ = kept
    gone = {280, 281, 282, *range(290, 298)}
    assert sorted(rows["language"]) == sorted(r for r in rows["documents"] if r[0] not in gone)


def test_one_of_each_group_of_near_duplicates(kept):
    rows, _ = kept
    roots = brute.components([(r[0], r[1]) for r in rows["language"]])
    want = sorted(r for r in rows["language"] if roots[r[0]][1] == r[0])
    assert sorted(rows["near_duplicates"]) == want and len(want) < len(rows["language"])


def test_contaminated_documents_go(kept):
    rows, items = kept
    want = sorted(r for r in rows["near_duplicates"] if not contaminated(r[1], items))
    assert sorted(rows["decontamination"]) == want
    assert {r[0] for r in rows["near_duplicates"]} - {r[0] for r in want} == set(range(260, 270))


def test_sources_come_to_their_targets(kept):
    rows, _ = kept
    before, after = rows["decontamination"], Counter(rows["mixing"])
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r[3]] += size(r)
    for r, n in after.items():
        assert r in before and n <= 2
        taken[r[3]] += n * size(r)
    want = targets(sizes)
    most = max(map(size, before))
    assert all(abs(taken[s] - want[s]) <= 2 * most for s in sizes), (dict(taken), want)


def test_shards_hold_every_row_once(kept):
    rows, _ = kept
    assert Counter(r[:5] for r in rows["sharding"]) == Counter(rows["mixing"])
    by = defaultdict(list)
    for r in rows["sharding"]:
        by[r[-2]].append(r[-1])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len(by) == 16 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
