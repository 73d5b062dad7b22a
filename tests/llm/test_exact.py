"""Operators against plain versions of what they compute."""

import random
import re
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import components, decontamination, fingerprints, induced, licenses, mixing, near_duplicates, phrases, repeats, secrets, sharding, substrings


def by_id(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def _small(monkeypatch):
    for name, value in (("PART_BYTES", 20_000), ("BUCKET_BYTES", 9_000), ("SHARD_BYTES", 12_000), ("FLUSH", 500)):
        monkeypatch.setattr(repeats, name, value)


@pytest.mark.parametrize(("small", "hot"), [(False, 50_000), (True, 50_000), (True, 3)])
def test_substrings(spark, corpus_dir, corpus_rows, monkeypatch, small, hot):
    """In one piece; in many; and with nearly all anchors split by content."""
    if small:
        _small(monkeypatch)
    monkeypatch.setattr(repeats, "HOT", hot)
    assert by_id(substrings.op2_substrings(spark, corpus_dir)) == brute.substrings([r[:2] for r in corpus_rows])


def test_substrings_on_disk(spark, corpus, corpus_rows):
    """The whole corpus as one shard, far larger than the limits: queues go to disk and seeds are sorted by recursion."""
    found = substrings.remove_substrings(corpus, digest=True, held=200, base=50)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"].hex()) for r in found.collect()}
    assert got == brute.substrings([r[:2] for r in corpus_rows])


def test_a_shard_larger_than_its_limits(tmp_path):
    rng = random.Random(7)
    bodies = [bytes(rng.choice(b"abc") for _ in range(rng.randint(50, 80))) for _ in range(300)]
    bodies += [bodies[i][:52] + b"zz" for i in range(0, 300, 3)]
    owner, n = np.array([rng.randint(0, 90) for _ in bodies]), np.array([len(b) - 49 for b in bodies])
    least = {}
    for o, b in zip(owner.tolist(), bodies, strict=True):
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(o, least.get(b[i : i + 50], o))
    want = [o > least[b[i : i + 50]] for o, b in zip(owner.tolist(), bodies, strict=True) for i in range(len(b) - 49)]
    (tmp_path / "large").mkdir()
    disk = induced.Disk(str(tmp_path), held=1_000, base=500)
    assert substrings.shared_windows(owner, n, bodies, 50, disk).tolist() == want
    assert disk.spilled > 10_000 and disk.depth > 1
    roomy = induced.Disk(str(tmp_path / "large"))
    assert substrings.shared_windows(owner, n, bodies, 50, roomy).tolist() == want
    assert roomy.spilled == 0 and roomy.depth == 1


@pytest.mark.parametrize(("small", "hot"), [(False, 50_000), (True, 50_000), (True, 3)])
def test_phrases(spark, corpus_dir, corpus_rows, monkeypatch, small, hot):
    if small:
        _small(monkeypatch)
        monkeypatch.setattr(phrases.remove_phrases, "__defaults__", (False, 20))
    monkeypatch.setattr(repeats, "HOT", hot)
    assert by_id(phrases.op6_phrases(spark, corpus_dir)) == brute.phrases([r[:2] for r in corpus_rows])


def test_equal_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 300).astype(np.uint8)
    a, b = rng.integers(0, 280, 200), rng.integers(0, 280, 200)
    a_end, b_end = a + rng.integers(1, 6, 200), b + rng.integers(1, 6, 200)
    want = [data[i:j].tolist() == data[k:m].tolist() for i, j, k, m in zip(a, a_end, b, b_end, strict=True)]
    assert repeats.same_bytes(data, a, a_end, b, b_end, step=7).tolist() == want and any(want)


@pytest.mark.parametrize("group", [5, 40, 10_000])
def test_nodes_of_suffix_trees(group):
    """Internal nodes of all groups are the word sequences that occur with two different next words, or twice at full depth."""
    rng = random.Random(group)
    bodies = [" ".join(rng.choice(["b", "a", "ab", "\x01c"]) for _ in range(rng.randint(6, 12))).encode() for _ in range(60)]
    depth = 6
    words, sizes = phrases.numbered(bodies)
    flat = [w for b in bodies for w in b.split(b" ")]
    assert [sorted(set(flat))[k] for k in words.tolist()] == flat
    starts = np.concatenate([np.arange(s - depth + 1) + o for s, o in zip(sizes, np.cumsum(sizes) - sizes, strict=True)])
    suffixes = [tuple(words[s : s + depth].tolist()) for s in starts]
    want = {}
    for d in range(1, depth + 1):
        for s in suffixes:
            want.setdefault(s[:d], []).append(s[d : d + 1])
    want = {k: len(v) for k, v in want.items() if len(v) > 1 and (len(k) == depth or len(set(v)) > 1)}
    got, groups = {}, list(phrases.by_prefix(words, starts, depth, group))
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(starts)))
    assert all(len(g) <= group or len({suffixes[i] for i in g}) == 1 for g in groups)
    for g in groups:
        order, shared = phrases.subtree(words, starts[g], depth)
        ordered = [suffixes[g[i]] for i in order]
        assert ordered == sorted(ordered)
        for d, first, end in phrases.internal_nodes(shared):
            for a, b in zip(first.tolist(), end.tolist(), strict=True):
                got[ordered[a][:d]] = got.get(ordered[a][:d], 0) + b - a
    deep = lambda nodes: {k: v for k, v in nodes.items() if len(k) == depth}
    assert deep(got) == deep(want)
    if len(groups) == 1:
        assert got == want
    place = (np.array([rng.randint(0, 5) for _ in suffixes]), np.zeros(len(suffixes), dtype=np.int64), np.arange(len(suffixes)))
    first = {}
    for s, p in zip(suffixes, zip(*(x.tolist() for x in place), strict=True), strict=True):
        first[s] = min(p, first.get(s, p))
    assert phrases.repeated(words, starts, place, depth, group).tolist() == [p > first[s] for s, p in zip(suffixes, zip(*(x.tolist() for x in place), strict=True), strict=True)]


def test_near_duplicates(spark, corpus_dir, corpus_rows, monkeypatch):
    want = brute.components([r[:2] for r in corpus_rows])
    for block, group, heavy in ((512, 12 << 20, 1000), (2, 500, 1)):  # the second splits every bucket into many blocks and groups
        for name, value in (("BLOCK", block), ("GROUP_BYTES", group), ("HEAVY", heavy)):
            monkeypatch.setattr(near_duplicates, name, value)
        got = by_id(near_duplicates.op10_near_duplicates(spark, corpus_dir))
        assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_all_texts_of_a_document_link(spark):
    words = lambda tag, cut=0: " ".join(f"{tag}{i}" for i in range(60 - cut))
    docs = [(5, words("a")), (5, words("b")), (6, words("a", 2)), (7, words("b", 2)), (8, words("c")), (9, words("c")), (9, words("d")), (12, words("d", 1)), (None, words("a")), (None, words("e")), (13, "")]
    rows = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (9, 8), (12, 8), (13, 13)]
    assert sorted(str(r["component_id"]) for r in rows if r["doc_id"] is None) == ["5", "None"]


@pytest.mark.parametrize("block", [512, 3])
def test_links_that_no_pivot_has(spark, monkeypatch, block):
    """Chains of texts that drift apart: neighbours are linked, ends are not; all of them share buckets."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for chain in range(6):
        words = base[:]
        for step in range(8):
            docs.append((chain * 100 + step, " ".join(words)))
            for _ in range(8):
                words[rng.randrange(len(words))] = f"x{chain}y{step}z{rng.random()}"
    rng.shuffle(docs)
    want = brute.components(docs)
    got = by_id(near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_blocks_of_large_buckets(spark):
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 300, 60).astype(np.uint64)) for _ in range(7)] for _ in range(2))
    assert near_duplicates.intersections(left, right, width=16).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(200, i) for i in range(201, 230)] + [(i, i + 1) for i in range(300, 330)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_induced_sorting(tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    for t in range(150):
        monkeypatch.setattr(induced, "BLOCK", int(rng.choice([3, 7, 1 << 18])))
        symbols = int(rng.integers(1, 5))
        text = rng.integers(1, symbols + 1, rng.integers(1, 120))
        text = np.tile(text[:5], 12) if t % 3 == 0 else text
        text = np.append(text, 0).astype(np.uint16)
        cap = int(rng.integers(1, 20))
        (tmp_path / str(t)).mkdir()
        out = list(induced.descending(text, cap, induced.Disk(str(tmp_path / str(t)), int(rng.choice([5, 50, 10**6])), int(rng.choice([2, 10**6])))))
        places, common = (np.concatenate(x) for x in zip(*out, strict=True))
        keys = [tuple(text[i : i + cap].tolist()) for i in places]
        assert sorted(places.tolist()) == list(range(len(text)))
        assert all(a >= b for a, b in zip(keys, keys[1:], strict=False))
        for a, b, n in zip(keys, keys[1:], common[1:].tolist(), strict=False):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_decontamination_and_mixing_against_sql(spark, corpus_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.register(t, spark.read.parquet(f"{corpus_dir}/{t}.parquet").toPandas())
    for f, sql in ((decontamination.op3_decontamination, decontamination.ORACLE), (mixing.op4_mixing, mixing.ORACLE)):
        got = f(spark, corpus_dir).toPandas()
        want = con.sql(sql).df()[list(got.columns)]
        assert sorted(map(tuple, got.astype(object).to_numpy().tolist())) == sorted(map(tuple, want.astype(object).to_numpy().tolist()))


def test_mix_meets_targets(spark, corpus):
    rows = mixing.mix(corpus).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - own[0]["target"]) <= 2 * max(r["size"] for r in own)
        assert all(r["copies"] <= 2 for r in own)
    copies = sum(r["copies"] for r in rows)
    assert mixing.mixed_documents(corpus).count() == copies


def test_spans_are_removed(spark, corpus_dir):
    docs, benchmark = (spark.read.parquet(f"{corpus_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = {r["doc_id"]: r["clean_text"] for r in decontamination.remove_spans(docs, benchmark).collect()}
    for r in decontamination.contamination(docs, benchmark).collect():
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", clean[r["id"]] or "")
        assert len(words) == r["n_words"] - r["n_hit"]


def test_sharding(spark, corpus, corpus_dir, tmp_path):
    rows = sharding.op1_sharding(spark, corpus_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in corpus.collect())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_records(corpus, bucket_bytes=3_000)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again.collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_records(corpus.repartition(5), bucket_bytes=3_000).collect()}
    sharding.write_shards(again, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


@pytest.mark.parametrize("small", [False, True])
def test_fingerprints(spark, corpus_dir, corpus_rows, monkeypatch, small):
    if small:
        monkeypatch.setattr(fingerprints.edit_documents, "__defaults__", (4_000,))
    import hashlib

    order = sorted(corpus_rows, reverse=True, key=lambda r: r[0])
    got = by_id(fingerprints.op8_fingerprints(spark, corpus_dir))
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        n, sha, own, other, near_edited, near_next = got[r[0]]
        assert (n, sha) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (own, other) == (fingerprints.digest(text), fingerprints.digest(edited))
        assert near_edited == (own == other) and near_next == (own == fingerprints.digest(following))


@pytest.mark.parametrize("bits", [25, 1])
def test_clashing_digests_are_told_apart(spark, monkeypatch, tmp_path, bits):
    """With digests of two values, most different texts clash; with two bits, nearly all texts are compared."""
    monkeypatch.setattr(fingerprints, "BITS", bits)
    rows = [(1, "Same  Text"), (2, "same text"), (3, "other"), (4, "\uff53ame text"), (5, None), (6, " "), (7, "third"), (7, "Other"), (None, "third")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = {r["doc_id"]: r["group"] for r in fingerprints.fingerprint_documents(docs.where("doc_id != 7")).collect()}
    assert key == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}
    monkeypatch.setattr(fingerprints, "digest_of_form", lambda form: f"{len(form) % 2:016x}")
    digests = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    forms = {(r["doc_id"], r["text"]): fingerprints.canonical(r["text"]) for r in docs.collect()}
    code = spark.createDataFrame([(d, t, f"{len(f) % 2:016x}") for (d, t), f in forms.items()], "doc_id bigint, text string, digest string")
    named = fingerprints.with_variants(docs, digests.join(code, (digests["doc_id"].eqNullSafe(code["doc_id"])) & digests["text"].eqNullSafe(code["text"])).select(digests["doc_id"], "key", "digest", digests["text"].alias("t")))
    got = {(r["doc_id"], r["t"]): r["fingerprint"] for r in named.collect()}
    assert len(got) == len(rows)
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (forms[a] == forms[b]), (a, b, got[a], got[b])


def test_license_alignment():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        matched = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in matched)
        assert all(p < q and r < s for (p, r), (q, s) in zip(matched, matched[1:], strict=False))
        assert len(matched) <= brute.longest_common(a, b)
    unique = list("abcdefghij")
    for _ in range(50):  # where all words are unique the alignment is a longest one
        a, b = rng.sample(unique, 8), rng.sample(unique, 8)
        assert len(licenses.align(a, b)) == brute.longest_common(a, b)


def test_license_scan_finds_edited_and_repeated_notices():
    known = [licenses.Template(n, t) for n, t in sorted(licenses.TEMPLATES.items())]
    filler = "lorem the of license version software " * 30
    for name, text in licenses.TEMPLATES.items():
        _, found, coverage, *_ = licenses.find_license(f"{filler} {text} {text} {filler}", known)
        assert found == name and coverage == 1.0
    words = licenses.TEMPLATES["mit-grant"].split()
    words[4] = "entirely"
    assert licenses.find_license(" ".join(words), known)[1] == "mit-grant"
    assert licenses.find_license(filler, known)[1] is None


def test_secret_base_spans():
    hexa, key = "0123456789abcdef" * 2, "AKIA" + "A" * 12
    text = f'Token = "{hexa}" é {key}, password: short, passwd=longenough; API_KEY:{key}'
    spans = [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.base_spans(text)]
    assert Counter(k for k, _ in spans) == {"assign": 3, "hex": 1, "access": 2}
    assert ("hex", hexa) in spans and ("assign", "passwd=longenough") in spans
    assert secrets.base_spans("AKIA" + "A" * 11 + " " + hexa[:-1] + " token=short") == []


def test_secret_network_learns(spark):
    rng = random.Random(3)
    docs = []
    for i in range(400):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        docs.append((i, f'some words token = "{value}" and mail{i}.example.com or version{i}.release.notes'))
    net = secrets.fit(spark.createDataFrame(docs, "doc_id bigint, text string"))
    probe = "the pwd is " + "".join(rng.choice("0123456789abcdef") for _ in range(30)) + " at mail77.example.com"
    found = secrets.scan(spark.createDataFrame([(1, probe), (2, None)], "doc_id bigint, text string"), net).orderBy("doc_id").collect()
    assert [probe[s["start"] : s["end"]] for s in found[0]["spans"]] == [probe.split()[3]]
    assert found[1]["spans"] == []


def test_secret_network_sees_every_document(spark):
    """Findings of one rare form, in a few of many documents, are all trained on, whatever their order; ten more documents change the network."""
    docs = [(i, f"version{i}.release.notes" if i % 50 else f"token = {'abcdef'[i % 6] * 4}{i:036d}") for i in range(6000)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    fields = secrets.labelled(table(docs))
    assert fields.where("label = 0").count() == 5880 and fields.where("label = 1").count() == 360
    found = [secrets.fit(table(d), epochs=1, group=1000) for d in (docs, docs[::-1], [*docs, *((i, f"mail{i}.example.com") for i in range(6000, 6010))])]
    assert found[0].threshold == found[1].threshold and (found[0].kernel == found[1].kernel).all()
    assert (found[0].kernel != found[2].kernel).any()
    net = secrets.fit(table(docs), group=1000)
    assert net.recall is not None and net.recall >= 0.9
