"""The queries' digest columns against plain versions, where SQL cannot express them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexspark.llm import common, language, licenses, secrets, sharding


def test_sizes_and_checksums_of_shards(spark, corpus_dir, corpus_rows):
    text = {r[0]: (r[1] or "").encode() for r in corpus_rows}
    rows = sharding.op1_sharding(spark, corpus_dir).collect()
    assert {r["doc_id"] for r in rows} == set(text) and len(rows) == len(text)
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]), "rows", None)


def test_base_findings_of_secrets(spark, tmp_path):
    hexa, key = "0123456789abcdef", "AKIAABCDEFGHIJKL"
    texts = [
        None, "", f'api-key="{hexa}" secret : {hexa * 2}', f"{key}MNOP {key[:15]} x{key}", "PassWord=abcdefgh token:1234567 APIKEY = 'aaaa.bbbb/cccc+=' tokens=abcdefgh",
        f"é🙂 token={hexa * 2} {hexa * 3}{key}", f"secret={key} secret=={key} passwd\t=abcdefghij", hexa * 2 + "g" + hexa * 2, "api_key:    abcdefgh" * 3,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = {
        "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(2)) >= 8),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group(0)) >= 16),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m.group(0)) >= 32),
    }
    for r in secrets.op9_secrets(spark, str(tmp_path)).collect():
        found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, (pattern, fine)) in enumerate(kinds.items()) for m in pattern.finditer(texts[r["doc_id"]] or "") if fine(m)]
        names = Counter(s.split(":")[0] for _, _, s in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(names[k] for k in kinds)
        base = [s for _, _, s in sorted(found)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("model")] == base
        assert len(spans) == len(base) + r["n_model"]
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))


def test_recall_of_the_secret_network(spark):
    network = secrets.fit(common.documents(spark, "/root/testdata/sf0.01"))
    assert network.recall >= secrets.RECALL - 0.01 and 0 < network.threshold <= 1


def test_naive_bayes_by_counting(spark, corpus_dir, corpus_rows):
    """Posteriors from plain counts, one text at a time, over the same hashed n-grams."""
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in corpus_rows}
    grams = lambda t: [int(b) for _, bucket in language._grams([t]) for b in bucket]
    counts, sizes = defaultdict(Counter), Counter()
    for i, text, lang, *_ in corpus_rows:
        if lang is not None and not held[i]:
            counts[lang].update(grams(text))
            sizes[lang] += 1
    total = {x: sum(c.values()) + 0.5 * language.BUCKETS for x, c in counts.items()}
    got = {r["doc_id"]: r for r in language.op7_language(spark, corpus_dir).collect()}
    for i, text, *_ in corpus_rows:
        assert got[i]["held_out"] == held[i]
        g = grams(text)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        score = {x: math.log(sizes[x] / sum(sizes.values())) + sum(math.log((counts[x][b] + 0.5) / total[x]) for b in g) for x in counts}
        best = max(score.values())
        posterior = 1 / sum(math.exp(s - best) for s in score.values())
        assert got[i]["score"] == pytest.approx(posterior, abs=1e-3)
        if posterior > 0.51:
            assert score[got[i]["lang_pred"]] == best


def test_licenses_by_trying_every_place(spark):
    """Each notice that aligns with a template at some place is found: here all places are tried, not seeds alone."""
    known = {n: t for n, t in licenses.TEMPLATES.items() if n in ("mit-grant", "gpl-notice-bare", "lgpl-notice", "cc-by-sa-notice", "bsd-grant")}
    grant = known["mit-grant"].split()
    texts = [
        " ".join(grant), " ".join(w for i, w in enumerate(grant) if i % 9), " ".join(w for i, w in enumerate(grant) if i % 3), "x " * 50 + known["bsd-grant"] + " y " * 50 + known["lgpl-notice"],
        "licensed under the GNU Lesser General Public License", "licensed under the GNU General Public License and licensed under CC BY-SA 4.0", "nothing of that kind", None, "",
    ]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), known).collect()
    templates = [licenses.Template(n, t) for n, t in sorted(known.items())]
    for r in rows:
        words = licenses.words_of(texts[r["doc_id"]])
        want = set()
        for t in templates:
            size = len(t.words)
            if any(t.holds(licenses.align(words[max(0, a) : a + 2 * size], t.words)) for a in range(-size // 2, len(words))):
                want.add(t.name)
        assert {f["license"] for f in r["findings"]} == want, texts[r["doc_id"]]
