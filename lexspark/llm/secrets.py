"""Secret scan: base patterns, and a character convolutional network over every candidate.

The base patterns find assignments, access keys and long hex strings; their spans always stay. Candidates are the base
findings and every other run of token characters with letters and digits. Each is scored by a small convolutional network,
in numpy, on its characters and the text around it; a candidate longer than the network's field is
scored in overlapping pieces, and the highest score counts. Candidates at or above the threshold that are no base findings
are added with the kind "model".

The network is trained on labelled findings: base findings (label 1) and other candidates (label 0) of all
documents, with generated findings of known
formats beside them; in half of the findings the text around them is blanked, so that the value itself counts.
Values are split three ways (SPLITS), so that a value is in one part alone, with whatever text around it. The network is fitted on the first, in groups of
about GROUP fields (more beyond GROUPS groups): in each epoch every group goes on from the same network, and their networks are averaged by size. On the
second its scores, counted in bins of 1 / BINS of the unit's output, are calibrated (Platt scaling) and the threshold is set: the calibrated probability FLOOR, or more if a negative
scores more, but never so high that, with a confidence of 95 %, fewer than RECALL of all such findings reach it. Recall is measured on the third, and is part of the network and of every result row.

Edge cases: a null text is empty and has no spans; equal texts have equal spans, wherever they stand; a very long text is scanned
whole, in time proportional to its length; of spans that start alike the kinds come in the order of KINDS; an empty table gives
no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
RECALL, FLOOR = 0.95, 0.9
#: Fields that one task trains on, groups of them at most (the driver sees a network for each), and bins of scores.
GROUP, GROUPS, BINS, EPOCHS = 4_000, 256, 256, 6
#: Standard deviations of a one-sided confidence of 95 %.
SURE = 1.645
#: Parts of the values: to fit, to calibrate and set the threshold, to measure recall.
SPLITS = ((0.0, 0.6), (0.6, 0.8), (0.8, 1.0))
#: Characters of the field: before the candidate, of it, after it.
LEFT, BODY, RIGHT = 24, 48, 8
FIELD, WIDTH, EMBED, FILTERS = LEFT + BODY + RIGHT, 5, 8, 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of token characters that hold letters and digits."""
    found = ((m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text))
    return [(a, b) for a, b, t in found if any(c.isdigit() for c in t) and any(c.isalpha() for c in t)]


def apart(found: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The candidates that overlap none of the spans; both in order of their starts, candidates without overlaps among them."""
    out, k, reach = [], 0, -1
    for a, b in found:
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def _ids(text: str, blank: bool = False) -> np.ndarray:
    """Printable ASCII as itself, other letters 1, the rest 2; blank: a field without surroundings."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where((points >= 32) & (points < 127), points, np.where(points > 127, 1, 2)).astype(np.uint8)


def fields(text: str, start: int, end: int, surroundings: bool = True) -> list[np.ndarray]:
    """The fields of a candidate: one, or overlapping ones if it is longer than BODY. 0 pads."""
    out = []
    for at in range(start, max(start + 1, end - BODY // 2), BODY // 2):
        stop = min(at + BODY, end)
        row = np.zeros(FIELD, dtype=np.uint8)
        row[LEFT : LEFT + stop - at] = _ids(text[at:stop])
        if surroundings:
            before, after = text[max(0, at - LEFT) : at], text[stop : stop + RIGHT]
            row[LEFT - len(before) : LEFT] = _ids(before)
            row[LEFT + BODY : LEFT + BODY + len(after)] = _ids(after)
        out.append(row)
        if stop == end:
            break
    return out


@dataclass
class Network:
    """Embedding, one convolution, ReLU, maximum and mean over positions, one unit; then Platt's a, b."""

    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    a: float = 1.0
    b: float = 0.0
    threshold: float = 2.0
    recall: float | None = None  # at the threshold, of findings that neither training nor the threshold has seen

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (128, EMBED)), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)

    def _forward(self, rows: np.ndarray):
        x = self.embedding[rows]
        n = FIELD - WIDTH + 1
        columns = np.concatenate([x[:, k : k + n] for k in range(WIDTH)], axis=2)
        h = np.maximum(columns @ self.kernel + self.bias, 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return columns, h, top, pooled, pooled @ self.out + self.out_bias

    def outputs(self, rows: np.ndarray) -> np.ndarray:
        """The unit's output for each row."""
        return np.concatenate([self._forward(rows[i : i + 256])[-1] for i in range(0, len(rows), 256)]) if len(rows) else np.zeros(0)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.outputs(rows) + self.b)))

    def step(self, rows: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        """One step of Adam on the logistic loss."""
        columns, h, top, pooled, z = self._forward(rows)
        m, n = len(rows), h.shape[1]
        dz = (1 / (1 + np.exp(-z)) - y) / m
        d_pool = dz[:, None] * self.out
        dh = np.repeat((d_pool[:, FILTERS:] / n)[:, None, :], n, axis=1)
        i, f = np.indices((m, FILTERS))
        dh[i, top, f] += d_pool[:, :FILTERS]
        dh *= h > 0
        d_columns = dh @ self.kernel.T
        d_embedding = np.zeros_like(self.embedding)
        for k in range(WIDTH):
            np.add.at(d_embedding, rows[:, k : k + n], d_columns[:, :, k * EMBED : (k + 1) * EMBED])
        grads = {"embedding": d_embedding, "kernel": np.tensordot(columns, dh, axes=([0, 1], [0, 1])), "bias": dh.sum(axis=(0, 1)), "out": pooled.T @ dz, "out_bias": dz.sum()}
        state["t"] = t = state.get("t", 0) + 1
        for name, g in grads.items():
            m1, m2 = state.get(name, (0, 0))
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            state[name] = (m1, m2)
            setattr(self, name, getattr(self, name) - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8))


def generated(n: int, seed: int) -> np.ndarray:
    """Fields of n made-up findings: hex strings, base64 strings, prefixed keys."""
    rng = np.random.default_rng(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    out = []
    for _ in range(n):
        prefix, letters, size = [("", "abcdef" + digits, rng.integers(24, 65)), ("", upper + lower + digits + "+/", rng.integers(24, 49)), ("sk_live_", upper + lower + digits, 24), ("AKIA", upper + digits, 16)][rng.integers(4)]
        value = prefix + "".join(letters[i] for i in rng.integers(0, len(letters), size))
        out += fields(value, 0, len(value))
    return np.array(out)


def _epoch(net: Network, rows: np.ndarray, y: np.ndarray, state: dict, seed: list[int]) -> None:
    """One pass over the rows in an order of its own."""
    order = np.random.default_rng(seed).permutation(len(rows))
    for i in range(0, len(order), 64):
        net.step(rows[order[i : i + 64]], y[order[i : i + 64]], state, 0.01)


def _calibrate(net: Network, z: np.ndarray, target: np.ndarray, n: np.ndarray) -> None:
    """Platt scaling and the threshold, by outputs z of the unit that stand for n fields each."""
    for _ in range(300):  # gradient descent on two numbers
        p = 1 / (1 + np.exp(-(net.a * z + net.b)))
        net.a -= 0.1 * float(((p - target) * z * n).sum() / n.sum() if len(z) else 0)
        net.b -= 0.1 * float(((p - target) * n).sum() / n.sum() if len(z) else 0)
    scores = 1 / (1 + np.exp(-(net.a * z + net.b)))
    found = np.argsort(scores[target == 1], kind="stable")
    if len(found):
        upto = np.cumsum(n[target == 1][found])
        missed = upto[-1] * (1 - RECALL)
        k = max(0, int(missed - SURE * math.sqrt(missed * RECALL)))
        reached = float(scores[target == 1][found][np.searchsorted(upto, k, "right")])
        net.threshold = min(reached, max(FLOOR, float(scores[target == 0].max(initial=0))))


def train(rows: np.ndarray, y: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> Network:
    """Fit, calibrate and set the threshold, and measure recall, each on values that the others do not have. For rows that fit in memory.

    Without labelled rows of both kinds nothing is ever added.
    """
    net = Network.fresh(seed)
    if not y.any() or y.all():
        return net
    _, value = np.unique(rows[:, LEFT : LEFT + BODY], axis=0, return_inverse=True)
    place = np.random.default_rng(seed).permutation(int(value.max()) + 1)[value] / (value.max() + 1)
    used, held, unseen = (np.flatnonzero((place >= a) & (place < b)) for a, b in SPLITS)
    state: dict = {}
    for epoch in range(epochs):
        _epoch(net, rows[used], y[used], state, [seed, epoch])
    _calibrate(net, net.outputs(rows[held]), y[held], np.ones(len(held)))
    unseen = unseen[y[unseen] == 1]
    if len(unseen):
        net.recall = float((net.probability(rows[unseen]) >= net.threshold).mean())
    return net


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            for a, _, b in spans:
                out += [(row.tobytes(), 1) for half in (True, False) for row in fields(text, a, b, half)]
            for a, b in apart(candidates(text or ""), spans):
                out += [(row.tobytes(), 0) for row in fields(text, a, b)]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.binary()), pa.array([y for _, y in out], pa.int32())], ["field", "label"])


def _rows(fields_: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(fields_.to_pylist()), dtype=np.uint8).reshape(-1, FIELD)


def _made(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """n generated findings for each number that comes in."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = [r.tobytes() for r in generated(n, 3 + i)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([1] * len(rows), pa.int32())], ["field", "label"])

    return of


_LEARNT = ("embedding", "kernel", "bias", "out", "out_bias")
_STEP = "group int, n bigint, t bigint, numbers binary"


def _trained(net: Network, state: dict, epoch: int, seed: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """An epoch of one group: the network's numbers after it, with Adam's two means of each."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        rows, y = _rows(table.column("field")), table.column("label").to_numpy().astype(float)
        order = np.argsort(y, kind="stable")
        order = order[np.argsort(rows[order].view(f"S{FIELD}").ravel(), kind="stable")]
        own, moments, group = replace(net), dict(state), key[0].as_py()
        _epoch(own, rows[order], y[order], moments, [seed, epoch, group])
        numbers = np.concatenate([np.ravel(x) for name in _LEARNT for x in (getattr(own, name), *moments[name])])
        return pa.table([pa.array([group], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([moments["t"]], pa.int64()), pa.array([numbers.tobytes()], pa.binary())], ["group", "n", "t", "numbers"])

    return of


def _averaged(net: Network, steps: list, state: dict) -> None:
    """The groups' numbers by the size of the groups, in order of the groups, so that sums come out alike."""
    steps = sorted(steps, key=lambda r: r["group"])
    total, at = np.average([np.frombuffer(r["numbers"]) for r in steps], axis=0, weights=[r["n"] for r in steps]), 0
    for name in _LEARNT:
        shape = np.shape(getattr(net, name))
        value, *moments = (total[at + k * (size := int(np.prod(shape))) : at + (k + 1) * size].reshape(shape) for k in range(3))
        setattr(net, name, value if shape else float(value))
        state[name], at = tuple(moments), at + 3 * size
    state["t"] = max(r["t"] for r in steps)


def _outputs(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(net.outputs(_rows(batch.column("field"))), pa.float64())], ["label", "z"])

    return of


def labelled(docs: DataFrame) -> DataFrame:
    """field, label: every different labelled field of all documents."""
    return docs.select("text").mapInArrow(_labelled, "field binary, label int").distinct()


def fit(docs: DataFrame, seed: int = 1, epochs: int = EPOCHS, group: int = GROUP) -> Network:
    """Train on every labelled field of all documents, on the executors; as train does, but by groups.

    The driver sees a network for each group, at most GROUPS of them, and counts of scores by bin.
    """
    own, spark = common.durable(labelled(docs)), docs.sparkSession
    net, state = Network.fresh(seed), {}
    n, n_other = own.agg(F.count("*"), F.count_if(F.col("label") == 0)).first()
    if not n_other:
        return net
    groups = min(GROUPS, -(-n // group))
    made = spark.range(0, groups, 1, groups).mapInArrow(_made(-(-max(200, n // 4) // groups)), "field binary, label int")
    value = F.substring("field", LEFT + 1, BODY)
    place = F.shiftrightunsigned(F.xxhash64(F.lit("split"), value), 1).cast("double") / float(1 << 63)
    rows = common.durable(own.unionByName(made).select("field", "label", place.alias("place"), F.pmod(F.xxhash64(F.lit("group"), value), F.lit(groups)).cast("int").alias("group")))
    used, held, unseen = (rows.where((F.col("place") >= a) & (F.col("place") < b)) for a, b in SPLITS)
    used = used.select("group", "field", "label").repartition(groups, "group")  # a number of tasks that Spark does not reduce
    for epoch in range(epochs):
        steps = used.groupBy("group").applyInArrow(_trained(net, state, epoch, seed), _STEP).collect()
        if steps:
            _averaged(net, steps, state)
    scored = held.select("field", "label").mapInArrow(_outputs(net), "label int, z double")
    counts = scored.groupBy("label", F.floor(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), "z")) * BINS).alias("bin")).agg(F.count("*").alias("n"), F.min("z").alias("least"), F.max("z").alias("most"))
    bins = sorted(counts.collect(), key=lambda r: (r["label"], r["bin"]))  # two labels, 100 * BINS bins
    z = np.array([r["least"] if r["label"] else r["most"] for r in bins], dtype=float)  # the threshold is set by the least finding and the highest other
    _calibrate(net, z, np.array([r["label"] for r in bins], dtype=float), np.array([r["n"] for r in bins], dtype=float))
    reached = 1 / (1 + F.exp(-(F.lit(net.a) * F.col("z") + F.lit(net.b)))) >= net.threshold
    hit, of = unseen.where("label = 1").select("field", "label").mapInArrow(_outputs(net), "label int, z double").agg(F.count_if(reached), F.count("*")).first()
    net.recall = hit / of if of else None
    return net


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end, score>> by start, then kind, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def found_in(net: Network, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        owners, rows = [], []
        for i, text in enumerate(texts):
            base = base_spans(text)
            for a, k, b in [*base, *((a, 3, b) for a, b in apart(candidates(text), base))]:
                new = fields(text, a, b)
                rows += new
                owners += [(i, a, k, b)] * len(new)
        best: dict = {}
        for owner, p in zip(owners, net.probability(np.array(rows)).tolist(), strict=True):
            best[owner] = max(best.get(owner, 0.0), p)
        out: list = [[] for _ in texts]
        for (i, a, k, b), p in best.items():
            if k < 3 or p >= net.threshold:
                out[i].append((a, k, b, p))
        return [sorted(s) for s in out]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [s for texts in tokens.slices(batch.column("text"), 256) for s in found_in(shared.value, [t or "" for t in texts])]
            cells = [[{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, k, b, p in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cells, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document."""
    docs = common.documents(spark, sf_dir)
    network = fit(docs)
    found = scan(docs, network)
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "model")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        n("model").alias("n_model"), F.lit(network.recall).cast("double").alias("held_out_recall"),
    )
