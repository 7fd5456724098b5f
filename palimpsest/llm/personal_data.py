"""Personal data: base patterns and a skip-chain conditional random field.

Base patterns mark emails, IP addresses, card and phone numbers. The field's nodes
are the base spans, and of what is left of a text the tokens that hold a digit or an at
sign, numbers written with single spaces being one; labels are none and the four kinds.
Neighbouring nodes share a chain potential; nodes that repeat the same address or the
same last digits, however distant, share a skip potential, so one clear mention lends its
label to its unclear copies. Potentials are trained piecewise, as log
ratios of counts of the base labels over all documents; a node without a base label that
repeats a clear mention of its text is not known, rather than none, and is not counted; marginals come from loopy
sum-product message passing over all texts of a batch at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import slices

# The kinds, in their order.
KINDS = ("email", "ip", "card", "phone")
#: Buckets of token shapes, which bound the trained table.
SHAPES = 2048
#: Rounds of message passing, and share of the old message kept.
ROUNDS, DAMPING = 8, 0.3
#: Largest log ratio of a potential of two nodes, and edges that are counted beforehand, half
#: of them as if labels were independent, half of equal labels.
CLIP, PRIOR = 6.0, 20.0
#: Edges whose messages are made at once: bounds their tables.
EDGES = 1 << 16
#: A token takes a kind from this marginal on.
SURE = 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_DIGITS = re.compile(r"[0-9]")
_NUMERIC = re.compile(r"[0-9().+/-]+")
#: Digits of a number written with spaces, at most, and digits that copies of one share.
LONGEST, LAST = 20, 9


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; linear in the text's length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGITS.search(text):
        return out
    for m in _NUMBERS.finditer(text):
        parts, place = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                out.append((1, place, place + length))
            place += length + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _shape(token: str) -> int:
    """Bucket of a whole token's shape: runs of digits, letters and each mark, digit runs
    by length, and whether its digits pass the card checksum."""
    digits = re.sub(r"[^0-9]", "", token)
    s = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 6)}", token))
    if 13 <= len(digits) <= 19 and _luhn(digits):
        s += "|sum"
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % SHAPES


def _key(token: str) -> str:
    """What similar mentions share: an address in lower case, four numbers with dots or commas
    between, or the last LAST of at least three digits."""
    token = token.strip(".,;:!?()[]<>\"'")
    if "@" in token:
        return token.lower()
    parts = re.split(r"[.,]", token)
    if len(parts) == 4 and all(p.isdecimal() for p in parts):
        return ".".join(parts)
    digits = re.sub(r"[^0-9]", "", token)
    return digits[-LAST:] if len(digits) >= 3 else ""


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of a text's nodes in order: the base spans, of overlapping ones the
    first, and tokens beside them; numeric tokens with single spaces between are one."""
    taken: list[tuple[int, int, int]] = []
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if not taken or s >= taken[-1][1]:
            taken.append((s, e, k + 1))
    out, at, digits = [], 0, 0  # digits of the last node, where it is a number to be joined
    for m in _TOKEN.finditer(text):
        s, e = m.start(), m.end()
        while at < len(taken) and taken[at][1] <= s:
            out.append(taken[at])
            at, digits = at + 1, 0
        if at < len(taken) and taken[at][0] < e:  # a base span, or what stands around one
            continue
        mine = len(_DIGITS.findall(m.group())) if _NUMERIC.fullmatch(m.group().rstrip(".,;:!?")) else 0
        if mine and digits and out[-1][1] + 1 == s and text[s - 1] == " " and digits + mine <= LONGEST:
            out[-1] = (out[-1][0], e, 0)
            digits += mine
        else:
            out.append((s, e, 0))
            digits = mine
        if m.group()[-1] in ".,;:!?":
            digits = 0
    return [*out, *taken[at:]]


class Graph:
    """Mentions of several texts with their base labels, chain edges and skip edges."""

    def __init__(self, texts: list[str], bases: list[list[tuple[int, int, int]]]):
        self.text, self.start, self.end, self.label, shapes, known = [], [], [], [], [], []
        edges: dict[int, list[tuple[int, int]]] = {0: [], 1: []}
        for number, (text, spans) in enumerate(zip(texts, bases, strict=True)):
            if "@" not in text and not _DIGITS.search(text):
                continue
            last: dict[str, int] = {}
            before, first, clear, keys = -9, len(self.start), set(), []
            for s, e, label in mentions(text, spans):
                node, said = len(self.start), text[s:e].strip(".,;:!?()[]<>\"'")
                self.text.append(number)
                self.start.append(s)
                self.end.append(e)
                self.label.append(label)
                shapes.append(_shape(said))
                if s - before <= 1:
                    edges[0].append((node - 1, node))
                keys.append(key := _key(said))
                if key:
                    if key in last:
                        edges[1].append((last[key], node))
                    last[key] = node
                    if label:
                        clear.add(key)
                before = e
            known += [label > 0 or key not in clear for label, key in zip(self.label[first:], keys, strict=True)]
        self.shape = np.array(shapes, dtype=np.int64)
        self.labels = np.array(self.label, dtype=np.int64)
        self.known = np.array(known, dtype=bool)
        self.edges = {k: np.array(v, dtype=np.int64).reshape(-1, 2) for k, v in edges.items()}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(KINDS) + 1
    unary, pair = np.zeros((SHAPES, n), dtype=np.int64), np.zeros((2, n, n), dtype=np.int64)
    for b in slices(batches, "text"):
        texts = [t or "" for t in b.column("text").to_pylist()]
        g = Graph(texts, [base_spans(t) for t in texts])
        np.add.at(unary, (g.shape[g.known], g.labels[g.known]), 1)
        for k, e in g.edges.items():
            e = e[g.known[e].all(1)]
            np.add.at(pair[k], (g.labels[e[:, 0]], g.labels[e[:, 1]]), 1)
    flat = np.concatenate((unary.ravel(), pair.ravel()))
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(flat[at], pa.int64())})


class Field:
    """Log potentials from the counts of all documents."""

    def __init__(self, docs: DataFrame):
        n = len(KINDS) + 1
        flat = np.zeros(SHAPES * n + 2 * n * n)
        table = docs.select("text").mapInArrow(_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        flat[table.column("cell").to_numpy()] = table.column("n").to_numpy()
        unary, pair = flat[: SHAPES * n].reshape(SHAPES, n), flat[SHAPES * n :].reshape(2, n, n)
        self.unary = np.log((unary + 0.5) / (unary.sum(1, keepdims=True) + 0.5 * n))
        self.pair = []
        share = (unary.sum(0) + 1.0) / (unary.sum() + n)  # of each label among all nodes
        for p in pair:  # log ratio of joint to independent: what an edge adds to its ends
            p = p + p.T + PRIOR * (share[:, None] * share[None, :] + np.diag(share))
            p /= p.sum()
            self.pair.append(np.clip(np.log(p / (share[:, None] * share[None, :])), -CLIP, CLIP))

    def marginals(self, g: Graph) -> np.ndarray:
        n, out = len(KINDS) + 1, self.unary[g.shape].copy()
        sure = g.labels > 0
        out[sure] = -8.0
        out[sure, g.labels[sure]] = 0.0
        i = np.concatenate([g.edges[k][:, d] for k in (0, 1) for d in (0, 1)])
        j = np.concatenate([g.edges[k][:, 1 - d] for k in (0, 1) for d in (0, 1)])
        sizes = [len(g.edges[0])] * 2 + [len(g.edges[1])] * 2
        ends = np.cumsum([0, *sizes])
        back = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in (1, 0, 3, 2)]) if len(i) else np.zeros(0, int)
        # some edges of one kind at a time: a long text has millions
        parts = [(lo, min(lo + EDGES, ends[x + 1]), self.pair[x // 2]) for x in range(4) for lo in range(ends[x], ends[x + 1], EDGES)]
        message = np.zeros((len(i), n))
        for _ in range(ROUNDS if len(i) else 0):
            belief = out.copy()
            np.add.at(belief, j, message)
            held, new = belief[i] - message[back], np.empty_like(message)
            for lo, hi, pair in parts:
                send = held[lo:hi, :, None] + pair
                top = send.max(1)
                new[lo:hi] = top + np.log(np.exp(send - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = out
        np.add.at(belief, j, message)
        belief = np.exp(belief - belief.max(1, keepdims=True)) if len(belief) else belief
        return belief / belief.sum(1, keepdims=True) if len(belief) else belief

    def spans(self, texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
        """Base spans, and all spans, of each text."""
        bases = [base_spans(t) for t in texts]
        g = Graph(texts, bases)
        found = [list(b) for b in bases]
        if len(g.shape):
            p = self.marginals(g)
            best = p.argmax(1)
            hit = (best > 0) & (p.max(1) >= SURE) & (g.labels == 0)
            run: list[int] | None = None
            for node in [*np.flatnonzero(hit).tolist(), None]:
                if run and (node is None or node != run[-1] + 1 or g.text[node] != g.text[run[-1]] or best[node] != best[run[-1]] or g.start[node] - g.end[run[-1]] > 1):
                    text, kind = g.text[run[0]], int(best[run[0]]) - 1
                    s, e = g.start[run[0]], g.end[run[-1]]
                    while s < e and texts[text][s] in "([<\"'":
                        s += 1
                    while e > s and texts[text][e - 1] in ".,;:!?)]>\"'":
                        e -= 1
                    if s < e:  # nodes beside the base spans overlap with nothing
                        found[text].append((kind, s, e))
                    run = None
                if node is not None:
                    run = [*(run or []), node]
        return bases, [sorted(x) for x in found]


def find(docs: DataFrame) -> DataFrame:
    """docs' columns with base and spans: arrays of (kind, start, end), code points,
    end exclusive, by kind as in KINDS, then start. A very long text is taken whole: its
    mentions and their edges stay in memory, at some 400 bytes each.

    A null text has no spans; repeated rows each keep their row; columns of docs named
    base or spans are replaced; an empty table gives no rows."""
    field = Field(docs)
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    docs = docs.select(*keep)
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            both = field.spans([t or "" for t in b.column("text").to_pylist()])
            made = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in y], item) for y in both]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*keep, "base", "spans"])

    return docs.mapInArrow(run, f"{names}, base {spans}, spans {spans}")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in square brackets, in
    capitals; overlapping spans become one, of the first's kind. A null text stays null,
    repeated rows each keep their row, all columns stay; an empty table gives no rows."""
    field = Field(docs)

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in spans):
            if s >= at:
                out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            k = b.schema.get_field_index("text")
            texts = b.column(k).to_pylist()
            found = field.spans([t or "" for t in texts])[1]
            yield b.set_column(k, "text", pa.array([None if t is None else clean(t, x) for t, x in zip(texts, found, strict=True)], pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
