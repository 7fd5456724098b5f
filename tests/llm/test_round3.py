"""Periodic runs, the conversation trie and the mix against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from palimpsest.llm import conversation_trie, mixing, periodic_runs
from palimpsest.llm.queries import QUERIES
from tests.test_queries import DATA


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i and not any((i, j - i + q, g) in out for g in range(1, q)):
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_occurrences_equal_comparison():
    rng = np.random.default_rng(1)
    for block in (1, 2, 4, 16, 64):
        ids = rng.integers(0, 2, 400)
        ids[200:300] = ids[100:200]
        starts = np.arange(0, 380, block)
        got = sorted(zip(*map(np.ndarray.tolist, periodic_runs.occurrences(ids, starts, block, block)), strict=True))
        want = [(s, d) for s in starts.tolist() for d in range(block, 2 * block) if s + d + block <= 400 and (ids[s : s + block] == ids[s + d : s + d + block]).all()]
        assert got == want


@pytest.mark.parametrize("largest", [1 << 16, 4])
def test_runs_equal_brute_force(monkeypatch, largest):
    monkeypatch.setattr(periodic_runs, "LARGEST", largest)
    rng = random.Random(2)
    for _ in range(400):
        w, k = [], rng.randint(1, 4)
        while len(w) < rng.randint(0, 120):
            part = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
            w += (part * rng.randint(1, 7))[: rng.randint(1, 60)]
        assert periodic_runs.find_runs(np.array(w, dtype=np.int64)) == brute_runs(w)


def test_periodic_runs_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \t\x0b ", 1), (4, "a " * 6, 1), (4, "a " * 6, 1), (None, "x é é é é é é  y", 1), (5, "ab " * 50_000 + "c", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(2)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(frame).collect()), key=str)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (4, [(0, 6, 1)], "a"), (None, [], "x é é é é é é  y"), (5, [(0, 50_000, 1)], "ab c")]
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(frame.limit(0)).count() == 0


def test_op11_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        number = {x: k for k, x in enumerate(dict.fromkeys(w))}
        runs, r = brute_runs([number[x] for x in w]), got[doc]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest()


def brute_trie(rows, shared=lambda c: zlib.crc32(str(c).encode()) % 4):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", sha(f"{len((role or '').encode())}:{role or ''}{text or ''}"), text or ""))
    seqs = {}
    for c in turns:
        base = sorted(turns.get(c - c % 20, []))[: shared(c)]
        seqs[c] = [(t[2], t[4]) for t in base + sorted(turns[c])[shared(c) :]]
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in sorted(seqs.items()):
        ends[tuple(s)].append(c)
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    out = []
    for node, m in members.items():
        sub = [x for x in members if x[: len(node)] == node]
        kids = [x for x in sub if len(x) == len(node) + 1]
        leaf = [x for x in sub if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in sub)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in sub if x)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), len(leaf), saved, sha(",".join(map(str, ends[node])))))
    return sorted(out, key=str)


@pytest.mark.parametrize("nodes", [1 << 16, 40, 7])
def test_trie_equals_brute_force(spark, nodes, monkeypatch):
    monkeypatch.setattr(conversation_trie, "TURNS", 60)
    rng = random.Random(4)
    rows = [(rng.choice([*range(70), 400, None]), rng.choice([None, *range(6)]), rng.choice("ua"), rng.choice(["x y", "x", "", None, "z  z z"])) for _ in range(300)]
    rows += [(7, k, "u", "x") for k in range(40)] + rows[:20]  # a long conversation, repeated rows
    rows = [r + ("k",) for r in rows]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string").repartition(3)
    turns = conversation_trie.numbered(frame)
    from pyspark.sql import functions as F

    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    got = conversation_trie.trie(*conversation_trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 20, shared), nodes_a_shard=nodes)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie([r[:4] for r in rows])


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    assert conversation_trie.trie(*conversation_trie.rebuilt(conversation_trie.numbered(frame), F.col("conv_id"), F.lit(0))).count() == 0


def test_spilling_queue():
    rng, queue, want = random.Random(5), conversation_trie.SpillingQueue(most=10), []
    for _ in range(500):
        if rng.random() < 0.6 or not want:
            item = (rng.randrange(50), str(rng.randrange(9)))
            queue.push(item)
            want.append(item)
        else:
            assert queue.first() == min(want) and queue.pop() == min(want)
            want.remove(min(want))
    assert [queue.pop() for _ in want] == sorted(want) and queue.first() is None


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    stopped = set()
    while True:
        left, w = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        above = {s for s in order if s not in stopped and left * weight[s] / w > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / w for s in order}
        stopped |= above


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 50)  # orders cut into slices
    rng = random.Random(6)
    rows = [(k, " ".join("w" * (1 + k % 3) for _ in range(rng.choice([0, 1, 5, 200]))), rng.choice(["b", "b", "b", "b", "a", "c", None, "é"]), 1, "k") for k in range(300)]
    rows += [(None, "one two", "tiny", 1, "k"), (None, None, "void", 1, "k"), *rows[:5], (900, "long " * 30_000, "b", 1, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int, key string").repartition(3)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    targets, (documents, pieces) = brute_targets(sizes), mixing.mix(frame)
    docs, parts = documents.collect(), pieces.collect()
    assert len(docs) == len(rows)
    for source in sizes:
        plan = next(d for d in docs if abs(d.target - targets[source]) < 1e-6 * max(1, targets[source]) and d.source_size == sizes[source])
        taken = sum(p.length for p in parts if p.rank == plan["rank"])
        assert abs(taken - targets[source]) <= 0.5
    place = {(d["rank"], d["at"]): d["size"] for d in docs if d["size"]}
    got = defaultdict(int)
    for p in parts:
        assert 0 < p.length and 0 <= p.start and p.start + p.length <= place[p["rank"], p["at"]]
        got[p["rank"], p["at"]] += p.length
    assert all(n <= 3 * place[k] for k, n in got.items())
    # any stretch of the mix holds the sources close to their shares
    total, block = sum(targets.values()), max(p.length for p in parts)
    half = int(total / block) // 2
    for rank in {d["rank"] for d in docs}:
        first = sum(p.length for p in parts if p["rank"] == rank and p.slot < half)
        assert abs(first - next(d.target for d in docs if d["rank"] == rank) / 2) <= 6 * block + 0.01 * total
    again = sorted(map(tuple, mixing.mix(frame.repartition(5))[1].collect()))
    assert again == sorted(map(tuple, parts))


def test_mix_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none)[0].count() == mixing.mix(none)[1].count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], none.schema)
    documents, pieces = mixing.mix(blank)
    assert [(d.target, d.source_size) for d in documents.collect()] == [(0.0, 0), (0.0, 0)] and pieces.count() == 0


def test_lengths_that_do_not_lead_on_end(spark):
    from palimpsest.llm import warc
    from palimpsest.llm.common import fresh_path

    marks = [f"WARC/1.0\r\nContent-Length: {n}\r\n\r\n" for n in ("-37", "0", "9" * 30, "9" * 18, "x", "", " 5 ")]
    pages = [(k, "u", "<p>" + m * 3 + "end") for k, m in enumerate(marks)] + [(90, "u", "".join(marks)), (91, None, None), (None, "n", "null id"), (7, "r", "again"), (7, "r", "again")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    path = fresh_path(spark, "archives")
    warc.write_warc(frame, path)
    got = sorted(r.payload for r in warc.read_warc(spark, path).select("payload").collect())
    assert got == sorted(p[2] or "" for p in pages)
    warc.write_warc(frame.limit(0), path := fresh_path(spark, "archives"))
    assert warc.read_warc(spark, path).count() == 0


def test_rows_that_repeat_an_id_count_by_themselves(spark):
    from palimpsest.llm import embedding_dedup

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [1.0, 0.0]), (9, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (9, 0, 9, True)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("block", [16, 64])
def test_blocks_lose_no_link(spark, block, monkeypatch):
    from palimpsest.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base + 0.08 * rng.standard_normal(base.shape), rng.standard_normal((180, 16)), base[:9]])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert [r.n_links for r in sorted(got)] == links.sum(1).tolist() and links.sum() > 60


def test_the_cut_is_an_exact_rank(spark):
    from palimpsest.llm.quality_rules import rank_cut

    rng = random.Random(1)
    steps = [rng.randint(-3_000_000, 900_000) for _ in range(1500)] + [-5] * 400
    frame = spark.createDataFrame([(s,) for s in steps], "at long").repartition(5)
    for share in (0.0, 0.02, 0.5, 0.9, 1.0):
        assert rank_cut(frame, share) == sorted(steps)[max(1, int(np.ceil(share * len(steps)))) - 1]
    assert rank_cut(frame.limit(0), 0.02) == 0


def test_chunk_joins_of_a_batch_equal_the_tokenizer():
    from palimpsest.llm.chunk_codec import ChunkEncoder
    from palimpsest.llm.tokens import word_bpe

    rng = random.Random(7)
    parts = ["alpha", "beta,", "don't", "x..", "1,5", "é", "  ", "\n", "İ", "\t", "ｆｏｏ", "<unk>", "...", "Wort­bruch"]
    shared = " ".join(rng.choice(parts) for _ in range(300))
    texts = [shared + " ".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(40)] + ["", " ", "a"]
    enc, tok = ChunkEncoder(), word_bpe().tok
    for got, text in zip(enc.encode(texts), texts, strict=True):
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_a_clear_mention_lends_its_label_to_unclear_copies(spark):
    from palimpsest.llm import personal_data

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    phone = lambda: f"+{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
    filler = lambda: " ".join(word() if rng.random() < 0.8 else str(rng.randint(1, 99)) for _ in range(40))
    rows, copies, alone = [], {}, {}
    for k in range(300):
        p, text = phone(), filler()
        if k % 3 == 0:  # clear twice: what the field learns from
            text += f" call {p} now {filler()} again {p} {filler()}"
        elif k % 3 == 1:  # clear once, and a copy whose start is masked
            copies[k] = p.split(" ", 1)[1]
            text += f" call {p} now {filler()} or {copies[k]} then {filler()}"
        else:  # masked alone
            alone[k] = p.split(" ", 1)[1]
            text += f" code {alone[k]} then {filler()}"
        rows.append((k, text))
    found = {r.doc_id: r for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    marked = lambda k, said: any(x.kind == "phone" and rows[k][1][x.start : x.end].strip() == said for x in found[k].spans)
    assert sum(marked(k, said) for k, said in copies.items()) >= 0.95 * len(copies)
    assert sum(marked(k, said) for k, said in alone.items()) <= 0.05 * len(alone)
    assert all([(x.kind, x.start, x.end) for x in r.base] == [(personal_data.KINDS[k], s, e) for k, s, e in personal_data.base_spans(rows[r.doc_id][1])] for r in found.values())


def test_groups_of_toxic_texts_need_no_word_list():
    from palimpsest.llm import toxicity

    rng = random.Random(12)
    bad = [["aaaa", "aabb", "aacc"], ["éé1", "éé2", "éé3"], ["зло1", "зло2", "зло3"]]
    docs, toxic, kind = [], [], []
    for k in range(600):
        text = {rng.choice("lmnopqrstuv") for _ in range(6)}
        toxic.append(k % 4 == 0)
        kind.append(rng.choice([0, 0, 0, 1, 1, 2]) if toxic[-1] else -1)
        docs.append(text | (set(rng.sample(bad[kind[-1]], 2)) if toxic[-1] else set()))
    assert toxicity.groups(docs, np.array(toxic)).tolist() == kind
    assert toxicity.groups(docs, np.zeros(600, dtype=bool)).tolist() == [-1] * 600
    fold = np.arange(600) % toxicity.FOLDS
    marks = np.column_stack([*[np.array(kind) == k for k in range(toxicity.GROUPS)], toxic])
    p = toxicity.Chain(docs, marks, fold, np.ones(600)).predict([{"éé1", "éé2", "l"}, {"l", "m"}, {"зло1", "зло3"}])
    assert p[0, 1] > 0.5 > p[0, 0] and p[0, -1] > 0.5 > p[1, -1] and p[2, 2] > 0.5
