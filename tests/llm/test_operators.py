"""Edge cases and brute-force checks of the training-data operators."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import discriminant, embedding_dedup, jaccard_join, packing, personal_data, quality_rules, token_files, toxicity, warc
from palimpsest.llm.chunk_codec import ChunkEncoder, encode_decode
from palimpsest.llm.common import connected_components, fresh_path
from palimpsest.llm.tokens import byte_bpe, word_bpe

LONG = " ".join(f"w{i % 911}x" for i in range(20_000))
TEXTS = ["one two three four five six seven " * 6, "one two three four five six seven " * 6, None, "", "  \n\t ", LONG, "a", "Mail a.b@x.org or +1 555 123 4567, 10.0.0.1, 4111 1111 1111 1111", "you idiot"]
SCHEMA = "doc_id long, text string, kept boolean, spans string, rejected int, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, True, "s", 1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id here", None, None, None, None), (0, TEXTS[0], True, "s", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (5, 0, 0), (8, 1, 1), (8, 1, 1), (None, 1, 1), (3, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, labels, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert got[0].n_words == 42 and got[0].n_repeat_words == 42 and got[0].base_failed and not got[0].kept
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[2].base_failed
    assert got[5].n_words == 20_000
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).count() == len(TEXTS) + 2


def test_quality_scores_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") if i % 3 else f"w{rng.randrange(30)}" for i in range(rng.randint(20, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (70, None)]
    marks = [(i, int(i % 2 == 0), 0) for i in range(60)] + [(None, 1, 0), (4, 1, 0), (5, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for t in texts for w in t.split()}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(a, b) for t in texts for a, b in zip(t.split(), t.split()[1:])}
    twos = {(r.a, r.b): r.h for r in spark.createDataFrame([(a, b, hashed[a], hashed[b]) for a, b in pairs], "a string, b string, x long, y long").select("a", "b", F.xxhash64("x", "y").alias("h")).collect()}
    for buckets in (1, 64, 1 << 12):
        grams = [[hashed[w] % buckets for w in ws] + [twos[p] % buckets for p in zip(ws, ws[1:])] for ws in ((t or "").split() for _, t in rows)]
        trusted = [i is not None and i < 60 and i % 2 == 0 for i, _ in rows]
        raw, target = Counter(g for x in grams for g in x), Counter(g for x, t in zip(grams, trusted) if t for g in x)
        want = {}
        for (i, _), x, t in zip(rows, grams, trusted):
            share = (target.total() - t) / (raw.total() - 1)
            want[i] = sum(np.log((target[g] - t + 1) / ((raw[g] - 1) * share + 1)) for g in x) / max(len(x), 1)
        got = quality_rules.quality_rules(frame, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), buckets=buckets).collect()
        assert len(got) == len(rows) and all(abs(r.llr - want[r.doc_id]) < 1e-5 for r in got)
        # the cut: all but LOST of the trusted documents reach it, and what reaches it stays
        cut = min(0, sorted(r.llr for r, in [(x,) for x in got] if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == 0)[0])
        assert all(r.kept == (not r.base_failed and r.llr >= cut) for r in got)


def test_quality_rules_keep_clashing_columns(spark, labels):
    rows = [(0, "some plain words " * 10, 7, "a", True), (1, None, 8, "b", False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _w int, _h1 string, kept boolean")
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame, labels).collect()}
    assert (got[0]["_w"], got[0]["_h1"], got[1]["_w"]) == (7, "a", 8)
    assert quality_rules.keep_good(frame, labels).columns == frame.columns
    assert quality_rules.base_rules(frame).columns == [*frame.columns, *quality_rules.OWN[:6]]


def test_toxicity(docs, labels, empty):
    assert toxicity.score(docs, labels).count() == len(TEXTS) + 2
    assert toxicity.score(docs, labels.limit(0)).filter("rejected").count() == 0
    assert toxicity.score(empty, labels).count() == 0


def test_toxic_share_of_the_sample_does_not_move_probabilities(spark):
    # no word tells the classes apart: each probability is the labels' share, 1 in 10
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefghijkl", k=8)) + f" n{i}", "x" if i % 3 else "y") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    for sample in (80, 6000):
        got = [r.p_toxic for r in toxicity.score(frame, marks, sample).collect()]
        assert abs(np.mean(got) - 0.1) < 0.02


def test_discriminant(docs, labels, empty):
    rows = discriminant.score_documents(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in discriminant.score_documents(docs, labels.limit(0)).collect())
    assert discriminant.score_documents(empty, labels).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for k in range(60):
        x = rng.integers(0, 2**62, 300, dtype=np.uint64) >> rng.integers(0, 63, 300, dtype=np.uint64)
        x = np.concatenate((x[: k * 5], np.array([2**64 - 1, 2**32, 2**32 - 1, 0], dtype=np.uint64), np.zeros(k * 9, dtype=np.uint64)))
        assert (token_files.simple8b_decode(token_files.simple8b_encode(x)) == x).all()


def test_token_files(spark, docs):
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(docs, path)
    at = 0
    for r in token_files.read_token_files(spark, path).orderBy("start").collect():
        ids = np.frombuffer(r.ids, dtype="<u4")
        text = "no id here" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.start == at and ids.tolist() == [*byte_bpe().tok.encode(text, add_special_tokens=False).ids, 0]
        at += len(ids)


def test_piece_and_chunk_encoding():
    rng = random.Random(1)
    letters = ["a", "B", " ", " ", "\n", "é", "\t", "1", "'s", "!", " ", "́", "<|endoftext|>", "ß", "wort "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for _ in range(400)]
    for enc in (byte_bpe(), word_bpe()):
        assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ChunkEncoder().encode(texts)] == [e.ids for e in word_bpe().tok.encode_batch(texts, add_special_tokens=False)]


def test_encode_decode(docs, empty):
    tok = word_bpe().tok
    for r in encode_decode(docs).collect():
        ids = tok.encode("no id here" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert encode_decode(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.with_crc(packing.pack_documents(docs)).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for w in windows.values():
        total = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == total
            total += r.length
        assert total <= 2048 and (total == 2048 or total & (total - 1) == 0)
    # each id of each document lies in exactly one piece (documents 0 and null repeat)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text in [*enumerate(TEXTS), (None, "no id here")]:
        ids = np.array([*word_bpe().tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine, times = pieces.pop(doc), 2 if doc == 0 else 1
        covered = np.zeros(len(ids), dtype=int)
        for r in mine:
            covered[r.start : r.start + r.length] += 1
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        assert (covered == times).all()
    assert not pieces
    assert packing.pack_documents(empty).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        target, sums = rng.randint(1, 60), {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        taken = packing.fullest(sorted(counts), counts, target)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= target)
        assert all(n <= counts[k] for k, n in taken.items())


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_rejects_records_in_payloads(spark, compression):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    htmls = ["x" + fake, fake * 40, "", None, "é" * 900, "é" * 900, "WARC/1.0\r\n", "y" * 1200 + fake, "z" * 999, "z" * 999, "é" * 900]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://a/{i}\r\nX: y", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_warc(pages.coalesce(1), path, compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # splits within records
    try:
        got = {int(r.record_id[10:-1]): r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == list(range(len(htmls)))
    for i, h in enumerate(htmls):
        if i in (4, 5):
            assert got[i].warc_type == "revisit" and got[i].refers_to == "<urn:page:10>"
        else:
            assert got[i].warc_type == "response" and got[i].payload == (h or "")
            assert got[i].payload_digest == hashlib.sha1((h or "").encode()).hexdigest()


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 64))
    near = base[:40] + 0.03 * rng.standard_normal((40, 64))
    chain = np.array([np.cos(a) * base[0] / np.linalg.norm(base[0]) + np.sin(a) * np.eye(64)[0] for a in np.linspace(0, 1.4, 9)])
    x = np.concatenate((base, near, base[:5], chain))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(link, label[None, :], len(x)).min(1))
    assert [got[i].n_links for i in range(len(x))] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_jaccard_join(spark, docs, empty):
    rng, texts = random.Random(6), []
    for _ in range(40):
        words = [f"t{rng.randrange(5000)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            if len(copy) > 3 and rng.random() < 0.8:
                copy[rng.randrange(len(copy))] = f"u{rng.randrange(9)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [None, "", "x y", "x  y"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    part = list(range(len(texts)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    got = {r.doc_id: r for r in jaccard_join.similar_documents(frame, 3, 90, 100).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == part
    assert jaccard_join.similar_documents(docs).count() == len(TEXTS) + 2
    assert jaccard_join.keep_one(docs).filter("doc_id = 1").count() == 0
    assert jaccard_join.similar_documents(empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 400)}}


def test_personal_data(docs, empty):
    rows = {r.doc_id: r for r in personal_data.find(docs).collect()}
    text = TEXTS[7]
    assert [(s.kind, text[s.start : s.end]) for s in rows[7].base] == [("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 555 123 4567")]
    assert all(set(r.base) <= set(r.spans) for r in rows.values()) and rows[2].spans == []
    clean = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert clean[7] == "Mail [EMAIL] or [PHONE], [IP], [CARD]" and clean[2] is None and clean[6] == "a"
    assert personal_data.find(empty).count() == 0


def test_skip_edges_carry_a_label():
    field = personal_data.Field.__new__(personal_data.Field)
    n = len(personal_data.KINDS) + 1
    field.unary = np.log(np.full((personal_data.SHAPES, n), 1 / n))
    field.pair = [np.zeros((n, n)), 3 * np.eye(n) - 1]
    text = "call +1 555 123 4567890 now, or later +15551234567890 or 15551234567890"
    graph = personal_data.Graph([text], [personal_data.base_spans(text)])
    assert len(graph.edges[1]) == 1
    assert personal_data.Field.marginals(field, graph)[-1].argmax() == personal_data.KINDS.index("phone") + 1


def test_pipeline_rows(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) > 50


def test_vocabulary_holds_every_feature_that_a_model_chooses(spark):
    rows = [(i, i % 3, int(i % 4 == 0), int(i % 8 == 0), 0, ["all", f"w{i % 7}"] + ["bad"] * (i % 4 == 0) + ["worse"] * (i % 8 == 0) + ["fine"] * (i % 4 > 1)) for i in range(300)]
    sample = spark.createDataFrame(rows, "doc_id long, fold long, toxic long, insult long, contempt long, features array<string>")
    names = toxicity._vocabulary(sample)
    sets, fold = [set(r[5]) for r in rows], np.array([r[1] for r in rows])
    for column in (2, 3):
        y = np.array([bool(r[column]) for r in rows])
        for inside in (fold >= 0, *[fold != k for k in range(toxicity.FOLDS)]):
            assert set(toxicity.choose([s for s, i in zip(sets, inside, strict=True) if i], y[inside])) <= names
    assert {"bad", "worse", "fine"} <= names and "all" not in names
