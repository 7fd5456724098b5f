"""What a worker remembers of pieces, and what it holds at once."""

import numpy as np

from palimpsest.llm import packing, token_files, tokens


def test_a_worker_remembers_what_it_meets_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    enc = tokens.PieceEncoder("byte_bpe_50k.json", True)
    common, given, call = [f"common{k}" for k in range(50)], [], enc.tok.encode_batch_fast

    class Counted:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return call(texts, **options)

    tok, enc.tok = enc.tok, Counted()
    for n in range(40):
        texts = [" ".join([w, f"rare{n}x{k}"]) + "." for k, w in enumerate(common)] + ["", "  two ", "\n\n a\n"]
        got = enc.encode(texts)
        assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.known) <= 600 and enc.used < 5000
    # a piece that comes again and again is given to the tokenizer once (each time that the
    # memory was full, before)
    assert sum(t.split("\n").count("common7") for t in given) == 1


def test_few_pieces_go_to_the_tokenizer_at_once(monkeypatch):
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc = tokens.PieceEncoder(name, spaced)
        most, call = [], enc.tok.encode_batch_fast

        class Counted:
            def __getattr__(self, name):
                return getattr(tok, name)  # noqa: B023

            def encode_batch_fast(self, texts, **options):
                most.append(len(texts))  # noqa: B023
                return call(texts, **options)  # noqa: B023

        tok, enc.tok = enc.tok, Counted()
        text = " ".join(f"w{k * 7919 % 100003}" for k in range(10_000))
        assert enc.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
        assert max(most) <= 4096


def test_blocks_are_read_one_at_a_time(monkeypatch):
    import pyarrow as pa

    ids = [np.arange(5), np.arange(3) + 70_000]
    rows = [
        {"file": 1, "block": b, "first": 8 * b, "doc_ids": [b, None], "lengths": [5, 3], "n_ids": 8, "n_words": 0, "words": token_files.simple8b_encode(np.concatenate(ids)).astype("<u8").tobytes()}
        for b in range(3)
    ]
    batch = pa.RecordBatch.from_pylist(rows, schema=token_files._SCHEMA)

    class Columns:  # a copy of the whole batch in Python is not to be had
        num_rows, column = batch.num_rows, staticmethod(batch.column)

    got = [r for x in token_files._from_blocks(iter([Columns()])) for r in x.to_pylist()]
    want = [{"file": 1, "doc_id": d, "at": 8 * b + at, "ids": i.astype("<u4").tobytes()} for b in range(3) for d, at, i in ((b, 0, ids[0]), (None, 5, ids[1]))]
    assert got == want


def test_packing_leaves_no_pieces_in_its_worker(monkeypatch):
    import pyarrow as pa
    import pyspark

    class Context:
        get, partitionId = classmethod(lambda cls: cls), staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [" ".join(f"word{k}" for k in range(3000)), "a b"]})
    for _ in range(2):  # and the next task learns anew
        rows = [r for x in packing._pack_partition(iter([batch]), 1, 2048) for r in x.to_pylist()]
        ids = b"".join(r["ids"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == 1)
        assert np.frombuffer(ids, "<u4").tolist() == [*tokens.word_bpe().tok.encode(batch.column("text")[0].as_py(), add_special_tokens=False).ids, 1]
        assert not tokens.word_bpe().known


def test_stars_take_no_round_and_a_path_few(spark, monkeypatch):
    from palimpsest.llm import common

    written, write = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, name, path=None: written.append(name) or write(df, name, path))
    for edges, most in (([(5, 1), (1, 7), (9, 2), (9, 2), (4, 4), (None, 3)], 1), ([(k, k + 1) for k in range(12)], 6), ([(3, 1), (3, 2)], 3), ([], 1)):
        written.clear()
        root = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
        for _ in root:
            for a, b in (e for e in edges if e[0] in root and e[1] in root and e[0] != e[1]):
                root[a] = root[b] = min(root[a], root[b])
        got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == sorted(root.items())
        assert len(written) <= most


def test_labelled_texts_are_made_once(spark, monkeypatch):
    import contextlib
    import io

    from palimpsest.llm import toxicity

    plans, write = [], toxicity.stage

    def kept(df, name):
        with contextlib.redirect_stdout(out := io.StringIO()):
            df.explain()
        plans.append(out.getvalue())
        return write(df, name)

    monkeypatch.setattr(toxicity, "stage", kept)
    docs = [(k, f"text {k} " + ("bad" if k % 3 == 0 else "fine"), "de" if k % 2 else "en") for k in range(60)]
    chain = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int"))
    assert max(p.count("SortMergeJoin") for p in plans) == 1
    p = chain.predict([toxicity.features("bad text"), toxicity.features("fine text")])
    assert p[0, -1] > 0.9 and p[1, -1] < 0.1


def test_new_pieces_are_learned_in_few_passes(monkeypatch):
    enc = tokens.PieceEncoder("byte_bpe_50k.json", True)
    lots, add, searched, search = [], enc._add, [], tokens.pc.match_substring_regex
    monkeypatch.setattr(enc, "_add", lambda some, ids, sizes: lots.append(len(some)) or add(some, ids, sizes))
    monkeypatch.setattr(tokens.pc, "match_substring_regex", lambda *a, **b: searched.append("regex") or search(*a, **b))
    monkeypatch.setattr(tokens.pc, "match_substring", lambda *a, **b: 1 / 0)
    texts = [" ".join(f"w{k * 7919 % 100003}" for k in range(10_000)), "a  b", "a\n\nb c", " \n x ", "\n y<|endoftext|> z", "end\n", "a\n b \nc", ""]
    assert [g.tolist() for g in enc.encode(texts)] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(lots) <= tokens.AT_ONCE and len([n for n in lots if n > 100]) == 3 and searched == ["regex"]


def test_block_pairs_are_not_shuffled(spark, monkeypatch):
    from palimpsest.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "SENT_BYTES", 3 * 32 * 16 * 8)  # three blocks go to the tasks at once
    rng = np.random.default_rng(4)
    base = rng.standard_normal((90, 16))
    x = np.concatenate([base, base + 0.08 * rng.standard_normal(base.shape), rng.standard_normal((180, 16)), base[:9], base + 0.05 * rng.standard_normal(base.shape)])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    stages, real = [], embedding_dedup._found

    def watched(*args):
        spark.sparkContext.setJobGroup("pairs", "pairs")
        out, seen = real(*args), spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup("rest", "rest")
        stages.extend(len(seen.getJobInfo(j).stageIds) for j in seen.getJobIdsForGroup("pairs"))
        return out

    monkeypatch.setattr(embedding_dedup, "_found", watched)
    got = sorted(embedding_dedup.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect())
    assert [r.n_links for r in got] == links.sum(1).tolist() and links.sum() > 150
    reach = np.linalg.matrix_power((links | np.eye(len(x), dtype=bool)).astype(float), 16) > 0
    assert [r.component_id for r in got] == [int(np.flatnonzero(row)[0]) for row in reach]
    assert len(stages) > 4 and set(stages) == {1}  # several stretches, none of them shuffled
