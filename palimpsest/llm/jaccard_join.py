"""N-gram Jaccard join with a token-group matrix. Exact.

Documents with equal shingle sets are one class. Shingles are ordered rarest first, by a
count over all documents in a sketch of fixed width; two sets of the wanted similarity
share SHARED of their first shingles (their prefixes), or as many as they must have in
common. Of the classes with a prefix shingle, that with the commonest prefix is its hub
(the text that near copies were made from has no shingle of its own), and a class lies
with the hub of most of its shingles. The classes of a hub form groups of bounded size,
each with a copy of the hub. A group is a matrix: the union of its members' shingles, and
which member holds which.

Each group is compared within first, and what its links join, over all groups by their
hubs, becomes one component. Only then do groups meet: those of one hub, and those that
share enough prefix shingles, unless all their classes are one component already. Each
class's overlap with the other group's union bounds what any member can reach; a group
pair whose bounds leave something is opened and compared as a product of 0/1 matrices.
It returns a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, connected_components, group_back, group_min_back, perhaps_in, slices, spanning, stage

#: Buckets of the shingle counts, at least and at most (16 MB are broadcast then), and bytes
#: of text for each. A smaller sketch makes prefixes less rare, and changes no result.
SKETCH, SKETCH_MOST, SKETCH_BYTES = 1 << 16, 1 << 24, 64
#: Slices of the sketch that tasks send.
SLICES = 64
#: Classes of a group, and shingles of its members, about.
GROUP, GROUP_SHINGLES = 256, 1 << 20
#: Prefix shingles that two linked sets must share.
SHARED = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: bijective."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row, from the words' hashes."""
    out = _mix(h[: len(h) - k + 1] + np.uint64(k))
    for j in range(1, k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return out


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the ascending distinct 64-bit hashes of its k-word shingles, A-Z
    lower-cased; with fewer words, of the whole sequence; none without words."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8")) for w in words), dtype=np.uint64, count=len(words))
    word = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # none but at a text's ends
    h = hashed[coded.indices.to_numpy()][word] if len(words) else np.zeros(0, dtype=np.uint64)
    at = np.concatenate(([0], np.cumsum(word)))[lists.offsets.to_numpy()].tolist()
    rolled = _shingles(h, k) if len(h) >= k else h[:0]
    out = []
    for a, b in zip(at, at[1:]):
        out.append(np.unique(rolled[a : b - k + 1]) if b - a >= k else _shingles(h[a:b], b - a) if b > a else h[:0])
    return out


def _count_buckets(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total = np.zeros(buckets, dtype="<u4")
    for b in slices(batches, "text", rows=4096):
        at, n = np.unique(np.concatenate(shingle_sets(b.column("text"), k)) & np.uint64(buckets - 1), return_counts=True)
        total[at.astype(np.int64)] += n.astype("<u4")
    parts = total.reshape(SLICES, -1)
    some = TaskContext.get().partitionId() // 256  # so many tasks meet before all do
    yield pa.RecordBatch.from_pydict({"part": pa.array(range(SLICES), pa.int32()), "some": pa.array([some] * SLICES, pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())})


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), dtype="<u4").astype(np.uint64) for x in pdf["counts"])
    packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "some": pdf["some"].iloc[:1], "counts": [packed]})


def _rarity(docs: DataFrame, k: int) -> np.ndarray:
    """Log2 of the number of (document, shingle) in each bucket, one byte each. Tasks
    send their counts in packed slices; a slice is summed over some tasks, then all."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(SKETCH_MOST, max(SKETCH, 1 << (size // SKETCH_BYTES).bit_length()))
    schema = "part int, some int, counts binary"
    counts = docs.select("text").mapInArrow(lambda it: _count_buckets(it, k, buckets), schema)
    counts = counts.groupBy("part", "some").applyInPandas(_add_up, schema).groupBy("part").applyInPandas(_add_up, schema)
    out = np.zeros((SLICES, buckets // SLICES), dtype=np.uint8)
    for r in counts.toLocalIterator():  # SKETCH_MOST counts in all at most, whatever the input
        out[r["part"]] = np.log2(np.frombuffer(zlib.decompress(r["counts"]), dtype="<u4") + 1.0).astype(np.uint8)
    return out.ravel()


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, rarity) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in slices(batches, "text", rows=4096):
        n, sig, firsts, common = [], [], [], []
        for s in shingle_sets(b.column("text"), k):
            n.append(len(s))
            sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            least = -(-num * len(s) // den)  # in common with a linked set, at least
            count = rarity.value[(s & np.uint64(len(rarity.value) - 1)).astype(np.int64)]
            order = np.lexsort((s, count))[: len(s) - least + min(SHARED, least)]
            common.append(int(8 * count[order].mean()) if len(s) else 0)
            firsts.append(s[order].view(np.int64))
        ends = np.concatenate(([0], np.cumsum([len(f) for f in firsts]))).astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": b.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "common": pa.array(common, pa.int64()),
                "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts]))),
            }
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are shuffled twice."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for b in slices(batches, "text"):
        texts = [pack((t or "").encode("utf-8")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])


class Matrix:
    """A group's members, their union of shingles, and who holds which."""

    def __init__(self, members: pa.StructArray, k: int):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sets = shingle_sets(pa.array([unpack(t).decode("utf-8") for t in members.field("text").to_pylist()], pa.large_string()), k)
        self.reps, self.sizes = members.field("rep").to_numpy(), np.array([len(s) for s in sets])
        self.union, self.cells = np.unique(np.concatenate(sets), return_inverse=True)
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)

    def on(self, columns: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members whose shingles at the chosen places of the union are enough for a link,
        and their cells: (members, row of each cell, column among the chosen)."""
        place = np.full(len(self.union), -1, dtype=np.int64)
        place[columns] = np.arange(len(columns))
        column = place[self.cells]
        hit = column >= 0
        enough = den * np.bincount(self.rows[hit], minlength=len(self.sizes)) >= num * self.sizes
        hit &= enough[self.rows]
        at = np.cumsum(enough) - 1
        return np.flatnonzero(enough), at[self.rows[hit]], column[hit]


def linked(one: Matrix, two: Matrix | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets between two groups, or within one (i < j)."""
    none = np.zeros(0, dtype=np.int64)
    if two is None:  # shingles of one member alone add to no intersection
        columns = np.flatnonzero(np.bincount(one.cells, minlength=len(one.union)) > 1)
        keep1, row1, col1 = keep2, row2, col2 = one.on(columns, num, den)
        n2 = one.sizes
    else:
        _, at1, at2 = np.intersect1d(one.union, two.union, assume_unique=True, return_indices=True)
        columns = at1
        keep1, row1, col1 = one.on(at1, num, den)
        keep2, row2, col2 = two.on(at2, num, den) if len(keep1) else (none, none, none)
        n2 = two.sizes
    if not len(keep1) or not len(keep2):
        return none, none
    both = np.zeros((len(keep1), len(keep2)), dtype=np.float64)
    for lo in range(0, len(columns), 8192):  # strips of the vocabulary bound the matrices
        parts = []
        for size, row, col in ((len(keep1), row1, col1), (len(keep2), row2, col2)):
            mine = (col >= lo) & (col < lo + 8192)
            part = np.zeros((size, min(8192, len(columns) - lo)), dtype=np.float32)
            part[row[mine], col[mine] - lo] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    i, j = np.nonzero(den * both >= num * (one.sizes[keep1][:, None] + n2[keep2][None, :] - both))
    i, j = keep1[i], keep2[j]
    return (i[i < j], j[i < j]) if two is None else (i, j)


def _forest(reps: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Each linked class with the smallest that it reaches over the links (i, j)."""
    ids, place = np.unique(reps, return_inverse=True)  # a hub may be there twice
    root = ids[spanning(len(ids), place[i], place[j])]
    hit = root != ids
    return pa.RecordBatch.from_pydict({"a": pa.array(ids[hit], pa.int64()), "b": pa.array(root[hit], pa.int64())})


def _within(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            m = Matrix(batch.column("members")[row].values, k)
            yield _forest(m.reps, *linked(m, None, num, den))


def _between(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one, two = (Matrix(batch.column(c)[row].values, k) for c in ("members", "members2"))
            i, j = linked(one, two, num, den)
            if len(i):
                yield _forest(np.concatenate((one.reps, two.reps)), i, j + len(one.reps))


def _groups(shared: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n, hub, g) of the classes in shared (rep, n, token, hub) that share enough of
    their prefix to link with any other. The least size of a linked set bounds how much."""
    enough = F.col("tokens") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * (num * num) / F.lit(den * den)))
    homes = stage(shared.groupBy("rep").agg(F.max("n").alias("n"), F.mode("hub", True).alias("hub"), F.count("*").alias("tokens")).filter(enough).drop("tokens"), "homes")
    sized = group_back(homes, "hub", F.struct(F.count("*").alias("m"), F.sum("n").alias("t")), lambda x: F.greatest(F.ceil(F.sum(x["m"]) / GROUP), F.ceil(F.sum(x["t"]) / GROUP_SHINGLES)), "parts")
    return stage(sized.select("rep", "n", "hub", F.xxhash64("hub", F.pmod(F.xxhash64("rep"), "parts")).alias("g")), "groups")


def _pairs(shared: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """(g1, g2): groups that may hold a link between two components.

    placed: rep, n, hub, g, component. Groups of one hub all meet; others need enough
    prefix shingles in common. A pair whose classes are all of one component is left out,
    as is one whose sizes are too far apart."""
    bounds = placed.groupBy("g", "hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("small"), F.max("n").alias("large"))
    bounds = stage(bounds, "bounds")
    one = bounds.select(*[F.col(c).alias(f"{c}1") for c in bounds.columns])
    two = bounds.select(*[F.col(c).alias(f"{c}2") for c in bounds.columns])
    fit = (F.col("large2") * den >= F.col("small1") * num) & (F.col("large1") * den >= F.col("small2") * num)
    open_ = (F.least("lo1", "lo2") != F.greatest("hi1", "hi2")) & fit
    own = one.join(two.hint("merge"), (F.col("hub1") == F.col("hub2")) & (F.col("g1") < F.col("g2")) & open_).select("g1", "g2")
    # the matrix's cells: shingle, hub, and the hub's groups that hold it; shingles of one
    # hub or one component have no more to say
    cells = shared.select("rep", "token").join(placed.select("rep", "hub", "g", "component").hint("merge"), "rep")
    cells = cells.groupBy("token", "hub").agg(F.collect_set("g").alias("gs"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    hubs = cells.groupBy("token").agg(F.collect_list(F.struct("hub", "gs")).alias("hubs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    hubs = hubs.filter((F.size("hubs") > 1) & (F.col("lo") != F.col("hi")))
    crossed = hubs.select("hubs", F.explode("hubs").alias("h1")).select("h1", F.explode("hubs").alias("h2")).filter("h1.hub < h2.hub")
    met = crossed.select(F.explode("h1.gs").alias("a"), F.col("h2.gs").alias("bs")).select("a", F.explode("bs").alias("b"))
    met = met.groupBy(F.least("a", "b").alias("g1"), F.greatest("a", "b").alias("g2")).agg(F.count("*").alias("common"))
    met = met.join(one.hint("merge"), "g1").join(two.hint("merge"), "g2")
    need = F.least(F.lit(SHARED), F.ceil(F.least("small1", "small2") * num / F.lit(den)))
    return own.unionByName(met.filter(open_ & (F.col("common") >= need)).select("g1", "g2"))


def similar_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text): documents
    link when den * intersection >= num * union of their k-word shingle sets, at equality
    too.

    Texts without words, null texts and rows with a null id link with nothing and are
    their own component. Rows that repeat a doc_id count as one document (with the
    union of what its texts link with) and each keep their row. Other columns are ignored.
    An empty table gives no rows. A very long text is one set; a task holds a group, of at
    most about GROUP_SHINGLES shingles or one text more."""
    spark = docs.sparkSession
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rarity = spark.sparkContext.broadcast(_rarity(every, k))
    rows = stage(every.mapInArrow(lambda it: _prefixes(it, k, num, den, rarity), "doc_id long, n_shingles long, sig binary, common long, prefix array<long>"), "prefixes")
    alive = rows.filter("doc_id is not null and sig is not null")
    owned = stage(group_min_back(alive.select("doc_id", "n_shingles", "sig"), "sig", F.col("doc_id"), "rep").select("doc_id", "n_shingles", "rep"), "owned")
    classes = alive.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("common").alias("common"), F.first("prefix").alias("prefix"))
    entries = classes.select("rep", "n", "common", F.explode("prefix").alias("token"))
    hubs = entries.groupBy("token").agg(F.count("*").alias("classes"), F.max(F.struct("common", "rep"))["rep"].alias("hub")).filter("classes > 1").select("token", "hub")
    shared = stage(entries.select("rep", "n", "token").join(hubs.hint("merge"), "token"), "shared")
    grouped = _groups(shared, num, den)
    # a group's hub is its guest, so that what links with the hub is joined over its groups
    members = stage(grouped.select(F.col("rep").alias("doc_id"), "g").unionByName(grouped.select(F.col("hub").alias("doc_id"), "g")).distinct(), "members")
    # texts travel, not shingles: they pack into a fraction of the bytes
    texts = every.filter(perhaps_in(members, "doc_id")).mapInArrow(_packed, "doc_id long, text binary").join(members.hint("merge"), "doc_id")
    groups = stage(texts.groupBy("g").agg(F.collect_list(F.struct(F.col("doc_id").alias("rep"), "text")).alias("members")), "opened")
    edges = "a long, b long"
    inner = stage(groups.select("members").mapInArrow(lambda it: _within(it, k, num, den), edges), "links")
    first = stage(connected_components(inner), "components")
    placed = grouped.join(first.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    pairs = stage(_pairs(shared, stage(placed, "placed"), num, den), "pairs")
    wanted = groups.filter(perhaps_in(pairs.select(F.explode(F.array("g1", "g2")).alias("g")), "g"))
    crossed = pairs.join(wanted.withColumnRenamed("g", "g1").hint("merge"), "g1")
    crossed = crossed.join(wanted.select(F.col("g").alias("g2"), F.col("members").alias("members2")).hint("merge"), "g2")
    outer = stage(crossed.select("members", "members2").mapInArrow(lambda it: _between(it, k, num, den), edges), "links")
    found = first
    if not outer.isEmpty():
        found = stage(connected_components(outer.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
    joined = owned.join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    out = joined.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = rows.filter("doc_id is null or sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component: that of its smallest doc_id.

    Of rows that repeat that id, the one with the smallest text stays. Rows with a null id
    take part by their texts, behind all others; those without a word are all kept, as are
    other documents without words (one row an id). Ids lie below 2^62. All of docs' columns
    stay as they are; an empty table gives no rows."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    # beyond any id in use, the same for equal texts
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    nameless = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(f"[^{SPACE[1:-1]}]"), F.lit(False))
    keyed = docs.filter(~nameless).select(F.coalesce(F.col("doc_id").cast("bigint"), stand_in).alias(key), F.struct("*").alias("row"))
    found = similar_documents(keyed.select(F.col(key).alias("doc_id"), "row.text"), k, num, den)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    one = keyed.join(kept.hint("merge"), key, "left_semi").groupBy(key).agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return one.select("row.*").unionByName(docs.filter(nameless))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_shingles and component_id of each document, by similar_documents(): three-word
    shingles, 0.9."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)
