"""N-gram Jaccard join: universe-partition pigeonhole over sets of word shingles, verified exactly.

Sets are grouped into size bands so that a partner is in the same band or the next. Two sets that meet in band b's partition
and reach the threshold differ in at most H tokens. Tokens are hashed into m segments; a segment is "found" if it is equal in
both sets or, where one-deletion neighbourhoods are indexed, differs in one token. An exact segment costs one signature and
absorbs one difference, a segment with deletions costs its size more and absorbs two; allocation() chooses how many of each by
expected signatures and chance candidates. The sum leaves SLACK, so that similar sets share need() found segments, not one.

Signatures are dealt by value and sorted, and each bucket is read as a stream. First, each set is paired with its bucket's first
set (one pair a set, never all pairs); pairs met in two buckets or more are verified on the texts, and links are united.
Buckets whose sets are then all in one component are done. Of the others, those with up to LIGHT components give their pairs
across components, of which only those met often enough for need() are verified: a pair met c times in light buckets can be
similar only if c and the smaller number of the two sets' heavy buckets make up need(). What is left are sets with need() heavy
buckets or more. They are joined cluster by cluster in blocks of BLOCK sets: overlaps come from products of token
columns, only a spanning forest of the links leaves a block pair. No bucket is held in memory as rows of all pairs, no case is dropped.

Equal sets are one node from the start; a task gives a node's signatures once. Shingles and words are known by 64-bit hashes,
a set by the 64-bit sum of its mixed hashes. A null or empty text has no words, an empty set, and is linked with nothing. Fewer
words than a shingle are one shingle. Rows are told apart by doc_id and text: different texts under one doc_id are compared as
any others are. A null doc_id is compared but names no component if others can. An empty table gives no rows; other columns
are unused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import chunks
from .common import saved, ship
from .components import components, forest

#: Components of a light bucket at most; signatures that a chance meeting costs; segments beyond the pigeonhole's; sets in a
#: block; nodes that a task remembers.
LIGHT, CANDIDATE, SLACK, BLOCK, SEEN = 8, 0.5, 2, 2_000, 200_000
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _C1
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles (uint64, sorted) of each text."""
    plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\t\n\v\f\r]", " ")
    split = pc.split_pattern(plain, " ")
    rows = np.repeat(np.arange(len(split), dtype=np.int32), np.diff(split.offsets.to_numpy()))
    coded = split.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(w) if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    full = np.array([bool(w) for w in coded.dictionary.to_pylist()], bool)
    index = coded.indices.to_numpy()
    keep = full[index]
    hashes, rows = own[index[keep]], rows[keep]
    n = np.bincount(rows, minlength=len(split))
    ends = np.cumsum(n)
    x = hashes.copy()
    for k in range(1, min(words, len(x))):
        x[: len(x) - k] = _mix(x[: len(x) - k]) * _C3 + hashes[k:]
    out = []
    for b, m in zip(ends.tolist(), n.tolist(), strict=True):
        if m >= words:
            out.append(np.unique(x[b - m : b - words + 1]))
        elif m:
            short = hashes[b - m : b - m + 1]
            for k in range(1, m):
                short = _mix(short) * _C3 + hashes[b - m + k : b - m + k + 1]
            out.append(_mix(short + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(x: np.ndarray) -> int:
    """The 64 bits that stand for a set."""
    total = (int(_mix(x).sum(dtype=np.uint64)) + len(x) * int(_C1)) % 2**64
    return total - 2**64 if total >= 2**63 else total


#: Sets up to this size have their bands at hand; larger ones make theirs.
LARGEST = 50_000_000


def bands(percent: int, most: int) -> list[int]:
    """The upper ends of the size bands; a partner of a set in one band is in it or in a neighbour."""
    his = [1]
    while his[-1] < most:
        his.append(max(his[-1] + 1, his[-1] * 100 // percent))
    return his


def allocation(hi: int, percent: int, sets: float) -> tuple[int, int]:
    """Segments, and how many of them have deletions, for a band's partition; (0, 0) where only equal sets can be similar. `sets`
    is about how many sets the partition holds."""
    h = hi * (100 - percent) // percent
    if h == 0:
        return 0, 0
    best, found = math.inf, (h + 1 + SLACK, 0)
    for d in range(0, (h + 1) // 2 + 1):
        # with deletions a found segment may stand for two of the sum, so that SLACK + 1 of them need twice as much of it
        m = d + max(0, h + 1 + (2 * SLACK + 1 if d else SLACK) - 2 * d)
        if m < 2:
            continue
        k = hi / m
        cost = m + d * k + CANDIDATE * sets * m * math.exp(-2 * k) * (1 + d / m * k)
        if cost < best:
            best, found = cost, (m, d)
    return found


def need(n: int, b: int, his: list[int], percent: int, m: int, d: int) -> int:
    """How many found segments a set of n shingles shares at least with any similar partner in band b's partition."""
    most = min(n * 100 // percent, his[b + 1]) if n <= his[b] else his[b]
    differ = (n + most) * (100 - percent) // (100 + percent)
    if d:
        return -(-(m + d - differ) // 2)
    return max(1, m - differ)


def signatures(x: np.ndarray, part: int, m: int, d: int) -> np.ndarray:
    """A set's signatures in one partition."""
    mixed = _mix(x)
    segment = (_mix(x ^ np.uint64((part + 1) * 0x51ED27)) % np.uint64(m)).astype(np.int64)
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, segment, mixed)
    tag = np.full(m, part, np.uint64) * _C2 + np.arange(m, dtype=np.uint64) * _C1
    out = [sums + tag]
    if d:
        with_deletions = segment < d
        out.append(sums[segment[with_deletions]] - mixed[with_deletions] + tag[segment[with_deletions]])
    return _mix(np.concatenate(out))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and node (null for an empty set) of every row of (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=8_000_000):
                sets = shingle_sets(part.column(2), words)
                n = np.array([len(x) for x in sets], np.int64)
                nodes = pa.array([_node(x) if len(x) else None for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), nodes], ["doc_id", "text_hash", "n_shingles", "node"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long")


def _signature_rows(docs: DataFrame, words: int, percent: int, sets: float) -> DataFrame:
    """sig, node and need of every document's set, in its own band's partition and in the one below."""
    plans: dict[int, tuple[int, int]] = {}
    first = bands(percent, LARGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        his = first
        seen: set[int] = set()  # copies need not be dealt again
        for batch in batches:
            for part in chunks(batch, most=2_000_000):
                sigs, nodes, needs = [], [], []
                for x in shingle_sets(part.column(0), words):
                    if not len(x) or (node := _node(x)) in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(node)
                    if len(x) > his[-2]:  # which a band and the next are needed for; those before stay as they are
                        his = bands(percent, 4 * len(x))
                    band = int(np.searchsorted(his, len(x)))
                    for b in (band, band - 1):
                        if b < 0 or b < band and len(x) > his[b] * 100 // percent:
                            continue
                        if b not in plans:
                            plans[b] = allocation(his[b], percent, sets)
                        if plans[b][0]:
                            sigs.append(signatures(x, b, *plans[b]))
                            nodes.append(np.full(len(sigs[-1]), node, np.int64))
                            needs.append(np.full(len(sigs[-1]), need(len(x), b, his, percent, *plans[b]), np.int32))
                if sigs:
                    columns = [np.concatenate(sigs).view(np.int64), np.concatenate(nodes), np.concatenate(needs)]
                    for at in range(0, len(columns[0]), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["sig", "node", "need"])

    return docs.select("text").mapInArrow(run, "sig long, node long, need int")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (sig, node, need) in order of sig and node; gives sig, first (the bucket's first node), node and need of the buckets
    with two nodes or more, each node once. Holds one row between batches."""
    sig0 = node0 = need0 = None  # the last row, while it is alone in its bucket
    open_sig = leader = last = None
    for batch in batches:
        sig, node, need_ = (batch.column(k).to_numpy() for k in range(3))
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        fresh[0] = last != (int(sig[0]), int(node[0]))
        last = (int(sig[-1]), int(node[-1]))
        sig, node, need_ = sig[fresh], node[fresh], need_[fresh]
        if not len(sig):
            continue
        if sig0 is not None:
            sig, node, need_ = np.append(sig0, sig), np.append(node0, node), np.append(need0, need_).astype(np.int32)
            sig0 = None
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(starts, len(sig)))
        first = node[starts]
        goes_on = open_sig is not None and sig[0] == open_sig
        if goes_on:
            first[0] = leader
        shown = sizes >= 2
        shown[0] |= goes_on
        if shown[-1]:
            open_sig, leader = int(sig[-1]), int(first[-1])
        else:
            open_sig, sig0, node0, need0 = None, sig[-1], node[-1], need_[-1]
        keep = np.repeat(shown, sizes)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(np.repeat(first, sizes)[keep]), pa.array(node[keep]), pa.array(need_[keep])], ["sig", "first", "node", "need"])


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                both = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                index = both.indices.to_numpy()
                sets = shingle_sets(both.dictionary, words)
                n, good = len(part), []
                for k in range(n):
                    x, y = sets[index[k]], sets[index[n + k]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        good.append(k)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(good, pa.int64())) for c in range(2)], ["u", "v"])

    left = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    right = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    joined = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "tx", "ty")
    return joined.mapInArrow(run, "u long, v long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of a shares with each of b. Tokens of many sets are columns of a product of matrices; pairs that share a
    rarer token are counted one by one."""
    rows = [np.repeat(np.arange(len(x)), list(map(len, x))) for x in (a, b)]
    tokens, index = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ia, ib = index[: len(rows[0])], index[len(rows[0]) :]
    na, nb = np.bincount(ia, minlength=len(tokens)), np.bincount(ib, minlength=len(tokens))
    common = np.flatnonzero((na > 0) & (nb > 0) & (na * nb > 64))
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(common), 2048):
        part = common[at : at + 2048]
        place = np.full(len(tokens), -1)
        place[part] = np.arange(len(part))
        x, y = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        for m, i, r in ((x, ia, rows[0]), (y, ib, rows[1])):
            own = place[i] >= 0
            m[r[own], place[i[own]]] = 1
        out += x @ y.T
    rare = (na > 0) & (nb > 0) & (na * nb <= 64)
    keep_a, keep_b = rare[ia], rare[ib]
    ta, ra, tb, rb = ia[keep_a], rows[0][keep_a], ib[keep_b], rows[1][keep_b]
    order = np.argsort(tb, kind="stable")
    tb, rb = tb[order], rb[order]
    begin, count = np.searchsorted(tb, ta), nb[ta]
    left = np.repeat(ra, count)
    right = rb[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    out += np.bincount(left * len(b) + right, minlength=out.size).reshape(out.shape)
    return out


def _join_cluster(nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) among the rows (cluster, size, node, text) of each cluster: a spanning forest of each block pair."""

    def run(table: pa.Table) -> pa.Table:
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        block = table["block"].to_numpy()
        sets = shingle_sets(table["text"].combine_chunks(), words)
        ids = table["node"].to_numpy()
        one, two = np.flatnonzero(block == x), np.flatnonzero(block == y)
        common = _overlaps([sets[k] for k in one], [sets[k] for k in two]).astype(np.int64)
        n = np.array([len(t) for t in sets])
        i, j = np.nonzero(100 * common >= percent * (n[one][:, None] + n[two][None, :] - common))
        u, v = forest(ids[one[i]], ids[two[j]])
        return pa.table({"u": u, "v": v})

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = nodes.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "text")
    return dealt.groupBy("cluster", "x", "y").applyInArrow(run, "u long, v long")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def classes(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    base, named = _classes(docs, words, percent)
    return base.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """_sets() of the documents; and by node the component and its first row: node, component_id, first_id and first_hash."""
    ship(docs.sparkSession)
    rows = _rows(docs)
    base = saved(_sets(rows, words), "sets")
    # a node's first row, of a null doc_id only if there is no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    firsts = saved(base.where(F.col("node").isNotNull()).groupBy("node").agg(first), "nodes")
    repeated = bool(base.groupBy("doc_id", "text_hash").count().where("count > 1").take(1))

    def texts(nodes: DataFrame) -> DataFrame:
        """node and text of the nodes given."""
        used = firsts.join(nodes, "node", "left_semi").select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("h"))
        found = rows.join(used, rows["doc_id"].eqNullSafe(F.col("id")) & (rows["text_hash"] == F.col("h"))).select("node", "text")
        return found.dropDuplicates(["node"]) if repeated else found

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        return _verified(pairs, saved(texts(ends), "texts"), words, percent)

    sets = base.count() / 8  # about what one band's partition holds
    dealt = _signature_rows(rows, words, percent, sets).repartition("sig").sortWithinPartitions("sig", "node")
    buckets = saved(dealt.mapInArrow(_buckets, "sig long, first long, node long, need int"), "buckets")

    # pairs with the bucket's first set, met twice or more
    pairs = buckets.where("node <> first").groupBy(F.col("first").alias("x"), F.col("node").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    pairs = saved(pairs.where("n >= 2").select("x", "y"), "pairs")
    links = saved(verified(pairs), "links")
    label = _labels(firsts, components(links))

    # buckets that are not within one component
    labelled = buckets.select("sig", "node", "need").join(label, "node")
    span = labelled.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    mixed = saved(labelled.join(span, "sig"), "mixed")
    spread = mixed.select("sig", "c").distinct().groupBy("sig").agg(F.count(F.lit(1)).alias("classes"))
    mixed = mixed.join(spread, "sig").select("sig", "node", "need", "c", (F.col("classes") > LIGHT).alias("heavy"))
    mixed = saved(mixed, "spread")
    counts = saved(mixed.groupBy("node").agg(F.first("c").alias("c"), F.min("need").alias("need"), F.count_if("heavy").alias("heavy")), "counts")

    light = mixed.where("not heavy").select("sig", "c", "node")
    few = light.select("sig", "c").distinct()
    across = few.select("sig", F.col("c").alias("c1")).join(few.select("sig", F.col("c").alias("c2")), "sig").where("c1 < c2")
    left, right = light.select("sig", F.col("c").alias("c1"), F.col("node").alias("x")), light.select("sig", F.col("c").alias("c2"), F.col("node").alias("y"))
    met = across.join(left, ["sig", "c1"]).join(right, ["sig", "c2"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    side = lambda k: counts.select(F.col("node").alias(k), F.col("need").alias(f"need_{k}"), F.col("heavy").alias(f"heavy_{k}"))
    met = met.join(side("x"), "x").join(side("y"), "y").where(F.col("n") + F.least("heavy_x", "heavy_y") >= F.greatest("need_x", "need_y"))
    found = verified(saved(met.select("x", "y"), "more"))

    # sets that may meet in heavy buckets alone, in clusters that such buckets connect
    crowded = counts.where("heavy >= need").select("node")
    if crowded.take(1):
        within = mixed.where("heavy").join(crowded, "node", "left_semi").select("sig", "node")
        head = within.groupBy("sig").agg(F.min("node").alias("head"))
        cluster = components(within.join(head, "sig").select(F.col("node").alias("u"), F.col("head").alias("v")))
        sizes = cluster.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        members = cluster.join(sizes, "component").select("node", F.col("component").alias("cluster"), "size")
        found = found.unionByName(_join_cluster(members.join(texts(members.select("node")), "node"), words, percent))
    label = saved(_labels(firsts, components(saved(links.union(found), "links"))), "labels")
    least = label.join(firsts, "node").groupBy("c").agg(F.min("first").alias("least"))
    named = label.join(least, "c").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.doc_id").alias("first_id"), F.col("least.text_hash").alias("first_hash"))
    return base, named


def _labels(firsts: DataFrame, known: DataFrame) -> DataFrame:
    """node and c, its component so far, named by a node; a set without links is alone."""
    return firsts.select("node").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("c"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of two rows or more: that with the smallest doc_id (null after all others, the smallest hash of
    the text where two texts share it), with its own columns; of rows that repeat both, one. Texts without words stay."""
    base, named = _classes(docs, words, percent)
    of = base.where(F.col("node").isNotNull()).join(named, "node")
    own = of.select("doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).alias("stays"))
    marks = own.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    marks = saved(marks.select(F.col("doc_id").alias("marked_id"), F.col("text_hash").alias("marked_hash"), "stays"), "marks")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("marked_id")) & (F.xxhash64(docs["text"]) == F.col("marked_hash"))
    rest = docs.join(marks.hint("shuffle_hash"), same, "left_anti")
    if not marks.where("stays").take(1):
        return rest
    again = docs.join(marks.where("stays").hint("shuffle_hash"), same)
    row = F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row")
    return rest.unionByName(again.groupBy("marked_id", "marked_hash").agg(row).select("row.*"))


#: The classes in DuckDB for four words and 85 percent, by counting the shingles that documents share.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] || chr(10) || w[i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
      UNION ALL SELECT doc_id, array_to_string(w, chr(10)) FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON d.doc_id = r.a LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
