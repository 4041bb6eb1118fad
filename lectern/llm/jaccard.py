"""N-gram Jaccard join in metric space.

A document's set holds its distinct shingles of five words; Jaccard distance
is a metric on these sets.  Documents link when their similarity reaches 0.75,
that is, at a distance of at most ``RADIUS`` = 0.25.  The join finds all links
that can change the components, exactly:

1. Documents with equal sets are one node (distance 0).
2. Any two nodes within the radius share one of their first
   ``n - ceil(0.75 n) + 1`` shingles in a common order (rare ones first).  The
   nodes with such a shingle in common form a run.  Set size is the distance
   to the empty set, so links join sizes within a factor of 0.75; runs are cut
   into windows of such sizes, each node in two of them.  Windows of a few
   nodes are compared directly, if sizes and the shingle's places in both sets
   allow a link.  In larger ones the smallest node is the pivot.  The windows
   of one pivot make up its Voronoi region: nodes at distance 1 from every
   pivot are in none, and a node near several pivots is replicated to each of
   their regions, so every other link lies inside a region.
3. The distance of each member to its pivot is computed.  Members within the
   radius link to the pivot, hence belong to one component, and need not be
   compared with each other.
4. The rest of a region is cut into rings of one radius around the pivot; by
   the triangle inequality a link joins members of the same or of adjacent
   rings, so each member is replicated to the next ring as well.  Rings whose
   members are in one component are done.
5. A ring whose sets fill many blocks is split by several new pivots: each
   member's home is the Voronoi region of its nearest pivot, and it is
   replicated to every region whose pivot is at most two radii farther off, as
   a member linked with one at home there must be.  Only members outside the
   ring's main component look for partners, each in its home region.
   This repeats as long as regions shrink by half; what is left is joined
   member by member, in blocks of bounded bytes.

How far a region is split depends on its size, but every branch finds the
same links: what the pivots do not rule out is compared.

The order of shingles only affects cost: those counted as frequent come last.
Frequencies come from all documents; a bounded number of the most frequent
shingles is sent to all tasks.

A null or empty text has an empty set, ``n_shingles`` 0, and is linked with
nothing.  Every input row gives one row.  Rows that share a ``doc_id`` are one
vertex of the graph, so their links are united; rows without ``doc_id`` get no
component and link nothing.  Columns besides ``doc_id`` and ``text`` are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import spread
from lectern.llm.graph import components
from lectern.llm.spark import groups_for, in_arrow, let_go, settle, settle_bucketed, shuffle_width
from lectern.llm.words import hash_words, release, slices, split_words, windows

SHINGLE = 5
PERCENT = 75
RADIUS = 0.25

#: Frequent shingles: percent of each set that is counted, least count, and greatest number (16 bytes each) sent to the tasks.
COUNTED, COMMON_LEAST, COMMON_MOST = 40, 3, 1 << 19
#: Runs up to this size are compared pair by pair.
SMALL_RUN = 8
#: Bytes of sets on each side of a block (a set counts ``SET_BYTES`` more), blocks of a region that is not split further, and pivots of one that is.
BLOCK_BYTES, SET_BYTES, LEAF_BLOCKS, PIVOTS = 4 << 20, 2048, 64, 8
#: Bits of the filter that tells which documents' sets are needed.
FILTER_BITS = 1 << 26
#: Bytes of input for each group of shingles that Python counts or sorts at once.
GROUP_BYTES = 8 << 20


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; the whole sequence where it is shorter."""
    flat, off = split_words(texts, lower=True)
    h = hash_words(flat)
    runs = windows(h, n)
    out = []
    for a, b in zip(off.tolist(), off[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(windows(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(h[:0])
    return out


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Frequent shingles, most frequent last.

    Counts the ``COUNTED`` lowest percent of each set by hash, which holds all
    shingles that the hash order alone would put first.  A slice sends each
    distinct shingle once, so a shingle of all documents is no hot key.
    """
    buckets = groups_for(docs, GROUP_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                token, n = np.unique(np.concatenate([s[: len(s) * COUNTED // 100 + 1] for s in sets]), return_counts=True)
                bucket = (token % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                token, n, bucket = token[order], np.minimum(n[order], 65535).astype(np.uint16), bucket[order]
                if not len(token):
                    continue
                cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for c in (token, n)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), *blobs], ["bucket", "tokens", "counts"])

    def total(table: pa.Table) -> pa.Table:
        release()
        token, n = _flat(table.column("tokens"), np.uint64)[0], _flat(table.column("counts"), np.uint16)[0]
        order = np.argsort(token)
        token, n = token[order], n[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, head) if len(head) else n
        many = n >= COMMON_LEAST
        return pa.table([pa.array(token[head][many].view(np.int64)), pa.array(n[many])], ["token", "n"])

    counted = in_arrow(docs.select("text"), count, "bucket int, tokens binary, counts binary").groupBy("bucket").applyInArrow(total, "token long, n long")
    top = counted.orderBy(F.desc("n"), "token").limit(COMMON_MOST).select("token").toArrow()
    let_go(docs.sparkSession)
    return top.column("token").to_numpy().view(np.uint64)[::-1].copy()


def shingled(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``doc_id, n_shingles, digest`` of the set and ``prefix`` (order keys of its first shingles)."""
    by_value = np.argsort(common)
    sent = docs.sparkSession.sparkContext.broadcast((common[by_value], by_value.astype(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, place = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                digest, prefix, size = [], [], []
                for s in shingle_sets(part.column("text")):
                    size.append(len(s))
                    if not len(s):
                        digest.append(None)
                        prefix.append(None)
                        continue
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    key = s >> np.uint64(1)
                    if len(value):
                        at = np.minimum(np.searchsorted(value, s), len(value) - 1)
                        known = value[at] == s
                        key[known] = place[at[known]] | np.uint64(1 << 63)
                        key.sort()
                    prefix.append(key[: len(s) - -(-PERCENT * len(s) // 100) + 1].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "n_shingles", "digest", "prefix"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, digest binary, prefix binary")


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of all blobs and their number in each blob."""
    blobs = column.to_pylist()
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(blobs), dtype), np.array([len(b) // size for b in blobs], np.int64)


def _meta(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A set's size (22 bits, cut) and a shingle's relative place in it (10 bits, rounded down)."""
    return (at * 1023 // n << 22 | np.minimum(n, (1 << 22) - 1)).astype(np.uint32)


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets with these sizes and places of their first common shingle can link."""
    na, nb = (a & 0x3FFFFF).astype(np.int64), (b & 0x3FFFFF).astype(np.int64)
    left = np.minimum(na - (a >> 22) * na // 1023, nb - (b >> 22) * nb // 1023)
    # overlap of t / (1 + t) of both sizes, t = PERCENT / 100
    fits = left * (100 + PERCENT) >= PERCENT * (na + nb)
    return fits & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) | (np.maximum(na, nb) == 0x3FFFFF)


def first_regions(nodes: DataFrame, buckets: int) -> DataFrame:
    """Distinct ``pivot, x, star`` of all runs of nodes ``rep, n, prefix``; without ``star`` a pair of a small run."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = _flat(batch.column("prefix"), np.uint64)
            owner = np.repeat(batch.column("rep").to_numpy(), n)
            meta = _meta(np.repeat(batch.column("n").to_numpy(), n), spread(np.zeros(len(n), np.int64), n))
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, owner, meta, bucket = key[order], owner[order], meta[order], bucket[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for c in (key, owner, meta)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), *blobs], ["bucket", "keys", "owners", "metas"])

    def runs(table: pa.Table) -> pa.Table:
        release()
        key, owner, meta = (_flat(table.column(c), t)[0] for c, t in (("keys", np.uint64), ("owners", np.int64), ("metas", np.uint32)))
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else np.zeros(0, bool)
        key, owner, meta = key[many], owner[order][many], meta[order][many]
        size = np.floor(np.log(np.maximum(meta & 0x3FFFFF, 1)) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)
        key, owner, meta, size = np.tile(key, 2), np.tile(owner, 2), np.tile(meta, 2), np.concatenate([size, size + 1])
        order = np.lexsort((owner, size, key))
        key, owner, meta, size = key[order], owner[order], meta[order], size[order]
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] != size[:-1])])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([head, [len(key)]]))
        large = n > SMALL_RUN
        pivots = [np.repeat(owner[head[large]], n[large] - 1)]
        others = [owner[spread(head[large] + 1, n[large] - 1)]]
        stars = len(pivots[0])
        for step in range(1, SMALL_RUN):
            own = ~large & (n > step)
            a = spread(head[own], n[own] - step)
            ok = _possible(meta[a], meta[a + step])
            pivots.append(owner[a][ok])
            others.append(owner[a + step][ok])
        pair = np.stack([np.concatenate(pivots), np.concatenate(others), np.arange(sum(map(len, pivots))) < stars], axis=1)
        pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)
        return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(pair[:, 2] == 1)], ["pivot", "x", "star"])

    dealt = in_arrow(nodes.select("rep", "n", "prefix"), deal, "bucket int, keys binary, owners binary, metas binary")
    found = dealt.groupBy("bucket").applyInArrow(runs, "pivot long, x long, star boolean")
    return found.groupBy("pivot", "x").agg(F.bool_or("star").alias("star"))


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``lectern_maybe``: true where ``doc_id`` is one of ``ids``, and for few others.

    One bit for each of ``FILTER_BITS`` hash values goes to all tasks, 8 MB in
    all at any number of ids, so no text is shuffled.
    """
    h = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1
    bits = ids.filter("doc_id IS NOT NULL").select(h().alias("h")).groupBy(F.bitmap_bucket_number("h").alias("lectern_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("lectern_bits"))
    found = rows.withColumn("lectern_at", F.when(F.col("doc_id").isNotNull(), h())).withColumns({"lectern_k": F.bitmap_bucket_number("lectern_at"), "lectern_at": F.bitmap_bit_position("lectern_at")}).join(F.broadcast(bits), "lectern_k", "left")
    byte = F.conv(F.hex(F.expr("substring(lectern_bits, CAST(lectern_at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("lectern_at") % 8).cast("int")).bitwiseAND(1) == 1
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(bit, F.lit(False)).alias("lectern_maybe"))


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, s`` (the set as bytes) of the documents in ``ids``, and of few others, which no later join asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "s"])

    return in_arrow(marked(docs.select("doc_id", "text"), ids).filter("lectern_maybe").select("doc_id", "text"), run, "doc_id long, s binary")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def links_between(token: np.ndarray, size: np.ndarray, rows: np.ndarray, columns: np.ndarray, near, width: int = 1024, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in ``rows`` and ``columns`` whose sets link, among those for which ``near(rows, columns)`` holds.

    Intersections are products of 0/1 matrices over the shingles that both
    sides have, ``tile`` rows and ``width`` shingles at a time.
    """
    code = np.unique(token, return_inverse=True)[1].ravel().astype(np.int32)
    first = np.concatenate([[0], np.cumsum(size)])

    def side(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return code[spread(first[own], size[own])], np.repeat(np.arange(len(own), dtype=np.int32), size[own])

    of_rows, of_columns = side(rows), side(columns)
    common = np.intersect1d(of_rows[0], of_columns[0])

    def shared_only(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(common, c)
        known = place < len(common)
        known[known] = common[place[known]] == c[known]
        order = np.argsort(place[known], kind="stable")
        return place[known][order], at[known][order]

    (rc, ra), (cc, ca) = shared_only(*of_rows), shared_only(*of_columns)
    for low in range(0, len(rows), tile):
        mine = (ra >= low) & (ra < low + tile)
        tc, ta, n = rc[mine], ra[mine] - low, min(tile, len(rows) - low)
        both = np.zeros((n, len(columns)), np.float32)
        for a in range(0, len(common), width):
            b = min(a + width, len(common))
            own = slice(*np.searchsorted(tc, (a, b)))
            if own.start == own.stop:
                continue
            other = slice(*np.searchsorted(cc, (a, b)))
            x, y = np.zeros((n, b - a), np.float32), np.zeros((len(columns), b - a), np.float32)
            x[ta[own], tc[own] - a] = 1
            y[ca[other], cc[other] - a] = 1
            both += x @ y.T
        at = np.arange(low, low + n)
        union = size[rows[at]][:, None] + size[columns][None, :] - both
        i, j = np.nonzero((100 * both >= PERCENT * union) & near(at, np.arange(len(columns))))
        yield i + low, j


def distances(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """``region, pivot, x, star, d, linked`` and the size of ``x`` for ``region, pivot, x, star``.

    ``sets`` is bucketed by document, so the first join shuffles no sets.  In
    the second, one row of the sets meets the many rows of a hot pivot, and the
    skew join splits those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, linked, size, held, p = [], [], [], None, None
            for pb, xb in zip(batch.column("sp"), batch.column("sx")):
                blob = pb.as_buffer()
                if p is None or blob != held:
                    held, p = blob, np.frombuffer(blob, np.uint64)
                x = np.frombuffer(xb.as_buffer(), np.uint64)
                both = shared(p, x)
                union = len(p) + len(x) - both
                d.append(1 - both / union)
                size.append(len(x))
                linked.append(100 * both >= PERCENT * union)
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("pivot"), batch.column("x"), batch.column("star"), pa.array(d, pa.float64()), pa.array(linked, pa.bool_()), pa.array(size, pa.int64())], ["region", "pivot", "x", "star", "d", "linked", "size"])

    with_x = regions.join(sets.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")), "x")
    # files without buckets, so that this join shuffles both sides and can split a hot pivot
    of_pivots = settle(sets.join(regions.select(F.col("pivot").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    with_both = with_x.join(of_pivots.select(F.col("doc_id").alias("pivot"), F.col("s").alias("sp")), "pivot")
    return in_arrow(with_both.select("region", "pivot", "x", "star", "sx", "sp"), run, "region long, pivot long, x long, star boolean, d double, linked boolean, size long")


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the component of ``x`` as ``label``."""
    label = components(links).select(F.col("id").alias("x"), F.col("component").alias("label"))
    return members.join(label, "x", "left").withColumn("label", F.coalesce("label", "x"))


def rings(member: DataFrame) -> DataFrame:
    """Members ``region, x, label, d, size, asks`` of rings with several components; ``asks`` marks those outside the most frequent one."""
    ring = F.least(F.floor(F.col("d") / RADIUS), F.lit(3)).cast("int")
    home = F.explode(F.array(ring, ring + 1)).alias("ring")
    member = settle(member.select("region", "x", "label", "d", "size", home).filter("ring < 4").select(F.xxhash64("region", "ring").alias("region"), "x", "label", "d", "size").distinct(), light=True)
    count = member.groupBy("region", "label").agg(F.count("*").alias("n"))
    main = count.groupBy("region").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"))
    open_ = main.filter(F.col("m.n") < F.col("n")).select("region", F.col("m.label").alias("main"))
    return settle(member.join(open_, "region").withColumn("asks", F.col("label") != F.col("main")).drop("main"), light=True)


def weighed(members: DataFrame) -> DataFrame:
    """``members`` of regions that still have something to ask, with the region's ``bytes`` and its blocks of all members and of those that ask."""
    weight = 8 * F.col("size") + SET_BYTES
    blocks = lambda b: F.ceil(b / BLOCK_BYTES).cast("int")
    per = members.groupBy("region").agg(F.sum(weight).alias("bytes"), F.sum(F.when(F.col("asks"), weight)).alias("b"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    per = per.filter("b IS NOT NULL AND l0 <> l1").select("region", "bytes", blocks(F.col("bytes")).alias("n"), blocks(F.col("b")).alias("n_asks"))
    return settle(members.join(per, "region"), light=True)


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` found by comparing the members that ask with all of their region, block by block."""
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("x", "region"), F.col(n)).cast("int")
    base = ("region", "x", "label", "d")
    one = F.col("n") * F.col("n_asks") == 1
    # a row of a single block both asks and answers
    role = lambda asks, answers: F.struct(F.lit(asks).alias("asks"), F.lit(answers).alias("answers"))
    single = members.filter(one).select(*base, F.lit(0).alias("i"), F.lit(0).alias("j"), "asks", F.lit(True).alias("answers"))
    asked = members.filter(~one & F.col("asks")).select(*base, own("n_asks").alias("i"), F.explode(every("n")).alias("j"), role(True, False).alias("r")).select(*base, "i", "j", "r.*")
    others = members.filter(~one).select(*base, F.explode(every("n_asks")).alias("i"), own("n").alias("j"), role(False, True).alias("r")).select(*base, "i", "j", "r.*")
    rows = single.unionByName(asked).unionByName(others).join(sets.select(F.col("doc_id").alias("x"), "s"), "x")

    def compare(table: pa.Table) -> pa.Table:
        release()
        asks, answers = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "answers"))
        x, label, d = (table.column(c).to_numpy() for c in ("x", "label", "d"))
        token, size = _flat(table.column("s"), np.uint64)
        u, v = np.flatnonzero(asks), np.flatnonzero(answers)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (np.abs(d[u[i]][:, None] - d[v[j]][None, :]) <= RADIUS + 1e-9) & (label[u[i]][:, None] != label[v[j]][None, :])

        a, b = [x[:0]], [x[:0]]
        for i, j in links_between(token, size, u, v, near):
            # one link for each pair of components is enough
            _, first = np.unique(np.stack([label[u[i]], label[v[j]]], axis=1), axis=0, return_index=True)
            a.append(x[u[i[first]]])
            b.append(x[v[j[first]]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.groupBy("region", "i", "j").applyInArrow(compare, "a long, b long")


def voronoi(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the regions of new pivots, without labels, and the links ``a, b`` of members to pivots.

    A region's pivots are its members with the least hashes.  Home is the
    nearest pivot, the one with the smaller id on ties.
    """
    order = F.struct(F.xxhash64("x").alias("h"), F.col("x").alias("p"))
    # each member hands on itself, each partial list the least few of what it has seen
    spread_ = members.groupBy("region", F.pmod(F.xxhash64("x", F.lit(1)), F.greatest(F.lit(1), F.col("n"))).alias("part"))
    few = spread_.agg(F.slice(F.array_sort(F.collect_list(order)), 1, PIVOTS).alias("ps"))
    pivots = few.groupBy("region").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ps"))), 1, PIVOTS).alias("ps")).select("region", F.explode("ps.p").alias("pivot"))
    measured = settle(distances(members.select("region", "x", F.lit(True).alias("star")).join(pivots, "region"), sets))
    near = measured.groupBy("region", "x").agg(F.min(F.struct("d", "pivot")).alias("home"), F.collect_list(F.struct("pivot", "d")).alias("to"))
    cells = near.select("region", "x", "home", F.explode("to").alias("t")).filter(F.col("t.d") <= F.col("home.d") + 2 * RADIUS + 1e-9)
    rows = members.drop("d", "label", "n", "n_asks", "above").withColumnRenamed("bytes", "above").join(cells, ["region", "x"])
    at_home = F.col("t.pivot") == F.col("home.pivot")
    out = rows.select(F.xxhash64("region", "t.pivot").alias("region"), "x", "size", "above", F.col("t.d").alias("d"), (F.col("asks") & at_home).alias("asks"))
    return out, measured.filter("linked AND pivot <> x").select(F.col("pivot").alias("a"), F.col("x").alias("b"))


def linked_components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, component`` of the nodes ``rep, prefix`` that have a link."""
    regions = settle(first_regions(nodes, groups_for(docs, GROUP_BYTES))).withColumn("region", F.col("pivot"))
    ids = regions.select(F.col("pivot").alias("doc_id")).union(regions.select("x")).distinct()
    sets = settle_bucketed(sets_of(docs, ids), "doc_id", shuffle_width(docs.sparkSession))
    measured = settle(distances(regions, sets))
    links = measured.filter("linked").select(F.col("pivot").alias("a"), F.col("x").alias("b"))
    members = weighed(rings(labelled(measured.filter("star"), links)).withColumn("above", F.lit(2**62)))
    while True:
        split = (F.col("n") * F.col("n_asks") > LEAF_BLOCKS) & (2 * F.col("bytes") <= F.col("above"))
        links = links.union(settle(block_links(members.filter(~split), sets)))
        members = members.filter(split)
        if members.isEmpty():
            return components(links)
        cells, found = voronoi(members, sets)
        links = links.union(found)
        members = weighed(labelled(cells, links))


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    docs = docs.select("doc_id", "text")
    table = settle(shingled(docs, common_shingles(docs)))
    nodes = settle(table.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("n_shingles", "doc_id").alias("n"), F.min_by("prefix", "doc_id").alias("prefix")))
    linked = settle(linked_components(docs, nodes), light=True)
    rows = table.select("doc_id", "n_shingles", "digest").join(nodes.select("digest", "rep"), "digest", "left")
    # a doc_id with several texts unites their components
    own = rows.filter("rep IS NOT NULL AND doc_id IS NOT NULL AND rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    split = table.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("digest").alias("k")).filter("k > 1").isEmpty()
    if not split:
        linked = settle(components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(own)), light=True)
        rows = rows.withColumn("rep", F.when(F.col("rep").isNotNull(), F.col("doc_id")))
    out = rows.join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, that with the smallest id, of each component; rows without id stay.

    Only documents that may have to go, by a bitmap of their ids, are shuffled
    to be compared with the ids exactly.
    """
    found = settle(join(docs), light=True)
    gone = found.filter("doc_id <> component_id").select("doc_id")
    rows = marked(docs, gone)
    kept = rows.filter("lectern_maybe").join(gone, "doc_id", "left_anti").unionByName(rows.filter("NOT lectern_maybe")).select(*docs.columns)
    if found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))
