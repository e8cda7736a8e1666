"""N-gram Jaccard join with signature trees.

Texts' sets of 5-word shingles link at 100 * intersection >= 75 * union. In any order of all shingles, two linked
sets share at least min(m) of their first p(n) = n - ceil(3n/4) + m(n), m(n) = ceil(n/8) (prefix filtering,
extended). No step makes all pairs of a group, and texts without near copies are not moved:

1. Candidates. In the order of their hashes, rows of the prefixes' shingles are sorted by shingle; only texts that
   have enough that another text has too go on, one for each class of equal sets.
2. Order. All shingles of these are sorted by shingle and counted. Then the order is: shingles of one set, those of at
   most COMMON, the others. A set whose prefix is its own drops out, which leaves hardly more than the sets with links.
3. Blocks. Sets with the same min-hash meet in blocks of bounded size. A signature tree over a block has nodes that
   hold their members' token bitmaps combined with OR, and the range of their sizes. Two nodes, or one with itself, are
   traversed at once; a pair goes when sizes or the largest possible overlap rule out a link, or when all members
   are connected already. What is left is compared exactly.
4. The rest, which is what keeps links whole. Sets of different components that share enough uncommon prefix shingles
   make pairs, of at most COMMON sets each shingle. Sets whose prefix has enough common shingles, as in large groups of copies,
   are packed into blocks by component; blocks that share such a shingle have their trees traversed against each
   other, and report only edges that connect components. Of each two components one pair is compared first, all
   others only if the two are still apart.

links() also counts every document's links. All links lie in components, so there each two sets of a component are
compared exactly, one of each class of equal sets, in tiles of bounded size that are dealt over the tasks; the counts
are weighed by the sizes of the classes.

Shingles are compared by 64-bit hashes, equal sets by 128 bits. Null, empty and wordless texts have no shingles and stay alone;
fewer than five words are one shingle. Rows without doc_id are left out; rows that repeat a doc_id have one
result, and doc_id must name one text. An empty table gives an empty result. Columns besides doc_id and
text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import batch_of, drop_stored, ids_and_bytes, lean, mix, picked, runs, stored, text_batches, texts

if TYPE_CHECKING:  # a worker that joins texts needs no pandas, which takes 27 MB
    import pandas as pd

WORDS = 5
#: Bytes of text that are hashed at once: the hashes take some 50 bytes a byte.
PIECE = 1 << 18
#: Rows that a task settles among themselves before the rest is sent.
BUFFER = 1 << 18
#: Sets and bytes of hashes of a block.
BLOCK = 1024
BLOCK_BYTES = 1 << 22
#: Shingles of the sets of a tile, about; a tile has about BLOCK sets at most.
TILE = 1 << 19
#: A shingle of more candidates than this is common.
COMMON = 64
_MUL = 0x9E3779B97F4A7C15


# -- sets of shingles -------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


_POWERS, _INVERSES = _powers(_MUL, PIECE + 1), _powers(pow(_MUL, -1, 1 << 64), PIECE + 1)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
_WHITE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
_PLACES = [np.uint64(pow(_MUL, 3 + i, 1 << 64)) for i in range(WORDS)]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of at most PIECE bytes, and where they start: differences of a running sum of the
    bytes' numbers times powers; of long words, xxh3."""
    a = np.frombuffer(data, np.uint8)
    white = np.ones(len(a) + 2, bool)
    white[1:-1] = _WHITE[a]
    edges = np.flatnonzero(white[1:] != white[:-1])
    start, end = edges[0::2], edges[1::2]
    total = np.zeros(len(a) + 1, np.uint64)
    np.take(_BYTES, a, out=total[1:])
    total[1:] *= _POWERS[: len(a)]
    np.cumsum(total, out=total)
    h = mix((total[end] - total[start]) * _INVERSES[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > 64):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h, start


def _long_text(t: bytes) -> np.ndarray:
    """Word hashes of a text of more than PIECE bytes, cut at white space; a word as long is hashed by itself."""
    out, at = [], 0
    while at < len(t):
        end = at + PIECE
        if end < len(t):
            cut = max(t.rfind(w, at, end) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # no white space: the word goes on to the next
                nexts = [x for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := t.find(w, end)) >= 0]
                end = min(nexts, default=len(t))
                out.append(np.array([xxhash.xxh3_64_intdigest(t[at:end])], np.uint64))
                at = end
                continue
            end = cut + 1
        out.append(word_hashes(t[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _of_words(h: np.ndarray) -> np.ndarray:
    """Hashes of each WORDS neighbours, or of all words if they are fewer."""
    k = min(WORDS, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out += h[j : n + j] * _PLACES[j]
    return mix(out)


def sets_of(texts_: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; A-Z count as a-z."""
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def close():
        h, start = word_hashes(b"\n".join(group))
        at = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in group]))
        whole = _of_words(h) if len(h) >= WORDS else h
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out.append(np.unique(whole[lo : hi - WORDS + 1]) if hi - lo >= WORDS else _of_words(h[lo:hi]))
        group.clear()

    held = 0
    for t in texts_:
        t = t.lower()
        if held + len(t) + 1 > PIECE and group:
            close()
            held = 0
        if len(t) >= PIECE:  # nothing is held then
            out.append(np.unique(_of_words(_long_text(t))))
        else:
            group.append(t)
            held += len(t) + 1
    if group:
        close()
    return out


def shingles(text: bytes) -> np.ndarray:
    return sets_of([text])[0]


def _ceil_div(a, b):
    return -(-a // b)


def extra(n):
    return _ceil_div(n, 8)


def prefix_size(n):
    return np.minimum(n, n - _ceil_div(3 * n, 4) + extra(n))


def least_shared(n):
    """Prefix shingles that a set of n shares with any set it links to."""
    return extra(_ceil_div(3 * n, 4))


def linked(overlap, a, b):
    """100 * overlap >= 75 * union."""
    return 7 * overlap >= 3 * (a + b)


# -- signature trees ---------------------------------------------------------------


class Components:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def signature(hashes: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of width bits that has a set's tokens."""
    bits = np.zeros(width, bool)
    bits[(hashes % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits)


def width_for(n: int) -> int:
    """Bits for sets of up to n, so that few tokens share one."""
    return 1 << max(9, min(15, int(8 * n - 1).bit_length()))


class Node:
    __slots__ = ("lo", "hi", "least", "most", "slack", "bits", "kids")


class SignatureTree:
    """Over items lo to lo + len(sizes) in the order given: leaves are items; a node has its members' bitmaps combined with OR, their
    range of sizes, and at most how many tokens of one member share a bit with another (slack)."""

    FAN = 8

    def __init__(self, bits: list[np.ndarray], sizes: list[int], lo: int = 0):
        level = []
        for i, n in enumerate(sizes):
            x = Node()
            x.lo, x.hi, x.least, x.most, x.bits, x.kids = lo + i, lo + i + 1, n, n, bits[i], ()
            x.slack = n - int(np.bitwise_count(x.bits).sum())
            level.append(x)
        while len(level) > 1:
            up = []
            for k in range(0, len(level), self.FAN):
                kids = level[k : k + self.FAN]
                x = Node()
                x.lo, x.hi, x.least, x.most, x.slack = kids[0].lo, kids[-1].hi, min(c.least for c in kids), max(c.most for c in kids), max(c.slack for c in kids)
                x.bits, x.kids = np.bitwise_or.reduce([c.bits for c in kids]), kids
                up.append(x)
            level = up
        self.root = level[0] if level else None


def possible(a: Node, b: Node) -> int:
    """The largest overlap that members of two nodes can have: tokens they share are on bits that both have, and one bit
    holds one token but for the slack."""
    return int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.slack, b.slack)


def traverse(a: Node, b: Node, comps: Components, check) -> None:
    """Calls check(i, j) for pairs of items below a and b that may link and are not connected; it returns whether they
    do, and then they are."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if 4 * a.most < 3 * b.least or 4 * b.most < 3 * a.least:
            continue
        root = comps.find(a.lo)
        if all(comps.find(i) == root for x in (a, b) for i in range(x.lo, x.hi)):
            continue
        if a is not b and not linked(possible(a, b), a.least, b.least):
            continue
        if not a.kids and not b.kids:
            if a is not b and check(a.lo, b.lo):
                comps.union(a.lo, b.lo)
        elif a is b:
            stack.extend((a.kids[i], a.kids[j]) for i in range(len(a.kids)) for j in range(i, len(a.kids)))
        elif b.kids and (not a.kids or b.hi - b.lo >= a.hi - a.lo):
            stack.extend((a, k) for k in b.kids)
        else:
            stack.extend((k, b) for k in a.kids)


def _checker(sets: list[np.ndarray]):
    return lambda i, j: bool(linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])))


def join_block(sets: list[np.ndarray]) -> list[int]:
    """For each set (in order of size) the position of its component's first set, links being exact."""
    comps, check = Components(len(sets)), _checker(sets)
    for i in range(1, len(sets)):  # most of a block is like its first
        if 4 * len(sets[0]) >= 3 * len(sets[i]) and check(0, i):
            comps.union(0, i)
    if any(comps.find(i) for i in range(len(sets))):
        width = width_for(max(map(len, sets)))
        tree = SignatureTree([signature(s, width) for s in sets], [len(s) for s in sets])
        traverse(tree.root, tree.root, comps, check)
    return [comps.find(i) for i in range(len(sets))]


def join_blocks(a: list[np.ndarray], b: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
    """Edges (positions in a + b) that connect components of a with components of b, by labels, or within one block if b is
    empty; links being exact. Each block in order of labels."""
    sets = a + b
    comps, check, edges, seen = Components(len(sets)), _checker(sets), [], {}
    for i, x in enumerate(labels):
        comps.union(seen.setdefault(x, i), i)
    width = width_for(max(map(len, sets)))

    def checked(i, j):
        if not check(i, j):
            return False
        edges.append((i, j))
        return True

    bits = [signature(s, width) for s in sets]
    one = SignatureTree(bits[: len(a)], [len(s) for s in a]).root
    other = SignatureTree(bits[len(a) :], [len(s) for s in b], len(a)).root if b else one
    traverse(one, other, comps, checked)
    return edges


# -- step 1: candidates --------------------------------------------------------------


def _batches(batches, *more: str):
    """IDs, sets and other columns of each batch of texts."""
    for b in batches:
        rows = list(ids_and_bytes(b))
        if rows:
            yield np.array([i for i, _ in rows], np.int64), sets_of([t for _, t in rows]), *(b.column(b.schema.get_field_index(c)) for c in more)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set) and 128 bits d1, d2 that name the set; stored."""

    def run(batches):
        for ids, sets in _batches(batches):
            d = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield batch_of(doc_id=ids, n=np.array([len(s) for s in sets], np.int64), d1=np.array([x >> 64 for x in d], np.uint64).view(np.int64), d2=np.array([x & (1 << 64) - 1 for x in d], np.uint64).view(np.int64))

    return stored(texts(docs).where("doc_id is not null").mapInArrow(lean(run), "doc_id bigint, n bigint, d1 bigint, d2 bigint").dropDuplicates(["doc_id"]), "digests")


def _prefix_rows(batches):
    """Rows (key, doc_id, shared 0) of the smallest hashes of each text; of those that several texts of the task have, one row,
    and how many each of these texts has (shared above 0)."""
    rows, held = [], 0

    def flush():
        key, doc = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = runs(key)
        many = np.repeat((size := np.diff(np.append(first, len(key)))) > 1, size)
        send = ~many
        send[first] = True
        who, n = np.unique(doc[many], return_counts=True)
        rows.clear()
        return batch_of(key=np.concatenate([key[send], mix(who.view(np.uint64))]).view(np.int64), doc_id=np.concatenate([doc[send], who]), shared=np.concatenate([np.zeros(send.sum(), np.int32), n.astype(np.int32)]))

    for ids, sets in _batches(batches):
        prefixes = [s[: prefix_size(len(s))] for s in sets]
        rows.append((np.concatenate(prefixes), np.repeat(ids, [len(p) for p in prefixes])))
        held += len(rows[-1][0])
        if held > BUFFER:
            yield flush()
            held = 0
    if held:
        yield flush()


def _shared_rows(batches):
    """Of rows sorted by key: doc_id and how many keys it shares."""
    kept, known = None, None
    for b in batches:
        key, doc, shared = (b.column(c).to_numpy() for c in ("key", "doc_id", "shared"))
        aside = shared > 0
        if aside.any():
            yield batch_of(doc_id=doc[aside], shared=shared[aside].astype(np.int64))
        key, doc = key[~aside], doc[~aside]
        if kept is not None:
            key, doc = np.concatenate([kept[0], key]), np.concatenate([kept[1], doc])
        if not len(key):
            continue
        first = runs(key)
        size = np.diff(np.append(first, len(key)))
        hit = np.repeat(size > 1, size) | (key == known if known is not None else False)
        if hit[-1]:
            known = key[-1]
        wait = (key == key[-1]) & ~hit
        kept = key[wait], doc[wait]
        if hit.any():
            who, n = np.unique(doc[hit], return_counts=True)
            yield batch_of(doc_id=who, shared=n)


def _least(n):
    return F.ceil(F.ceil(n * 3 / 4) / 8)


def candidates(docs: DataFrame, info: DataFrame) -> DataFrame:
    """doc_id, n: the first text of each class of equal sets that may have links to other sets; stored."""
    rows = texts(docs).where("doc_id is not null").mapInArrow(lean(_prefix_rows), "key bigint, doc_id bigint, shared int")
    shared = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_shared_rows), "doc_id bigint, shared bigint").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    firsts = info.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    return stored(firsts.join(shared, "doc_id").where(F.col("shared") >= _least(F.col("n"))).select("doc_id", "n"), "candidates")


# -- step 2: order -----------------------------------------------------------------------


def _token_rows(batches, most: int):
    """Rows (key, node, weight 1) of all hashes; of a hash that more than most sets of the task have, one row of their number, and
    rows of weight 0, by node, with the hash as token."""
    rows, held = [], 0

    def flush():
        key, node = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        first = runs(key)
        size = np.diff(np.append(first, len(key)))
        many = size > most
        aside = np.repeat(many, size)
        n, k = (~aside).sum(), many.sum()
        rows.clear()
        return batch_of(
            key=np.concatenate([key[~aside], key[first[many]], mix(node[aside].view(np.uint64))]).view(np.int64), node=np.concatenate([node[~aside], node[first[many]], node[aside]]),
            weight=np.concatenate([np.ones(n, np.int32), size[many].astype(np.int32), np.zeros(aside.sum(), np.int32)]), token=np.concatenate([np.zeros(n + k, np.uint64), key[aside]]).view(np.int64),
        )

    for b in batches:
        sets = [np.frombuffer(h, "<u8") for h in b.column("hashes").to_pylist()]
        if not sets:
            continue
        rows.append((np.concatenate(sets), np.repeat(b.column("node").to_numpy(), [len(s) for s in sets])))
        held += len(rows[-1][0])
        if held > BUFFER:
            yield flush()
            held = 0
    if held:
        yield flush()


def _counted_rows(batches, most: int):
    """Of rows sorted by key: node, token and whether it is common, of each that two sets have at least."""
    kept, known = None, None
    for b in batches:
        key, node, weight, token = (b.column(c).to_numpy() for c in ("key", "node", "weight", "token"))
        if (aside := weight == 0).any():
            yield batch_of(node=node[aside], token=token[aside], common=np.ones(aside.sum(), bool))
        key, node, weight = key[~aside], node[~aside], weight[~aside]
        if kept is not None:
            key, node, weight = (np.concatenate(x) for x in zip(kept, (key, node, weight), strict=True))
        if not len(key):
            continue
        first = runs(key)
        size = np.diff(np.append(first, len(key)))
        total = np.repeat(np.add.reduceat(weight.astype(np.int64), first), size)
        common = (total > most) | (key == known if known is not None else False)
        if common[-1]:
            known = key[-1]
        last = key == key[-1]
        wait = last & ~common  # most rows of a key
        kept = key[wait], node[wait], weight[wait]
        if (out := (common | (total > 1)) & ~wait & (weight == 1)).any():
            yield batch_of(node=node[out], token=key[out], common=common[out])
    if kept is not None and len(kept[0]) > 1:
        yield batch_of(node=kept[1], token=kept[0], common=np.zeros(len(kept[0]), bool))


_SETS = "node bigint, n bigint, hashes binary"


def _ordered(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, n, hashes, rare and common (hashes of the prefix) and a min-hash k of the sets that may have links; stored."""

    def hashed(batches):
        for nodes, sets in _batches(batches):
            yield batch_of(node=nodes, n=np.array([len(s) for s in sets], np.int64), hashes=pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))

    def prefixed(batches):
        for b in batches:
            rows = []
            for node, n, h, rare, common in zip(*(b.column(c).to_pylist() for c in ("node", "n", "hashes", "rare", "common")), strict=True):
                left = int(prefix_size(n)) - (n - len(rare) - len(common))
                if left < least_shared(n):
                    continue
                rare, common = (np.sort(np.array(x, "<i8")) for x in (rare, common))
                k = int(mix(np.frombuffer(h, "<u8") ^ np.uint64(_MUL)).min().view(np.int64))
                rows.append((node, n, h, rare[:left].tobytes(), common[: max(0, left - len(rare))].tobytes(), k))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["node", "n", "hashes", "rare", "common", "k"])

    sets = picked(texts(docs), chosen, "doc_id", "sets", lambda joined: joined.select("doc_id", "text").mapInArrow(lean(hashed), _SETS).dropDuplicates(["node"]))
    most = COMMON
    rows = sets.mapInArrow(lean(lambda x: _token_rows(x, most)), "key bigint, node bigint, weight int, token bigint").repartition("key").sortWithinPartitions("key")
    counted = rows.mapInArrow(lean(lambda x: _counted_rows(x, most)), "node bigint, token bigint, common boolean")
    lists = counted.groupBy("node").agg(F.collect_list(F.when(~F.col("common"), F.col("token"))).alias("rare"), F.collect_list(F.when(F.col("common"), F.col("token"))).alias("common"))
    out = stored(sets.join(lists, "node").mapInArrow(lean(prefixed), f"{_SETS}, rare binary, common binary, k bigint"), "ordered")
    drop_stored(sets)
    return out


# -- steps 3 and 4 ---------------------------------------------------------------------


def _edges_of(edges) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])


def _blocks(sets: DataFrame) -> DataFrame:
    """Edges (a, b) to the first set of each component found in blocks of equal min-hash. Ranges also split by node,
    so a hot key is dealt over many tasks, and a run of it is cut at BLOCK sets or BLOCK_BYTES."""

    def run(batches):
        block, at, held = [], None, 0

        def close():
            order = sorted(range(len(block)), key=lambda i: (len(block[i][1]), block[i][0]))
            roots = join_block([block[i][1] for i in order])
            return [(block[order[i]][0], block[order[r]][0]) for i, r in enumerate(roots) if r != i]

        for b in batches:
            for k, node, h in zip(b.column("k").to_pylist(), b.column("node").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                if block and (k != at or len(block) >= BLOCK or held > BLOCK_BYTES):
                    if len(block) > 1:
                        yield _edges_of(close())
                    block, held = [], 0
                at = k
                held += len(h)
                block.append((node, np.frombuffer(h, "<u8")))
        if len(block) > 1:
            yield _edges_of(close())

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.select("k", "node", "hashes").repartitionByRange(parts, "k", "node").sortWithinPartitions("k", "node").mapInArrow(lean(run), "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component that edges(a, b) make; nodes without edges are left out.

    Each round takes the smallest label among neighbours and then that label's own label; labels lie in the
    shared folder, and only a count of changes comes to the driver."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        low = both.join(of_b, "b").groupBy("a").agg(F.min("lb").alias("m"))
        step = labels.join(low, labels["node"] == low["a"]).select("node", F.least("label", "m").alias("l1"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("l1"), F.col("label").alias("l2"))
        new = stored(step.join(jump, "l1", "left").select("node", F.least("l1", F.coalesce("l2", "l1")).alias("label"), "old"), "labels")
        changed = new.where("label <> old").head(1)
        drop_stored(labels)
        labels = new.select("node", "label")
        labels._basalt_path = new._basalt_path
        if not changed:
            drop_stored(both)
            return labels


def _labelled(sets: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    return sets.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), *more)


def _rare_rows(batches):
    """Pairs (x, y) of different labels and like sizes for each key that they have, from rows sorted by key; a key has COMMON at most."""
    kept = None
    for b in batches:
        cols = [b.column(c).to_numpy() for c in ("key", "node", "label", "n")]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        last = cols[0] == cols[0][-1] if len(cols[0]) else np.empty(0, bool)
        kept = [c[last] for c in cols]
        yield from _pairs_of(*(c[~last] for c in cols))
    if kept is not None:
        yield from _pairs_of(*kept)


def _pairs_of(key, node, label, n) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    first = runs(key)
    size = np.diff(np.append(first, len(key)))
    mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    for g in np.unique(size[mixed]):
        at = first[mixed & (size == g)]
        i, j = np.triu_indices(g, 1)
        step = max(1, 500_000 // len(i))
        for lo in range(0, len(at), step):
            rows = at[lo : lo + step][:, None]
            a, b = (rows + i).ravel(), (rows + j).ravel()
            keep = (label[a] != label[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
            a, b = node[a[keep]], node[b[keep]]
            if len(a):
                yield batch_of(x=np.minimum(a, b), y=np.maximum(a, b))


def _rare_pairs(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (x, y) of sets of different components that share enough uncommon shingles, for what else they can share."""

    def run(batches):
        for b in batches:
            rare = [np.frombuffer(x, "<i8") for x in b.column("rare").to_pylist()]
            if rare:
                own = [len(x) for x in rare]
                yield batch_of(key=np.concatenate(rare), **{c: np.repeat(b.column(c).to_numpy(), own) for c in ("node", "label", "n")})

    rows = _labelled(sets, labels, "n", "rare").mapInArrow(lean(run), "key bigint, node bigint, label bigint, n bigint")
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_rare_rows), "x bigint, y bigint").groupBy("x", "y").agg(F.count(F.lit(1)).alias("s"))
    x, y = (sets.select(F.col("node").alias(c), _least(F.col("n")).alias(f"m{c}"), (F.length("common") / 8).alias(f"c{c}")) for c in "xy")
    enough = F.col("s") >= F.greatest("mx", "my") - F.least("cx", "cy")
    return pairs.join(x, "x").join(y, "y").where(enough).select("x", "y")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the components (lx, ly) of those pairs (x, y) whose sets link."""

    def run(batches):
        for b in batches:
            keep = []
            for p, q in zip(b.column("hx").to_pylist(), b.column("hy").to_pylist(), strict=True):
                s, t = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                keep.append(bool(linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
            yield pa.RecordBatch.from_arrays([b.column("lx"), b.column("ly")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    hx, hy = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "xy")
    return pairs.join(hx, "x").join(hy, "y").select("lx", "ly", "hx", "hy").mapInArrow(lean(run), "a bigint, b bigint").distinct()


_BLOCK = "block bigint, label bigint, least bigint, most bigint, labels binary, sizes binary, hashes binary, tokens array<bigint>"


def _placed(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label, block), and the stored table it reads: rows of node, label, bytes in the order of label and node, cut where BLOCK sets or BLOCK_BYTES are full.
    Tasks add up weights for themselves and store them; the driver gets one total a task, so the number
    of blocks follows the sets and not the partitions."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            weight = np.maximum(1, -(-b.column("bytes").to_numpy() * BLOCK // BLOCK_BYTES))
            ends = at + np.cumsum(weight)
            if len(ends):
                at = int(ends[-1])
            yield batch_of(node=b.column("node"), label=b.column("label"), part=np.full(len(ends), part, np.int64), start=ends - weight, end=ends)

    spark = slim.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, "label", "node").sortWithinPartitions("label", "node")
    rows = stored(ordered.mapInArrow(lean(run), "node bigint, label bigint, part bigint, start bigint, end bigint"), "placed")
    before, at = [], 0
    for part, total in sorted(tuple(r) for r in rows.groupBy("part").agg(F.max("end")).collect()):
        before.append((part, at))
        at += total
    offsets = spark.createDataFrame(before, "part bigint, before bigint")
    return rows.join(offsets, "part").select("node", "label", F.floor((F.col("before") + F.col("start")) / BLOCK).alias("block")), rows


def _common_blocks(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks, by label, of the sets whose prefix has enough common shingles to link by them alone: label where all are of one
    (null otherwise), sizes, sets, and the common shingles of the prefixes; stored."""

    def run(batches):
        rows, at = [], None

        def close():
            sizes = [r[2] for r in rows]
            own = {r[1] for r in rows}
            tokens = np.unique(np.concatenate([np.frombuffer(r[4], "<i8") for r in rows]))
            cols = [[at], [rows[0][1] if len(own) == 1 else None], [min(sizes)], [max(sizes)], *([np.array([r[i] for r in rows], "<i8").tobytes()] for i in (1, 2)), [b"".join(r[3] for r in rows)], [tokens]]
            kinds = [*[pa.int64()] * 4, *[pa.binary()] * 3, pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        for b in batches:
            for block, *r in zip(*(b.column(c).to_pylist() for c in ("block", "node", "label", "n", "hashes", "common")), strict=True):
                if rows and block != at:
                    yield close()
                    rows = []
                at = block
                rows.append(r)
        if rows:
            yield close()

    enough = sets.where(F.length("common") / 8 >= _least(F.col("n")))
    place, rows = _placed(_labelled(enough, labels, F.length("hashes").cast("bigint").alias("bytes")))
    some = enough.join(place, "node").select("block", "node", "label", "n", "hashes", "common")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = stored(some.repartition(parts, "block").sortWithinPartitions("block", "label", "node").mapInArrow(lean(run), _BLOCK), "blocks")
    drop_stored(rows)
    return out


def _common_edges(blocks: DataFrame) -> DataFrame:
    """Edges (a, b) between components that links connect, from blocks that share a common shingle."""

    def run(batches):
        def side(b, i, c):
            labels, sizes = (np.frombuffer(b.column(f"{x}{c}")[i].as_py(), "<i8") for x in ("labels", "sizes"))
            return labels.tolist(), np.split(np.frombuffer(b.column(f"hashes{c}")[i].as_py(), "<u8"), np.cumsum(sizes)[:-1])

        for b in batches:
            for i in range(b.num_rows):
                labels, sets = side(b, i, "x")
                more, others = side(b, i, "y") if b.column("x")[i].as_py() != b.column("y")[i].as_py() else ([], [])
                labels = labels + more
                yield _edges_of([(labels[p], labels[q]) for p, q in join_blocks(sets, others, labels)])

    slim = blocks.select(F.explode("tokens").alias("token"), "block", "label", "least", "most")
    x, y = (slim.select("token", *(F.col(c).alias(f"{c}{s}") for c in ("block", "label", "least", "most"))) for s in "xy")
    like = (F.col("mostx") * 4 >= F.col("leasty") * 3) & (F.col("mosty") * 4 >= F.col("leastx") * 3)
    apart = F.col("labelx").isNull() | F.col("labely").isNull() | (F.col("labelx") != F.col("labely"))
    pairs = x.join(y, "token").where((F.col("blockx") <= F.col("blocky")) & like & apart).select(F.col("blockx").alias("x"), F.col("blocky").alias("y")).distinct()
    bx, by = (blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{c}{s}") for c in ("labels", "sizes", "hashes"))) for s in "xy")
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.join(bx, "x").join(by, "y").repartition(parts, "x", "y")
    return dealt.mapInArrow(lean(run), "a bigint, b bigint").distinct()


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """digests(docs); the sets that may have links; and node, label of the sets with links."""
    spark = docs.sparkSession
    with text_batches(spark):
        info = digests(docs)
        chosen = candidates(docs, info)
        sets = _ordered(docs, chosen)
        edges = stored(_blocks(sets), "edges")
        labels = connected(edges)
        blocks = _common_blocks(sets, labels)
        pairs = stored(_rare_pairs(sets, labels), "pairs")
        first = _apart(pairs, labels).groupBy("lx", "ly").agg(F.min_by(F.struct("x", "y"), F.xxhash64("x", "y")).alias("p")).select("p.x", "p.y", "lx", "ly")
        labels = merged(labels, stored(_common_edges(blocks).unionByName(_verified(first, sets)), "across"))
        drop_stored(blocks, edges)
        labels = merged(labels, stored(_verified(_apart(pairs, labels), sets), "across"))
        drop_stored(pairs)
    return info, sets, labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after edges between components, by their labels; these and the edges are deleted."""
    top = connected(edges)
    new = top.select(F.col("node").alias("label"), F.col("label").alias("to"))
    every = labels.unionByName(top.select("node", F.col("node").alias("label"))).dropDuplicates(["node"])
    out = stored(every.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    drop_stored(labels, edges, top)
    return out


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs in different components, with these (lx below ly)."""
    lx, ly = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "xy")
    both = pairs.join(lx, "x", "left").join(ly, "y", "left").select("x", "y", F.coalesce("lx", "x").alias("p"), F.coalesce("ly", "y").alias("q"))
    return both.where("p <> q").select("x", "y", F.least("p", "q").alias("lx"), F.greatest("p", "q").alias("ly"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and component_size."""
    info, sets, labels = _joined(docs)
    drop_stored(sets)
    return _named(info, labels)


def _classes(info: DataFrame) -> DataFrame:
    """n, d1, d2, node (smallest doc_id) and class_size of each class of equal sets."""
    return info.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("class_size"))


def _named(info: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes are the smallest doc_id of their class, and labels the smallest node, so labels are component_id."""
    classes = _classes(info).join(labels, "node", "left").select("n", "d1", "d2", F.coalesce("label", "node").alias("component_id"), "class_size")
    size = classes.groupBy("component_id").agg(F.sum("class_size").alias("component_size"))
    known = classes.join(size, "component_id").select("n", "d1", "d2", "component_id", "component_size")
    one = F.lit(1).cast("bigint")
    return info.join(known, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_size", one).alias("component_size"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: products of 0/1 matrices, width shingles at a time."""
    out = np.zeros((len(a), len(b)), np.float64)
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def placed(sets):
        row, h = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
        there = shared[at] == h if len(shared) else np.zeros(len(h), bool)
        row, at = row[there], at[there]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    sides = [(len(x), *placed(x)) for x in (a, b)]
    for lo in range(0, len(shared), width):
        both = []
        for n, row, at in sides:
            k = slice(*np.searchsorted(at, [lo, lo + width]))
            m = np.zeros((n, min(width, len(shared) - lo)), np.float32)
            m[row[k], at[k] - lo] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out.astype(np.int64)


_COUNTS = "node bigint, linked bigint"


def _tile_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one tile with another or with itself, or of several small components: for each set how many
    documents of other sets it links to there."""
    import pandas as pd

    nodes, counts = [], []
    for (_, i, j), g in pdf.groupby(["label", "i", "j"]):
        sets = [np.frombuffer(h, "<u8") for h in g["hashes"]]
        node, own, n, docs = (g[c].to_numpy() for c in ("node", "tile", "n", "docs"))
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(x) or not len(y):
            continue
        link = linked(overlaps([sets[k] for k in x], [sets[k] for k in y]), n[x][:, None], n[y][None, :])
        if i == j:
            np.fill_diagonal(link, False)
        else:
            nodes.append(node[y])
            counts.append(link.T @ docs[x])
        nodes.append(node[x])
        counts.append(link @ docs[y])
    return pd.DataFrame({"node": np.concatenate([*nodes, np.empty(0, np.int64)]).astype(np.int64), "linked": np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)})


def _linked_docs(sets: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """node, linked: how many documents of other sets each set links to. A component's sets are dealt over tiles by
    hash, and each two of its tiles meet in a task; components of one tile share tasks."""
    slim = stored(sets.select("node", "n").join(labels, "node").join(classes.select("node", "class_size"), "node").select("node", "label", "n", F.col("class_size").alias("docs")), "linked")
    total = slim.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("sum_n"))
    tiled = stored(total.select("label", "sum_n", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("sum_n") / TILE)).cast("int").alias("tiles")), "tiles")
    small = tiled.where("tiles = 1").agg(F.coalesce(F.sum("sum_n"), F.lit(0))).head()[0]
    groups = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-small // TILE))
    many = slim.join(tiled, "label").withColumn("tile", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = many.withColumn("o", other).select("node", "label", "docs", "tile", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(F.col("label")).alias("g"), (F.col("tiles") == 1).alias("one"))
    full = met.join(sets.select("node", "n", "hashes"), "node")
    return full.groupBy("one", "g", "i", "j").applyInPandas(_tile_links, _COUNTS).groupBy("node").agg(F.sum("linked").alias("linked"))


def links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with an equal set), class_size, n_links (how many other documents it
    links to), component_id and component_size. Documents of a class have the same links."""
    info, sets, labels = _joined(docs)
    classes = stored(_classes(info), "classes")
    counts = stored(_linked_docs(sets, labels, classes), "counts")
    drop_stored(sets)
    one = F.lit(1).cast("bigint")
    of_class = classes.join(counts, "node", "left").select("n", "d1", "d2", F.col("node").alias("class_id"), "class_size", (F.col("class_size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    of_doc = info.join(of_class, ["n", "d1", "d2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", one).alias("class_size"), F.coalesce("n_links", one - 1).alias("n_links"))
    return _named(info, labels).join(of_doc, "doc_id").select("doc_id", "n_shingles", "class_id", "class_size", "n_links", "component_id", "component_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component; rows without doc_id stay."""
    drop = components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_drop"))
    return docs.join(stored(drop, "near"), F.col("doc_id") == F.col("_drop"), "left_anti")
