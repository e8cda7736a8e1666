"""Suffix-array dedup: removes repeated substrings by distributed prefix doubling over sampled positions.

Each byte goes that a string of LENGTH bytes covers which also starts in a document of smaller doc_id. Spark sorts
rows of rank and position, in rounds at growing lengths, 18, 34, 50 and 82 bytes; a round ranks again what the one before
left, and positions whose rank only one document has drop out. The rank of 2k bytes at a position is that of the
pair of ranks of k bytes at the position and k further on. A rank is named by a 64-bit hash of the pair, so texts'
own ranks double where the text is, and only the sorting and dropping goes over the cluster.

Rows for every byte would be some 20 times the texts. So the first round ranks a sample: of the positions whose ANCHOR
bytes lie in a string of LENGTH, the one with the smallest rank (all of equal ones). Equal strings have it at the same
place, so a string that another document has holds only anchors whose rank another document has.

1. 18 bytes: rows of all anchors; those of one document drop out.
2. 82 bytes: all that the strings around an anchor can hold, its surroundings. Where a smaller doc_id has equal
   ones, all those strings are doomed at once, so of a group of copies only the first goes on; and it only if its
   anchor's rank has other surroundings too.
3. 34 bytes: of these anchors the 16 bytes more to the left and to the right. A string reaches over one of them.
4. 50 bytes, the threshold: the strings left, those whose anchor has not dropped out; doomed where a smaller doc_id has
   the same. Ranks of these have 96 bits, those of the second round 128.

Before each sort a task settles what it can among its own rows, and sends one row for a key that many of them share, so a passage
in a third of all documents costs its key's task a row for each batch of texts. Sorted rows are read as a stream.

Null and empty texts, texts below LENGTH and rows without doc_id lose nothing, and the latter take nothing from
others. doc_id must name one text; rows that repeat it have the same result. An empty table gives an empty result. Columns
besides doc_id and text are not read. Long texts are ranked in slices.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import batch_of, drop_stored, ids_and_bytes, mix, picked, runs, stored, text_batches, texts

LENGTH = 50
ANCHOR = 18
#: Bytes of a long text that are ranked at once, each taking about a hundred bytes of memory.
SLICE = 1 << 20
#: Bytes of texts that are ranked together.
GROUP = 1 << 18
#: Rows that a task settles among themselves before the rest is sent.
BUFFER = 1 << 19
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD6E8FEB86659FD93)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


class Ranks:
    """Ranks of all positions of some bytes, at lengths that double: of(k) for any k is made of the binary
    digits of k, as ranks of powers of two at growing offsets."""

    def __init__(self, data: np.ndarray):
        self.power = {1: _BYTES[data]}
        self.factor = {1: _MUL}

    def _double(self, k: int) -> None:
        if k not in self.power:
            self._double(k // 2)
            h, f = self.power[k // 2], self.factor[k // 2]
            self.power[k] = h[: len(h) - k // 2] * f + h[k // 2 :] if len(h) > k // 2 else h[:0]
            self.factor[k] = np.uint64(int(f) ** 2 & 0xFFFFFFFFFFFFFFFF)

    def raw(self, k: int) -> np.ndarray:
        out, at, bit = None, 0, 1 << k.bit_length()
        while bit:
            if k & bit:
                self._double(bit)
                h = self.power[bit]
                out = h if out is None else out[: max(0, len(h) - at)] * self.factor[bit] + h[at:][: len(out)]
                at += bit
            bit >>= 1
        return out

    def of(self, k: int) -> np.ndarray:
        h = self.raw(k)
        return (h ^ (h >> np.uint64(29))) * _SALT


def _window(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w neighbours of a, by doubling."""
    k = 1
    while 2 * k <= w:
        a = f(a[:-k], a[k:])
        k *= 2
    return f(a[: len(a) - (w - k)], a[w - k :]) if k < w else a


def least_ranks(ranks: np.ndarray, w: int, there: np.ndarray) -> np.ndarray:
    """The smallest of each w neighbours; 0 where no string starts."""
    return np.where(there, _window(ranks, w, np.minimum), np.uint64(0)) if len(there) else np.empty(0, np.uint64)


def anchors(ranks: np.ndarray, least: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest rank of some w neighbours; all of equal ones."""
    if not len(least):
        return np.empty(0, np.int64)
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_window(np.concatenate([pad, least, pad]), w, np.maximum) == ranks)


class Stretch:
    """Texts end to end, or a part of a long one: positions own to until (of a part) are its own, and bytes around them include
    all that their strings hold. Positions are those in the stretch; position() gives them in their documents."""

    def __init__(self, ids: list[int], texts_: list[bytes], length: int, base: int = 0, own: int = 0, until: int | None = None):
        self.ids, self.bytes, self.length, self.base = np.array(ids, np.int64), b"".join(texts_), length, base
        self.own, self.until = own, len(self.bytes) if until is None else until
        self.edges = np.cumsum([0] + [len(t) for t in texts_])
        self.ranks = Ranks(np.frombuffer(self.bytes, np.uint8))
        self.w = length - ANCHOR + 1

    def of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, at, "right") - 1

    def position(self, at: np.ndarray) -> np.ndarray:
        return at - self.edges[self.of(at)] + self.base

    def placed(self, found: list[np.ndarray]) -> np.ndarray:
        """Positions here of sorted positions in each document, those of its own."""
        at = np.concatenate([x + (e - self.base) for x, e in zip(found, self.edges[:-1].tolist(), strict=True)])
        return at[(at >= self.own) & (at < self.until)]

    def starts(self) -> np.ndarray:
        """Where a string lies in one document."""
        there = np.ones(max(0, len(self.bytes) - self.length + 1), bool)
        for e in self.edges[1:-1].tolist():
            there[max(0, e - self.length + 1) : e] = False
        return there

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        h = self.ranks.of(ANCHOR)
        return h, least_ranks(h, self.w, self.starts())

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        h, least = self.ranked()
        at = anchors(h, least, self.w)
        at = at[(at >= self.own) & (at < self.until)]
        return at, h[at]

    def surroundings(self, at: np.ndarray) -> np.ndarray:
        """Ranks of what the strings around each anchor can hold, cut at the text's ends."""
        reach, doc = self.length - ANCHOR, self.of(at)
        lo, hi = np.maximum(at - reach, self.edges[doc]), np.minimum(at + self.length, self.edges[doc + 1])
        whole = hi - lo == self.length + reach
        out = np.empty(len(at), np.uint64)
        if whole.any():
            out[whole] = self.ranks.of(self.length + reach)[lo[whole]]
        for i in np.flatnonzero(~whole):
            out[i] = xxhash.xxh3_64_intdigest(self.bytes[lo[i] : hi[i]] + bytes([at[i] - lo[i]]))
        return out

    def reaching(self, at: np.ndarray, left: int) -> np.ndarray:
        """Ranks of the bytes from left before each anchor to half of what is missing to LENGTH; 0 where the text ends before."""
        size, doc = ANCHOR + half(self.length), self.of(at)
        there = (at - left >= self.edges[doc]) & (at - left + size <= self.edges[doc + 1])
        out = np.zeros(len(at), np.uint64)
        if there.any():
            out[there] = np.maximum(mix(self.ranks.raw(size)[at[there] - left] + np.uint64(left)), np.uint64(1))
        return out

    def strings(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Starts of strings whose anchor (of the smallest rank in them) has a shared rank to the left, or, where they don't reach
        over that, to the right."""
        h, least = self.ranked()
        part, out = half(self.length), []
        both = np.intersect1d(left, right, assume_unique=True)
        for at, offsets in ((left, range(part + 1, self.w)), (right, range(part)), (both, [part])):
            start = (at[:, None] - np.array(offsets)[None, :]).ravel()
            anchor = np.repeat(at, len(offsets))
            there = (start >= 0) & (start < len(least))
            start, anchor = start[there], anchor[there]
            out.append(start[least[start] == h[anchor]])
        return np.unique(np.concatenate(out))

    def string_ranks(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the strings at some starts 64 bits and 32 bits more, from the ranks of their parts."""
        h = self.ranks.raw(self.length)[start]
        a, k = self.ranks.raw(ANCHOR), half(self.length)
        b = self.ranks.raw(k)
        parts = a[start] + b[start + ANCHOR] * _SALT + b[start + self.length - k] * _MUL
        return mix(h).view(np.int64), (mix(parts ^ _SALT) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def half(length: int) -> int:
    return (length - ANCHOR) // 2


def stretches(rows: list[tuple], length: int) -> Iterator[tuple[Stretch, list[tuple]]]:
    """Stretches of about GROUP bytes of rows (doc_id, text, ...), with the rows; long texts in parts of SLICE bytes. Texts below
    LENGTH are left out."""
    group, held = [], 0
    for row in rows:
        t = row[1]
        if len(t) < length:
            continue
        if len(t) > SLICE:
            for lo in range(0, len(t), SLICE):
                base = max(0, lo - 2 * length)
                yield Stretch([row[0]], [t[base : lo + SLICE + 2 * length]], length, base, lo - base, min(len(t), lo + SLICE) - base), [row]
            continue
        group.append(row)
        held += len(t)
        if held > GROUP:
            yield Stretch([r[0] for r in group], [r[1] for r in group], length), group
            group, held = [], 0
    if group:
        yield Stretch([r[0] for r in group], [r[1] for r in group], length), group


# -- rounds of sorting -------------------------------------------------------------------


class Buffer:
    """Rows (key, sub, doc, more columns) of a task; flush() settles among them and returns the batches to send: rows to
    be sorted (starts null), and what is settled: positions (starts) by document."""

    def __init__(self, settle: Callable, columns: dict):
        self.settle, self.columns, self.rows, self.held = settle, columns, [], 0

    def add(self, *cols: np.ndarray) -> None:
        self.rows.append(cols)
        self.held += len(cols[0])

    def flush(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.rows, strict=True)]
        self.rows, self.held = [], 0
        order = np.lexsort((cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        send, done = self.settle(*cols[:3])
        doc, start = cols[2][done], cols[3][done]
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order].astype("<i4")
        at = runs(doc)
        blobs = [x.tobytes() for x in np.split(start, at[1:])] if len(doc) else []
        none = np.zeros(len(blobs), np.int64)
        out = {n: np.concatenate([c[send].astype(t), none.astype(t)]) for (n, t), c in zip(self.columns.items(), cols, strict=True)}
        out["key"][len(out["key"]) - len(blobs) :] = mix(doc[at].astype(np.uint64)).view(np.int64)
        out["doc_id"][len(out["doc_id"]) - len(blobs) :] = doc[at]
        return batch_of(**out, starts=pa.array([None] * int(send.sum()) + blobs, pa.binary()))


def _by_run(key, sub, doc):
    """For rows sorted by (key, sub, doc): where their (key, sub) begins, and its first and last doc."""
    first = runs(key, sub)
    size = np.diff(np.concatenate([first, [len(key)]]))
    return np.repeat(doc[first], size), np.repeat(doc[first + size - 1], size), first


def _settle_shared(key, sub, doc):
    """Keys of several documents here are shared: all their rows are settled, and one goes on for others to meet."""
    least, most, first = _by_run(key, sub, doc)
    done = least != most
    send = ~done
    send[first] = True
    return send, done


def _settle_doomed(key, sub, doc):
    """Rows are doomed if a smaller doc_id has their key here; the others go on."""
    least, _, _ = _by_run(key, sub, doc)
    return doc == least, doc > least


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key and sorted in each task."""
    return rows.repartition("key").sortWithinPartitions("key", *by)


def _rows_of(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return batch_of(doc_id=doc, starts=pa.nulls(len(doc), pa.binary()), at=at.astype(np.int32))


def _settled(b: pa.RecordBatch) -> tuple[pa.RecordBatch | None, dict[str, np.ndarray]]:
    """What a batch has settled, and the other rows' columns."""
    blobs = b.column(b.schema.get_field_index("starts"))
    aside = np.asarray(blobs.is_valid())
    cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names if n != "starts"}
    passing = batch_of(doc_id=cols["doc_id"][aside], starts=blobs.filter(pa.array(aside)), at=pa.nulls(int(aside.sum()), pa.int32())) if aside.any() else None
    return passing, {n: c[~aside] for n, c in cols.items()}


_FOUND = "doc_id bigint, starts binary, at int"


def _shared(batches):
    """Positions whose key has another document, by document; of rows sorted by (key, doc_id)."""
    kept, known = None, None
    for b in batches:
        passing, cols = _settled(b)
        if passing is not None:
            yield passing
        key, doc, at = (cols[n] if kept is None else np.concatenate([kept[n], cols[n]]) for n in ("key", "doc_id", "at"))
        if not len(key):
            continue
        least, most, first = _by_run(key, key, doc)
        hit = (least != most) | (key == known if known is not None else False)
        open_ = (key == key[-1]) & ~hit  # its run may go on in the next batch
        if hit[-1]:
            known = key[-1]
        kept = {"key": key[open_], "doc_id": doc[open_], "at": at[open_]}
        if hit.any():
            yield _rows_of(doc[hit], at[hit])


def _doomed(batches):
    """Positions whose (key, sub) has a smaller doc_id, by document; of rows sorted by (key, sub, doc_id)."""
    last = None
    for b in batches:
        passing, cols = _settled(b)
        if passing is not None:
            yield passing
        key, sub, doc, at = (cols[n] for n in ("key", "sub", "doc_id", "at"))
        if not len(key):
            continue
        least, _, _ = _by_run(key, sub, doc)
        if last is not None and last[:2] == (key[0], sub[0]):
            least = np.where((key == key[0]) & (sub == sub[0]), last[2], least)
        last = (key[-1], sub[-1], least[-1])
        if (hit := doc > least).any():
            yield _rows_of(doc[hit], at[hit])


_RANKED = "doc_id bigint, starts binary, at int, open boolean, l bigint, r bigint"


def _ranked(batches):
    """Of anchors sorted by (key, sub, doc_id), sub ranking their surroundings: the doomed, by document; and a row for each that is
    the first with its surroundings while its key has others, with its ranks to the left and right."""

    def opened(rows):
        n = len(rows["key"])
        return batch_of(doc_id=rows["doc_id"], starts=pa.nulls(n, pa.binary()), at=rows["at"].astype(np.int32), open=np.ones(n, bool), l=rows["l"], r=rows["r"])

    def doomed(found: pa.RecordBatch):
        n = found.num_rows
        return batch_of(doc_id=found.column(0), starts=found.column(1), at=found.column(2), open=np.zeros(n, bool), l=pa.nulls(n, pa.int64()), r=pa.nulls(n, pa.int64()))

    last, kept, several = None, None, None
    names = ("key", "sub", "doc_id", "at", "l", "r")
    for b in batches:
        passing, cols = _settled(b)
        if passing is not None:
            yield doomed(passing)
        key, sub, doc, at = (cols[n] for n in names[:4])
        if not len(key):
            continue
        least, _, _ = _by_run(key, sub, doc)
        if last is not None and last[:2] == (key[0], sub[0]):
            least = np.where((key == key[0]) & (sub == sub[0]), last[2], least)
        last = (key[-1], sub[-1], least[-1])
        if (hit := doc > least).any():
            yield doomed(_rows_of(doc[hit], at[hit]))
        rows = {n: cols[n][~hit] for n in names}
        if kept is not None:
            rows = {n: np.concatenate([kept[n], rows[n]]) for n in names}
        k = rows["key"]
        if not len(k):
            continue
        least, most, _ = _by_run(k, k, rows["sub"])  # first and last surroundings of each key
        go = (least != most) | (k == several if several is not None else False)
        if go[-1]:
            several = k[-1]
        wait = (k == k[-1]) & ~go
        kept = {n: rows[n][wait] for n in names}
        if go.any():
            yield opened({n: rows[n][go] for n in names})


# -- the four rounds -----------------------------------------------------------------------


def _places(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """Sorted positions of each row, from its lists of blobs (name) and of integers (name_at)."""
    at = b.column(b.schema.get_field_index(f"{name}_at"))
    ends, flat = at.offsets.to_numpy(), at.values.to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for k, blobs in enumerate(b.column(b.schema.get_field_index(name)).to_pylist()):
        own = [np.frombuffer(x, "<i4").astype(np.int64) for x in blobs or ()]
        out.append(np.unique(np.concatenate([flat[ends[k] : ends[k + 1]], *own])))
    return out


def _flushed(batches, length: int, buffer: Buffer, rows: Callable, *names: str):
    """Batches that rows(stretch, positions of each of its documents by each of names) puts into the buffer, sent as it fills."""
    for b in batches:
        found = [_places(b, n) for n in names]
        every = list(zip(*zip(*ids_and_bytes(b), strict=True), *found, strict=True)) if b.num_rows else []
        for s, own in stretches(every, length):
            rows(s, *([r[2 + k] for r in own] for k in range(len(names))))
            if buffer.held > BUFFER:
                yield buffer.flush()
    if buffer.held:
        yield buffer.flush()


def _sampled(length: int):
    def run(batches):
        buffer = Buffer(_settle_shared, {"key": np.int64, "_": np.int8, "doc_id": np.int64, "at": np.int32})

        def rows(s: Stretch):
            at, h = s.anchors()
            buffer.add(h.view(np.int64), np.zeros(len(at), np.int8), s.ids[s.of(at)], s.position(at).astype(np.int32))

        for b in _flushed(batches, length, buffer, rows):
            yield b.drop_columns(["_"])

    return run


def _surrounded(length: int):
    def run(batches):
        buffer = Buffer(_settle_doomed, {"key": np.int64, "sub": np.int64, "doc_id": np.int64, "at": np.int32, "l": np.int64, "r": np.int64})

        def rows(s: Stretch, shared):
            if len(at := s.placed(shared)):
                sides = (s.reaching(at, left).view(np.int64) for left in (half(length), 0))
                buffer.add(s.ranks.of(ANCHOR)[at].view(np.int64), s.surroundings(at).view(np.int64), s.ids[s.of(at)], s.position(at).astype(np.int32), *sides)

        yield from _flushed(batches, length, buffer, rows, "shared")

    return run


def _sides(batches):
    """Rows of open anchors by their ranks to the left (position times 2) and right (plus 1)."""
    buffer = Buffer(_settle_shared, {"key": np.int64, "_": np.int8, "doc_id": np.int64, "at": np.int32})
    for b in batches:
        doc, at = b.column("doc_id").to_numpy(), b.column("at").to_numpy().astype(np.int64)
        for side, name in enumerate("lr"):
            key = b.column(name).to_numpy()
            there = key != 0
            buffer.add(key[there], np.zeros(there.sum(), np.int8), doc[there], 2 * at[there] + side)
        if buffer.held > BUFFER:
            yield buffer.flush().drop_columns(["_"])
    if buffer.held:
        yield buffer.flush().drop_columns(["_"])


def _strings(length: int):
    def run(batches):
        buffer = Buffer(_settle_doomed, {"key": np.int64, "sub": np.int32, "doc_id": np.int64, "at": np.int32})

        def rows(s: Stretch, sides):
            left, right = (s.placed([x[x % 2 == side] // 2 for x in sides]) for side in (0, 1))
            if len(left) + len(right) and len(at := s.strings(left, right)):
                buffer.add(*s.string_ranks(at), s.ids[s.of(at)], s.position(at).astype(np.int32))

        yield from _flushed(batches, length, buffer, rows, "sides")

    return run


def _by_doc(found: DataFrame, name: str) -> DataFrame:
    """Positions by document: settled ones as blobs (name), others as integers (name_at); stored."""
    return stored(found.groupBy("doc_id").agg(F.collect_list("starts").alias(name), F.collect_list("at").alias(f"{name}_at")), name)


def doomed_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, anchors and starts, stored: of each document that has any, anchors that are doomed with their
    surroundings, and starts of other doomed strings (each as lists of blobs of 32-bit integers, and of integers with _at)."""
    spark = docs.sparkSession
    rows = texts(docs).where("doc_id is not null")
    with text_batches(spark):
        sampled = rows.mapInArrow(_sampled(length), "key bigint, doc_id bigint, at int, starts binary")
        shared = _by_doc(_sorted(sampled, "doc_id").mapInArrow(_shared, _FOUND), "shared")
        marked = picked(rows, shared, "doc_id", "ranked", lambda j: _sorted(j.select("doc_id", "text", "shared", "shared_at").mapInArrow(_surrounded(length), "key bigint, sub bigint, doc_id bigint, at int, l bigint, r bigint, starts binary"), "sub", "doc_id").mapInArrow(_ranked, _RANKED))
        drop_stored(shared)
        anchors_ = _by_doc(marked.where("not open").select("doc_id", "starts", "at"), "anchors")
        sides = marked.where("open").select("doc_id", "at", "l", "r").mapInArrow(_sides, "key bigint, doc_id bigint, at int, starts binary")
        sides = _by_doc(_sorted(sides, "doc_id").mapInArrow(_shared, _FOUND), "sides")
        drop_stored(marked)
        own = picked(rows, sides, "doc_id", "strings", lambda j: _sorted(j.select("doc_id", "text", "sides", "sides_at").mapInArrow(_strings(length), "key bigint, sub int, doc_id bigint, at int, starts binary"), "sub", "doc_id").mapInArrow(_doomed, _FOUND))
        drop_stored(sides)
        starts = _by_doc(own, "starts")
        drop_stored(own)
        found = stored(anchors_.join(starts, "doc_id", "full").select("doc_id", *(F.coalesce(c, F.array().cast(t)).alias(c) for n in ("anchors", "starts") for c, t in ((n, "array<binary>"), (f"{n}_at", "array<int>")))), "doomed")
    drop_stored(anchors_, starts)
    return found


# -- results -------------------------------------------------------------------------------


def covered(n: int, anchors_: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes doomed strings cover: those around anchors, and those at starts."""
    step = np.zeros(n + 1, np.int32)
    for lo, hi in ((np.maximum(anchors_ - (length - ANCHOR), 0), np.minimum(anchors_ + length, n)), (starts, starts + length)):
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(length: int):
    def run(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for b in batches:
            rows = []
            for (i, t), a, s in zip(ids_and_bytes(b), _places(b, "anchors"), _places(b, "starts"), strict=True):
                gone, spans, kept = 0, 0, t
                if len(a) or len(s):
                    mask = covered(len(t), a, s, length)
                    gone = int(mask.sum())
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
                rows.append((i, len(t), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names)

    return run


_LISTS = ("anchors", "anchors_at", "starts", "starts_at")
_CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the bytes left), n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    found = doomed_strings(docs, length)
    none = (F.coalesce(c, F.array().cast("array<int>" if c.endswith("at") else "array<binary>")).alias(c) for c in _LISTS)
    return texts(docs).join(found, "doc_id", "left").select("doc_id", "text", *none).mapInArrow(_cut(length), _CUT)


def summary(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same without kept. Only texts that lose something are moved."""
    found = doomed_strings(docs, length)
    with text_batches(docs.sparkSession):
        cut = picked(texts(docs), found, "doc_id", "cut", lambda j: j.select("doc_id", "text", *_LISTS).mapInArrow(_cut(length), _CUT).drop("kept", "n_bytes").dropDuplicates(["doc_id"]))
    drop_stored(found)
    whole = texts(docs).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    zero = F.lit(0).cast("bigint")
    return whole.join(cut, "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))
