"""Repeated byte strings by merging sparse Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that starts anywhere else as well is
removed.  A transform of the whole corpus has no place on one machine, so suffixes are
taken at *anchors* only.  Of the hashes of all ``gram``-byte strings inside a window of
``length`` bytes the smallest is an anchor (all of them, if several are equal): equal
windows have equal anchors at equal places, so a repeat always shares an anchor.

1. Anchors are grouped by their hash.  An anchor that occurs once is no repeat.  Where
   the whole reach of an anchor (all windows that hold it) is equal in several places,
   every window in it repeats; one representative stands for all of them from here on.
2. Where the reaches differ, the representatives' texts go to a bucket by anchor.  Each
   Arrow batch of a bucket is a shard.  A shard's suffixes (from the anchor on) are put in
   order once; with the bytes before them and the common prefixes of neighbours they are
   the shard's sparse transform.  Two transforms are merged by refining their interleave:
   it starts as one block (all of one shard, then all of the other) and is refined four
   bytes at a time; inside a block both shards' suffixes are runs in order already, so
   they are interleaved by rank and never sorted again.  A block that holds suffixes of
   one shard only is settled: its order and common prefixes are that shard's own.  The
   depth at which neighbours of two shards part is their common prefix.  Then the merged
   transform's column of preceding bytes refines the intervals leftward, a byte at a time.
   A window that begins e bytes before its anchor repeats if another suffix of its
   leftward interval shares ``length - e`` bytes to the right.
3. Removed ranges are gathered by document and applied to its bytes.

Scale: anchors are about 2 / (length - gram + 2) of the bytes; texts are dealt by document
once, and that exchange serves the representatives and the removal.  Copies of a reach
inside an Arrow batch are settled there and send one row on.  Anchors that are frequent in
a sample of the documents are dealt by their reach; a representative's bucket with more
than ``hot_anchor`` members is split by ranges of window starts and the bytes that those
windows share, level by level, until each part is small or is a single window.  The sample
decides how rows are dealt, never what is found.  A group is read as a stream: of a reach
or anchor at most two rows are held.  A text of any length is read in segments.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose
nothing; a null id is an id of its own; rows with equal id and text are separate places;
strings are judged on the input and may overlap; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import among, blocks, cut, prefix_hash, span_hash

LENGTH, GRAM = 200, 64
#: Representatives of a bucket that one task takes; larger ones are split.
HOT_ANCHOR = 5_000
#: Share of the sampled documents' anchors, and number of them, from which an anchor counts as frequent.
SAMPLE, HOT_SHARE, HOT_SEEN = 0.02, 1 / 20_000, 8
#: Representatives whose texts a worker holds at a time (whole buckets; each has under 2 * LENGTH bytes).
HELD = 20_000
#: Anchors among which a mapper settles copies; window starts of a long text that are looked at together.
LOCAL, SEGMENT = 1 << 19, 1 << 20
#: States of a dealt row: its copies are known, it need not be looked at again, its anchor is frequent.
KNOWN, PASSED, FREQUENT = 1, 2, 4


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every run of ``width`` values."""
    op = np.minimum if least else np.maximum
    n = len(values) - width + 1
    if width == 1:
        return values.copy()
    fill = np.uint64(2**64 - 1) if least else np.uint64(0)
    padded = np.full(-(-len(values) // width) * width, fill)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of one text, their hashes, and the hashes of their reaches."""
    parts, reach = [], length - gram
    for a in range(0, len(data) - length + 1, segment):
        # windows that begin in a..b, and what the reaches of their anchors may need on both sides
        b = min(a + segment, len(data) - length + 1)
        lo, hi = max(0, a - reach), min(len(data), b + 2 * length)
        at, anchor, own = _segment_anchors(data[lo:hi], a - lo, b - a, length, gram)
        parts.append((at + lo, anchor, own))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none
    at, anchor, own = (np.concatenate([p[k] for p in parts]) for k in range(3))
    if len(parts) > 1:  # windows of two segments may have one anchor
        at, first = np.unique(at, return_index=True)
        anchor, own = anchor[first], own[first]
    return at, anchor, own


def _segment_anchors(data: np.ndarray, begin: int, windows: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = len(data), length - gram + 1
    sums = prefix_hash(data)
    starts = np.arange(begin, begin + windows + width - 1)
    grams = span_hash(sums, starts, starts + gram)
    least = _sliding(grams, width, True)  # per window
    wide = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    wide[width - 1 : width - 1 + len(least)] = least
    found = np.flatnonzero(_sliding(wide, width, False) == grams)
    at = found + begin
    lo, hi = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
    reach = span_hash(sums, lo, hi) ^ (at - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return at, grams[found].view(np.int64), reach.view(np.int64)


def _settled(anchor: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """States of rows by the copies among them: one row of several equal ones goes on, the others are passed."""
    order = np.lexsort((reach, anchor))
    a, r = anchor[order], reach[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])]
    label = np.cumsum(first) - 1
    many = np.bincount(label)[label] > 1
    state = np.zeros(len(anchor), np.int32)
    state[order] = np.where(many, np.where(first, KNOWN, KNOWN | PASSED), 0)
    return state


def _find_anchors(keyed: DataFrame, length: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """(key, tag, pos, anchor, reach, state) of all anchors; frequent: hashes of frequent anchors, sorted."""
    names = ["key", "tag", "pos", "anchor", "reach", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            held: list[tuple] = []
            size = 0
            for block in blocks(batch.column(2)):
                found = [anchors_of(block.data[block.offsets[i] : block.offsets[i + 1]], length, gram) for i in range(block.rows)]
                many = [len(f[0]) for f in found]
                if sum(many):
                    own = [np.repeat(k[block.first : block.first + block.rows], many) for k in keys]
                    held.append((*own, *(np.concatenate([f[k] for f in found]) for k in range(3))))
                    size += sum(many)
                if size > LOCAL:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate([h[k] for h in held]) for k in range(5)]
        state = _settled(columns[3], columns[4])
        if len(frequent):
            near = np.minimum(np.searchsorted(frequent, columns[3]), len(frequent) - 1)
            state |= np.where(frequent[near] == columns[3], FREQUENT, 0).astype(np.int32)
        return pa.record_batch([*map(pa.array, columns), pa.array(state)], names=names)

    return keyed.select("key", "tag", "text").mapInArrow(run, "key long, tag long, pos long, anchor long, reach long, state int")


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Consecutive rows of sorted batches in tables that never part the rows of one value."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            values = batch.column(column).to_numpy(zero_copy_only=False)
            if held and size >= most:
                last = held[-1].column(column)[-1].as_py()
                k = int(np.searchsorted(values != last, True)) if values[0] == last else 0
                if k == 0 and values[0] == last:
                    k = len(values)
                if k < len(values):
                    if k:
                        held.append(batch.slice(0, k))
                        batch = batch.slice(k)
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                    continue
            held.append(batch)
            size += batch.num_rows
            break
    if held:
        yield pa.Table.from_batches(held)


def group_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows sorted by anchor and reach, with whether the reach repeats and whether the row stands for it.

    A row stands for its reach if it is the first of it and its anchor has other reaches (or
    is frequent: then they may be elsewhere).  Each row is told at most once of either.  Of
    the last anchor of a batch at most two rows are kept for the next one: its first, and
    the first of its last reach.
    """
    carried: pa.RecordBatch | None = None
    told_range = told_stand = np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        if carried is not None:
            batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        anchor, reach, state = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "reach", "state"))
        told_range = np.r_[told_range, np.zeros(n - len(told_range), bool)]
        told_stand = np.r_[told_stand, np.zeros(n - len(told_stand), bool)]
        passed = (state & PASSED) > 0
        rows = np.flatnonzero(~passed)
        repeats, stands = passed.copy(), np.zeros(n, bool)
        keep = rows[:0]
        if len(rows):
            a, r = anchor[rows], reach[rows]
            new_anchor = np.r_[True, a[1:] != a[:-1]]
            new_reach = new_anchor | np.r_[True, r[1:] != r[:-1]]
            of_anchor, of_reach = np.cumsum(new_anchor) - 1, np.cumsum(new_reach) - 1
            kinds = np.bincount(of_anchor, new_reach)[of_anchor]
            repeats[rows] = (np.bincount(of_reach)[of_reach] > 1) | ((state[rows] & KNOWN) > 0)
            stands[rows] = new_reach & ((kinds > 1) | ((state[rows] & FREQUENT) > 0))
            keep = rows[np.unique([np.flatnonzero(new_anchor)[-1], np.flatnonzero(new_reach)[-1]])]
        yield batch, repeats & ~told_range, stands & ~told_stand
        carried = batch.take(pa.array(keep)) if len(keep) else None
        told_range, told_stand = repeats[keep] | told_range[keep], stands[keep] | told_stand[keep]


def _dealt(found: DataFrame, split_all: bool = False) -> DataFrame:
    """Rows by anchor, those of frequent ones (or all) by anchor and reach, passed ones anywhere."""
    to = F.when(F.col("state").bitwiseAND(PASSED) > 0, F.xxhash64("key", "tag", "pos")).when((F.col("state").bitwiseAND(FREQUENT) > 0) | F.lit(split_all), F.xxhash64("anchor", "reach")).otherwise(F.col("anchor"))
    return found.repartition(to).sortWithinPartitions("anchor", "reach")


def _group_anchors(found: DataFrame) -> DataFrame:
    """(key, tag, pos, anchor, repeats): places whose whole reach repeats, and (repeats false) places that stand for a reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, repeats, stands in group_stream(batches):
            for take, told in ((repeats, True), (stands, False)):
                if k := int(take.sum()):
                    part = batch.select(["key", "tag", "pos", "anchor"]).filter(pa.array(take))
                    yield pa.record_batch([*part.columns, pa.array(np.full(k, told))], names=["key", "tag", "pos", "anchor", "repeats"])

    return _dealt(found).mapInArrow(run, "key long, tag long, pos long, anchor long, repeats boolean")


# ---- transforms


class SparseTransform:
    """Suffixes of a shard in order: what follows each anchor (padded), what precedes it, and common prefixes.

    rows: which input row each is.  lcp: the bytes shared with the suffix before it.
    """

    def __init__(self, right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, rows: np.ndarray, lcp: np.ndarray):
        self.right, self.right_size, self.left, self.left_size, self.rows, self.lcp = right, right_size, left, left_size, rows, lcp

    @classmethod
    def of(cls, before: list[bytes], after: list[bytes], length: int, gram: int) -> SparseTransform:
        """The transform of one shard; the only place where suffixes are sorted."""
        n, reach, width = len(before), length - gram, length + -length % 4
        left = np.frombuffer(b"".join(x[::-1].ljust(reach, b"\0") for x in before), np.uint8).reshape(n, reach)
        right = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in after), np.uint8).reshape(n, width)
        right_size, left_size = np.array([len(x) for x in after], np.int64), np.array([len(x) for x in before], np.int64)
        # of texts that only differ in padding the shorter one comes first
        by_size = np.argsort(right_size, kind="stable")
        order = by_size[np.argsort(np.ascontiguousarray(right[by_size]).view(f"S{width}").ravel(), kind="stable")]
        right, right_size = right[order], right_size[order]
        lcp = np.zeros(n, np.int64)
        differ = right[1:] != right[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[1:] = np.minimum(np.minimum(lcp[1:], length), np.minimum(right_size[1:], right_size[:-1]))
        return cls(right, right_size, left[order], left_size[order], order, lcp)


def merge(a: SparseTransform, b: SparseTransform, length: int = LENGTH) -> SparseTransform:
    """The transform of both shards' suffixes, by refining one interleave of the two orders."""
    na, n = len(a.rows), len(a.rows) + len(b.rows)
    right, right_size = np.concatenate([a.right, b.right]), np.concatenate([a.right_size, b.right_size])
    columns = right.view(">u4")
    order = np.arange(n)  # the interleave: places of the concatenated shards
    block = np.zeros(n, np.int64)
    parts = np.zeros(n, np.int64)  # where neighbours part
    active = order.copy()
    for depth in range(columns.shape[1] + 1):
        if not len(active):
            break
        here = order[active]
        value = (columns[here, depth] if depth < columns.shape[1] else right_size[here]).astype(np.uint64)
        own = block[active]
        key = (np.cumsum(np.r_[True, own[1:] != own[:-1]]) - 1).astype(np.uint64) << np.uint64(32) | value
        of_a = here < na
        ka, kb = key[of_a], key[~of_a]
        to = np.empty(len(here), np.int64)
        to[of_a] = np.arange(len(ka)) + np.searchsorted(kb, ka, "left")
        to[~of_a] = np.arange(len(kb)) + np.searchsorted(ka, kb, "right")
        merged, ranked = np.empty_like(here), np.empty_like(key)
        merged[to], ranked[to] = here, key
        order[active] = merged
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        apart = np.flatnonzero(new[1:] & (ranked[1:] >> np.uint64(32) == ranked[:-1] >> np.uint64(32)))
        differ = (ranked[apart] ^ ranked[apart + 1]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 4:]
        parts[active[apart + 1]] = 4 * depth + (differ != 0).argmax(axis=1)
        label = np.cumsum(new) - 1
        block[active] = active[np.flatnonzero(new)][label]
        # where only one shard is left, its own order and prefixes hold
        total = np.bincount(label)
        from_a = np.bincount(label, merged < na)
        both = (from_a > 0) & (from_a < total)
        same = np.flatnonzero(~new)
        parts[active[same]] = 4 * (depth + 1)
        active = active[both[label]]
    shard = order >= na
    lcp = np.zeros(n, np.int64)
    own = np.concatenate([a.lcp, b.lcp])[order]
    capped = np.minimum(np.minimum(parts[1:], length), np.minimum(right_size[order][1:], right_size[order][:-1]))
    lcp[1:] = np.where(shard[1:] == shard[:-1], own[1:], capped)
    both_of = lambda x, y: np.concatenate([x, y])[order]
    return SparseTransform(right[order], right_size[order], both_of(a.left, b.left), both_of(a.left_size, b.left_size), both_of(a.rows, b.rows), lcp)


def merge_shards(shards: list[SparseTransform], length: int = LENGTH) -> tuple[SparseTransform, np.ndarray, np.ndarray]:
    """The merged transform, which input row (counted over the shards) each suffix is, and common prefixes of neighbours."""
    at = 0
    for s in shards:
        s.rows = s.rows + at
        at += len(s.rows)
    while len(shards) > 1:
        shards = [merge(*shards[k : k + 2], length) if k + 1 < len(shards) else shards[k] for k in range(0, len(shards), 2)]
    return shards[0], shards[0].rows, shards[0].lcp


def repeated_windows(merged: SparseTransform, bucket: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Per suffix and e in 0..length-gram: whether the window that begins e bytes before its anchor repeats.

    bucket: of each suffix, in the merged order; equal buckets are neighbours.  A suffix is
    only held against others of its bucket.
    """
    n, reach = merged.left.shape
    out = np.zeros((n, reach + 1), bool)
    lcp = merged.lcp.copy()
    lcp[1:][bucket[1:] != bucket[:-1]] = 0
    rows = np.arange(n)  # suffixes whose leftward interval still holds another one
    interval = np.cumsum(np.r_[True, lcp[1:] < gram]) - 1 if n else rows
    for e in range(reach + 1):
        if e:
            ok = merged.left_size[rows] >= e
            rows, interval = rows[ok], interval[ok]
            if not len(rows):
                break
            keys = interval * 256 + merged.left[rows, e - 1]
            _, interval, count = np.unique(keys, return_inverse=True, return_counts=True)
            many = count[interval] > 1
            rows, interval = rows[many], interval[many]
            if not len(rows):
                break
        # to the right: suffixes of one run share at least length - e bytes
        run = np.cumsum(np.r_[True, lcp[1:] < length - e])[rows]
        ok = merged.right_size[rows] >= length - e
        keys = interval[ok] * np.int64(n + 1) + run[ok]
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        out[rows[ok], e] = count[back] > 1
    return out


def _regrouped(merged: SparseTransform, bucket: np.ndarray) -> SparseTransform:
    """The suffixes bucket by bucket, in the merged order within each; prefixes are the least between old places."""
    by = np.argsort(bucket[merged.rows], kind="stable")
    lcp = np.zeros(len(by), np.int64)
    step = np.flatnonzero(by[1:] > by[:-1]) + 1
    near = step[by[step] == by[step - 1] + 1]
    lcp[near] = merged.lcp[by[near]]
    far = step[by[step] != by[step - 1] + 1]
    if len(far):
        flat = np.stack([by[far - 1] + 1, np.minimum(by[far] + 1, len(by))], axis=1).ravel()
        lcp[far] = np.minimum.reduceat(np.append(merged.lcp, 0), flat)[::2]
    return SparseTransform(merged.right[by], merged.right_size[by], merged.left[by], merged.left_size[by], merged.rows[by], lcp)


def _bucket_ranges(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Byte ranges (key, tag, lo, hi) that the representatives of a bucket lose by repeats between differing reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "bucket", HELD):
            shards = [SparseTransform.of(b.column("before").to_pylist(), b.column("after").to_pylist(), length, gram) for b in table.to_batches() if b.num_rows]
            key, tag, pos, bucket, low, high = (table.column(c).to_numpy() for c in ("key", "tag", "pos", "bucket", "low", "high"))
            merged = _regrouped(merge_shards(shards, length)[0], bucket)
            order = merged.rows
            hit = repeated_windows(merged, bucket[order], length, gram)
            e = np.arange(hit.shape[1])
            hit &= (e >= low[order][:, None]) & (e <= high[order][:, None])
            rows, e = np.nonzero(hit)
            if len(rows):
                begin = pos[order][rows] - e
                # consecutive window starts of a row become one range; e grows, so starts fall
                new = np.r_[True, (rows[1:] != rows[:-1]) | (begin[1:] != begin[:-1] - 1)]
                end = np.r_[np.flatnonzero(new)[1:] - 1, len(rows) - 1]
                own = order[rows[new]]
                yield pa.record_batch([pa.array(key[own]), pa.array(tag[own]), pa.array(begin[end]), pa.array(begin[new] + length)], names=["key", "tag", "lo", "hi"])

    dealt = texts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key long, tag long, lo long, hi long")


_TEXTS = "key long, tag long, pos long, bucket long, low int, high int, before binary, after binary"


def _texts_of(joined: DataFrame, length: int, gram: int) -> DataFrame:
    """The text around each representative: its reach, cut at the anchor."""
    reach = length - gram
    names = ["key", "tag", "pos", "bucket", "low", "high", "before", "after"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out: list[tuple] = []
                for key, tag, text, stands in zip(*(part.column(n).to_pylist() for n in ("key", "tag", "text", "stands"))):
                    if (key, tag) == last:  # an equal row: one of them stands for all
                        continue
                    last = key, tag
                    raw = text.encode()
                    out += [(key, tag, s["pos"], s["anchor"], 0, reach, raw[max(0, s["pos"] - reach) : s["pos"]], raw[s["pos"] : s["pos"] + length]) for s in stands]
                columns = list(zip(*out)) if out else [[]] * 8
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return joined.mapInArrow(run, _TEXTS)


# ---- hot buckets


def _split(texts: DataFrame, length: int) -> DataFrame:
    """Rows of hot buckets for each quarter of their window starts, with the bytes that a quarter's windows share as bucket.

    anchor: the part's bucket.  reach: all bytes that its windows cover.  A row is in a part if
    a window of the part has room in its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(at, 1 << 12)
                out: list[tuple] = []
                for key, tag, pos, bucket, low, high, before, after in zip(*(c.to_pylist() for c in part.columns)):
                    cuts = [low + (high - low + 1) * q // 4 for q in range(5)]
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        e0, e1 = max(a, length - len(after)), min(b - 1, len(before))
                        if e0 <= e1:
                            shared = before[len(before) - a :] if a else b"", after[: length - (b - 1)]
                            cover = before[len(before) - e1 :] if e1 else b"", after[: length - e0]
                            out.append((key, tag, pos, _digest(bucket, a, b, *shared), _digest(e0, e1, 0, *cover), a, b - 1, before, after))
                if not out:
                    continue
                columns = list(zip(*out))
                anchor, reach = np.array(columns[3], np.int64), np.array(columns[4], np.int64)
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(anchor), pa.array(reach), pa.array(_settled(anchor, reach) | np.int32(FREQUENT))]
                yield pa.record_batch([*arrays, pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.int32()), pa.array(columns[7], pa.binary()), pa.array(columns[8], pa.binary())], names=names)

    names = ["key", "tag", "pos", "anchor", "reach", "state", "low", "high", "before", "after"]
    return texts.mapInArrow(run, "key long, tag long, pos long, anchor long, reach long, state int, low int, high int, before binary, after binary")


def _digest(*parts: object) -> int:
    h = blake2b(digest_size=8)
    for p in parts:
        own = p if isinstance(p, bytes) else str(p).encode()
        h.update(len(own).to_bytes(4, "little") + own)
    return int.from_bytes(h.digest(), "little", signed=True)


def _group_parts(parts: DataFrame, length: int) -> DataFrame:
    """Of split rows: ranges (lo, hi) whose cover repeats, and (lo null) rows that stand for a cover."""
    names = ["key", "tag", "pos", "bucket", "low", "high", "before", "after", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, repeats, stands in group_stream(batches):
            own = batch.select(["key", "tag", "pos", "anchor", "low", "high", "before", "after"])
            if k := int(repeats.sum()):
                part = own.filter(pa.array(repeats))
                pos, low, high = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "low", "high"))
                left, right = (np.array([len(x) for x in part.column(c).to_pylist()], np.int64) for c in ("before", "after"))
                lo, hi = pos - np.minimum(high, left), pos - np.maximum(low, length - right) + length
                none = pa.nulls(k, pa.binary())
                yield pa.record_batch([*part.columns[:6], none, none, pa.array(lo), pa.array(hi)], names=names)
            if k := int(stands.sum()):
                yield pa.record_batch([*own.filter(pa.array(stands)).columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)

    return _dealt(parts, split_all=True).mapInArrow(run, f"{_TEXTS}, lo long, hi long")


def _split_ranges(warm: DataFrame, length: int, gram: int, hot_anchor: int) -> list[DataFrame]:
    """Ranges of hot buckets: split until every part has at most hot_anchor rows or is a single window."""
    out = []
    width = length - gram + 1
    while True:
        grouped = cut(_group_parts(_split(warm, length), length))
        out.append(grouped.filter("lo IS NOT NULL").select("key", "tag", "lo", "hi"))
        width = -(-width // 4)
        if width == 1:  # one window a part: its equals are found, the rest is alone
            return out
        stands = grouped.filter("lo IS NULL").drop("lo", "hi")
        size = stands.groupBy("bucket").count()
        fit, hot = size.filter(F.col("count").between(2, hot_anchor)).select("bucket"), size.filter(F.col("count") > hot_anchor).select("bucket")
        out.append(_bucket_ranges(stands.join(fit, "bucket", "left_semi"), length, gram))
        warm = cut(stands.join(hot, "bucket", "left_semi").select("key", "tag", "pos", "bucket", "low", "high", "before", "after"))
        if warm.isEmpty():
            return out


# ---- documents


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text, and what tells rows apart: the id (key) with a hash of the text (tag)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tag"), "doc_id", "text")


def _frequent(keyed: DataFrame, length: int, gram: int, sample: float, share: float, seen: int) -> np.ndarray:
    """Hashes of the anchors that are frequent in a sample of the documents; at most 1 / share of them."""
    found = _find_anchors(keyed.sample(False, sample, 17), length, gram, np.zeros(0, np.int64))
    counts = cut(found.groupBy("anchor").count().filter(F.col("count") >= 2))
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.filter(F.col("count") >= max(seen, total * share)).select("anchor").toArrow()
    return np.sort(often.column("anchor").to_numpy())


def removed_ranges(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_anchor: int = HOT_ANCHOR, sample: float = SAMPLE, hot_share: float = HOT_SHARE, hot_seen: int = HOT_SEEN
) -> tuple[DataFrame, DataFrame]:
    """Documents with what tells them apart, and the byte ranges (key, tag, lo, hi) that repeat; hi may pass the end."""
    keyed = _keyed(docs, id_col, text_col)
    frequent = _frequent(keyed, length, gram, sample, hot_share, hot_seen)
    grouped = cut(_group_anchors(_find_anchors(keyed, length, gram, frequent)))
    whole = grouped.filter("repeats").select("key", "tag", F.greatest(F.lit(0), F.col("pos") - (length - gram)).alias("lo"), (F.col("pos") + length).alias("hi"))
    stands = grouped.filter("NOT repeats").drop("repeats")
    hot = cut(stands.groupBy("anchor").count().filter(F.col("count") > hot_anchor).select("anchor"))
    ranges = whole
    if not hot.isEmpty():
        own = cut(stands.join(hot, "anchor", "left_semi"))
        some = among(keyed, own, "tag", "key long, tag long, doc_id long, text string")
        for more in _split_ranges(cut(_representatives(some, own, length, gram)), length, gram, hot_anchor):
            ranges = ranges.union(more)
        stands = stands.join(hot, "anchor", "left_anti")
    return keyed, ranges.union(_bucket_ranges(_representatives(keyed, stands, length, gram), length, gram))


def _representatives(keyed: DataFrame, stands: DataFrame, length: int, gram: int) -> DataFrame:
    by_doc = stands.groupBy("key", "tag").agg(F.collect_set(F.struct("pos", "anchor")).alias("stands"))
    return _texts_of(keyed.join(by_doc, ["key", "tag"]).select("key", "tag", "doc_id", "text", "stands"), length, gram)


def _kept(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        hi = min(hi, len(raw))
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    at, kept = 0, []
    for lo, hi in merged:
        kept.append(raw[at:lo])
        at = hi
    return b"".join([*kept, raw[at:]]), merged


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document row: its bytes, the removed spans (``lo:hi``) and the bytes that are left."""
    keyed, ranges = removed_ranges(docs, id_col=id_col, text_col=text_col, **options)
    # equal rows name the same ranges: each once
    own = ranges.groupBy("key", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size, spans, kept = [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                    raw = text.encode()
                    left, gone = _kept(raw, [(r["lo"], r["hi"]) for r in found or ()])
                    size.append(len(raw))
                    spans.append([f"{lo}:{hi}" for lo, hi in gone])
                    kept.append(left)
                yield pa.record_batch([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.string())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = keyed.join(own, ["key", "tag"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<string>, kept binary")
