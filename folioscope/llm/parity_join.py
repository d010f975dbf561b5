"""Documents linked by the Jaccard similarity of their word shingles: a parity-sketch join.

A sketch of a set is a row of bits; each element flips one of them.  Two sketches differ in
at most as many bits as their sets have elements that are not shared, so the Hamming distance
is a lower bound of the symmetric difference.  Two sets of similarity t, the smaller with n
elements, differ in at most n (1 - t) / t elements.

1. Sets are put into bands of size; the two sets of a pair lie in one band (of the smaller
   one) and at most the next.  A band fixes the budget D, the largest difference of a pair
   whose smaller set is in it, and cuts the sketch into pieces: D + 1 and a quarter more.
   A pair differs in at most D of the pieces, so at least the others are equal.  The
   pigeonhole key of a piece is the XOR of hashes of its set bits.  A set whose size a pair
   of the band below may have as the larger one gives the pieces of that band too.
2. Keys that one set has alone go.  A set needs as many shared keys as a pair has equal
   pieces; most sets have far fewer and are done.  Pieces without a set bit say little: they
   are left out unless a set has more of them than the pieces beyond D + 1.
3. What is left is put in the order of how many sets have a key; the most frequent ones, as
   many as a pair shares but one, may go as well (a pair still shares one of the others).
4. Sets that share a key are tied to their neighbour in the order of size, if sizes allow a
   link.  Linked sets are thereby connected by ties; ties are no links yet.
5. Each connected group of ties is verified: pairs whose dense sketches differ in more bits
   than their sizes allow are no links, and the others are counted element by element.

Scale: texts are read twice, and the second time a task gives the keys of equal sets once.
Keys are streamed in sorted order, so a key that a third of all sets has takes time in
proportion to it but no memory.  A group of ties beyond ``BLOCK_SETS`` sets or
``BLOCK_SHINGLES`` elements is dealt into blocks, and every two blocks meet in a task of
their own; each task gives a spanning forest of its links, never all pairs.  Components come
from contraction on DataFrames, which looks a tie up once, not in every round.

Defined cases: a text of fewer words than a shingle is its whole sequence; null, empty and
word-free texts have no set and are linked with nothing; equal sets are linked; a component is
named by its smallest non-null doc_id (null if all are null); repeated rows and ids each give
a row; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.bwt_dedup import _whole_groups
from folioscope.llm.near_copies import shingle_sets
from folioscope.llm.shared import among, blocks, cut, give_back, mix
from folioscope.llm.simhash import connected_components

SHINGLE, PERCENT = 4, 85
#: A band reaches to so many hundredths of its smallest size.
BAND = 160
#: Bits of a piece of a sketch (only those set are held).
PIECE_BITS = 1 << 20
#: A group of ties is verified in blocks of so many sets and elements at most.
BLOCK_SETS, BLOCK_SHINGLES = 8192, 1 << 23
#: Keys are counted up to so many sets.
MANY = 1 << 12
#: Sets of which a task remembers that it has given their keys.
REMEMBERED = 1 << 18

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@lru_cache(maxsize=64)
def bands(percent: int = PERCENT) -> np.ndarray:
    """The smallest size of each band, and one more beyond all sizes.

    A band is wide enough for the larger set of a pair to lie in it or in the next one.
    """
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, edges[-1] * max(BAND, -(-10_000 // percent)) // 100 + 1))
    return np.array(edges, np.int64)


def budget(band: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of a pair whose smaller set lies in the band."""
    return int(bands(percent)[band + 1] - 1) * (100 - percent) // percent


def pieces(found: np.ndarray, band: int, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The pigeonhole keys of a set in a band, and how many of them a linked set shares at least (0: only an equal set is linked)."""
    most = budget(band, percent)
    if not most:
        return np.zeros(0, np.uint64), 0
    more = (most + 1 + 3) // 4
    many = most + 1 + more
    spread = mix(found ^ _C)
    piece = (spread % np.uint64(many)).astype(np.int64)
    bit = (spread // np.uint64(many)) % np.uint64(PIECE_BITS)
    by = np.argsort(piece, kind="stable")
    # equal bits of a piece cancel out, as they do in the sketch
    hashed = mix(bit * _A + piece.astype(np.uint64) * _B + np.uint64(1))[by]
    first = np.flatnonzero(np.r_[True, np.diff(piece[by]) != 0])
    key = np.zeros(many, np.uint64)
    key[piece[by][first]] = np.bitwise_xor.reduceat(hashed, first)
    own = mix(key + np.arange(many, dtype=np.uint64) * _A + np.array([band + 1], np.uint64) * _B)
    low = key == 0
    if int(low.sum()) <= more:
        return own[~low], more + 1 - int(low.sum())
    return own, 1


def _set_ids(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two integers."""
    if not len(found):
        return 0, 0
    n = np.uint64(len(found))
    sums = np.array([mix(found ^ _A).sum(dtype=np.uint64) + n, mix(found ^ _B).sum(dtype=np.uint64) ^ n])
    a, b = mix(sums).view(np.int64).tolist()
    return a, b


def _read(rows: DataFrame, shingle: int) -> DataFrame:
    """Of each row the 128 bits of its set, and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                sets = shingle_sets(block, shingle)
                ids = np.array([_set_ids(s) for s in sets], np.int64).reshape(-1, 2)
                part = batch.slice(block.first, block.rows)
                yield pa.record_batch([*part.columns[:3], pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "key", "tag", "h1", "h2", "n"])

    return rows.select("doc_id", "key", "tag", "text").mapInArrow(run, "doc_id long, key long, tag long, h1 long, h2 long, n long")


_KEY = "gram long, sid long, weight int"


def _keys(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(gram, sid, 0): the keys of each set; and with weight -1 a row for each set with its size and need in gram.

    sid: 63 bits of the set, and a bit that tells the band of the set from the band below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bands(percent)
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(0)):
                grams, ids, many = [], [], []
                for s in shingle_sets(block, shingle):
                    if not len(s):
                        continue
                    h, _ = _set_ids(s)
                    if h in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(h)
                    band = int(np.searchsorted(edges, len(s), "right")) - 1
                    for below in (0, 1):
                        if below and (not band or percent * len(s) > 100 * int(edges[band] - 1)):
                            continue
                        own, need = pieces(s, band - below, percent)
                        if not need:
                            continue
                        grams += [np.array([len(s) << 32 | need], np.uint64), own]
                        ids.append((h & -2) | below)
                        many.append(1 + len(own))
                if grams:
                    many = np.array(many)
                    weight = np.zeros(int(many.sum()), np.int32)
                    weight[np.cumsum(many) - many] = -1
                    yield pa.record_batch([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(weight)], names=["gram", "sid", "weight"])

    return rows.select("text").mapInArrow(run, _KEY)


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that several sets have, with the number of these (at most MANY) as weight; rows of weight -1 pass.

    A group is held until it is told from the next one or has MANY rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held, held_ids = none, none
        full = last = None  # the key whose first MANY rows are out; the last row

        def rows(gram: np.ndarray, sid: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(gram), pa.array(sid), pa.array(count.astype(np.int32))], names=["gram", "sid", "weight"])

        for batch in batches:
            gram, sid, weight = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            told = weight < 0
            if told.any():
                yield batch.filter(pa.array(told))
                gram, sid = gram[~told], sid[~told]
            # equal rows of several tasks count once
            new = np.r_[True, (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])][: len(gram)]
            if len(gram) and (gram[0], sid[0]) == last:
                new[0] = False
            gram, sid = gram[new], sid[new]
            if not len(gram):
                continue
            last = gram[-1], sid[-1]
            gram, sid = np.r_[held, gram], np.r_[held_ids, sid]
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            size = np.diff(np.r_[first, len(gram)])
            count = np.minimum(np.repeat(size, size), MANY)
            if full is not None:
                count[gram == full] = MANY
            waits = (gram == gram[-1]) & (count < MANY)
            full = gram[-1] if count[-1] == MANY else None
            out = ~waits & (count > 1)
            if out.any():
                yield rows(gram[out], sid[out], count[out])
            held, held_ids = gram[waits], sid[waits]
        if len(held) > 1:
            yield rows(held, held_ids, np.full(len(held), len(held)))
        give_back()

    to = F.when(F.col("weight") < 0, F.col("sid")).otherwise(F.col("gram"))
    return keys.repartition(to).sortWithinPartitions("gram", "sid").mapInArrow(run, _KEY)


def _selected(shared: DataFrame) -> DataFrame:
    """(gram, n, sid): of the sets that have as many shared keys as they need, the rarest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "sid", 1 << 16):
            sid, gram, weight = (table.column(c).to_numpy() for c in ("sid", "gram", "weight"))
            new = np.r_[True, sid[1:] != sid[:-1]]
            told = weight < 0
            # a set that several tasks gave has several equal heads
            head = told & (new | np.r_[True, gram[1:] != gram[:-1]])
            first = np.flatnonzero(new)
            label = np.cumsum(new) - 1
            keys = np.bincount(label, ~told).astype(np.int64)
            before = np.cumsum(~told) - 1
            place = before - (np.cumsum(keys) - keys)[label]
            # should sets of unequal sizes share their 63 bits, each size is given the keys of all
            for take in _one_head_each(head, label):
                have = np.zeros(len(first), bool)
                n, need = np.zeros((2, len(first)), np.int64)
                have[label[take]] = True
                n[label[take]], need[label[take]] = gram[take] >> 32, gram[take] & 0xFFFFFFFF
                keep = ~told & (have & (keys >= need))[label] & (place <= (keys - need)[label])
                if keep.any():
                    yield pa.record_batch([pa.array(gram[keep]), pa.array(n[label[keep]]), pa.array(sid[keep])], names=["gram", "n", "sid"])
        give_back()

    return shared.repartition("sid").sortWithinPartitions("sid", "weight", "gram").mapInArrow(run, "gram long, n long, sid long")


def _one_head_each(head: np.ndarray, label: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the heads, at most one of each set at a time."""
    at = np.flatnonzero(head)
    while len(at):
        one = np.r_[True, label[at[1:]] != label[at[:-1]]]
        yield at[one]
        at = at[~one]


def _ties(selected: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) between neighbours by size among the sets that have a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((3, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, n, sid = np.concatenate([last, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            ids = sid & -2
            tied = (gram[1:] == gram[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (ids[1:] != ids[:-1])
            a, b = ids[:-1][tied], ids[1:][tied]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
            last = np.array([gram[-1:], n[-1:], sid[-1:]])

    return selected.repartition("gram").sortWithinPartitions("gram", "n", "sid").mapInArrow(run, "a long, b long")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A parity sketch of each set, a row of 64-bit words; long enough for the largest set."""
    bits = 1 << int(min(16, max(8, int(4 * max(map(len, sets), default=1) - 1).bit_length())))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for k, s in enumerate(sets):
        flips = np.bincount((mix(s ^ _B) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        out[k] = np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def linked_groups(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the first set that it is linked to, directly or over others.

    Sets not reached yet wait in the order of size.  A set that is reached looks at those
    that wait and fit in size; sketches rule out most, the others are compared as they are.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    label = np.arange(m)
    sketch = sketches(sets)
    waits = np.argsort(size, kind="stable")
    reached = np.zeros(m, bool)
    for seed in range(m):
        if reached[seed]:
            continue
        reached[seed] = True
        queue = [seed]
        while queue:
            one = queue.pop()
            waits = waits[~reached[waits]]
            if not len(waits):
                return label
            n = int(size[one])
            lo, hi = np.searchsorted(size[waits], [-(-percent * n // 100), 100 * n // percent + 1])
            near = waits[lo:hi]
            near = near[np.bitwise_count(sketch[near] ^ sketch[one]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (n + size[near])]
            for k in near.tolist():
                place = np.minimum(np.searchsorted(sets[one], sets[k]), n - 1)
                both = int((sets[one][place] == sets[k]).sum())
                if 100 * both >= percent * (n + int(size[k]) - both):
                    label[k] = label[seed]
                    reached[k] = True
                    queue.append(k)
    return label


def _verified(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links of the sets of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "task", 1 << 10):
            task, ids = table.column("task").to_numpy(), table.column("set_no").to_numpy()
            sets = [s for block in blocks(table.column("text")) for s in shingle_sets(block, shingle)]
            edges = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own, at = np.unique(ids[lo:hi], return_index=True)
                label = linked_groups([sets[lo + i] for i in at], percent)
                linked = np.flatnonzero(label != np.arange(len(label)))
                if len(linked):
                    yield pa.record_batch([pa.array(own[linked]), pa.array(own[label[linked]])], names=["a", "b"])
            del table, sets
            give_back()

    return texts.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def similar_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """Per document row: doc_id, n_shingles (distinct ones), component_id (smallest doc_id reachable by links)."""
    if not 50 <= percent <= 100:
        raise ValueError(f"a similarity of 50 to 100 percent, not {percent}")
    held = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    held = held.withColumn("key", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("tag", F.xxhash64("text", F.col("text").isNull(), F.col("doc_id").isNull()))
    sets = cut(_read(held, shingle))
    some = sets.filter("n > 0")

    tied = connected_components(cut(_ties(_selected(_shared(_keys(held, shingle, percent))), percent).distinct()))
    named = some.join(tied.select(F.col("node"), F.col("root").alias("tied")), F.col("h1").bitwiseAND(-2) == F.col("node"))
    wanted = cut(named.groupBy("h1", "h2", "tied", "n").agg(F.min(F.struct("key", "tag")).alias("r")).select("h1", "h2", "tied", "n", "r.key", "r.tag").withColumn("set_no", F.monotonically_increasing_id()))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / block_shingles))
    large = wanted.groupBy("tied").agg(parts.alias("parts")).filter("parts > 1")
    own = F.pmod(F.xxhash64("set_no"), F.col("parts"))
    other = F.when(F.col("parts") > 1, F.array_except(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.array(own))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = wanted.join(large, "tied", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("other", F.explode(other))
    dealt = dealt.select("key", "tag", "set_no", F.xxhash64("tied", F.least(own, "other"), F.greatest(own, "other")).alias("task"))
    texts = among(held, wanted, "tag", "key long, tag long, text string").join(dealt, ["key", "tag"]).select("task", "set_no", "text")
    roots = connected_components(cut(_verified(texts, shingle, percent)))

    ids = wanted.select("set_no", "h1", "h2")
    first = ids.select(F.col("set_no").alias("root"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    rooted = ids.join(roots, F.col("set_no") == F.col("node")).join(first, "root").select("h1", "h2", "r1", "r2")
    distinct = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = distinct.join(rooted, ["h1", "h2"], "left").filter("rows > 1 OR r1 IS NOT NULL").withColumns({"r1": F.coalesce("r1", "h1"), "r2": F.coalesce("r2", "h2")})
    classes = cut(classes.select("h1", "h2", "least", "r1", "r2"))
    names = classes.groupBy("r1", "r2").agg(F.min("least").alias("component_id"))
    found = classes.join(names, ["r1", "r2"]).select("h1", "h2", "component_id", F.lit(True).alias("met"))
    out = some.join(found, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.union(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
