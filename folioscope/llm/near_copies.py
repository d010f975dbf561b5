"""Near copies: SimHash fingerprints linked by op8's trie self-join, held against the exact Jaccard similarity of 4/5.

Fingerprints find the copies within an error budget; no budget that does without comparing
nearly all pairs finds all copies of a similarity of 4/5 (about ten bits, up to twenty and
more), so what is beyond the budget is found by shingles, without a lost pair:

1. Every text becomes its set of hashed shingles.  Equal sets are one from here on.  The
   fingerprint of a set has the bits that over half of its shingles have.
2. Fingerprints are linked by the trie self-join of simhash.py within the budget.  The texts
   of a component of links come together and are held against the real similarity; what
   holds is a class.
3. Two sets of similarity 4/5 share one of the first n - ceil(4n/5) + 1 elements of the
   larger and the first n - ceil(8n/9) + 1 of the smaller (the prefix filter), in any order
   that holds for all.  A first order puts only listed, very common shingles last.  Sets
   that meet no other of fitting size there are done.
4. The elements of the other sets are counted exactly, shingle by shingle, and rare ones
   come first in the order that is used from here on.  A set with enough elements of its
   own (a fifth) drops out: its prefix meets nobody.
5. In the bucket of a shingle the sets are put in order of size, and neighbours whose sizes
   are within 4/5 are tied: a bucket gives a chain, not its pairs, and sets that could be
   similar end up in one component of ties.  Ties inside a class are done.
6. The texts of classes that are tied come together; there pairs are held against the real
   similarity, walking from class to class and only looking at sets not yet reached.

Scale: prefixes, elements, ties and texts are linear in the input, and each is streamed.
After step 4 a component is little more than a group of near copies; it is worked off in
one task, in memory in proportion to the shingles of its distinct texts.  The list of common
shingles and the bit table that keeps other texts out of steps 2, 4 and 6 are bounded; they
only save work.

Defined cases: null, empty and word-free texts are one set; texts shorter than a shingle
hash the whole sequence; letters are compared in ASCII lower case; the row with the
smallest non-null doc_id of a group (linked directly or over others) stays; of rows with
equal id and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.bwt_dedup import _whole_groups
from folioscope.llm.shared import LOWER, NON_SPACE, Block, among, blocks, cut, give_back, mix, prefix_hash, span_hash, word_spans
from folioscope.llm.simhash import bucket_links, connected_components, majority

SHINGLE = 5
#: Differing bits of linked fingerprints.
BUDGET = 5
#: A shingle that so many texts of some COUNTED shingles have is common; so many are listed.
COMMON, COUNTED, LISTED = 3, 1 << 21, 200_000
#: Unlisted elements count up to MANY; listed ones weigh more.
MANY, UNLISTED = 1 << 12, 1 << 20
_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(block: Block, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each row's shingle hashes, sorted, each once."""
    data = LOWER[block.data]
    starts, ends, first = word_spans(block, data, NON_SPACE)
    words = span_hash(prefix_hash(data), starts, ends)
    n = max(0, len(words) - shingle + 1)
    runs = np.full(n, _SEED)
    for k in range(shingle):
        runs = mix(runs * _STEP + words[k : k + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
            continue
        h = np.full(min(1, b - a), _SEED + np.uint64(b - a))
        for k in range(a, b):
            h = mix(h * _STEP + words[k : k + 1])
        out.append(h)
    return out


def _set_id(found: np.ndarray) -> int:
    return int(mix(np.array([mix(found ^ _SEED).sum(dtype=np.uint64)]) + np.uint64(len(found))).view(np.int64)[0])


def similar_groups(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """For each set the first set it is linked to, directly or over others, by a Jaccard similarity of 4/5 or more.

    The prefix filter again, now with the exact number of sets that have an element.  Sets
    of one class (equal in known) are linked already and are reached together.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    label = np.arange(m)
    known = label if known is None else np.unique(known, return_inverse=True)[1]
    mates = np.argsort(known, kind="stable")
    first_mate = np.searchsorted(known[mates], np.arange(m + 1))
    # elements alone in their slot are in one set only and need not be put in order
    mask = np.uint64((1 << int(4 * size.sum() + 1).bit_length()) - 1)
    met = np.zeros(int(mask) + 1, np.uint8)
    for s in sets:
        slot = s & mask
        met[slot] = np.minimum(met[slot] + 1, 2)
    some = [s[met[s & mask] > 1] for s in sets]
    del met
    owner = np.repeat(np.arange(m), [len(s) for s in some])
    _, element, texts = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
    del some
    keep = texts[element] > 1
    owner, element = owner[keep], element[keep]
    shared = np.bincount(owner, minlength=m)
    take = np.maximum(size - (4 * size + 4) // 5 + 1 - (size - shared), 0)
    by = np.lexsort((element, texts[element], owner))
    owner, element = owner[by], element[by]
    first = np.r_[0, np.cumsum(shared)]
    keep = np.arange(len(owner)) - first[owner] < take[owner]
    owner, element = owner[keep], element[keep]
    first = np.r_[0, np.cumsum(np.bincount(owner, minlength=m))]
    by = np.argsort(element, kind="stable")
    own, values, owner = element, element[by], owner[by]
    waits = np.ones(m, bool)
    held = left = m

    def reach(one: int, seed: int) -> list[int]:
        found = mates[first_mate[known[one]] : first_mate[known[one] + 1]]
        label[found], waits[found] = seed, False
        return found.tolist()

    for seed in range(m):
        if not waits[seed]:
            continue
        queue = reach(seed, seed)
        left -= len(queue)
        while queue and left:
            if left * 2 < held:
                keep = waits[owner]
                values, owner, held = values[keep], owner[keep], left
            one = queue.pop()
            wanted = own[first[one] : first[one + 1]]
            lo, hi = np.searchsorted(values, wanted), np.searchsorted(values, wanted, "right")
            many = hi - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            other = np.unique(owner[at])
            n = size[one]
            for k in other[waits[other] & (5 * np.minimum(n, size[other]) >= 4 * np.maximum(n, size[other]))].tolist():
                if not waits[k]:
                    continue
                place = np.minimum(np.searchsorted(sets[one], sets[k]), n - 1)
                if 9 * int((sets[one][place] == sets[k]).sum()) >= 4 * int(n + size[k]):
                    found = reach(k, seed)
                    left -= len(found)
                    queue += found
    return label


def _read(rows: DataFrame, shingle: int) -> DataFrame:
    """Of each row its set, the set's fingerprint and size (common is null); and common shingles with their number of texts."""
    names = ["doc_id", "key", "tag", "set_id", "fp", "n", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def count() -> pa.RecordBatch:
            values, texts = np.unique(np.concatenate(held), return_counts=True)
            often = texts >= COMMON
            k = int(often.sum())
            none = pa.nulls(k, pa.int64())
            return pa.record_batch([none, none, none, none, none, pa.array(texts[often]), pa.array(values[often].view(np.int64))], names=names)

        for batch in batches:
            for block in blocks(batch.column(3)):
                sets = shingle_sets(block, shingle)
                part = batch.slice(block.first, block.rows)
                prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                yield pa.record_batch([*part.columns[:3], pa.array([_set_id(s) for s in sets], pa.int64()), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.int64())], names=names)
                held += sets
                if sum(map(len, held)) > COUNTED:
                    yield count()
                    held = []
        if held:
            yield count()

    return rows.select("doc_id", "key", "tag", "text").mapInArrow(run, "doc_id long, key long, tag long, set_id long, fp long, n long, common long")


def _prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def _short_prefix(n: np.ndarray) -> np.ndarray:
    return n - (8 * n + 8) // 9 + 1


def _prefixes(rows: DataFrame, common: np.ndarray, texts: np.ndarray, shingle: int) -> DataFrame:
    """(gram, place, set_id): the first elements of each set; common (sorted) and texts say which come last.

    place: twice the set's size, and one more for elements beyond the short prefix; these
    only count where the set is the larger one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                grams, place, ids, take = [], [], [], []
                for s in shingle_sets(block, shingle):
                    if not len(s):
                        continue
                    k = int(_prefix_size(len(s)))
                    weight = np.zeros(len(s), np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        weight = np.where(common[at] == s, texts[at], 0)
                    grams.append(s[np.argsort(weight, kind="stable")[:k]])
                    place.append(2 * len(s) + (np.arange(k) >= _short_prefix(len(s))))
                    ids.append(_set_id(s))
                    take.append(k)
                if grams:
                    yield pa.record_batch(
                        [pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.repeat(np.array(ids, np.int64), take))], names=["gram", "place", "set_id"]
                    )

    return rows.select("text").mapInArrow(run, "gram long, place int, set_id long")


def _met(prefixes: DataFrame) -> DataFrame:
    """Sets (set_id) that share a first element with another set of fitting size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _neighbours(batches):
            yield pa.record_batch([pa.array(np.unique(np.r_[a, b]))], names=["set_id"])

    return prefixes.repartition("gram").sortWithinPartitions("gram", "place", "set_id").mapInArrow(run, "set_id long")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows (gram, place, set_id) in that order each one and the last one before it that lies in a short prefix, if the sizes fit."""
    last = np.zeros((3, 0), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, place, ids = np.concatenate([last, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        short = (place & 1) == 0
        before = np.maximum.accumulate(np.where(short, np.arange(len(gram)), -1))
        keep = before[-1]
        at = np.r_[-1, before[:-1]]
        rows = np.flatnonzero(at >= 0)
        at = at[rows]
        tied = (gram[rows] == gram[at]) & (5 * (place[at] >> 1) >= 4 * (place[rows] >> 1)) & (ids[rows] != ids[at])
        yield ids[at[tied]], ids[rows[tied]]
        last = np.array([gram[keep : keep + 1], place[keep : keep + 1], ids[keep : keep + 1]]) if keep >= 0 else last[:, :0]
    give_back()


def _ties(prefixes: DataFrame) -> DataFrame:
    """Ties (a, b) between neighbours by size in the bucket of a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _neighbours(batches):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return prefixes.repartition("gram").sortWithinPartitions("gram", "place", "set_id").mapInArrow(run, "a long, b long")


_ELEMENT = "set_id long, gram long, weight int"


def _elements(texts: DataFrame, common: np.ndarray, often: np.ndarray, shingle: int) -> DataFrame:
    """(set_id, gram, weight) of every set: unlisted elements with weight 0, and as many of the listed ones as a prefix may hold.

    A row of weight -1 tells of each set how many elements it has and, in the lower half of gram, how many are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                grams, weights, many = [], [], []
                for s in shingle_sets(block, shingle):
                    weight = np.zeros(len(s), np.int64)
                    if len(common) and len(s):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        weight = np.where(common[at] == s, UNLISTED + np.minimum(often[at], UNLISTED), 0)
                    rare, last = s[weight == 0], np.argsort(weight, kind="stable")
                    last = last[weight[last] > 0]
                    told = np.array([len(s) << 32 | len(last)], np.uint64)
                    last = last[: int(_prefix_size(len(s)))]
                    grams += [told, rare, s[last]]
                    weights += [np.array([-1], np.int32), np.zeros(len(rare), np.int32), weight[last].astype(np.int32)]
                    many.append(1 + len(rare) + len(last))
                yield pa.record_batch([pa.array(np.repeat(ids[block.first : block.first + block.rows], many)), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(weights))], names=["set_id", "gram", "weight"])

    return texts.select("set_id", "text").mapInArrow(run, _ELEMENT)


def _counted(elements: DataFrame) -> DataFrame:
    """Elements with the number of sets that have them (at most MANY) as weight; those of one set are left out.

    Others than those of weight 0 pass.  A group is held until it is told from the next one or has MANY rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        full: int | None = None  # the gram whose first MANY rows are out
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                table = pa.concat_tables([held, table])
            table, held, full = step(table, full, False)
            if table.num_rows:
                yield from table.combine_chunks().to_batches()
        if held is not None and held.num_rows:
            table, _, _ = step(held, full, True)
            yield from table.combine_chunks().to_batches()
        give_back()

    def step(table: pa.Table, full: int | None, end: bool) -> tuple[pa.Table, pa.Table, int | None]:
        gram, weight = table.column("gram").to_numpy(), table.column("weight").to_numpy()
        own = weight == 0
        label = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
        count = np.minimum(np.bincount(label, own).astype(np.int64)[label], MANY)
        if full is not None:
            count = np.where(gram == full, MANY, count)
        out = np.where(own, count, weight).astype(np.int32)
        waits = (gram == gram[-1]) & own & (count < MANY) & (not end)
        full = int(gram[-1]) if count[-1] == MANY else None
        done = table.set_column(table.column_names.index("weight"), "weight", pa.array(out)).filter(pa.array(~waits & (out != 1)))
        return done, table.filter(pa.array(waits)), full

    to = F.when(F.col("weight") != 0, F.col("set_id")).otherwise(F.col("gram"))
    return elements.repartition(to).sortWithinPartitions("gram").mapInArrow(run, _ELEMENT)


def _refined(counted: DataFrame) -> DataFrame:
    """(gram, place, set_id): the first elements of each set, rare ones first, as far as other sets have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "set_id", 1 << 16):
            ids, gram, weight = (table.column(c).to_numpy() for c in ("set_id", "gram", "weight"))
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])  # the row that tells the sizes
            label = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
            n, listed = (gram[first] >> 32)[label], (gram[first] & 0xFFFFFFFF)[label]
            shared = np.bincount(label, (weight > 0) & (weight <= MANY)).astype(np.int64)[label]
            # elements that no other set has come first; what is left of the prefix is taken here
            at = n - listed - shared + np.arange(len(ids)) - first[label] - 1
            keep = (weight > 0) & (at < _prefix_size(n))
            place = (2 * n + (at >= _short_prefix(n))).astype(np.int32)
            yield pa.record_batch([pa.array(gram[keep]), pa.array(place[keep]), pa.array(ids[keep])], names=["gram", "place", "set_id"])
        give_back()

    dealt = counted.repartition("set_id").sortWithinPartitions("set_id", "weight", "gram")
    return dealt.mapInArrow(run, "gram long, place int, set_id long")


def _confirmed(texts: DataFrame, shingle: int) -> DataFrame:
    """(set_id, root) of the sets that are linked to another one, from the texts of every component (tied); sets of equal known are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "tied", 1 << 10):
            tied, ids, known = (table.column(c).to_numpy() for c in ("tied", "set_id", "known"))
            sets = [s for block in blocks(table.column("text")) for s in shingle_sets(block, shingle)]
            edges = np.flatnonzero(np.r_[True, tied[1:] != tied[:-1], True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own, at = np.unique(ids[a:b], return_index=True)
                label = similar_groups([sets[a + i] for i in at], known[a + at])
                # ids are in order, so the first set of a group has the smallest
                if (linked := np.flatnonzero(label != np.arange(len(label)))).size:
                    yield pa.record_batch([pa.array(own[linked]), pa.array(own[label[linked]])], names=["set_id", "root"])

    return texts.repartition("tied").sortWithinPartitions("tied").mapInArrow(run, "set_id long, root long")


def _linked(sets: DataFrame) -> DataFrame:
    """(set_id, key, tag, known, tied) of the sets whose fingerprint is linked to another set's by the trie self-join, or equal to it; tied names the component."""
    # all buckets are dealt again: 36 rows of each fingerprint, whatever their number
    roots = connected_components(bucket_links(sets.select("fp").distinct(), BUDGET, 0))
    tied = sets.join(roots, sets.fp == roots.node, "left").select("set_id", "key", "tag", F.col("set_id").alias("known"), F.coalesce("root", "fp").alias("tied"))
    several = tied.groupBy("tied").count().filter("count > 1").select("tied")
    return tied.join(several, "tied", "left_semi")


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, the other columns of wanted, text): the text of one row of each set wanted."""
    return among(rows, wanted, "tag", "key long, tag long, text string").join(wanted, ["key", "tag"]).drop("key", "tag")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id.

    Rows with a null id come last in their group; of rows with equal id and text one stays.
    A row is told from others by its id (key) and a hash of its text (tag).
    """
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("document"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    held = held.withColumn("key", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("tag", F.xxhash64("text", F.col("text").isNull(), F.col("doc_id").isNull()))
    read = cut(_read(held, shingle))
    listed = read.filter("common IS NOT NULL").groupBy("common").agg(F.sum("n").alias("texts")).orderBy(F.desc("texts"), "common").limit(LISTED).toArrow()
    common, texts = listed.column("common").to_numpy().view(np.uint64), listed.column("texts").to_numpy()
    by = np.argsort(common)
    sets = read.filter("common IS NULL").select("doc_id", "key", "tag", "set_id")
    one_row = cut(read.filter("common IS NULL").groupBy("set_id", "fp").agg(F.min(F.struct("key", "tag")).alias("r")).select("set_id", "fp", "r.key", "r.tag"))

    near = cut(_confirmed(_among(held, cut(_linked(one_row))), shingle))
    one_row = one_row.drop("fp")

    met = _met(_prefixes(held, common[by], texts[by], shingle)).distinct()
    active = cut(one_row.join(met, "set_id"))
    prefixes = _refined(_counted(_elements(_among(held, active), common[by], texts[by], shingle)))
    ties = _ties(prefixes).distinct().join(near.toDF("a", "x"), "a", "left").join(near.toDF("b", "y"), "b", "left")
    ties = cut(ties.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a <> b"))
    tied = connected_components(ties).select(F.col("node").alias("known"), F.col("root").alias("tied"))
    wanted = one_row.join(near, "set_id", "left").withColumn("known", F.coalesce("root", "set_id")).drop("root").join(tied, "known")
    links = cut(_confirmed(_among(held, cut(wanted)), shingle))

    rooted = sets.join(links, "set_id", "left").join(near.toDF("set_id", "near"), "set_id", "left").select("doc_id", "key", "tag", F.coalesce("root", "near", "set_id").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "key", "tag")).alias("b")).select("b.key", "b.tag")
    return held.join(best, ["key", "tag"], "left_semi").dropDuplicates(["key", "tag"]).select("document.*")
