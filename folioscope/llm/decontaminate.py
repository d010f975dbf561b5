"""Benchmark decontamination by a generalised suffix automaton of the test items.

Item and document texts are lower-cased (A-Z) and cut into words of digits, letters and
everything beyond ASCII.  The automaton is built over item words (as integers), item by item, so no string
crosses two items.  Document words stream through it; the longest matching length after
each word tells whether a window (``window`` consecutive item words, or a whole shorter
item) ends there, and suffix links give the items that hold the window.

Words that are no item word, and word pairs that no item has, reset or cut any match.  They are found with
vector operations first, so the automaton only steps through runs long enough to hold a
window; this skips no match.

Scale: items are dealt into automata of at most ``max_item_words`` words, built on the
executors (some 500 bytes a word; the driver only passes their bytes on).  With one
automaton, it is sent to the workers and documents are streamed through it in one pass,
without a shuffle.  With more, a first pass keeps the documents that have the hash of any
window of any item in a bit table of fixed size; these go through one automaton after the
other, which is then given up, so that workers and driver hold one at a time.

Defined cases: null or word-free texts have no words, no hits and are not contaminated;
items without words match nothing; an item whose id is null is matched but not listed;
repeated items are reported under each of their ids; repeated document rows each give a row; null ids stay
null; other columns of the documents pass through :func:`remove_contamination`
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import LOWER, WORD_CHARS, Block, blocks, cut, hash_of, mix, prefix_hash, span_hash, word_spans

WINDOW = 10
#: Words of one automaton.
MAX_ITEM_WORDS = 200_000
#: Bits of the table of window hashes.
TABLE_BITS = 1 << 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    block = Block(0, data, np.array([0, len(data)]))
    starts, ends, _ = word_spans(block, data, WORD_CHARS)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)]


class ItemAutomaton:
    """Generalised suffix automaton of word sequences, with what a window match needs."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        ids: dict[bytes, int] = {}
        coded = [(item, [ids.setdefault(w, len(ids)) for w in words]) for item, words in items if words]
        self.words = list(ids)
        #: Edges by state << 32 | word.
        self.next: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self._words_at: list[list[int]] = [[]]
        ends: dict[int, set] = {}
        pairs: set[int] = set()
        whole: dict[int, list] = {}
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
            pairs.update(a << 32 | b for a, b in zip(word_ids, word_ids[1:]))
        del self._words_at
        for item, word_ids in coded:
            state = 0
            for w in word_ids:
                state = self.next[state << 32 | w]
                if self.length[state] >= window:
                    ends.setdefault(state, set()).add(item)
            if len(word_ids) < window:
                whole.setdefault(state, []).append(item)
        n = len(self.link)
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in reversed(order):
            if self.length[self.link[s]] >= window and s in ends:
                ends.setdefault(self.link[s], set()).update(ends[s])
        #: Per state at which windows end first on the links: the items that have the window.
        self.items_of: dict[int, frozenset] = {}
        #: Per state: nearest state at or above it on the links with a whole short item.
        self.short_at = [-1] * n
        self.window_state = [-1] * n
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.window_state[s] = s if self.length[up] < window else self.window_state[up]
            self.short_at[s] = s if s in whole else self.short_at[up]
            if self.window_state[s] == s:
                self.items_of[s] = frozenset(ends.get(s, ()))
        self.whole = whole
        self.shortest = min([window, *(len(w) for _, w in coded)]) if coded else window
        hashes = hash_of(self.words)
        rank = np.argsort(hashes)
        self.vocab_hash, self.vocab_id = hashes[rank], rank.astype(np.int64)
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt.get(last << 32 | w)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and p << 32 | w not in nxt:
            nxt[p << 32 | w] = new
            self._words_at[p].append(w)
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p << 32 | w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int) -> int:
        self.link.append(0)
        self.length.append(length)
        self._words_at.append([])
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        for x in self._words_at[q]:
            self.next[copy << 32 | x] = self.next[q << 32 | x]
        self._words_at[copy] = list(self._words_at[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next.get(p << 32 | w) == q:
            self.next[p << 32 | w] = copy
            p = self.link[p]
        return copy

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Word spans of all windows that occur in ids, merged, and the items that have them."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        spans: list[tuple[int, int]] = []
        items: set = set()
        for i, w in enumerate(ids):
            while state and state << 32 | w not in nxt:
                state = link[state]
                matched = length[state]
            if (to := nxt.get(state << 32 | w)) is None:
                continue
            state, matched = to, matched + 1
            reach = 0
            if matched >= window:
                reach = window
                items |= self.items_of[self.window_state[state]]
            short = self.short_at[state]
            if short == state and matched < length[state]:
                short = self.short_at[link[state]]
            while short > 0:
                reach = max(reach, length[short])
                items.update(self.whole[short])
                short = self.short_at[link[short]]
            if reach:
                lo = i + 1 - reach
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, i + 1))
        return spans, items

    def runs(self, hashes: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item word of each word (-1: none), and the runs of words that may hold a window."""
        ids = np.full(len(hashes), -1, np.int64)
        if len(self.vocab_hash) and len(hashes):
            at = np.minimum(np.searchsorted(self.vocab_hash, hashes), len(self.vocab_hash) - 1)
            ids = np.where(self.vocab_hash[at] == hashes, self.vocab_id[at], -1)
        known = ids >= 0
        joined = np.zeros(len(ids) + 1, bool)  # to the word before
        if len(ids) > 1 and len(self.pairs):
            maybe = np.flatnonzero(known[1:] & known[:-1] & (row_of[1:] == row_of[:-1])) + 1
            keys = ids[maybe - 1] << 32 | ids[maybe]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[maybe[self.pairs[at] == keys]] = True
        first = np.flatnonzero(known & ~joined[:-1])
        last = np.flatnonzero(known & ~joined[1:]) + 1
        enough = last - first >= self.shortest
        return ids, first[enough], last[enough]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, text, n_words) of the items that can match, each once."""
    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna(subset=["text"]).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(word_spans(b, LOWER[b.data], WORD_CHARS)[2]) for b in blocks(batch.column(1))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64))], names=["item", "text", "n_words"])

    return named.mapInArrow(run, "item string, text string, n_words long").filter("n_words > 0")


def build_automata(items: DataFrame, parts: int, window: int = WINDOW) -> Iterator[bytes]:
    """Pickled automata, one for each part of the items, built by the executors and passed on one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, item, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if part not in held:  # parts come one after the other
                    yield from flush(held)
                    held = {part: []}
                held[part].append((item, item_words(text)))
        yield from flush(held)

    def flush(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for part, rows in held.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([pickle.dumps(ItemAutomaton(rows, window), protocol=5)], pa.binary())], names=["part", "automaton"])

    dealt = items.select(F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int").alias("part"), "item", "text").repartition(parts, "part").sortWithinPartitions("part", "item", "text")
    for row in cut(dealt.mapInArrow(run, "part int, automaton binary")).toLocalIterator():
        yield bytes(row.automaton)


def _window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of every run of ``size`` word hashes one hash."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mix(out * _STEP + hashes[k : k + n])
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(TABLE_BITS)).astype(np.int64)


def window_table(items: DataFrame, window: int = WINDOW) -> tuple[np.ndarray, list[int]]:
    """A bit for the hash of every window of every item, and the window sizes that occur."""
    sizes = sorted(r[0] for r in items.select(F.least("n_words", F.lit(window)).cast("int")).distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(TABLE_BITS, bool)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                hashes = hash_of(item_words(text))
                bits[_slots(_window_hashes(hashes, min(window, len(hashes))))] = True
        if bits.any():
            yield pa.record_batch([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    table = np.zeros(TABLE_BITS // 8, np.uint8)
    for row in items.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        table |= np.frombuffer(row.bits, np.uint8)
    return table, sizes


def may_match(column: pa.Array, table: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Rows of a text column with a window whose bit is set."""
    out = np.zeros(len(column), bool)
    for block in blocks(column):
        data = LOWER[block.data]
        starts, ends, first = word_spans(block, data, WORD_CHARS)
        hashes = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        row_of = np.repeat(np.arange(block.rows), np.diff(first))
        for size in sizes:
            slot = _slots(_window_hashes(hashes, size))
            hit = np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            hit = hit[row_of[hit] == row_of[hit + size - 1]]
            out[block.first + row_of[hit]] = True
    return out


def match_batch(column: pa.Array, automata: list[ItemAutomaton]) -> list[tuple[int, list[tuple[int, int]], set]]:
    """Per row: words, hit word spans and items."""
    out = []
    for block in blocks(column):
        data = LOWER[block.data]
        starts, ends, first = word_spans(block, data, WORD_CHARS)
        hashes = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        row_of = np.repeat(np.arange(block.rows), np.diff(first))
        found: dict[int, tuple[list, set]] = {}
        for automaton in automata:
            ids, lo, hi = automaton.runs(hashes, row_of)
            for a, b in zip(lo.tolist(), hi.tolist()):
                spans, items = automaton.stream(ids[a:b].tolist())
                if spans:
                    own = found.setdefault(int(row_of[a]), ([], set()))
                    own[0].extend((a + x, a + y) for x, y in spans)
                    own[1].update(items)
        for i in range(block.rows):
            n = int(first[i + 1] - first[i])
            if i not in found:
                out.append((n, [], set()))
                continue
            out.append((n, [(x - int(first[i]), y - int(first[i])) for x, y in _merged(found[i][0])], found[i][1]))
    return out


_loaded: dict[bytes, ItemAutomaton] = {}


def _automata(sent: Broadcast) -> list[ItemAutomaton]:
    """The automaton of a broadcast, if there is one; a worker keeps the last one it has read."""
    if not sent.value:
        return []
    name = hashlib.sha256(sent.value).digest()
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = pickle.loads(sent.value)
    return [_loaded[name]]


def _only(sc: SparkContext, items: DataFrame, window: int) -> Broadcast:
    return sc.broadcast(next(build_automata(items, 1, window), b""))


_FOUND = "n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"
_PAIRS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _found_columns(rows: list) -> list[pa.Array]:
    spans = [[{"lo": x, "hi": y} for x, y in r[1]] for r in rows]
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, _PAIRS), pa.array([sorted(i for i in r[2] if i is not None) for r in rows], pa.list_(pa.string()))]


def _dealt_items(benchmark: DataFrame, max_item_words: int) -> tuple[DataFrame, int]:
    """The items, and into how many automata they go."""
    items = cut(_items(benchmark, "item_id", "text"))
    return items, -(-int(items.agg(F.sum("n_words")).first()[0] or 0) // max_item_words)


def _matches(rows: DataFrame, benchmark: DataFrame, window: int, max_item_words: int) -> DataFrame:
    """rows (key, tag, doc_id, text) with their words, hit spans (in words) and items."""
    items, parts = _dealt_items(benchmark, max_item_words)
    sc = rows.sparkSession.sparkContext
    names = [x.split()[0] for x in _FOUND.split(", ")]
    first = ["key", "tag", "doc_id", "text"]
    kept = "key long, tag long, doc_id long, text string"

    def match(sent, only_hits: bool, drop_text: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = match_batch(batch.column(3), _automata(sent))
                own = batch.columns[:2] if drop_text else batch.columns
                out = pa.record_batch([*own, *_found_columns(found)], names=[*(first[:2] if drop_text else first), *names])
                yield out.filter(pa.array([bool(f[1]) for f in found], pa.bool_())) if only_hits else out

        return run

    if parts <= 1:
        return rows.mapInArrow(match(_only(sc, items, window), False, False), f"{kept}, {_FOUND}")
    table, sizes = window_table(items, window)
    shared = sc.broadcast((table, sizes))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_match(batch.column(3), *shared.value)))

    some = cut(rows.mapInArrow(candidates, kept).dropDuplicates(["key", "tag"]))
    found: DataFrame | None = None
    for automaton in build_automata(items, parts, window):
        sent = sc.broadcast(automaton)
        part = cut(some.mapInArrow(match(sent, True, True), f"key long, tag long, {_FOUND}"))
        found = part if found is None else found.union(part)
        sent.destroy()
    all_of = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = found.groupBy("key", "tag").agg(all_of("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = rows.join(found, ["key", "tag"], "left").select(*first, "spans", "items")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_merged([(x["lo"], x["hi"]) for x in v or ()]) for v in batch.column(4).to_pylist()]
            rows_ = list(zip(_counts(batch.column(3)), told, [i or () for i in batch.column(5).to_pylist()]))
            yield pa.record_batch([*batch.columns[:4], *_found_columns(rows_)], names=[*first, *names])

    return joined.mapInArrow(merge, f"{kept}, {_FOUND}")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _counts(column: pa.Array) -> list[int]:
    return [int(n) for block in blocks(column) for n in np.diff(word_spans(block, LOWER[block.data], WORD_CHARS)[2])]


def _identity(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: the id (key) and a hash of the text (tag); and both themselves."""
    own, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    return [F.coalesce(own, F.lit(0).cast("long")).alias("key"), F.xxhash64(text, text.isNull(), own.isNull()).alias("tag"), own.alias("doc_id"), text.alias("text")]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Per document row: its words, the hit words, the items found and the hit spans (word numbers)."""
    found = _matches(docs.select(*_identity(docs, id_col, text_col)), benchmark, window, max_item_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    spans = F.transform("spans", lambda s: F.concat(s["lo"].cast("string"), F.lit(":"), s["hi"].cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), spans.alias("spans"))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some spans of its words."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(Block(0, data, np.array([0, len(data)])), LOWER[data], WORD_CHARS)
    kept, end = [], 0
    for lo, hi in spans:
        kept.append(raw[end : starts[lo]])
        end = int(ends[hi - 1])
    return b"".join([*kept, raw[end:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.8, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """The documents without the spans of benchmark windows, with the columns they came with.

    A hit span goes as a whole; what is left is matched again until nothing is hit.  A
    document with more than max_coverage of its words hit is dropped.
    """
    items, parts = _dealt_items(benchmark, max_item_words)
    if parts <= 1:
        return _remove_in_one_pass(docs, _only(docs.sparkSession.sparkContext, items, window), text_col, max_coverage)
    columns = ["key", "tag", "doc_id", "text", "spans"]
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    match = lambda rows: _matches(rows, benchmark, window, max_item_words)
    found = match(docs.select(*_identity(docs, id_col, text_col))).filter(F.size("spans") > 0).dropDuplicates(["key", "tag"])
    found = cut(found.select(*columns, (hit > max_coverage * F.greatest("n_words", F.lit(1))).alias("gone")))
    done = found.filter("gone").select("key", "tag", "gone", F.lit(None).cast("string").alias("clean"))
    waits = found.filter("NOT gone").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(x["lo"], x["hi"]) for x in v] for v in batch.column(4).to_pylist()]
            texts = [_without(t, s) for t, s in zip(batch.column(3).to_pylist(), spans)]
            yield pa.record_batch([*batch.columns[:3], pa.array(texts, pa.string())], names=columns[:4])

    while not waits.isEmpty():
        changed = cut(match(waits.mapInArrow(run, "key long, tag long, doc_id long, text string")).select(*columns))
        done = done.union(changed.filter(F.size("spans") == 0).select("key", "tag", F.lit(False), "text"))
        waits = changed.filter(F.size("spans") > 0)
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("document"), *_identity(docs, id_col, text_col)[:2])
    joined = held.join(done, ["key", "tag"], "left").filter("gone IS NULL OR NOT gone")
    clean = F.when(F.col("gone").isNotNull(), F.col("clean").cast(docs.schema[text_col].dataType)).otherwise(F.col("document")[text_col])
    return joined.select(*((clean if c == text_col else F.col("document")[c]).alias(c) for c in docs.columns))


def _remove_in_one_pass(docs: DataFrame, sent: Broadcast, text_col: str, max_coverage: float) -> DataFrame:
    at = docs.columns.index(text_col)

    def clean(text: str, spans: list[tuple[int, int]], automata: list) -> str:
        while spans:
            text = _without(text, spans)
            spans = match_batch(pa.array([text]), automata)[0][1]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(sent)
        for batch in batches:
            rows = match_batch(batch.column(at), automata)
            hit = np.array([sum(y - x for x, y in r[1]) for r in rows])
            words = np.array([r[0] for r in rows])
            if hit.any():
                texts = batch.column(at).to_pylist()
                texts = [clean(t, r[1], automata) if r[1] else t for t, r in zip(texts, rows)]
                arrays = list(batch.columns)
                arrays[at] = pa.array(texts, batch.column(at).type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
                batch = batch.filter(pa.array(hit <= max_coverage * np.maximum(words, 1)))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
