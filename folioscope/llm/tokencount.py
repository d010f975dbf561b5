"""Token counts of a unigram segmentation, by dynamic programming over a trie of pre-tokens.

A pre-token is a run without ASCII white space, led by the word mark of the vocabulary.
The distinct pre-tokens of a batch are put into a trie (here: in sorted order, where the
path to a word is what it shares with the one before).  Along each trie edge the best
score of any segmentation of the prefix, and its number of pieces, are worked out from
the pieces that end there - once for all pre-tokens that share the prefix.  What stands
at a pre-token's terminal is its token count; documents add up the counts of theirs.

The vocabulary file lists its pieces by rank; piece log-probabilities follow the
Zipf-Mandelbrot law over ranks, p ~ 1 / (rank + 2.7), since the file holds ranks only.
A character that no piece holds falls back to its UTF-8 bytes, a token each, at a
penalty.  Of equally good segmentations the one with fewer pieces counts.

Scale: no shuffle.  Counts of pre-tokens are kept in a worker between batches in a
bounded table.  The vocabulary is read on the driver and broadcast; its size is checked.

Defined cases: null and empty texts have no tokens; repeated rows each give a row; a
pre-token of any length is worked off in memory in proportion to it; other columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"
BYTE_PENALTY = 10.0
MAX_PIECES = 2_000_000
#: Pre-tokens a worker remembers between batches.
REMEMBERED = 400_000


class UnigramVocabulary:
    """Pieces with log-probabilities; what a character without a piece costs."""

    def __init__(self, pieces: list[str]):
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"{len(pieces)} pieces; at most {MAX_PIECES} are broadcast")
        total = math.log(sum(1 / (r + 2.7) for r in range(1, len(pieces) + 1))) if pieces else 0.0
        self.score: dict[str, float] = {}
        for r, piece in enumerate(pieces, 1):
            self.score.setdefault(piece, -math.log(r + 2.7) - total)
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = -math.log(len(pieces) + 2.7) - total - BYTE_PENALTY
        #: Lengths of the pieces that end in a character, longest first: the only spans worth a look.
        by_last: dict[str, set[int]] = {}
        for piece in self.score:
            by_last.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(v) for c, v in by_last.items()}

    @classmethod
    def load(cls, path: str = VOCABULARY) -> UnigramVocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls([model.id_to_piece(i) for i in ids])


def trie_counts(words: list[str], vocabulary: UnigramVocabulary) -> dict[str, int]:
    """Token count of each distinct word; forward values of shared prefixes are computed once."""
    score, lengths, penalty = vocabulary.score, vocabulary.lengths, vocabulary.byte_score
    best, pieces, previous = [0.0], [0], ""
    out: dict[str, int] = {}
    for word in sorted(words):
        path = WORD_MARK + word
        depth, limit = 0, min(len(previous), len(path))
        while depth < limit and previous[depth] == path[depth]:
            depth += 1
        del best[depth + 1 :], pieces[depth + 1 :]
        for end in range(depth + 1, len(path) + 1):
            c = path[end - 1]
            n = len(c.encode("utf-8", "surrogatepass"))
            top, count = best[end - 1] + n * penalty, pieces[end - 1] + n
            for size in lengths.get(c, ()):
                if size > end:
                    break
                own = score.get(path[end - size : end])
                if own is not None:
                    s = best[end - size] + own
                    if s > top or s == top and pieces[end - size] + 1 < count:
                        top, count = s, pieces[end - size] + 1
            best.append(top)
            pieces.append(count)
        out[word] = pieces[-1]
        previous = path
    return out


def count_tokens(docs: DataFrame, vocabulary: UnigramVocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: its pre-tokens, its tokens and its code points."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            column = batch.column(1)
            words_of, tokens_of, chars_of = (np.zeros(len(column), np.int64) for _ in range(3))
            for lo in range(0, len(column), 256):
                texts = [(t or "") for t in column.slice(lo, 256).to_pylist()]
                # bytes.split() parts at ASCII white space only
                split = [t.encode().split() for t in texts]
                distinct = set().union(*split) if split else set()
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in distinct if w not in known]
                named = {w.decode(): w for w in new}
                for word, n in trie_counts(list(named), sent.value).items():
                    known[named[word]] = n
                for i, words in enumerate(split, lo):
                    words_of[i], chars_of[i] = len(words), len(texts[i - lo])
                    tokens_of[i] = sum(map(known.__getitem__, words))
            yield pa.record_batch([batch.column(0), pa.array(words_of), pa.array(tokens_of), pa.array(chars_of)], names=["doc_id", "n_pretokens", "n_tokens", "n_chars"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_chars long")
