"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A text's pre-tokens are its words, each with the word mark before it. A task collects the
distinct words of a chunk of texts that it has not met, and walks their trie depth first
(that is, in sorted order): at each character the unigram forward score, the best total score of
pieces that end there, is found once for all words that share the prefix, and where a
word ends its number of pieces is kept. Texts then only add up the counts of
their words. The vocabulary is a broadcast of fixed size; nothing is shuffled.

A character without a piece scores as unknown and counts as its UTF-8 bytes (byte fallback).
Among equally good segmentations the one with the longer last piece wins.

Defined cases: a null text has no words and 0 tokens; repeated rows are counted alike;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

MARK = "▁"
#: Words whose counts a task remembers before it starts anew.
KNOWN = 3_000_000


@dataclass
class Vocabulary:
    scores: dict[str, float]
    longest: int
    unknown: float

    @classmethod
    def of_pieces(cls, scores: dict[str, float]) -> Vocabulary:
        return cls(scores, max(map(len, scores), default=1), min(scores.values(), default=0.0) - 10)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Pieces and scores of a SentencePiece model file; control, unknown and byte pieces excepted."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls.of_pieces({model.id_to_piece(i): model.get_score(i) for i in plain})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def trie_counts(words: list[str], vocabulary: Vocabulary) -> list[int]:
    """The number of pieces of each of the sorted distinct words."""
    scores, longest, unknown = vocabulary.scores.get, vocabulary.longest, vocabulary.unknown
    best, count = [0.0], [0]  # by depth, along the path from the root to the present node
    out, path = [], ""
    for word in words:
        word = MARK + word
        shared, top = 0, min(len(path), len(word))
        while shared < top and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            high, pieces = -np.inf, 0
            for start in range(max(0, end - longest), end):
                score = scores(word[start:end])
                if score is not None and best[start] + score > high:
                    high, pieces = best[start] + score, count[start] + 1
            if scores(word[end - 1]) is None and best[end - 1] + unknown > high:
                high, pieces = best[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode())
            best.append(high)
            count.append(pieces)
        out.append(count[-1])
        path = word
    return out


class _Counts:
    """Counts of the words met so far, by hash."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, found: W.Words) -> np.ndarray:
        """The number of tokens of each word of a chunk."""
        hashes, first, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes
        counts = np.zeros(len(hashes), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        raw = found.buf.tobytes()
        texts = sorted((raw[s:e].decode(), k) for s, e, k in zip(found.starts[first[new]].tolist(), found.ends[first[new]].tolist(), new.tolist(), strict=True))
        counts[[k for _, k in texts]] = trie_counts([t for t, _ in texts], self.vocabulary)
        if len(self.keys) + len(new) > KNOWN:
            self.keys, self.counts = hashes, counts
        elif len(new):
            keys = np.concatenate([self.keys, hashes[new]])
            order = np.argsort(keys)
            self.keys, self.counts = keys[order], np.concatenate([self.counts, counts[new]])[order]
        return counts[inverse]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of each row, by the vocabulary in the file at path."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Counts(shared.value)
        for batch in batches:
            words, tokens = [], []
            for i, j, found in W.word_chunks(batch.column(1), W.BY_SPACE, cased=True, size=1 << 23):
                words.append(np.diff(found.first))
                tokens.append(np.bincount(found.row, weights=known.of(found), minlength=j - i).astype(np.int64))
            if words:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(tokens), pa.int64())], ["id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_tokens long")
