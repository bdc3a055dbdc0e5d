"""Token counts by trie-shared dynamic programming over distinct pre-tokens.

A pre-token is a word of the text behind the word mark. The distinct pre-tokens of a batch are inserted in a trie; the
unigram forward score (best sum of piece scores up to a character) belongs to a trie node, so it is computed once per
shared prefix, level by level over all nodes of the level. The terminal node's piece count is the pre-token's token
count, and a text's count is the sum over its pre-tokens.

The vocabulary is a public one and only read: its pieces get Zipf scores by rank, ``-log(rank + 2.7)``. Characters no
piece covers fall back to one token per UTF-8 byte. Equal scores prefer fewer tokens, then the shorter last piece. Null
and empty texts, and texts of white space, have 0 tokens. Very long texts are counted whole, repeated rows one by one. Only
``doc_id`` and ``text`` are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxtable.llm.common import bounded, split_words

MARK = "▁"
BATCH_BYTES = 8 << 20
LONG = 192                     # longer pre-tokens are counted one by one, in constant memory
_MUL = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a SentencePiece file, most frequent first."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Counter:
    """Counts the tokens of pre-tokens with one vocabulary."""

    def __init__(self, pieces: list[str]):
        self.scores = {}
        for rank, piece in enumerate(pieces):
            self.scores.setdefault(piece, -float(np.log(rank + 2.7)))
        self.byte = min(self.scores.values(), default=-1.0) - 10.0
        self.longest = max(map(len, self.scores), default=1)
        tables = {}
        for piece, score in self.scores.items():
            tables.setdefault(len(piece), []).append((self._hash(piece), score))
        self.tables = {n: (np.array([h for h, _ in sorted(t)], np.uint64), np.array([s for _, s in sorted(t)]))
                       for n, t in tables.items()}

    @staticmethod
    def _hash(piece: str) -> int:
        """Sum of code point times a power of one odd number that falls to the right; the trie forms the same."""
        total, power = 0, 1
        for ch in reversed(piece):
            total = (total + (ord(ch) + 1) * power) % 2 ** 64
            power = power * int(_MUL) % 2 ** 64
        return total

    def one(self, word: str) -> int:
        """Forward recursion over a single pre-token; keeps the last positions only."""
        keep = self.longest + 1
        best, count = [0.0] * keep, [0] * keep
        for i in range(1, len(word) + 1):
            wide = len(word[i - 1].encode("utf-8", "surrogatepass"))
            top, n = best[(i - 1) % keep] + self.byte * wide, count[(i - 1) % keep] + wide
            for size in range(1, min(i, self.longest) + 1):
                s = self.scores.get(word[i - size:i])
                if s is not None:
                    j = (i - size) % keep
                    if (best[j] + s, -count[j] - 1) > (top, -n):
                        top, n = best[j] + s, count[j] + 1
            best[i % keep], count[i % keep] = top, n
        return count[len(word) % keep]

    def many(self, words: list[str]) -> np.ndarray:
        """Token counts of distinct pre-tokens (without mark)."""
        words = [MARK + w for w in words]
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self.one(words[i])
        rows = np.flatnonzero(sizes <= LONG)
        if not len(rows):
            return out
        size = sizes[rows]
        codes = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        node = np.zeros(len(rows), np.int64)               # trie node of each pre-token at the current level
        live = np.arange(len(rows))
        levels = [(np.zeros(1), np.zeros(1, np.int64), None, None)]     # score, count, parent, character
        for depth in range(1, int(size.max()) + 1):
            live = live[size[live] >= depth]
            char = codes[starts[live] + depth - 1].astype(np.int64)
            keys, inverse = np.unique(node[live] << 21 | char, return_inverse=True)
            node[live] = inverse
            parent, char = keys >> 21, (keys & 0x1FFFFF).astype(np.uint64)
            score, count = self._level(levels, depth, parent, char)
            levels.append((score, count, parent, char))
            if depth > self.longest:
                levels[depth - self.longest - 1] = None
            done = live[size[live] == depth]
            out[rows[done]] = count[node[done]]
        return out

    def _level(self, levels, depth, parent, char):
        """Best score and piece count of every node of a level, from its ancestors."""
        wide = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
        score = levels[depth - 1][0][parent] + self.byte * wide
        count = levels[depth - 1][1][parent] + wide
        up, hashed, power, letter = parent, np.zeros(len(parent), np.uint64), np.uint64(1), char
        for n in range(1, min(depth, self.longest) + 1):
            with np.errstate(over="ignore"):
                hashed = hashed + (letter + np.uint64(1)) * power
                power = power * _MUL
            if n in self.tables:
                known, scores = self.tables[n]
                at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashed)
                new = levels[depth - n][0][up[hit]] + scores[at[hit]]
                pieces = levels[depth - n][1][up[hit]] + 1
                better = (new > score[hit]) | ((new == score[hit]) & (pieces < count[hit]))
                score[hit[better]], count[hit[better]] = new[better], pieces[better]
            if n < depth and n < self.longest:
                letter = levels[depth - n][3][up]
                up = levels[depth - n][2][up]
        return score, count


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_pretokens, n_distinct`` of each whole text; no shuffle.

    ``vocabulary`` is read on the driver; the pieces (some 1 MB) go to the tasks with the function.
    """
    pieces = load_pieces(vocabulary or default_vocabulary())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces)
        for b in bounded(batches, "text", BATCH_BYTES):
            offsets, words = split_words(b.column("text"), lower=False)
            words = words.dictionary_encode()
            index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            per = counter.many(words.dictionary.to_pylist())
            total = np.concatenate([[0], np.cumsum(per[index])])
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            distinct = np.unique(row << 32 | index) >> 32
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(np.diff(offsets)),
                 pa.array(np.bincount(distinct, minlength=b.num_rows))],
                names=["doc_id", "n_tokens", "n_pretokens", "n_distinct"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_pretokens long, n_distinct long")
