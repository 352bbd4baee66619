"""Token counts under a unigram model, by dynamic programming shared along a trie.

Pre-tokens are the words of a text (split at white space) with the vocabulary's word mark in front.
The best segmentation of a prefix depends on nothing after it, so distinct pre-tokens go into a trie
and every node - a prefix that some pre-tokens share - gets its forward score and number of tokens
once. A node that ends a pre-token gives its count; a text's count is the sum over its words.

Tokenizers are not trained here and no public vocabulary at hand has unigram scores, so piece
probabilities follow Zipf's law over the vocabulary's order: the piece of rank r has probability
proportional to 1 / r. The counts are those of this model, not of the tokenizer the vocabulary is from.
Characters in no piece cost one byte piece for each UTF-8 byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, need

MARK = "▁"
_TEXT_AT_ONCE = 1 << 22
#: Words and padded characters scored at a time, the characters of a word scored on its own, bytes of words remembered.
_WORDS, _CELLS, _LONG, _REMEMBERED = 20_000, 1 << 21, 1000, 1 << 26


class Pieces:
    """Log-probabilities of a vocabulary's pieces in its order, and the pieces read backwards as a trie.

    The backward trie is a sorted array of (node, character) edges, so that many prefixes can look for
    the pieces they end in at once.
    """

    def __init__(self, pieces: list[str]):
        total = float(np.log((1 / np.arange(1, len(pieces) + 1)).sum())) if pieces else 0.0
        self.score = {p: -float(np.log(r)) - total for r, p in reversed(list(enumerate(pieces, 1)))}
        self.longest = max(map(len, pieces), default=1)
        self.byte = -float(np.log(max(1, len(pieces)))) - total
        edges: dict[int, int] = {}
        gain = [np.nan]
        for p, g in self.score.items():
            node = 0
            for c in reversed(p):
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key] = len(gain)
                    gain.append(np.nan)
                node = edges[key]
            gain[node] = g
        self.edges = np.array(sorted(edges), np.int64)
        self.below = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.gain = np.array(gain)

    @classmethod
    def of(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        return cls([model.id_to_piece(i) for i in range(model.vocab_size()) if not special(i)])

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes below by a character each, -1 for none."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
        return np.where(self.edges[at] == key, self.below[at], -1) if len(self.edges) else np.full(len(key), -1)


def trie_counts(words: list[str], pieces: Pieces) -> np.ndarray:
    """Tokens of the best segmentation of each word (with the mark in front); of equally good ones, the fewest tokens.

    Distinct words in order make a trie: a row shares the nodes of the row above as far as they are
    equal. Nodes are scored a depth at a time, each once, from the nodes above them.
    """
    out = np.zeros(len(words), np.int64)
    order = np.array(sorted(range(len(words)), key=lambda i: (len(words[i]) // 32, words[i])), np.int64)
    sizes = np.array([len(words[i]) for i in order], np.int64)
    top, at = np.maximum.accumulate(sizes), 0
    while at < len(order):  # words of like size together: rows are padded to the longest
        if sizes[at] > _LONG:
            out[order[at]] = _long_count(MARK + words[order[at]], pieces)
            at += 1
            continue
        width = top[at : at + _WORDS]
        fits = (width <= _LONG) & ((width + 1) * np.arange(1, len(width) + 1) <= _CELLS)
        part = order[at : at + max(1, int(fits.sum()))]
        at += len(part)
        part = np.array(sorted(part.tolist(), key=words.__getitem__), np.int64)
        out[part] = _counts([MARK + words[i] for i in part], pieces)
    return out


def _long_count(word: str, pieces: Pieces) -> int:
    """What ``_counts`` gives for one word, a character at a time with the last few scores only."""
    ring = pieces.longest + 1
    scores, tokens = [0.0] * ring, [0] * ring
    for end in range(1, len(word) + 1):
        c = word[end - 1]
        best, count = -np.inf, 0
        if c not in pieces.score:
            bytes_ = 1 + (c >= "\x80") + (c >= "\u0800") + (c >= "\U00010000")
            best, count = scores[(end - 1) % ring] + bytes_ * pieces.byte, tokens[(end - 1) % ring] + bytes_
        for back in range(1, min(end, pieces.longest) + 1):
            gain = pieces.score.get(word[end - back : end])
            if gain is not None:
                score, n = scores[(end - back) % ring] + gain, tokens[(end - back) % ring] + 1
                if score > best or (score == best and n < count):
                    best, count = score, n
        scores[end % ring], tokens[end % ring] = best, count
    return tokens[len(word) % ring]


def _counts(words: list[str], pieces: Pieces) -> np.ndarray:
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    width = int(size.max())
    rows = np.full((len(words), width), -1, np.int64)
    rows[np.arange(width) < size[:, None]] = flat
    fresh = np.ones((len(words), width), bool)
    np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1, out=fresh[1:])
    places = [np.zeros(len(words), np.int64)]  # by depth: the node of each row
    scores, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
    out = np.zeros(len(words), np.int64)
    for depth in range(1, width + 1):
        own = fresh[:, depth - 1] & (size >= depth)
        first = np.flatnonzero(own)
        places.append(np.cumsum(own) - 1)
        char = rows[first, depth - 1]
        bytes_ = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
        before = places[depth - 1][first]
        single = pieces.step(np.zeros(len(first), np.int64), char)
        unknown = (single < 0) | np.isnan(pieces.gain[np.maximum(single, 0)])
        best = np.where(unknown, scores[depth - 1][before] + bytes_ * pieces.byte, -np.inf)
        count = np.where(unknown, tokens[depth - 1][before] + bytes_, 0)
        live, node = np.arange(len(first)), np.zeros(len(first), np.int64)
        for back in range(1, min(depth, pieces.longest) + 1):
            node = pieces.step(node, rows[first[live], depth - back])
            live, node = live[node >= 0], node[node >= 0]
            if not len(live):
                break
            gain = pieces.gain[node]
            ends = np.flatnonzero(~np.isnan(gain))
            i = live[ends]
            above = places[depth - back][first[i]]
            score, n = scores[depth - back][above] + gain[ends], tokens[depth - back][above] + 1
            better = (score > best[i]) | ((score == best[i]) & (n < count[i]))
            best[i[better]], count[i[better]] = score[better], n[better]
        scores.append(best)
        tokens.append(count)
        done = np.flatnonzero(size == depth)
        out[done] = count[places[depth][done]]
    return out


class Counter:
    """Remembers the counts of up to ``most`` words and some megabytes; they are forgotten when full."""

    def __init__(self, pieces: Pieces, most: int = 1_000_000):
        self.pieces, self.most = pieces, most
        self.words, self.counts = pa.array([], pa.string()), np.empty(0, np.int64)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each whole text, a bounded amount of text at a time."""
        words, tokens, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < _TEXT_AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            split = [(t or "").split() for t in texts[at:end]]
            sizes = np.array([len(w) for w in split], np.int64)
            flat = pa.array([w for some in split for w in some], pa.string()).dictionary_encode()
            each = self._each(flat.dictionary)[np.asarray(flat.indices)] if len(flat) else np.empty(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(each)])
            stops = np.cumsum(sizes)
            words.append(sizes)
            tokens.append(sums[stops] - sums[stops - sizes])
            at = end
        return (np.concatenate(words), np.concatenate(tokens)) if words else (np.empty(0, np.int64),) * 2

    def _each(self, words: pa.Array) -> np.ndarray:
        if len(self.words) > self.most or self.words.nbytes > _REMEMBERED:
            self.words, self.counts = pa.array([], pa.string()), np.empty(0, np.int64)
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            some = words.take(pa.array(new))
            place[new] = len(self.words) + np.arange(len(new))
            self.counts = np.concatenate([self.counts, trie_counts(some.to_pylist(), self.pieces)])
            self.words = pa.concat_arrays([self.words, some])
        return self.counts[place]


def _counter(path: str) -> Counter:
    return held(("counter", path), lambda: Counter(Pieces.of(path)))


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every row. Null and empty texts have none; repeated rows stay."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(model)
        for s in batches:
            yield pd.DataFrame(dict(zip(("n_words", "n_tokens"), counter.texts(s.tolist()))))

    return need(docs, ["doc_id", "text"]).select("doc_id", counted("text").alias("c")).select("doc_id", "c.n_words", "c.n_tokens")
