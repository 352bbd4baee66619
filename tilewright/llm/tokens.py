"""Token ids of whole texts by a public byte-level tokenizer, each distinct pre-token encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Characters on which the standard library's classes agree with the tokenizer's own splitting
# pattern; a text with any other character is encoded by the library as a whole.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")
_PRETOKENS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Texts whose words cannot be taken one by one: white space next to white space or at an end, or of a rare kind.
_ODD_SPACE = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_TEXT_AT_ONCE = 1 << 20  # characters; arrays of 8 bytes for each word and id are some eight


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's ``encode(add_special_tokens=False)``.

    Byte-level BPE works inside pre-tokens, and a single space always begins one. So a text is split
    at its spaces and line ends, every distinct word goes to the tokenizer once, and the words' ids are
    put together by numpy. Texts with odd white space are split by the tokenizer's own pattern instead,
    and texts with special tokens or rare characters there are encoded whole. ``most`` bounds the
    remembered words but for those of one batch; when full, those stay that came again.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_pretoken = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        )
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_pattern = "|".join(re.escape(t) for t in self.special)
        self.most, self.known = most, {}
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.pool, self.begin, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.again = np.empty(0, bool)

    def _thin(self) -> None:
        """Forget the words that came in one batch only, and all if that leaves too many."""
        keep = np.flatnonzero(self.again)
        if len(keep) > self.most // 2:
            return self._forget()
        size = self.size[keep]
        ends = np.cumsum(size)
        self.pool = self.pool[np.repeat(self.begin[keep] - (ends - size), size) + np.arange(size.sum())]
        self.words, self.begin, self.size = self.words.take(pa.array(keep)), ends - size, size
        self.again = np.zeros(len(keep), bool)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, words: list[str]) -> None:
        """Remember the ids of new pre-tokens. Words of a space and letters split again where they are joined,
        so they are encoded as one text and the ids dealt out by their bytes."""
        plain = [w for w in words if w[0] == " " and w[-1].isalpha()]
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            raw = self._whole(["".join(part)])[0]
            ends = np.cumsum(self.n_bytes[np.frombuffer(raw, "<u4")])
            want = np.cumsum([len(w.encode()) for w in part])
            cut = np.searchsorted(ends, want)
            if not np.array_equal(ends[cut], want):
                self.known.update(zip(part, self._whole(part)))
                continue
            start = 0
            for w, end in zip(part, (4 * (cut + 1)).tolist()):
                self.known[w] = raw[start:end]
                start = end
        rest = [w for w in words if w not in self.known]
        for at in range(0, len(rest), 50_000):
            part = rest[at : at + 50_000]
            self.known.update(zip(part, self._whole(part)))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """One bytes object for each text (null: empty), in order, a bounded amount of text at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < _TEXT_AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            yield from self._batch([t or "" for t in texts[at:end]])
            at = end

    def _batch(self, texts: list[str]) -> list[bytes]:
        try:
            strings = pa.array(texts, pa.string())
        except UnicodeEncodeError:  # half of a surrogate pair
            return self._some(texts)
        pattern = _ODD_SPACE + (f"|{self.special_pattern}" if self.special else "")
        odd = np.asarray(pc.or_(pc.match_substring_regex(strings, pattern), pc.equal(strings, ""))) | (not self.by_pretoken)
        out: list[bytes] = [b""] * len(texts)
        slow = [i for i in np.flatnonzero(odd) if texts[i]]
        for i in range(0, len(slow), 256):
            for k, raw in zip(slow[i : i + 256], self._some([texts[k] for k in slow[i : i + 256]])):
                out[k] = raw
        plain = np.flatnonzero(~odd)
        if len(plain):
            for i, raw in zip(plain, self._by_words(strings.take(pa.array(plain)))):
                out[i] = raw
        return out

    def _by_words(self, strings: pa.Array) -> list[bytes]:
        # Each line begins a word that has no space before it; the first one's line end is taken off again.
        lines = pc.replace_substring(pc.binary_join_element_wise("\n", strings, ""), "\n", " \n")
        words = pc.split_pattern(pc.utf8_slice_codeunits(lines, 1), " ")
        flat = words.values.dictionary_encode()
        places = self._places(flat.dictionary)[np.asarray(flat.indices)]
        size, begin = self.size[places], self.begin[places]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        stops = ends[np.asarray(words.offsets)[1:] - 1]
        starts = np.concatenate([[0], stops[:-1]]) + 1
        return [ids[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each word's ids lie in the pool; new words are encoded as one text and dealt out by their bytes."""
        if len(self.words) > self.most:
            self._thin()
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.again[place[place >= 0]] = True
        at_new = np.flatnonzero(place < 0)
        if not len(at_new):
            return place
        new = words.take(pa.array(at_new))
        line = np.asarray(pc.starts_with(new, "\n"))
        spelled = pc.if_else(pa.array(line), new, pc.binary_join_element_wise(" ", new, ""))
        want = np.asarray(pc.binary_length(spelled)).astype(np.int64)
        sizes, raws = [], []
        for at in range(0, len(new), 2000):
            part = spelled.slice(at, 2000).to_pylist()
            raw = np.frombuffer(self._whole(["".join(part)])[0], "<u4")
            ends, stops = np.cumsum(self.n_bytes[raw]), np.cumsum(want[at : at + 2000])
            cut = np.searchsorted(ends, stops)
            if cut[-1] >= len(ends) or not np.array_equal(ends[cut], stops):
                each = [np.frombuffer(r, "<u4") for r in self._whole(part)]
                raw, cut = np.concatenate(each), np.cumsum([len(e) for e in each]) - 1
            raws.append(raw)
            sizes.append(np.diff(cut + 1, prepend=0))
        size, held = np.concatenate(sizes), len(self.pool)
        place[at_new] = len(self.words) + np.arange(len(new))
        self.pool = np.concatenate([self.pool, *raws])
        self.begin = np.concatenate([self.begin, held + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        self.words = pa.concat_arrays([self.words, new])
        return place

    def _some(self, texts: list[str]) -> list[bytes]:
        plain = [
            self.by_pretoken and not _OTHER.search(t) and not any(s in t for s in self.special) for t in texts
        ]
        split = [_PRETOKENS.findall(t) if p else () for t, p in zip(texts, plain)]
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        self._pretokens(list(set().union(*split).difference(known)))
        return [b"".join([known[w] for w in s]) if p else self._whole([t])[0] for t, s, p in zip(texts, split, plain)]


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
