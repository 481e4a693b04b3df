"""Token ids of whole texts with a public tokenizer, a distinct part of a word at a time."""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from stratasize.llm.common import Words

DEFAULT_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: How that tokenizer splits words into parts (a fixed value): contractions, letters, single numbers, and all other runs.
PARTS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points below this one have the same classes in every edition of Unicode that a tokenizer may carry.
SETTLED = 0x500
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: Bytes of texts that are encoded at once.
SLICE = 2 << 20
#: Parts in one text for the library's model.
PARTS = 200


class _Lists:
    """Id lists by number, in one array."""

    def __init__(self, dtype: np.dtype):
        self.offset, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)

    def add(self, size: np.ndarray, flat: np.ndarray) -> None:
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.offset = np.cumsum(self.size) - self.size

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size of each list, all ids) of the lists with the numbers given."""
        size = self.size[numbers]
        before = np.cumsum(size) - size
        return size, self.flat[np.repeat(self.offset[numbers] - before, size) + np.arange(int(size.sum()))]


class WordEncoder:
    """Encodes texts with a tokenizer that never joins across ASCII white space, such as the default one.

    Where the tokenizer has the default's normaliser and split, words of settled characters are lower-cased and cut into
    parts here, a slice at a time in arrays; each distinct part goes through the library's model once, and ids of
    documents are put together from those of their parts. All other words go through the whole tokenizer, each distinct
    one once. Up to most_parts parts of most_bytes in all are remembered for later slices, and forgotten together.
    """

    def __init__(self, path: str, end_id: int, most_parts: int = 300_000, most_bytes: int = 4 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.end_id, self.most_parts, self.most_bytes, self.whole = path, end_id, most_parts, most_bytes, None
        model = Tokenizer.from_file(path)
        vocabulary = model.get_vocab()
        self.dtype = np.dtype("<u2" if max(*vocabulary.values(), end_id) < 1 << 16 else "<u4")
        said = json.loads(model.to_str())
        self.special = [x["content"].encode() for x in said["added_tokens"]]
        split, *rest = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        suffix = said["model"].get("end_of_word_suffix")
        self.splits = suffix and steps == ["NFC", "Replace", "Lowercase"] and split.get("invert") and split.get("pattern") == {"Regex": PARTS_PATTERN} and [x["type"] for x in rest] == ["ByteLevel"]
        if self.splits:
            self.kind, self.lower = _tables(model.normalizer.normalize_str)
            self.ascii_kind, self.ascii_lower = (np.append(t[:128].astype(np.uint8), np.full(128, ODD, np.uint8)).tobytes() for t in (self.kind, self.lower))
            model.normalizer = normalizers.Sequence([])
            spaces = pre_tokenizers.WhitespaceSplit()
            # The byte level leaves printable ASCII as it is.
            self.model, self.cuts = model, (pre_tokenizers.Sequence([spaces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]), spaces)
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.lists, self.bytes = _Lists(self.dtype), 0

    def _numbers(self, parts: list[bytes], odd: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct parts, and of distinct odd words (known with a space before them), are in lists."""
        if len(self.known) > self.most_parts or self.bytes > self.most_bytes:
            self._forget()
        return self._found(parts, self._of_parts), self._found([b" " + w for w in odd], self._of_words)

    def _found(self, some: list[bytes], learn: Callable) -> np.ndarray:
        out = np.fromiter(map(self.known.get, some, itertools.repeat(-1)), np.int64, len(some))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            plain = np.fromiter((some[i].isascii() for i in missing.tolist()), bool, len(missing))
            missing = missing[np.argsort(plain, kind="stable")]
            new = [some[i] for i in missing.tolist()]
            size, flat = learn(new, len(new) - int(plain.sum()))
            out[missing] = numbers = np.arange(len(self.lists.size), len(self.lists.size) + len(new))
            self.known.update(zip(new, numbers.tolist(), strict=True))
            self.lists.add(size, flat)
            self.bytes += sum(map(len, new))
        return out

    def _of_parts(self, parts: list[bytes], middle: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each part, all ids); parts from the middle on are ASCII."""
        ids = []
        for some, self.model.pre_tokenizer in zip((parts[:middle], parts[middle:]), self.cuts, strict=True):
            texts = [b" ".join(some[i : i + PARTS]).decode() for i in range(0, len(some), PARTS)]
            ids += [np.array(e.ids, np.int64) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            raise ValueError("the tokenizer doesn't end each part with a suffixed id")
        return np.diff(ends, prepend=0), ids

    def _of_words(self, words: list[bytes], middle: int) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        found = [e.ids for e in self.whole.encode_batch([w[1:].decode() for w in words], add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((i for ids in found for i in ids), np.int64)

    def _kinds(self, codes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The kind of each byte's character, and the bytes of the lower-case text, which has the same length."""
        kind, low = (np.frombuffer(bytearray(data.translate(t)), np.uint8) for t in (self.ascii_kind, self.ascii_lower))
        if not data.isascii():
            lead = np.flatnonzero((codes >= 0xC2) & (codes < 0xE0))
            point = np.minimum((codes[lead].astype(np.int64) & 0x1F) << 6 | codes[lead + 1] & 0x3F, SETTLED)
            kind[lead] = kind[lead + 1] = self.kind[point]
            low[lead], low[lead + 1] = 0xC0 | self.lower[point] >> 6, 0x80 | self.lower[point] & 0x3F
        return kind, low

    def _odd_words(self, words: Words, data: bytes, kind: np.ndarray, spaces: np.ndarray) -> np.ndarray:
        """Indices of the words that aren't cut into parts here."""
        odd = [np.searchsorted(spaces, np.flatnonzero(kind == ODD))]
        for mark in self.special:
            at = data.find(mark)
            while at >= 0:
                odd.append(np.searchsorted(words.start, [at], side="right") - 1)
                at = data.find(mark, at + 1)
        return np.unique(np.concatenate(odd))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each with the end id; number of ids of each). A null text has the end id only."""
        words = Words(texts)
        n_docs = len(words.first) - 1
        if not len(words.start):
            return np.full(n_docs, self.end_id, self.dtype), np.ones(n_docs, np.int64)
        data = words.data.tobytes()
        spaces = np.append(-1, words.start + words.length)  # one before and after each word
        kind, low = self._kinds(words.data, data) if self.splits else (np.full(len(data), ODD, np.uint8), words.data)
        odd = self._odd_words(words, data, kind, spaces[1:])
        for a, b in zip(spaces[odd].tolist(), spaces[odd + 1].tolist(), strict=True):
            kind[a + 1 : b] = SPACE
        begin = _begins(kind, low)
        inside = kind != SPACE
        place = np.cumsum(inside)[begin] - 1
        buffer, bounds = low[inside], np.append(place, np.count_nonzero(inside))
        parts = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(buffer)]).dictionary_encode()
        whole = pa.array([data[a:b] for a, b in zip(words.start[odd].tolist(), words.end(odd).tolist(), strict=True)], pa.large_binary()).dictionary_encode()
        of_parts, of_words = self._numbers(_values(parts.dictionary), _values(whole.dictionary))
        number = of_parts[parts.indices.to_numpy()]
        word = begin - place  # as many spaces are before it
        if len(odd):
            word = np.searchsorted(spaces[1:], begin)
            order = np.argsort(np.concatenate([word, odd]), kind="stable")
            number = np.concatenate([number, of_words[whole.indices.to_numpy()]])[order]
            word = np.concatenate([word, odd])[order]
        size, flat = self.lists.joined(number)
        sums = np.concatenate(([0], np.cumsum(size)))
        per_doc = np.diff(sums[np.searchsorted(word, words.first)]) + 1
        out = np.empty(len(flat) + n_docs, dtype=self.dtype)
        ends = np.cumsum(per_doc) - 1
        inner = np.ones(len(out), dtype=bool)
        inner[ends] = False
        out[ends] = self.end_id
        out[inner] = flat
        return out, per_doc


def _values(values: pa.Array) -> list[bytes]:
    """All values of a large binary array."""
    bounds, data = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1].tolist(), (values.buffers()[2] or b"")
    data = data.to_pybytes() if len(data) else b""
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def _tables(normalised) -> tuple[np.ndarray, np.ndarray]:
    """By code point: its kind, and the lower-case one. Odd: what the normaliser joins with others, or isn't one settled
    character of as many bytes after it; white space besides the ASCII one; control characters; everything from SETTLED on."""
    kind, lower = np.full(SETTLED + 1, ODD, np.uint8), np.arange(SETTLED + 1, dtype=np.uint16)
    kind[0x20] = SPACE
    for code in range(0x21, SETTLED):
        own = chr(code)
        new = normalised(own)
        if len(new) == 1 and ord(new) < SETTLED and (ord(new) < 0x80) == (code < 0x80) and not own.isspace() and unicodedata.category(own) not in ("Cc", "Cn", "Mn", "Me", "Mc"):
            lower[code] = ord(new)
            kind[code] = LETTER if regex.match(r"\p{L}", new) else NUMBER if regex.match(r"\p{N}", new) else OTHER
    return kind, lower


def _begins(kind: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where parts begin: at a change of kind and at each number; a contraction is a part and ends after its letters."""
    new = np.empty(len(kind), dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= (kind == NUMBER) & ((low & 0xC0) != 0x80)
    new &= kind != SPACE
    mark = np.flatnonzero((low == 0x27) & new)
    if len(mark):
        after = np.concatenate([low[min(int(mark[0]), len(low)) :], [0, 0, 0]])
        base = int(mark[0])
        one, two, three = (after[mark - base + k] for k in (1, 2, 3))
        for ending in ENDINGS:
            hit = (one == ord(ending[0])) & (kind[np.minimum(mark + 1, len(kind) - 1)] == LETTER)
            if len(ending) == 2:
                hit &= two == ord(ending[1])
            ends = mark[hit] + 1 + len(ending)
            new[mark[hit] + 1] = False
            ends = ends[ends < len(kind)]
            new[ends] |= kind[ends] != SPACE
    return np.flatnonzero(new)


@functools.lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder for a Python worker, whose memory of parts serves its later tasks."""
    return WordEncoder(path, end_id)
