"""Token ids of whole texts with a public tokenizer (never trained here), for use inside tasks."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

# The pre-token pattern of the byte-level vocabularies,
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# whose classes are short ranges for the characters of Latin texts.
LETTERS = ["AZ", "az", "ªª", "µµ", "ºº", "ÀÖ", "Øö", "øɏ"]
SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")
#: A character for which that does not hold (other letters, spaces, digits and marks).
NOT_LATIN = "[^\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞₠-₿]"
#: Where a pre-token begins in any script: a single space between two characters that are none.
SAFE_CUT = r"(?<=\S) (?=\S)"
#: Words whose ids a worker keeps, bytes of these words, and characters that are encoded at a time.
KEPT, KEPT_BYTES, PORTION = 400_000, 16 << 20, 1 << 20
_OTHER, _LETTER, _DIGIT, _SPACE, _BLANK = range(5)


def byte_alphabet() -> dict[int, str]:
    """The character by which the vocabulary writes each byte of UTF-8, as the library maps it."""
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    points = [*range(0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)]
    return {b: c for p in points for b, c in zip(chr(p).encode(), level.pre_tokenize_str(chr(p))[0][0], strict=True)}


def _classes() -> np.ndarray:
    kind = np.full(0x251, _OTHER, dtype=np.uint8)
    for first, last in LETTERS:
        kind[ord(first):ord(last) + 1] = _LETTER
    kind[ord("0"):ord("9") + 1] = _DIGIT
    kind[[9, 10, 11, 12, 13]] = _BLANK
    kind[32] = _SPACE
    return kind


CLASSES = _classes()


def pre_tokens(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Does a pre-token begin at each character? ``codes`` are the characters of Latin texts one after
    the other, ``firsts`` marks each text's first character."""
    kind = CLASSES[np.minimum(codes, 0x250)]
    white = kind >= _SPACE
    before, after = np.empty_like(kind), np.empty_like(white)
    before[0], before[1:] = _BLANK, kind[:-1]
    after[-1], after[:-1] = True, white[1:] | firsts[1:]  # white space or the end of the text follows
    prior_white = before >= _SPACE
    # white space begins one after other characters, and alone before them; others where the kind changes
    starts = np.where(white, ~prior_white | ~after, (kind != before) & (before != _SPACE))
    starts |= firsts
    quotes = np.flatnonzero((codes == ord("'")) & starts & ((before != _SPACE) | firsts))
    if len(quotes):
        ends = np.append(np.flatnonzero(firsts)[1:], len(codes))
        limit = ends[np.searchsorted(ends, quotes, side="right")]
        padded = np.append(codes, [0, 0, 0])
        for suffix in SUFFIXES:
            size = len(suffix)
            hit = quotes + size < limit
            for i, c in enumerate(suffix):
                hit &= padded[quotes + 1 + i] == ord(c)
            at = quotes[hit]
            starts[at + 1] = False
            behind = at + size + 1
            starts[behind[behind < limit[hit]]] = True
    return starts


def first_characters(texts: list[str]) -> np.ndarray:
    """Of all characters of texts one after the other: is it the first of its text?"""
    out = np.zeros(sum(map(len, texts)) + 1, dtype=bool)
    out[np.cumsum([0, *map(len, texts)])] = True
    return out[:-1]


def words_at(joined: str, codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words that begin at the characters ``starts``, in UTF-8, without a copy each."""
    raw = joined.encode()
    if len(raw) != len(codes):
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        starts = (np.cumsum(width) - width)[starts]
    offsets = np.append(starts, len(raw)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def of_texts(texts: list[str], starts: np.ndarray, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The ids of all words, dealt to the texts in which the words begin."""
    ends = np.append(0, np.cumsum(size))[np.searchsorted(starts, np.cumsum([0, *map(len, texts)]))] * ids.itemsize
    packed = ids.tobytes()
    return [packed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class WordIds:
    """Ids of words (bytes), encoded when first met. When too many are kept, those met least since the last time are
    dropped."""

    def __init__(self):
        self._renew({}, array("I"), array("q", [0]))

    def _renew(self, slots: dict[bytes, int], flat: array, ends: array) -> None:
        self.slots, self.flat, self.ends = slots, flat, ends
        self.uses, self.bytes = np.zeros(len(slots), dtype=np.int64), sum(map(len, slots))

    def gather(self, words: pa.Array, encode: Callable[[list[bytes]], Iterable[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` one after the other, and how many each has; ``encode`` gives those of new words."""
        found = words.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = list(map(self.slots.get, distinct))
        new = [i for i, s in enumerate(slots) if s is None]
        for i, ids in zip(new, encode([distinct[i] for i in new]), strict=True):
            self.slots[distinct[i]] = slots[i] = len(self.slots)
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
            self.bytes += len(distinct[i])
        slots = np.array(slots, dtype=np.int64)
        index = found.indices.to_numpy()
        ends = np.array(self.ends)  # a copy: the array must be free to grow again
        start, size = ends[slots][index], (ends[slots + 1] - ends[slots])[index]
        total = np.cumsum(size)
        out = np.array(self.flat, dtype="<u4")[np.arange(int(size.sum())) + np.repeat(start - (total - size), size)]
        self._count(slots)
        return out, size

    def _count(self, slots: np.ndarray) -> None:
        self.uses = np.append(self.uses, np.zeros(len(self.slots) - len(self.uses), dtype=np.int64))
        self.uses[slots] += 1
        if len(self.slots) > KEPT or self.bytes > KEPT_BYTES:
            most = KEPT // 2
            least = np.partition(self.uses, -most)[-most] if len(self.uses) > most else 1
            keep = self.uses > max(1, least)
            kept, flat, ends = {}, array("I"), array("q", [0])
            for word, slot in self.slots.items():
                if keep[slot] and len(word) <= 64:
                    kept[word] = len(kept)
                    flat.extend(self.flat[self.ends[slot]:self.ends[slot + 1]])
                    ends.append(len(flat))
            self._renew(kept, flat, ends)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, without special tokens around them.

    A byte-level BPE merges inside pre-tokens only, so each distinct pre-token is encoded once, by the
    library's model, and its ids are kept. Latin texts are cut into pre-tokens as arrays; other texts
    at single spaces between words, which begin pre-tokens in any script, and their pieces are encoded
    by the library.

    A string of a special token in a text gives that token, as the library has it, or ordinary
    tokens with ``special_as_text``.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        self.not_latin, self.cut = re.compile(NOT_LATIN).search, re.compile(SAFE_CUT)
        self.model, self.alphabet = self.tokenizer.model.tokenize, byte_alphabet()
        self.space = self.alphabet[32]
        self.words = WordIds()

    def _of_word(self, word: bytes) -> list[int]:
        if word[:1] == b" " and word[1:].isalpha():
            return [t.id for t in self.model(self.space + word[1:].decode())]
        return [t.id for t in self.model(word.decode("latin-1").translate(self.alphabet))]

    def _latin(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        firsts = first_characters(texts)
        starts = np.flatnonzero(pre_tokens(codes, firsts))
        ids, size = self.words.gather(words_at(joined, codes, starts), lambda new: map(self._of_word, new))
        return of_texts(texts, starts, ids, size)

    def _other(self, text: str) -> bytes:
        cuts = [0, *[m.start() for m in self.cut.finditer(text)], len(text)]
        pieces = [text[a:b].encode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

        def encode(new: list[bytes]) -> Iterator[list[int]]:
            for i in range(0, len(new), 256):
                for e in self.tokenizer.encode_batch_fast([w.decode() for w in new[i:i + 256]], add_special_tokens=False):
                    yield e.ids

        return self.words.gather(pa.array(pieces, pa.large_binary()), encode)[0].tobytes()

    def _pieces(self, text: str) -> Iterator[str]:
        """A long text in pieces of about PORTION characters that begin pre-tokens."""
        start = 0
        while len(text) - start > PORTION:
            cut = self.cut.search(text, start + PORTION)
            if not cut:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def _whole(self, text: str) -> bytes:
        if self.special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(self._other(p) if self.not_latin(p) else self._latin([p])[0] for p in self._pieces(text))

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; a null text has none."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; short Latin texts are encoded together."""
        group: list[str] = []
        held = 0
        for text in texts:
            text = text or ""
            if len(text) > PORTION or self.not_latin(text) or self.special(text):
                yield from self._latin(group)
                group, held = [], 0
                yield self._whole(text)
                continue
            group.append(text)
            held += len(text)
            if held >= PORTION:
                yield from self._latin(group)
                group, held = [], 0
        yield from self._latin(group)


@functools.cache
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path, special_as_text)
