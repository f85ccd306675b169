"""Exact token ids of whole texts from the tokenizers library, with the ids of white-space-free pieces kept per worker.

Neither tokenizer here merges across the piece boundaries used, so the ids of a text are those of its pieces in a
row. Texts are cut, and equal pieces found, by Arrow's kernels; ids are put together by NumPy. Texts for which the
boundaries might not hold (special-token strings, unusual separators) are encoded whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept in a worker process; further ones are encoded anew for each slice, which costs time and changes no result.
CACHE_PIECES = 400_000
#: Bytes of text that are worked on at once (one longer text is a slice of its own).
SLICE = 6_000_000
#: Python and Arrow count these as white space, the library doesn't.
ODD = "\x1c\x1d\x1e\x1f"
#: A stop or comma at a word's end that doesn't follow a letter or digit: it belongs to a run of punctuation.
PUNCTUATED = re.compile(r"[.,](?=\s|$)(?<![^\W_].)", re.S)
ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
BYTE_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space other than single blanks and line ends between other characters.
LOOSE = r"\s\s|[\t\r\x0b\x0c\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPECIAL = "<\\||[\x1c-\x1f]"
#: A run of ASCII signs behind a Latin-1 letter or digit: no letter takes any of it, whatever the normal form.
SIGN = "[!-/:-@\\[-`{-~]$"
SIGNS = "([0-9A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff])([!-/:-@\\[-`{-~]+)$"
#: Letters whose small or composed form ends in a mark, which the library takes together with a stop behind it.
MARKED = "\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb4e"
#: A word of Latin-1 letters alone.
PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
CUT = "\x1d"


class PieceCache:
    """piece -> value, filled by encode_many for the missing pieces of a batch."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable], limit: int = CACHE_PIECES):
        self.encode_many, self.limit, self.kept = encode_many, limit, {}

    def ready(self, pieces: list[str]) -> dict:
        missing = set(pieces).difference(self.kept)
        if missing:
            if len(self.kept) + len(missing) > self.limit:
                self.kept = {}
                missing = set(pieces)
            todo = list(missing)
            self.kept.update(zip(todo, self.encode_many(todo), strict=True))
        return self.kept


def odd(text: str) -> bool:
    return any(c in text for c in ODD)


def latin(text: str) -> bool:
    """Whether lower case is a matter of each letter alone, and white space is known."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def word_pieces(text: str) -> list[str]:
    """For lower-casing tokenizers that drop white space: words, and stops and commas at their ends by themselves."""
    if odd(text):
        return [x for x in ASCII_SPACE.split(text) if x]
    if not latin(text) or "<|" in text:
        return text.split()
    text = text.lower()
    if not PUNCTUATED.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
    return text.split()


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool (starts, sizes) numbered by `at`, laid end to end, and the size of each."""
    sizes = sizes[at]
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return pool[:0], sizes
    kind = np.int32 if max(len(pool), ends[-1]) < 1 << 31 else np.int64
    return pool[np.repeat((starts[at] - (ends - sizes)).astype(kind), sizes) + np.arange(ends[-1], dtype=kind)], sizes


class Encoder:
    """ids of whole texts: little-endian unsigned 32-bit, all texts' ids in a row and how many each has."""

    #: Pieces that go through the library in one string, told apart by the file's special token; such strings in a call.
    GROUP, CALL = 200, 50

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.words = any(t.endswith("</w>") for t in vocab)
        self.mark = "<|endoftext|>" if "<|endoftext|>" in vocab else None
        self.mark_id = vocab.get(self.mark, -1)
        self.final = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.extra: list[str] = []
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library(self, pieces: list[str]) -> list[np.ndarray]:
        """Pieces without special-token strings, many to a call. Plain words are told apart by the ids that end a word, which
        is faster than a mark between them."""
        plain = [self.words and PLAIN.fullmatch(p) is not None for p in pieces]
        if not any(plain):
            return self._joined(pieces, self.mark)
        words = iter(self._joined([p for p, x in zip(pieces, plain, strict=True) if x], None))
        others = iter(self._joined([p for p, x in zip(pieces, plain, strict=True) if not x], self.mark))
        return [next(words if x else others) for x in plain]

    def _joined(self, pieces: list[str], mark: str | None) -> list[np.ndarray]:
        """Ids of each piece, of groups with the mark between pieces; without one: of words with a blank, or of pieces alone."""
        out: list[np.ndarray] = []
        size = self.GROUP if mark or self.words else 1
        groups = [pieces[i : i + size] for i in range(0, len(pieces), size)]
        for i in range(0, len(groups), self.CALL):
            some = groups[i : i + self.CALL]
            for g, e in zip(some, self.tok.encode_batch_fast([(mark or " ").join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                if mark:
                    at = np.flatnonzero(ids == self.mark_id)
                    starts, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]
                elif self.words:
                    ends = (np.flatnonzero(self.final[ids]) + 1).tolist()
                    starts = [0, *ends[:-1]]
                else:
                    starts, ends = [0], [len(ids)]
                if len(ends) != len(g):
                    raise RuntimeError("pieces of a group can't be told apart")
                out += [ids[a:z] for a, z in zip(starts, ends, strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Add the ids of unknown pieces."""
        made = self._library(pieces)
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        ends = len(self.pool) + np.cumsum(sizes)
        self.place.update(zip(pieces, range(len(self.starts), len(self.starts) + len(made)), strict=True))
        self.starts, self.sizes = np.concatenate([self.starts, ends - sizes]), np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, *made])

    def _places(self, words: list[str]) -> np.ndarray:
        """Where each of the distinct words is kept, until the next call.

        Pieces beyond the limit are forgotten then: frequent pieces come early, so those that are kept are worth more than
        a new start, unless most of the words are unknown.
        """
        for w in self.extra:
            del self.place[w]
        n = len(self.place)
        if self.extra:
            self.starts, self.sizes, self.pool, self.extra = self.starts[:n], self.sizes[:n], self.pool[: self.starts[n]], []
        k = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if missing := int((k < 0).sum()):
            if n + missing > self.limit and 2 * missing > len(words):
                self._clear()
                k[:] = -1
            new = [words[i] for i in np.flatnonzero(k < 0).tolist()]
            self.extra = new[max(0, self.limit - len(self.place)) :]
            self._learn(new)
            k = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return k

    def _cut(self, col: pa.Array) -> pa.Array:
        """A list of pieces for each regular text."""
        if self.words:  # lower case here just makes fewer pieces; beyond Latin-1 it is left to the library
            wide = pc.match_substring_regex(col, "[^\x00-\xff]")
            return pc.utf8_split_whitespace(pc.if_else(wide, col, pc.utf8_lower(col)))
        loose = pc.match_substring_regex(col, LOOSE)
        marked = pc.replace_substring(pc.replace_substring(col, " ", CUT + " "), "\n", CUT + "\n" + CUT)
        if pc.any(loose).as_py():
            own = [CUT.join(BYTE_PIECE.findall(t)) if x else None for t, x in zip(col.to_pylist(), loose.to_pylist(), strict=True)]
            marked = pc.coalesce(pa.array(own, col.type), marked)
        return pc.split_pattern(marked, CUT)

    def flat(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each text's ids) of a string array; null: empty."""
        col = pc.fill_null(col, "")
        special = pc.match_substring_regex(col, SPECIAL)
        lists = self._cut(pc.if_else(special, "", col))
        found = lists.flatten().dictionary_encode()
        words = found.dictionary
        # Signs behind a letter or digit are a piece of their own, so that words are kept without them.
        ended = pc.match_substring_regex(words, SIGN)
        some = words.filter(ended)
        signed = pc.match_substring_regex(some, SIGNS)
        stopped = pc.and_(pc.match_substring_regex(some, r"[\p{L}\p{N}][.,]$"), pc.invert(pc.match_substring_regex(some, f"[{MARKED}][.,]$")))
        stems = pc.if_else(signed, pc.replace_substring_regex(some, SIGNS, r"\1"), pc.if_else(stopped, pc.utf8_slice_codeunits(some, 0, -1), some))
        tails = pc.if_else(signed, pc.replace_substring_regex(some, f"(?s)^.*{SIGNS}", r"\2"), pc.if_else(stopped, pc.utf8_slice_codeunits(some, -1), ""))
        stems, tails = pc.replace_with_mask(words, ended, stems), pc.replace_with_mask(pa.repeat(pa.scalar("", words.type), len(words)), ended, tails)
        both = pa.concat_arrays([stems, tails]).dictionary_encode()
        k = self._places(both.dictionary.to_pylist())
        pairs = both.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()
        pool, n = gather(self.pool, self.starts[k], self.sizes[k], pairs)
        n = n.reshape(-1, 2).sum(axis=1)
        ids, sizes = gather(pool, np.cumsum(n) - n, n, found.indices.to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        n = np.diff(bounds)
        if pc.any(special).as_py():  # texts encoded whole take the place of their empty stand-ins
            parts = np.split(ids, bounds[1:-1])
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
                parts[i] = np.array(self.tok.encode_batch_fast([col[i].as_py()], add_special_tokens=False)[0].ids, np.uint32)
            ids, n = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, n

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes."""
        ids, n = self.flat(pa.array(texts, pa.large_string()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]


_SOLE: dict[tuple, object] = {}


def let_go() -> None:
    """Give back to the system what this worker process has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker, idle through later stages, holds no freed memory."""

    def whole(batches):
        yield from run(batches)
        let_go()

    return whole


def sole(key: tuple, make: Callable[[], object]):
    """The one large object that a worker process keeps from task to task; another one's key lets the last one go."""
    if key not in _SOLE:
        if _SOLE:
            _SOLE.clear()
            gc.collect()
            let_go()
        _SOLE[key] = make()
    return _SOLE[key]


def encoder(path: str, limit: int = CACHE_PIECES) -> Encoder:
    """One for each worker process and vocabulary file, so that pieces stay known from task to task."""
    return sole(("encoder", path, limit), lambda: Encoder(path, limit))


def text_slices(col: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of rows in turn, each of some `most` bytes of text: bounds a worker's memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def in_slices(ids: list, texts: list, chars: int = 2_000_000) -> Iterable[tuple[list, list]]:
    """Rows of a batch in slices of about so many characters: bounds a worker's memory."""
    a, b, n = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        a.append(i)
        b.append(t or "")
        n += len(b[-1])
        if n >= chars:
            yield a, b
            a, b, n = [], [], 0
    if a:
        yield a, b
