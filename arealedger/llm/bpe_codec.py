"""Byte-pair encoding with a heap of merge ranks over a linked symbol list, and decoding by vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PieceCache, in_slices, sole, word_pieces

#: Unicode white space, as the tokenizer files mean it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_letters() -> list[str]:
    """Byte -> printable letter: itself if printable in Latin-1, else the next letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Bpe:
    """A lower-casing word BPE read from a tokenizer file: pieces to ids, ids to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merge = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split.replace("\\s", SPACE))
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.cache = PieceCache(self._many)

    def merged(self, sym: list[int]) -> list[int]:
        """Merge sym in place, lowest rank first and leftmost among equals.

        The heap holds (rank, place, left, right, merged); an entry is stale once its place or its neighbour changed.
        """
        n = len(sym)
        if n < 2:
            return sym
        after, before, ranks = [*range(1, n), -1], [*range(-1, n - 1)], self.merge
        heap = []
        for i in range(n - 1):
            if (m := ranks.get((sym[i], sym[i + 1]))) is not None:
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := ranks.get((new, sym[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = before[i]
            if h >= 0 and (m := ranks.get((sym[h], new))) is not None:
                heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return [s for s in sym if s >= 0]

    def _word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return self.merged([self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]])

    def _plain(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # each letter by itself
        return [i for w in self.words.findall(text) for i in self._word(w)]

    def piece_ids(self, piece: str) -> list[int]:
        if "<|" not in piece:
            return self._plain(piece)
        out, at = [], 0
        for m in self.cut.finditer(piece):
            out += [*self._plain(piece[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._plain(piece[at:])

    def _many(self, pieces: list[str]) -> list[tuple[int, str, str]]:
        found = map(self.piece_ids, pieces)
        return [(len(x), " ".join(map(str, x)), " ".join(map(self.names.__getitem__, x))) for x in found]

    def ids(self, text: str) -> list[int]:
        return [i for p in word_pieces(text) for i in self.piece_ids(p)]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a space, as the library joins them where a file names no decoder."""
        return " ".join(self.names[i] for i in ids)


def codec(path: str) -> Bpe:
    return sole(("bpe", path), lambda: Bpe(path))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    A null or empty text has no ids. Null and repeated doc_ids (of bigint) keep a row each; other columns are not looked at; an empty
    table gives an empty one.
    """

    def run(batches):
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            for ids, texts in in_slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                split = [word_pieces(t) for t in texts]
                kept = c.cache.ready([p for x in split for p in x])
                rows = []
                for words in split:
                    found = [kept[p] for p in words]
                    rows.append((sum(x[0] for x in found), sha(" ".join([x[1] for x in found if x[0]])), sha(" ".join([x[2] for x in found if x[0]]))))
                n, a, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_encode(df: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """df with an array of token ids of each text; none for a null or empty one.

    Rows and other columns stay as they are; a column named `to` is replaced; an empty table stays empty.
    """
    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        c = codec(path)
        return s.map(lambda t: c.ids(t or ""))

    return df.withColumn(to, ids(text))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of each array of token ids; empty for a null or empty one.

    Rows and other columns stay as they are; a column named `to` is replaced; an empty table stays empty.
    """
    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        c = codec(path)
        return s.map(lambda x: c.decode(list(x)) if x is not None else "")

    return df.withColumn(to, text(ids))
