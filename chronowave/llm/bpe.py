"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks every adjacent pair up by binary search over the
sorted pair keys, finds each word's lowest rank, and merges all pairs of that rank, leftmost first, in every word at once.
Words past ``LONG_WORD`` symbols use a heap over the same pair table instead: rounds over one huge word would be quadratic.

A text is cut at lone spaces between two non-spaces, where byte-level pre-tokenization always cuts, so pieces can be
encoded once and looked up again; texts with other white space around a cut go through the full pattern.

Defined results: null and empty texts encode to no ids; ids decode to exactly the bytes encoded; special token strings in
a text become their special id; equal texts give equal ids. Other columns pass through or are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_groups

#: The pre-tokenization pattern of the vocabulary files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 256
NONE = np.iinfo(np.int64).max


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in out.values():
            out[chr(256 + extra)] = b
            extra += 1
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, cache_pieces: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.base = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.pairs: dict[int, tuple[int, int]] = {}  # for huge words, made when the first one comes
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache_pieces, self.cache, self.first, self.token_ids = cache_pieces, {}, {}, {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.results[at]

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, all words together in rounds."""
        out: list[bytes | None] = [self._merge_long(w) if len(w) > LONG_WORD or not w else None for w in words]
        live = np.array([i for i, w in enumerate(out) if w is None], np.int64)
        if not len(live):
            return out
        lengths = np.array([len(words[i]) for i in live], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
        while len(live):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            word = np.repeat(np.arange(len(live)), lengths)
            rank = np.full(len(symbols), NONE)
            rank[:-1], merged = self._lookup(symbols[:-1], symbols[1:])
            merged = np.append(merged, 0)
            rank[starts + lengths - 1] = NONE  # the last symbol of a word has no right neighbour
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < NONE
            hit = (rank == lowest[word]) & going[word]
            # In a run of overlapping equal pairs every other one merges, from the left.
            at = np.flatnonzero(hit)
            if len(at):
                fresh = np.concatenate(([True], np.diff(at) != 1))
                begin = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
                at = at[(at - begin) % 2 == 0]
                symbols[at] = merged[at]
                keep = np.ones(len(symbols), bool)
                keep[at + 1] = False
                lengths = lengths - np.bincount(word[at], minlength=len(live))
                symbols, word = symbols[keep], word[keep]
            done = ~going
            if done.any():
                ids = symbols[done[word]].astype("<u4").tobytes()
                ends = (4 * np.cumsum(lengths[done])).tolist()
                for k, a, b in zip(live[done].tolist(), [0, *ends], ends):  # noqa: B905  the last end begins no word
                    out[k] = ids[a:b]
                symbols, live, lengths = symbols[going[word]], live[going], lengths[going]
        return out

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        if n < 2:
            return np.array(ids, "<u4").tobytes()
        rank, result = (x.tolist() for x in self._lookup(np.array(ids[:-1]), np.array(ids[1:])))
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.results.tolist(), strict=True), strict=True))
        heap = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(rank, result, strict=True)) if r < NONE]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] < n:
                    if found := self.pairs.get(ids[p] * self.base + ids[after[p]]):
                        heapq.heappush(heap, (found[0], p, ids[p], ids[after[p]], found[1]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _tokens(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; letters, with a lone mark at the end, need no pattern."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return [piece]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = [*map(self._tokens, pieces)]
        if len(self.token_ids) > self.cache_pieces:
            self.token_ids = {}
        ids = self.token_ids
        distinct = list({t for f in found for t in f} - ids.keys())
        ids.update(zip(distinct, self.merge_words([t.encode("utf-8", "surrogatepass") for t in distinct]), strict=True))
        return [ids[f[0]] if len(f) == 1 else b"".join([ids[t] for t in f]) for f in found]

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        if len(self.cache) + len(self.first) > self.cache_pieces:
            self.cache, self.first = {}, {}
        parts, owner = [], []
        for k, t in enumerate(texts):
            if self.split_special and any(s in t for s in self.special):
                for p in self.split_special.split(t):
                    parts.append(p)
                    owner.append(k)
            else:
                parts.append(t)
                owner.append(k)
        cut = [None if p in self.special else p.split(" ") for p in parts]
        heads = {c[0] for c in cut if c} - self.first.keys()
        tails = set().union(*[c[1:] for c in cut if c]) - self.cache.keys()
        bare = lambda c: bool(c) and not (c[0].isspace() or c[-1].isspace())
        for new, into, lead in ((heads, self.first, ""), (tails, self.cache, " ")):
            good = [c for c in new if bare(c)]
            into.update(dict.fromkeys(new))
            into.update(zip(good, self._encode_pieces([lead + c for c in good]), strict=True))
        out: list[list[bytes]] = [[] for _ in texts]
        plain, get = [], self.cache.__getitem__
        for k, p, c in zip(owner, parts, cut, strict=True):
            if c is None:
                out[k].append(struct.pack("<I", self.special[p]))
            elif p:
                try:
                    out[k].append(self.first[c[0]] + b"".join(map(get, c[1:])))
                except TypeError:  # white space around a cut
                    plain.append((k, len(out[k]), p))
                    out[k].append(b"")
        for (k, at, _), ids in zip(plain, self._encode_pieces([p for _, _, p in plain]), strict=True):
            out[k][at] = ids
        return [b"".join(x) for x in out]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_OPEN: dict[str, object] = {}


def open_bpe(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, one in each Python worker."""
    if path not in _OPEN:
        _OPEN[path] = ByteBpe(path)
    return _OPEN[path]


#: The characters that ``\\s`` means in the vocabulary's pattern. Runs of ``LONG_RUN`` are cut out of long texts.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 10_000
_RUN = regex.compile(f"[{WHITE}]{{{LONG_RUN},}}+")


def fast_ids(encoding, text: str | None) -> np.ndarray:
    """The ids of a text by an encoder of ``open_fast``, as little-endian unsigned 32-bit integers.

    The encoder's pattern runs out of stack in a huge run of white space. Pre-tokenization always cuts before such a run, and
    before its last character where something follows, so the rest of the run is one word, and is encoded as one.
    """
    text = text or ""
    if len(text) < LONG_RUN or not (runs := [*_RUN.finditer(text)]):
        return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")
    parts, at = [], 0
    for m in runs:
        end = m.end() if m.end() == len(text) else m.end() - 1
        parts += [encoding.encode_to_numpy(text[at : m.start()], allowed_special="all"), np.array(encoding._encode_single_piece(text[m.start() : end]))]
        at = end
    return np.concatenate([*parts, encoding.encode_to_numpy(text[at:], allowed_special="all")]).astype("<u4")


def open_fast(path: str):
    """A tiktoken encoder with the ids of the same vocabulary file, for operators that only need ids (see ``fast_ids``).

    tiktoken takes ids for ranks, so the file's merges must make rising ids.
    """
    import tiktoken

    key = f"fast:{path}"
    if key not in _OPEN:
        bpe = ByteBpe(path)
        made = np.empty_like(bpe.results)
        made[bpe.ranks] = bpe.results
        assert (np.diff(made) > 0).all(), "merge ranks and ids differ in order"
        ranks = {t: i for i, t in enumerate(bpe.token_bytes) if i not in bpe.special.values()}
        _OPEN[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=bpe.special)
    return _OPEN[key]


def encode_column(path: str) -> Column:
    """A pandas UDF from text to ids as little-endian unsigned 32-bit integers in one binary value."""
    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = open_bpe(path)
        for s in batches:
            texts, out = s.tolist(), []
            for a, b in text_groups(texts):
                out += bpe.encode_batch(texts[a:b])
            yield pd.Series(out, dtype=object)

    return encode


def decode_column(path: str) -> Column:
    """A pandas UDF from packed ids to text."""
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = open_bpe(path)
        for s in batches:
            yield s.map(lambda x: bpe.decode(np.frombuffer(x or b"", "<u4").tolist()))

    return decode


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()

    def run(batches):
        import pyarrow as pa

        bpe = open_bpe(path)
        names = list(map(str, range(len(bpe.token_bytes))))
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for a, b in text_groups(texts):
                for packed in bpe.encode_batch(texts[a:b]):
                    ids = np.frombuffer(packed, "<u4").tolist()
                    rows.append((len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
