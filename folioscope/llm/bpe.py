"""Byte pair encoding of many pre-tokens at once, on ragged numpy arrays.

All pre-tokens of a batch lie behind each other in one symbol array.  A round
looks up the rank of every neighbouring pair, takes the lowest rank of each
pre-token (``minimum.reduceat``), merges that pair wherever it stands in the
pre-token, and closes the gaps.  Pre-tokens without a known pair leave the
arrays, so later rounds touch only what still changes.  A merge always outranks
the merges that made its parts, so merging every place of the lowest pair in
one round gives what the library's one-at-a-time queue gives.
"""

from __future__ import annotations

import json
import re

import numpy as np

NONE = np.iinfo(np.int32).max

#: Latin letters, digits and white space as the tokenizer's pattern sees them, up to U+017F.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
#: Characters whose treatment differs between Python and the library, or that lie beyond the table above.
_ODD = re.compile("[\u0000-\u0008\u000e-\u001f\u0080- İƀ-\U0010ffff]")
_PIECES = re.compile(f"[{_LETTER}]+|\n|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """The merges of a word-end BPE file of the ``tokenizers`` library.

    Everything comes from the file at ``path``: vocabulary, merges, word end
    and special strings.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        base = np.unique(np.concatenate((self.inner, self.final)))
        grid = np.arange(base.max() + 1, dtype=np.int32)
        # ranks of pairs of single bytes, which the first round asks for, as a table
        self.first = self.rank(np.repeat(grid, len(grid)), np.tile(grid, len(grid))).reshape(len(grid), -1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.library = Tokenizer.from_file(path)
        self.to_byte = {c: b for b, c in enumerate(chars)}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words behind each other, number of ids of each word)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        if not len(sym):
            return sym, counts
        ends = np.cumsum(size)[size > 0] - 1
        sym[ends] = self.final[raw[ends]]
        row = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), NONE, np.int32)
        inside = np.flatnonzero(row[:-1] == row[1:])
        rank[inside] = self.first[sym[inside], sym[inside + 1]]
        done_row, done_sym = [], []
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            length = np.diff(np.append(start, len(row)))
            best = np.repeat(np.minimum.reduceat(rank, start), length)
            settled = best == NONE
            done_row.append(row[settled])
            done_sym.append(sym[settled])
            hit = (rank == best) & ~settled
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # of overlapping places (a run of one symbol) every second one merges, from the left
            run = np.concatenate(([True], np.diff(at) != 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = ~settled
            keep[at + 1] = False
            rank[at] = -1
            sym, row, rank = sym[keep], row[keep], rank[keep]
            new = np.flatnonzero(rank == -1)
            touched = np.concatenate((new, new[new > 0] - 1))
            rank[touched] = NONE
            touched = touched[touched < len(sym) - 1]
            touched = touched[row[touched] == row[touched + 1]]
            rank[touched] = self.rank(sym[touched], sym[touched + 1])
        rows, syms = np.concatenate(done_row), np.concatenate(done_sym)
        return syms[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(words))

    def chunks(self, text: str) -> list:
        """A text as chunks that encode independently: strings without white
        space in lower case, tuples of pre-tokens where only the library's own
        normalizer is exact, and ids of special strings."""
        if "<|" in text:
            parts = self.specials.split(text)
            if len(parts) > 1:
                return [c for i, p in enumerate(parts)
                        for c in ([self.special[p]] if i % 2 else self.plain(p))]
        return self.plain(text)

    def plain(self, text: str) -> list:
        if _ODD.search(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [(bytes(map(self.to_byte.__getitem__, p)),) for p, _ in pieces]
        return text.lower().split()


class ChunkCache(dict):
    """chunk -> its ids as little-endian bytes, filled a batch at a time.

    ``room`` bounds the memory of a long task: a cache that outgrew it starts
    anew.  It only saves work, results do not depend on it.
    """

    def __init__(self, path: str, room: int = 100_000):
        super().__init__()
        self.bpe, self.room = WordBpe(path), room

    def chunked(self, texts: list[str]) -> list[list]:
        """The chunks of every text, all of them known to the cache."""
        if len(self) > self.room:
            self.clear()
        lists = [self.bpe.chunks(t) for t in texts]
        self.learn(set().union(*lists).difference(self))
        return lists

    def learn(self, chunks: set) -> None:
        """Encode new chunks: cut them all into pre-tokens at once, merge the
        distinct pre-tokens, put each chunk together from its pieces."""
        plain, pieces = [], []
        for c in chunks:
            if isinstance(c, str):
                plain.append(c)
            elif isinstance(c, int):
                self[c] = np.uint32(c).tobytes()
        odd = [c for c in chunks if isinstance(c, tuple)]
        text = "\n".join(plain)
        pieces = _PIECES.findall(text + "\n") if plain else []
        distinct = dict.fromkeys(pieces)
        distinct.pop("\n", None)
        words = [*(p.encode() for p in distinct), *(c[0] for c in odd)]
        ids, counts = self.bpe.merge(words)
        ids = ids.astype("<u4")
        first = np.cumsum(counts) - counts
        for i, c in enumerate(odd, len(distinct)):
            self[c] = ids[first[i]:first[i] + counts[i]].tobytes()
        if not plain:
            return
        number = dict(zip(distinct, range(len(distinct))), **{"\n": -1})
        of = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        n = np.where(of < 0, 0, counts[of])
        stop = np.cumsum(n)
        take = np.repeat(first[of] - (stop - n), n) + np.arange(stop[-1])
        raw, ends = ids[take].tobytes(), stop[of < 0] * 4
        starts = np.concatenate(([0], ends[:-1]))
        self.update(zip(plain, map(raw.__getitem__, map(slice, starts.tolist(), ends.tolist()))))


_caches: dict[str, ChunkCache] = {}


def cache(path: str) -> ChunkCache:
    """One cache for each Python worker and file."""
    if path not in _caches:
        _caches[path] = ChunkCache(path)
    return _caches[path]
