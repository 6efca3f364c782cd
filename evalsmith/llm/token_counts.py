"""Token counts by rank-synchronous merging.

Texts are cut into pre-tokens; a batch's distinct pre-tokens are held as one
ragged numpy array of byte symbols. In each step every sequence merges all
occurrences of its own lowest-rank pair at the same time; sequences without a
mergeable pair drop out. What is left of a sequence is its token count, and a
text's count is the sum over its pre-tokens.

All occurrences of a pair may merge at once because a merged symbol only
takes part in pairs of higher rank; of overlapping occurrences (a run of equal
symbols) every second one merges, from the left.

The vocabulary file is read from the path given, never copied. Its size is a
property of the tokenizer, not of the data, and it is checked before it is
broadcast.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special
token's string inside a text is one token, as in the library's default; texts
of any length are counted whole; repeated rows count alike; a column named like
the result is replaced, others take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, chunks

#: Texts are split as this fixed pattern splits them, before byte-level merges:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
#: Fixed: bytes that byte-level vocabularies write as themselves; the others
#: follow from code point 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

MAX_VOCABULARY_BYTES = 64 << 20
#: Characters cut into pre-tokens at a time, distinct pre-tokens whose counts
#: a task remembers, and bytes of pre-tokens merged at a time.
_CHARS, _KNOWN, _MERGE_BYTES = 1 << 21, 1 << 20, 1 << 21
_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)
#: Odd multipliers of the pre-token hash.
_BASE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE vocabulary file: the symbol of each byte;
    merge pairs as ascending keys with their ranks; the symbol each rank
    makes; special tokens, longest first."""
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary of over {MAX_VOCABULARY_BYTES} isn't broadcast")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _built(path, spec)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    hidden = [b for b in range(256) if b not in set(_SHOWN)]
    char = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return {
        "of_byte": np.array([vocab[char[b]] for b in range(256)], np.int64),
        "keys": keys[order],
        "rank": order.astype(np.int64),
        "made": np.array([vocab[a + b] for a, b in pairs], np.int64),
        "classes": char_classes(),
        "specials": sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True),
    }


def _built(path: str, spec: dict) -> None:
    """Raises on a file that asks for more than is built here: it would be
    counted wrongly."""
    cut = spec.get("pre_tokenizer") or {}
    asked = {k: spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
    asked |= {"normalizer": spec.get("normalizer"), "add_prefix_space": cut.get("add_prefix_space", True), "use_regex": not cut.get("use_regex", True)}
    asked |= {f"{k} of {t['content']}": t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")}
    found = [k for k, v in asked.items() if v]
    if spec["model"].get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel":
        found.append("another model or pre-tokenizer than byte-level BPE")
    if found:
        raise ValueError(f"{path} asks for what isn't built: {', '.join(found)}")


class Merger:
    """Merges ragged batches of byte sequences by the tables of a vocabulary."""

    def __init__(self, tables: dict):
        self.of_byte, self.keys, self.rank, self.made = (tables[k] for k in ("of_byte", "keys", "rank", "made"))
        self.none = np.int64(len(self.made))
        b = self.of_byte
        self.first = self._lookup(np.repeat(b, 256), np.tile(b, 256))

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive all merges, per pre-token."""
        out = np.zeros(len(tokens), np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        for a, b in chunks(lengths, _MERGE_BYTES):
            out[a:b] = self._merge(b"".join(tokens[a:b]), lengths[a:b])
        return out

    def _merge(self, data: bytes, lengths: np.ndarray) -> np.ndarray:
        out = lengths.copy()
        live = np.flatnonzero(lengths > 1)  # sequences still merging
        raw = np.frombuffer(data, np.uint8)[np.repeat(lengths > 1, lengths)]
        size = lengths[live]
        symbols = self.of_byte[raw]
        # rank[i]: of the pair of symbols i and i + 1, none across sequences.
        rank = np.full(len(raw), self.none)
        if len(live):
            rank[:-1] = self.first[(raw[:-1].astype(np.int64) << 8) | raw[1:]]
            rank[np.cumsum(size) - 1] = self.none
        while len(live):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            going = least < self.none
            if not going.all():
                out[live] = size
                keep = np.repeat(going, size)
                live, size, least, symbols, rank = live[going], size[going], least[going], symbols[keep], rank[keep]
                if not len(live):
                    break
                start = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(least, size))
            # In a run of neighbouring hits every second one merges.
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            seq = np.searchsorted(start, at, side="right") - 1
            symbols[at] = self.made[least[seq]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            symbols, rank = symbols[stay], rank[stay]
            size = size - np.bincount(seq, minlength=len(size))
            # Only pairs with a merged symbol have a new rank.
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(size) - 1] = True
            new = place[at]
            pair = np.concatenate([new, new[new > 0] - 1])
            rank[new] = self.none
            pair = pair[~last[pair]]
            rank[pair] = self._lookup(symbols[pair], symbols[pair + 1])
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.rank[i], self.none)


class TokenCounter:
    """Counts tokens of whole texts; remembers the counts of pre-tokens.

    A batch of texts is cut without a loop over characters. In one array of
    code points each has a class (letter, number, space, other, end of text);
    the pattern's matches are then the runs of a class, but that

    * a blank just before a run of letters, numbers or others belongs to it;
    * the last of several spaces before such a run is a match of its own;
    * an apostrophe that no blank or other character precedes takes the
      contraction behind it, and what follows starts anew.

    A pre-token is known by a 64-bit hash of its bytes.
    """

    def __init__(self, tables: dict):
        self.merger = Merger(tables)
        self.special = regex.compile("|".join(map(regex.escape, tables["specials"]))) if tables["specials"] else None
        self.classes = tables["classes"]
        self.known: dict[int, int] = {}
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, texts: list[str]) -> list[int]:
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if self.special is not None and self.special.search(t) is not None:
                pieces = self.special.split(t)
                out[i] += len(pieces) - 1
            else:
                pieces = [t]
            for p in pieces:
                if p:
                    parts.append(p)
                    owner.append(i)
        for a, b in chunks([len(p) for p in parts], _CHARS):
            np.add.at(out, np.array(owner[a:b], np.int64), self._sums(parts[a:b]))
        return out.tolist()

    def _sums(self, parts: list[str]) -> np.ndarray:
        """Tokens of each non-empty part."""
        points = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kind = self.classes[points]
        kind[ends] = _END
        begins = np.flatnonzero(self._begins(points, kind))
        # Ends of texts begin an empty-handed match: dropped here.
        real = kind[begins] != _END
        width = np.ones(len(points), np.int8)
        width += points >= 0x80
        width += points >= 0x800
        width += points >= 0x10000
        at = np.r_[0, np.cumsum(width, dtype=np.int64)]
        data = "\0".join(parts).encode("utf-8", "surrogatepass") + b"\0"
        start = at[begins]
        stop = np.r_[start[1:], len(data)]
        keys = self._hashes(np.frombuffer(data, np.uint8), start, stop)
        start, stop, keys, begins = start[real], stop[real], keys[real], begins[real]
        n = self._counts(data, start, stop, keys)
        part = np.searchsorted(ends, begins)
        return np.bincount(part, weights=n, minlength=len(parts)).astype(np.int64)

    def _begins(self, points: np.ndarray, kind: np.ndarray) -> np.ndarray:
        n = len(kind)
        before = np.r_[np.uint8(_END), kind[:-1]]
        begin = kind != before
        begin[kind == _END] = True
        blank = np.r_[False, points[:-1] == 0x20] & (before == _SPACE)
        spaces = kind == _SPACE
        after = np.r_[kind[1:], np.uint8(_END)]
        # The last space before a run of another class; at a text's end none.
        last = spaces & (after != _SPACE) & (after != _END)
        joins = begin & blank & ~spaces & (kind != _END)
        quote = np.flatnonzero((points == 0x27) & begin & ~joins)
        begin |= last
        begin &= ~joins
        # A contraction: the run behind the apostrophe doesn't begin, the
        # character behind the contraction does.
        if len(quote):
            p = np.r_[points, np.zeros(2, np.uint32)]
            one, two = p[quote + 1], p[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            length = np.where(short, 2, np.where(long_, 3, 0))
            quote, length = quote[length > 0], length[length > 0]
            begin[quote + 1] = False
            behind = quote + length
            begin[behind[behind < n]] = begin[behind[behind < n]] | (kind[behind[behind < n]] != _SPACE)
            # A blank behind it that joins a run keeps its place: it began already.
        return begin

    def _hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.power) < n + 1:
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n])]
        return (total[stop] - total[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * _LENGTH

    def _counts(self, data: bytes, start: np.ndarray, stop: np.ndarray, keys: np.ndarray) -> np.ndarray:
        n = np.fromiter(map(self.known.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        miss = np.flatnonzero(n < 0)
        if len(miss):
            fresh, first, where = np.unique(keys[miss], return_index=True, return_inverse=True)
            own = miss[first]
            found = self.merger.counts([data[a:b] for a, b in zip(start[own].tolist(), stop[own].tolist(), strict=True)])
            n[miss] = found[where]
            if len(self.known) + len(fresh) > _KNOWN:
                self.known = {}
            self.known.update(zip(fresh.tolist(), found.tolist(), strict=True))
        return n


def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text; map-only. The driver
    reads the vocabulary file at ``vocabulary`` and broadcasts its arrays."""
    shared = docs.sparkSession.sparkContext.broadcast({"tables": load_vocabulary(vocabulary)})

    def run(texts: pd.Series) -> pd.Series:
        held = shared.value  # stays with the Python worker from task to task
        if "counter" not in held:
            held["counter"] = TokenCounter(held["tables"])
        return pd.Series(held["counter"]([as_text(t) for t in texts]), dtype="int64")

    return docs.withColumn(out, F.pandas_udf(run, "long")(text_col))
