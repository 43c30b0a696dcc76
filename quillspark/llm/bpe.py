"""Byte-level BPE encoding by tree concatenation, and decoding.

Short texts split at spaces, and before line feeds, that no pre-token can cross into units. Arrow splits many texts at
once and tells the units apart; pre-tokens of distinct units of Latin letters, digits and signs are merged side by side,
one merge of each at a time (`Merges`), other units go to the library and are remembered. Text longer than `Settings.leaf` characters is cut in halves down to leaves, all leaves are encoded side by side, and neighbours
are joined bottom up: a window around the join is encoded again, and grows until on both sides it agrees with
the halves where agreement proves the whole; then left ids, window ids and right ids are put together.

Agreement proves the whole because (a) the pre-tokenizer scans forwards and looks at most two characters past a
boundary, so from a boundary that both sides have on, the scan is the same, and (b) inside one pre-token a
sequence of tokens is the encoding if each adjacent pair is one, which two equal adjacent tokens carry over.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, table

#: No pre-token of the byte-level pattern crosses the place before a space between two characters that are not
#: white space: what comes before ends there, and the space opens the next.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: what the library's byte-level pre-tokenizer cuts out.
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
#: White space for Python only, not for the tokenizer.
ODD = re.compile("[\x1c-\x1f]")
LONG = 32


@dataclass(frozen=True)
class Settings:
    leaf: int = 8192  # characters
    window: int = 64  # bytes on either side of a join, to begin with
    remembered: int = 150_000  # units that are not merged side by side
    group: int = 1 << 22  # characters of texts and leaves whose units are told apart together


@lru_cache(maxsize=2)
def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _beginnings(words: list[int]) -> np.ndarray:
    """For each token whether its pre-token is not the one of the token before."""
    found, words = np.ones(len(words), np.uint8), np.array(words, np.int64)
    found[1:] = words[1:] != words[:-1]
    return found


#: What a byte is part of: a letter (Latin, up to two bytes), a digit, a sign, a line feed, or what only the library cuts.
LETTER, DIGIT, SIGN, FEED, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER  # U+00C0 to U+027F
KIND[[*b"0123456789"]] = DIGIT
KIND[ord("'")] = OTHER  # may open a pre-token of its own kind
KIND[ord("\n")] = FEED
NEVER = np.int32(2**31 - 1)


class Merges:
    """The merges of a vocabulary for many pre-tokens side by side: in each round every pre-token makes the one merge that
    the library would make next, the first of its pairs with the least rank."""

    LONGEST = 64  # bytes of a pre-token

    def __init__(self, vocab: dict[str, int], merges: list, by_char: dict[str, int]):
        self.of_byte = np.zeros(256, np.int64)
        for c, b in by_char.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list | tuple) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        todo, slot = np.arange(len(keys))[::-1], self._slot(keys)[::-1]  # of equal pairs the first stays
        while len(todo):
            free = (self.keys[slot] < 0) | (self.keys[slot] == keys[todo])
            self.keys[slot[free]] = keys[todo[free]]
            won = free & (self.keys[slot] == keys[todo])
            self.ranks[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, `NEVER` where there is no merge."""
        keys = a << 32 | b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NEVER)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out

    def __call__(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, given by their places in raw, one behind the other, and how many each has."""
        sizes, found = np.ones(len(begin), np.int64), []
        order = np.argsort(length.astype(np.uint8), kind="stable")
        cut = np.searchsorted(length[order], [1, 2, 3, 5, 7, 9, 11, 13, 17, 25, self.LONGEST + 1])
        for i, j in zip(cut, cut[1:]):
            for k in range(i, j, 16384):  # as much as a core's cache holds
                some = order[k : min(j, k + 16384)]
                ids, sizes[some] = self._merged(raw, begin[some], length[some])
                found.append(ids)
        if not found:
            return np.empty(0, "<u4"), sizes
        flat = np.concatenate(found)
        stops = np.cumsum(sizes[order])
        at = np.empty(len(begin), np.int64)
        at[order] = stops - sizes[order]
        ends = np.cumsum(sizes)
        return flat[np.repeat(at - (ends - sizes), sizes) + np.arange(len(flat))], sizes

    def _merged(self, raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pre-tokens of about one length: a row for each place, a column for each pre-token."""
        rows, n = int(length.max()), len(begin)
        place = np.arange(rows)[:, None]
        alive = place < length
        ids = self.of_byte[raw[np.minimum(begin + place, len(raw) - 1)]]
        if rows > 1:
            keys = np.full((rows, n), NEVER, np.int32)  # rank of the pair that begins here, then the place
            ranks = np.full((rows - 1, n), NEVER, np.int32)
            pair = alive[1:]
            ranks[pair] = self.rank(ids[:-1][pair], ids[1:][pair])
            keys[:-1] = np.where(ranks < NEVER, ranks * self.LONGEST + place[:-1], NEVER)
            after = np.ascontiguousarray(np.broadcast_to(np.where(place + 1 < length, place + 1, rows), (rows, n))).astype(np.int64).reshape(-1)
            before = np.ascontiguousarray(np.broadcast_to(place - 1, (rows, n))).astype(np.int64).reshape(-1)
            flat, flat_keys, flat_alive = ids.reshape(-1), keys.reshape(-1), alive.reshape(-1)
            while True:
                least = keys.min(0)
                of = np.flatnonzero(least < NEVER)
                if not len(of):
                    break
                rank, at = np.divmod(least[of].astype(np.int64), self.LONGEST)
                here = at * n + of
                gone = after[here] * n + of
                flat[here] = made = self.made[rank]
                flat_alive[gone] = False
                flat_keys[gone] = NEVER
                after[here] = follow = after[gone]
                some = np.flatnonzero(follow < rows)
                flat_keys[here] = NEVER
                following = follow[some] * n + of[some]
                before[following] = at[some]
                new = self.rank(made[some], flat[following])
                flat_keys[here[some]] = np.where(new < NEVER, new * self.LONGEST + at[some].astype(np.int32), NEVER)
                ahead = before[here]
                some = np.flatnonzero(ahead >= 0)
                preceding = ahead[some] * n + of[some]
                new = self.rank(flat[preceding], made[some])
                flat_keys[preceding] = np.where(new < NEVER, new * self.LONGEST + ahead[some].astype(np.int32), NEVER)
        return ids.T[alive.T].astype("<u4"), alive.sum(0)


class _Parts(dict):
    """Ids of pre-tokens, each looked up once."""

    def __init__(self, merge, char: dict[int, str]):
        self.merge, self.char = merge, char

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            shown = part.replace(" ", self.char[32])
        else:
            shown = "".join(map(self.char.__getitem__, part.encode()))
        self[part] = found = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return found


class ByteBpe:
    """One tokenizer file; ids are the library's with add_special_tokens=False and no truncation or padding."""

    def __init__(self, path: str, settings: Settings = Settings()):
        from tokenizers import Tokenizer

        self.settings = settings
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        by_char = _byte_of_char()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("a byte-level tokenizer without normalizer, prefix space or stripping tokens is needed")
        size = max([*spec["model"]["vocab"].values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            if token not in added:
                self.bytes_of[i] = bytes(by_char[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decimal = [b"%d," % i for i in range(size)]
        self.special = added
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.cut = spec["pre_tokenizer"].get("use_regex", True) and spec["model"]["type"] == "BPE"
        self.merges = None
        if self.cut and set(by_char) <= set(spec["model"]["vocab"]) and not any(spec["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], by_char)
        self.parts = _Parts(self.tokenizer.model.tokenize, {b: c for c, b in by_char.items()})
        self.known: dict[str, bytes] = {}  # ids of a word that follows a space, or of a line feed and the word behind it
        self.odd: dict[str, bytes] = {}  # ids of other units
        self.known_first: dict[str, np.ndarray] = {}

    # -- direct encoding of units ------------------------------------------------------------------------------

    @staticmethod
    def words(text: str) -> list[str]:
        """text cut at its safe places, the space of each left out."""
        mark = "\0" if "\0" not in text else next(c for c in map(chr, range(1, 0x110000)) if c not in text and not c.isspace())
        return SAFE.sub(mark, text).split(mark)

    def _remember(self, words: list[str], apart: list[str]) -> None:
        """Encode what is not known: words that follow a space, and units that stand apart. The words are put one
        behind the other, as the places between them are safe, and the ids are dealt back by their lengths in bytes."""
        if len(self.known) + len(self.odd) > self.settings.remembered:
            self.known.clear()
            self.odd.clear()
            self.known_first.clear()
        if self.cut:  # words of Latin letters are cut here: they share most of their parts
            if len(self.parts) > self.settings.remembered:
                self.parts.clear()
            words = [w for w in words if not self._from_parts(w)]
        broken = [w for w in words if w[0] == "\n"]
        words = [w for w in words if w[0] != "\n"]
        pieces = [words[i : i + 4096] for i in range(0, len(words), 4096)]
        encoded = self.tokenizer.encode_batch_fast([*(" " + " ".join(x) for x in pieces), *broken, *apart], add_special_tokens=False)
        for piece, e in zip(pieces, encoded):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in piece])
            cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.length[ids]), ends) + 1)).tolist()]
            raw = ids.tobytes()
            self.known.update(zip(piece, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        alone = [array("I", e.ids).tobytes() for e in encoded[len(pieces) :]]
        self.known.update(zip(broken, alone))
        self.odd.update(zip(apart, alone[len(broken) :]))

    def _from_parts(self, word: str) -> bool:
        if not (word.isascii() or max(word) < "ɐ"):
            return False
        parts = self.parts
        if word.isalpha():
            self.known[word] = parts[" " + word]
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            self.known[word] = parts[" " + word[:-1]] + parts[word[-1]]
        elif ODD.search(word):
            return False
        elif word[0] == "\n":
            self.known[word] = parts["\n"] + (parts[word[1:]] if word[1:].isalpha() else b"".join(map(parts.__getitem__, PART(word[1:]))))
        else:
            self.known[word] = b"".join(map(parts.__getitem__, PART(" " + word)))
        return True

    def _units(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, Callable[[int], str]]]:
        """Ids of each text, how many each of its units has, and a function that gives the unit at a place.

        A line feed between other characters is a part of its own, so units end before it. A text whose spaces are not all
        safe places has a unit that is empty or begins or ends with white space, and is cut by `words`.
        """
        try:
            column = pa.array(texts, pa.large_string())
        except UnicodeEncodeError:  # surrogates
            return [self._one(t) for t in texts]
        out = self._dealt(pc.split_pattern(pc.replace_substring(column, "\n", " \n") if self.cut else column, " "), False)
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self._dealt(pa.array([self.words(texts[i]) for i in rest], pa.list_(pa.large_string())), True)):
                out[i] = x
        return out

    def _dealt(self, split: pa.Array, safe_only: bool) -> list[tuple[np.ndarray, np.ndarray, Callable[[int], str]] | None]:
        """The same of texts that are cut, None for those that are cut at other than safe places, which are told where not all are.

        Then the last unit may end with white space, and stands apart like the first.
        """
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code, begins = coded.indices.to_numpy(), ends[:-1]
        unit, inside = code.astype(np.int64), np.ones(len(code), bool)
        inside[begins] = False
        heads = coded.dictionary.take(coded.indices.take(pa.array(begins))).to_pylist()
        last = ends[1:][np.diff(ends) > 1] - 1 if safe_only else ends[:0]
        inside[last] = False
        lasts = [" " + w for w in coded.dictionary.take(coded.indices.take(pa.array(last))).to_pylist()]
        if len(self.known) + len(self.odd) > self.settings.remembered:
            self.known.clear()
            self.odd.clear()
            self.known_first.clear()
        used = np.zeros(len(coded.dictionary), bool)
        used[code[inside]] = True
        merged, size, apart = self._merged(coded.dictionary, used)
        words = coded.dictionary.take(pa.array(apart)).to_pylist()
        fresh = [w for w in words if w and w not in self.known and not w[-1].isspace() and not (w[1] if w[0] == "\n" and self.cut else w[0]).isspace()]
        self._remember(fresh, [*{h for h in [*heads, *lasts] if h}.difference(self.odd)])
        found = [*map(self.known.get, words)]
        safe = np.ones(len(used), bool)
        safe[apart] = [f is not None for f in found]
        first = [None if not safe_only and (not h or h[-1].isspace() and n > 1) else self.odd[h] for h, n in zip(heads, np.diff(ends).tolist())]
        raw = [f or b"" for f in chain(found, first, map(self.odd.__getitem__, lasts))]
        pool = np.concatenate((merged, np.frombuffer(b"".join(raw), "<u4")))
        at = np.cumsum(size) - size
        more = np.array([*map(len, raw)], np.int64) // 4
        begun = len(merged) + np.cumsum(more) - more
        at[apart], size[apart] = begun[: len(apart)], more[: len(apart)]
        at, size = np.append(at, begun[len(apart) :]), np.append(size, more[len(apart) :])
        unit[begins] = len(used) + np.arange(len(heads))
        unit[last] = len(used) + len(heads) + np.arange(len(last))
        sizes = size[unit]
        stops = np.cumsum(sizes)
        flat = pool[np.repeat(at[unit] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        stops = np.concatenate(([0], stops))
        good = np.logical_and.reduceat(safe[code] | ~inside, begins) if len(heads) else np.empty(0, bool)
        out = []
        for f, ok, a, b in zip(first, good.tolist(), ends.tolist(), ends[1:].tolist()):
            if f is None or not ok:
                out.append(None)
                continue
            name = lambda i, a=a: w if (w := coded.dictionary[code[a + i]].as_py())[0] == "\n" or not i else " " + w
            out.append((flat[stops[a] : stops[b]], sizes[a:b], name))
        return out

    def _merged(self, words: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the used words whose pre-tokens are runs of bytes of one kind, how many each word has, and the places of the other words."""
        sizes = np.zeros(len(words), np.int64)
        if self.merges is None or not used.any():
            return np.empty(0, "<u4"), sizes, np.flatnonzero(used)
        offsets, raw = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
        offsets, raw = offsets - offsets[0], raw[offsets[0] : offsets[-1]]
        kind = KIND[raw]
        kind[:-1][(raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = OTHER  # no letters
        length = np.diff(offsets)
        full = np.flatnonzero(length)
        lead = np.zeros(len(words), bool)
        lead[full] = raw[offsets[full]] == 10
        bad = kind >= FEED
        bad[offsets[:-1][lead]] = False
        use = used & (length > lead)
        use[np.repeat(np.arange(len(words)), length)[bad]] = False
        mine = np.flatnonzero(use)
        # The words one behind the other, each after its space, but for those that begin with a line feed.
        n, spaced = length[mine], ~lead[mine]
        ends = np.cumsum(n + spaced)
        begins = ends - n
        text, kinds = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8), np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        to = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        of = np.repeat(offsets[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text[to], kinds[to] = raw[of], kind[of]
        kinds[begins[spaced] - 1] = kinds[begins[spaced]]
        opens = np.ones(len(text), bool)
        opens[1:] = kinds[1:] != kinds[:-1]
        opens[ends - n - spaced] = True
        run = np.flatnonzero(opens)
        long = np.diff(run, append=len(text))
        owner = np.searchsorted(ends, run, "right")
        short = np.ones(len(mine), bool)
        short[owner[long > self.merges.LONGEST]] = False
        kept = short[owner]
        ids, each = self.merges(text, run[kept], long[kept])
        sizes[mine] = np.bincount(owner[kept], each, len(mine)).astype(np.int64)
        use[mine[~short]] = False
        return ids, sizes, np.flatnonzero(used & ~use)

    def _one(self, text: str) -> tuple[np.ndarray, np.ndarray, Callable[[int], str]]:
        """The same of a text that Arrow does not hold."""
        words = self.words(text)
        head, last = words[0], " " + words[-1] if len(words) > 1 else words[0]
        for _ in range(2):  # what was known may have gone to make room
            middle = set(words[1:-1]).difference(self.known)
            apart = [u for u in {head, last} if u not in self.odd]
            if middle or apart:
                self._remember(list(middle), apart)
        found = [self.odd[head], *map(self.known.__getitem__, words[1:-1])]
        found = found if len(words) == 1 else [*found, self.odd[last]]
        return np.frombuffer(b"".join(found), "<u4"), np.array([*map(len, found)]) // 4, lambda i: " " + words[i] if i else words[0]

    def _node(self, text: str, units: tuple[np.ndarray, np.ndarray, Callable[[int], str]]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """A leaf: its bytes, its ids, and marks of places where a pre-token begins: all of them in units of over
        `LONG` ids, only the unit's own in others."""
        ids, sizes, name = units
        starts = np.cumsum(sizes) - sizes
        marks = np.zeros(len(ids), np.uint8)
        marks[starts[sizes > 0]] = 1
        for i in np.flatnonzero(sizes > LONG).tolist():
            unit = name(i)
            if unit not in self.known_first:
                self.known_first[unit] = _beginnings(self.tokenizer.encode(unit, add_special_tokens=False).word_ids)
            marks[starts[i] : starts[i] + sizes[i]] = self.known_first[unit]
        return text.encode("utf-8", "surrogatepass"), ids, marks

    # -- tree concatenation ------------------------------------------------------------------------------------

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; special tokens' strings in them become their ids, as in the library."""
        out: list[np.ndarray | None] = [None] * len(texts)
        short, leaves, long = [], [], []  # leaves of all long texts are encoded at once
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.empty(0, "<u4")
            elif self.split_special is not None and any(map(text.__contains__, self.special)):
                parts = [np.array([self.special[x]], "<u4") if j % 2 else self.encode(x) for j, x in enumerate(self.split_special.split(text)) if x]
                out[i] = np.concatenate(parts)
            elif len(text) > self.settings.leaf:
                cut = self._leaves(text)
                long.append((i, len(leaves), len(leaves) + len(cut)))
                leaves += cut
            else:
                short.append(i)
        parts = [texts[i] for i in short] + leaves
        group = np.cumsum([*map(len, parts)]) // self.settings.group
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(parts)]
        units = [u for a, b in zip(cut, cut[1:]) if b > a for u in self._units(parts[a:b])]
        for i, (ids, _, _) in zip(short, units):
            out[i] = ids
        nodes = [*map(self._node, leaves, units[len(short) :])]
        for i, a, b in long:
            tree = nodes[a:b]
            while len(tree) > 1:
                tree = [self._join(x, y) for x, y in zip(tree[::2], tree[1::2])]
            out[i] = tree[0][1]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def _leaves(self, text: str) -> list[str]:
        leaf, count = self.settings.leaf, 1
        while len(text) > count * leaf:
            count *= 2
        cuts = [len(text) * i // count for i in range(count + 1)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def _join(self, left, right):
        """Each side: bytes, ids, beginnings of pre-tokens. Exact for the two texts together."""
        raw, cut, size = left[0] + right[0], len(left[0]), self.settings.window
        ends_l, ends_r = np.cumsum(self.length[left[1]]), np.cumsum(self.length[right[1]])
        starts_l, starts_r = ends_l - self.length[left[1]], ends_r - self.length[right[1]]
        while True:
            whole = size >= len(raw)
            a, proven = self._window_start(left, starts_l, cut, size)
            b = self._window_end(raw, starts_r, cut, size)
            ids, first = self._encode_window(raw[a:b])
            ends = a + np.cumsum(self.length[ids])
            starts = ends - self.length[ids]
            x = (np.searchsorted(starts_l, a), 0) if proven else self._agree(left, starts_l, ends_l, ids, first, starts, a, cut, last=True)
            y = (len(right[1]), len(ids)) if b == len(raw) else self._agree_right(right, starts_r, ids, first, starts, cut, b)
            if whole and a == 0 and b == len(raw):
                x, y = (0, 0), (len(right[1]), len(ids))
            if x is not None and y is not None and x[1] <= y[1]:
                take = slice(x[1], y[1])
                return raw, np.concatenate((left[1][: x[0]], ids[take], right[1][y[0] :])), np.concatenate((left[2][: x[0]], first[take], right[2][y[0] :]))
            size *= 2

    @staticmethod
    def _window_start(left, starts: np.ndarray, cut: int, size: int) -> tuple[int, bool]:
        """Where the window opens: a pre-token of the left side that ends before the last bytes, else a token."""
        before = int(np.searchsorted(starts, cut - size, "right"))
        if before == 0:
            return 0, True
        begun = np.flatnonzero(left[2][max(0, before - 2 * LONG) : before])  # if none, this is within a long unit
        if len(begun):
            return int(starts[max(0, before - 2 * LONG) + begun[-1]]), True
        at = before - 1
        while at > 0 and left[0][starts[at]] & 0xC0 == 0x80:  # not inside a character
            at -= 1
        return int(starts[at]), at == 0

    @staticmethod
    def _window_end(raw: bytes, starts: np.ndarray, cut: int, size: int) -> int:
        end = cut + size
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        return min(end, len(raw))

    def _encode_window(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        e = self.tokenizer.encode(raw.decode("utf-8", "surrogatepass"), add_special_tokens=False)
        return np.array(e.ids, "<u4"), _beginnings(e.word_ids)

    @staticmethod
    def _agree(side, starts_s, ends_s, ids, first, starts, a: int, cut: int, last: bool):
        """The last place left of the join inside one pre-token where two adjacent tokens are equal: index in the side, in the window."""
        where = {int(s): i for i, s in enumerate(starts_s[np.searchsorted(starts_s, a) :], int(np.searchsorted(starts_s, a)))}
        for j in range(len(ids) - 1, 0, -1):
            i = where.get(int(starts[j]))
            if i and starts[j] < cut - 16 and not first[j] and not side[2][i] and ids[j] == side[1][i] and ids[j - 1] == side[1][i - 1]:
                return i, j
        return None

    def _agree_right(self, right, starts_r, ids, first, starts, cut: int, b: int):
        """The first place right of the join, well before the window's end, from which on the right side holds."""
        where = {int(s): i for i, s in enumerate(starts_r[: np.searchsorted(starts_r, b - cut)])}
        nxt = np.flatnonzero(right[2][1 : LONG + 1])
        inside = len(right[2]) > LONG and not len(nxt)  # in the right side's long first unit, and no pre-token has begun
        opened = int(np.searchsorted(starts, cut))
        seen_right = 0
        for j in range(opened, len(ids)):
            if starts[j] > b - 16:
                return None
            i = where.get(int(starts[j]) - cut)
            if first[j] and starts[j] > cut:
                inside = False
            while seen_right < len(starts_r) and starts_r[seen_right] <= starts[j] - cut:
                inside = inside and not (right[2][seen_right] and starts_r[seen_right] > 0)
                seen_right += 1
            if i is None:
                continue
            if first[j] and right[2][i]:
                return i, j
            if inside and i and j and not first[j] and not right[2][i] and starts[j - 1] >= cut and ids[j] == right[1][i] and ids[j - 1] == right[1][i - 1]:
                return i, j
        return None

    # -- decoding ----------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with skip_special_tokens=False: bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def ids_sha256(self, ids: np.ndarray) -> str:
        return hashlib.sha256(b"".join(map(self.decimal.__getitem__, ids.tolist()))[:-1]).hexdigest()


@lru_cache(maxsize=2)
def load(path: str, settings: Settings = Settings()) -> ByteBpe:
    """In a Spark task the library gets as many threads as the task has cores."""
    if (task := TaskContext.get()) is not None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(task.cpus()))
    return ByteBpe(path, settings)


def gathered(batches, rows: int = 2000, size: int = 1 << 23):
    """Batches put together to about so many rows or bytes: the more texts, the fewer of their units are new."""
    held, n, nbytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, nbytes = n + batch.num_rows, nbytes + batch.nbytes
        if n >= rows or nbytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, nbytes = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """docs with ids (array of int) added; a column of that name is replaced. A null text counts as empty."""
    kept = docs.drop("ids")

    def run(batches):
        bpe = load(path or default_path(), settings)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [x.astype(np.int32) for x in bpe.encode_many([t or "" for t in part.column("text").to_pylist()])]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=[*part.schema.names, "ids"])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))]))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (with ids) with decoded added; null ids count as none."""
    kept = rows.drop("decoded")

    def run(batches):
        bpe = load(path or default_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [bpe.decode(np.array(x or [], np.int64)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so that ids need not leave the worker."""

    def run(batches):
        bpe = load(path or default_path(), settings)
        for part in gathered(batches):
            n, ids_hash, text_hash = [], [], []
            for ids in bpe.encode_many([t or "" for t in part.column("text").to_pylist()]):
                n.append(len(ids))
                ids_hash.append(bpe.ids_sha256(ids))
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(lean(run), T.StructType([kept.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))]))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to; the last stage, so text goes."""
    return digests(docs)
