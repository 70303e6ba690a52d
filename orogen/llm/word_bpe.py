"""Token ids of whole texts by a public tokenizer file, fast where the file's layout allows it.

The layout that gains: white space separates tokens and is dropped, letters are lowered, bytes are
merged inside words up to an end-of-word mark. There a text's ids are its words' ids one after another,
so each distinct word is encoded once per worker and kept, and new words are merged many at a time in
arrays. Every other layout, and every word outside plain Latin text, goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: Words of the younger and of the older generation that one worker keeps the ids of.
CACHE = 320_000
#: Longest word, in bytes, that is merged in arrays.
LONGEST = 48
NONE = np.int32(2**31 - 1)
#: Latin text without the separators that split() takes for white space and the tokenizer does not.
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ]")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [moved.get(b, chr(b)) for b in range(256)]


class Merges:
    """Byte-pair merges of many words at a time: words of equal length are rows, each step merges every row's best pair."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], "i4")
        self.last = np.array([vocabulary[s + end] for s in symbols], "i4")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in pairs], "i8")
        self.made = np.array([vocabulary[a + b] for a, b in pairs], "i4")
        self.bits = max(8, int(len(keys) * 16).bit_length())
        self.key = np.full(1 << self.bits, -1, "i8")
        self.rank = np.full(1 << self.bits, NONE, "i4")
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.key[slot] != -1:
                if self.key[slot] == key:
                    break
                slot = (slot + 1) & ((1 << self.bits) - 1)
            else:
                self.key[slot], self.rank[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype("i8")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype("i8") * self.base + b
        slot = self._slot(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.rank[slot], NONE)
        open_ = np.nonzero((held != keys) & (held != -1))
        while len(open_[0]):
            at = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_] = at
            held, want = self.key[at], keys[open_]
            out[open_] = np.where(held == want, self.rank[at], NONE)
            more = (held != want) & (held != -1)
            open_ = tuple(x[more] for x in open_)
        return out

    def encode(self, words: list[str]) -> dict[str, bytes]:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w) if w.isascii() else len(w.encode()), []).append(w)
        out: dict[str, bytes] = {}
        for size, same in by_size.items():
            raw = np.frombuffer("".join(same).encode(), "u1").reshape(len(same), size)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            at = np.arange(len(same))
            rank = self.ranks(ids[:, :-1], ids[:, 1:]) if size > 1 else np.empty((len(same), 0), "i4")
            while True:
                if ids.shape[1] > 1:
                    best = rank.argmin(axis=1)
                    low = rank[np.arange(len(best)), best]
                    done = low == NONE
                else:
                    done = np.ones(len(at), bool)
                ended, width = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                out.update(zip(map(same.__getitem__, at[done].tolist()), [ended[k : k + width] for k in range(0, len(ended), width)], strict=True))
                if done.all():
                    break
                go = ~done
                at, ids, rank, best, low = at[go], ids[go], rank[go], best[go], low[go]
                rows, place = np.arange(len(at)), np.arange(ids.shape[1] - 1)
                # the pair becomes one symbol; what stands after it moves up
                ids = np.where(place[None, :] <= best[:, None], ids[:, :-1], ids[:, 1:])
                ids[rows, best] = self.made[low]
                if ids.shape[1] == 1:
                    rank = np.empty((len(at), 0), "i4")
                    continue
                rank = np.where(place[None, :-1] < best[:, None], rank[:, :-1], rank[:, 1:])
                left, right = rows[best > 0], rows[best < ids.shape[1] - 1]
                b = best[left]
                rank[left, b - 1] = self.ranks(ids[left, b - 1], ids[left, b])
                b = best[right]
                rank[right, b] = self.ranks(ids[right, b], ids[right, b + 1])
        return out


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One per worker process, so that the words it knows serve all its tasks."""
    return TextIds(path)


class TextIds:
    """Ids of texts as little-endian unsigned 32-bit numbers, as encoding each text whole gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.merges = self.pattern = None
        model, steps = said["model"], (said.get("pre_tokenizer") or {}).get("pretokenizers") or []
        normal = [(n["type"], n.get("content")) for n in (said.get("normalizer") or {}).get("normalizers") or []]
        if (
            normal == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("invert")
            and steps[0].get("behavior") == "Removed"
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and model["type"] == "BPE"
            and model.get("end_of_word_suffix")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        ):
            self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: set[str], plain: bool) -> None:
        """Words that the young generation does not know get their ids; plain: of Latin text, lowered."""
        if len(self.young) + len(words) > CACHE:
            self.old, self.young = self.young, {}
        if self.old:
            known = {w for w in words if w in self.old}
            self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
            words = words - known
        odd = [w for w in words if len(w) > LONGEST // 2] if plain else list(words)
        if odd:
            self.young.update(zip(odd, self._whole(odd), strict=True))
            words = words.difference(odd)
        single = {w for w in words if w.isalpha()}
        rest = [(w, [w[:-1], w[-1]] if w[-1] in ".,;:!?" and w[:-1].isalpha() else self.pattern.findall(w)) for w in words - single]
        parts = {p for _, ps in rest for p in ps}
        ids = self.merges.encode(list(single | parts))
        self.young.update(zip(single, map(ids.__getitem__, single), strict=True))
        self.young.update([(w, ids[ps[0]] + ids[ps[1]] if len(ps) == 2 else b"".join([ids[p] for p in ps])) for w, ps in rest])

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        if not self.merges:
            for at in range(0, len(texts), 64):
                yield from self._whole(texts[at : at + 64])
            return
        for at in range(0, len(texts), 1024):
            split: list[list[str] | None] = []
            need: tuple[set[str], set[str]] = (set(), set())
            odd: list[bool] = []
            for text in texts[at : at + 1024]:
                other = bool(_OTHER.search(text)) or "<|" in text
                words = None if other and _SEPARATORS.search(text) else (text if other else text.lower()).split()
                odd.append(other)
                split.append(words)
                need[other].update(words or ())
            for other in (False, True):
                missing = need[other].difference(self.young)
                if missing:
                    self._learn(missing, not other)
            young = self.young
            for text, words, other in zip(texts[at : at + 1024], split, odd, strict=True):
                if words is None:
                    yield self._whole([text])[0]
                    continue
                try:
                    yield b"".join([young[w] for w in words])
                except KeyError:  # the generation changed between
                    self._learn(set(words).difference(young), not other)
                    young, old = self.young, self.old  # and may change again, but then the old one has the rest
                    yield b"".join([young[w] if w in young else old[w] for w in words])
