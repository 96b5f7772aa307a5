"""Token ids and exact prefix token counts of whole texts, one lookup a word.

Both vocabularies split a text before any merge, and never join across the
places where a run of blanks begins. A text is therefore cut there into units
(blanks, then the characters up to the next blank); each distinct unit is
encoded once by the public ``tokenizers`` library or by the prefix table below
and looked up afterwards. Texts with rarer white space are not cut at all.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units kept by a worker before the table starts anew: a bound on memory, not on work.
CACHE_UNITS = 400_000
#: Words without signs behind them, with their ids, in each of two tables, the newer and the older.
WORD_UNITS = 250_000
_ENCODED_AT_ONCE = 4096
_JOINED = 64
#: Lower-case words that normalising and splitting leave whole.
_PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+")
#: Signs behind such words are one piece, too (an apostrophe may start another).
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Blanks that both vocabularies and Python agree on.
_UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+\Z")
#: White space of any other kind: such a text is one unit.
_RARE_SPACE = re.compile(r"[^\S \t\n\r]|[\x1c-\x1f\x85᠎​﻿]")
#: What Python takes for white space but for the four blanks.
_OTHER_SPACE = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r") + "]"
#: Longer units are not kept.
_LONG_UNIT = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    # a task has one core; threads of the library would only add memory
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    For vocabularies that drop white space and case and split words from signs:
    a text's ids are those of its blank-separated words, one after another, and
    a word with signs behind it has the ids of both.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.signs: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word by the library."""
        out: list[bytes] = []
        for at in range(0, len(words), _ENCODED_AT_ONCE):
            got = self.tokenizer.encode_batch_fast(words[at : at + _ENCODED_AT_ONCE], add_special_tokens=False)
            out += [struct.pack(f"<{len(e)}I", *e.ids) for e in got]
        return out

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, many at once: each is one piece, whose last token alone ends a word."""
        out: list[bytes] = []
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for at in range(0, len(groups), 64):
            got = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups[at : at + 64]], add_special_tokens=False)
            for group, e in zip(groups[at : at + 64], got, strict=True):
                ids = np.array(e.ids, "<u4")
                raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                out += map(raw.__getitem__, map(slice, [0, *ends], ends)) if len(ends) == len(group) else self._ids(group)
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        plain = [w for w in new if _PLAIN_WORD.fullmatch(w)]
        rest = list(new.difference(plain))
        return dict(zip(plain, self._plain_ids(plain), strict=True)) | dict(zip(rest, self._ids(rest), strict=True))

    def _tails(self, tails: list[str]) -> list[bytes]:
        """Ids of signs behind words; none for none."""
        new = set(tails).difference(self.signs)
        if len(self.signs) + len(new) > _ENCODED_AT_ONCE:
            self.signs, new = {}, set(tails)
        order = list(new)
        self.signs.update(zip(order, self._ids(order), strict=True))
        return list(map(self.signs.__getitem__, tails))

    @staticmethod
    def _lower(text: str | None) -> str | None:
        if not text or text.isascii():
            return text and text.lower()
        try:
            text.encode("latin-1")  # in this range, too, lower case is one letter for one
        except UnicodeEncodeError:
            return text
        return text.lower()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, out of the tables or learned."""
        ids = list(map(self.known.get, words))
        if None in ids:
            absent = {w for w, x in zip(words, ids, strict=True) if x is None}
            new = {w: self.older[w] for w in absent if w in self.older}
            new |= self._learn(absent.difference(new))
            ids = [new[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            if len(self.known) + len(new) > WORD_UNITS:
                self.known, self.older = {}, self.known  # words in use move on to the new table
            self.known.update((w, x) for w, x in new.items() if len(w) <= _LONG_UNIT)
        return ids

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units: those of the word and of the signs behind it, where it is plain."""
        bodies = [u.rstrip(_SIGNS) for u in units]
        bodies = [b if len(b) == len(u) or _PLAIN_WORD.fullmatch(b) else u for b, u in zip(bodies, units, strict=True)]
        tails = self._tails([u[len(b) :] for b, u in zip(bodies, units, strict=True)])
        return [x + t if t else x for x, t in zip(self._words(bodies), tails, strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        lower = pa.array(map(self._lower, texts), pa.large_string())
        # texts with rarer white space than these four are left to the library
        whole = pc.fill_null(pc.match_substring_regex(lower, _OTHER_SPACE), False)
        words = pc.ascii_split_whitespace(pc.if_else(whole, "", lower))
        units = words.flatten().dictionary_encode()
        ids = pa.array(self._units(units.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(units.indices)
        # the ids of all texts lie in a row; those of a text end with its last word's
        ends = np.frombuffer(ids.buffers()[1], np.int64)[words.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in pairwise(ends)]
        rare = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        for k, got in zip(rare, self._ids([texts[k] for k in rare]), strict=True):
            out[k] = got
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class PrefixCounts:
    """Prefix dynamic programming for byte-level BPE.

    For each prefix of a unit the table holds the number of tokens of that
    prefix and its last token. The last token of a prefix is the one token that
    ends there and that the merges leave standing beside the last token of the
    prefix before it, so each entry follows from earlier ones and no prefix is
    encoded anew.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letter = self._letters()
        to_byte = {c: b for b, c in letter.items()}
        self.id_of = {bytes(to_byte[c] for c in word): i for word, i in model["vocab"].items() if all(c in to_byte for c in word)}
        ids = model["vocab"]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        for s in self.specials:  # stands for itself, never a merge
            self.id_of.pop(s.encode(), None)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = (ids[a], ids[b])
            self.rank[key] = order
            self.parts.setdefault(ids[a + b], key)
        self.order = {i: self.rank[p] for i, p in self.parts.items()}
        #: Lengths of the tokens with the same last three bytes, long ones first; shorter tokens may end anywhere.
        self.sizes: dict[bytes, tuple[int, ...]] = {}
        for word in self.id_of:
            if len(word) > 2:
                self.sizes[word[-3:]] = (*self.sizes.get(word[-3:], ()), len(word))
        self.sizes = {tail: (*sorted(set(sizes), reverse=True), 2, 1) for tail, sizes in self.sizes.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.done: dict[bytes, list[int]] = {}
        self.known: dict[str, np.ndarray] = {}
        import regex

        import public_tokenizers

        self.totals: dict[str, int] = {}
        self.piece_totals: dict[str, int] = {}
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.blank_runs = regex.compile(r"\s{2,}")
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

    @staticmethod
    def _letters() -> dict[int, str]:
        """The printable character that stands for each byte in byte-level vocabularies."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        out = {b: chr(b) for b in plain}
        rest = (b for b in range(256) if b not in out)
        return out | {b: chr(256 + n) for n, b in enumerate(rest)}

    def _stand(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Undo the merges of both sides from the latest back; the two must never
        show a pair at their seam that is merged before the next one undone.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        never = len(self.rank) + 1
        bound, a, b, ok = never, left, right, True
        while True:
            seam = self.rank.get((a, b))
            if seam is not None and seam < bound:
                ok = False
                break
            made_a, made_b = self.order.get(a, -1), self.order.get(b, -1)
            if made_a < 0 and made_b < 0:
                break
            # at one rank merges run from left to right, so the right side's is the later one
            if made_a > made_b:
                bound, a = made_a, self.parts[a][1]
            else:
                bound, b = made_b + 1, self.parts[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def _extend(self, raw: bytes, last: list[int], count: list[int]) -> None:
        """Go on with the table of a piece, from the prefix that ``last`` and ``count`` reach, to its end."""
        id_of, sizes, fits, stand = self.id_of, self.sizes, self.fits, self._stand
        for end in range(len(last), len(raw) + 1):
            for size in sizes.get(raw[max(0, end - 3) : end], (2, 1)):
                start = end - size
                token = id_of.get(raw[start:end]) if start >= 0 else None
                if token is not None:
                    if start:
                        left = last[start]
                        ok = fits.get((left, token))
                        if ok is None:
                            ok = stand(left, token)
                        if not ok:
                            continue
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")

    def piece(self, raw: bytes) -> list[int]:
        """Token counts of all prefixes of a piece that the merges see whole."""
        done = self.done.get(raw)
        if done is not None:
            return done
        count = [0]
        self._extend(raw, [-1], count)
        del count[0]
        if len(raw) <= _LONG_UNIT:
            if len(self.done) >= CACHE_UNITS:
                self.done.clear()
            self.done[raw] = count
        return count

    def _piece_totals(self, pieces: set[str]) -> dict[str, int]:
        """The last entry of each piece's table.

        In order of their bytes, so that a table goes on from the prefix that the
        piece has in common with the one before.
        """
        out, before, last, count = {}, b"", [-1], [0]
        for raw, piece in sorted((p.encode(), p) for p in pieces):
            same = 0
            for x, y in zip(before, raw):  # noqa: B905
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self._extend(raw, last, count)
            out[piece] = count[-1]
            before = raw
        return out

    def _unit_totals(self, units: list[str]) -> dict[str, int]:
        """Tokens of each unit: the sum over its pieces, each worked out once."""
        out, cut = {}, {}
        for u in units:
            if u[-1].isspace() or ("<|" in u and self.special and self.special.search(u)):
                out[u] = int(self.unit(u)[-1])
            else:
                cut[u] = self.pieces.findall(u)
        known = self.piece_totals
        wanted = {p for pieces in cut.values() for p in pieces}
        new = self._piece_totals(wanted.difference(known))
        if len(known) + len(new) > CACHE_UNITS:
            self.piece_totals = known = {p: known[p] for p in wanted if p in known}
        known |= new
        for u, pieces in cut.items():
            out[u] = known[pieces[0]] if len(pieces) == 1 else sum(map(known.__getitem__, pieces))
        for p in new:
            if len(p) > _LONG_UNIT:
                del known[p]
        return out

    def _plain(self, text: str) -> list[int]:
        """Counts at the ends of the bytes of a text without special tokens.

        Blanks at the end of a prefix are one piece there, whatever follows, so
        within a run of blanks the counts are those of the run as a piece.
        """
        out: list[int] = []
        done = 0
        for found in self.pieces.findall(text):
            got = self.piece(found.encode())
            out += [done + c for c in got] if done else got
            done = out[-1]
        if "  " in text or not text.isprintable():
            for m in self.blank_runs.finditer(text):
                at, run = len(text[: m.start()].encode()), m[0].encode()
                base = out[at - 1] if at else 0
                out[at : at + len(run)] = [base + c for c in self.piece(run)]
        return out

    def unit(self, text: str) -> np.ndarray:
        """Counts at the ends of the bytes of one unit; the last is the unit's own."""
        got = self.known.get(text)
        if got is None:
            if self.special and "<|" in text and self.special.search(text):
                out: list[int] = []
                at = 0
                for m in [*self.special.finditer(text), None]:
                    base = out[-1] if out else 0
                    part = self._plain(text[at : m.start() if m else len(text)])
                    if m:
                        # a prefix that ends inside the special string is ordinary text as far as that
                        inside = self._plain(text[at : m.end()])
                        start, size = len(text[at : m.start()].encode()), len(m[0].encode())
                        part += inside[start : start + size - 1] + [(part[-1] if part else 0) + 1]
                        at = m.end()
                    out += [base + c for c in part]
            else:
                out = self._plain(text)
            got = np.array(out, np.int32)
            if len(text) <= _LONG_UNIT:
                if len(self.known) >= CACHE_UNITS:
                    self.known.clear()
                self.known[text] = got
        return got

    def units(self, text: str | None) -> list[str]:
        return [] if not text else [text] if _RARE_SPACE.search(text) else _UNIT.findall(text)

    def unit_ends(self, texts: list[str | None]) -> list[tuple[list[str], list[int]]]:
        """The units of each text and the tokens of each unit.

        Their running sum is the prefix table at the ends of units; the last
        entry of a unit's own table is its count, worked out once. Only that
        entry is kept here, and the table is made of its pieces' (see ``piece``).
        """
        cut = [self.units(t) for t in texts]
        totals = self.totals
        new = self._unit_totals(list({u for units in cut for u in units}.difference(totals)))
        if len(totals) + len(new) > CACHE_UNITS:
            keep = {u: totals[u] for units in cut for u in units if u in totals}
            self.totals = totals = keep
        totals |= new
        out = [(units, [totals[u] for u in units]) for units in cut]
        for u in new:
            if len(u) > _LONG_UNIT:
                del totals[u]
        return out

    def prefixes(self, text: str | None) -> np.ndarray:
        """Token counts at the end of each byte of a whole text."""
        parts, done = [], 0
        for u in self.units(text):
            got = self.unit(u)
            parts.append(got + done)
            done += int(got[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


@lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)
