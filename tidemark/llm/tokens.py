"""Token ids of whole Arrow batches by the tokenizers library, each distinct word encoded once.

Tokenizers of the kinds used here (byte-level BPE, BPE with word ends) never join text across the
place where white space follows another character, so a text's ids are those of its stretches
'white space, then other characters', one after the other. A batch is cut there in numpy; stretches
not met before go to the library, separated by one of its special tokens, and all ids come from a
table of bounded size. Stretches are looked up by a hash and then compared byte by byte, so two with
one hash never get each other's ids. Texts with white space outside ASCII, about which programs differ, and
stretches that hold a special token's string go to the library alone.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa

from .words import SPACE, ragged, run_words, texts, words_hashes

#: White space of any kind but space and \t to \r.
ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
ODD_CODES = np.array([0xC285, 0xC2A0, *(int.from_bytes(chr(c).encode()) for c in (0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))], np.uint32)
#: First bytes of such white space.
ODD_LEAD = np.zeros(256, bool)
ODD_LEAD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def has_odd(run: np.ndarray) -> bool:
    at = np.flatnonzero(ODD_LEAD[run])
    if not len(at):
        return False
    first, second, third = (run[np.minimum(at + k, len(run) - 1)].astype(np.uint32) for k in range(3))
    two = first << 8 | second
    return bool((first < 0x20).any() or np.isin(np.where(first == 0xC2, two, two << 8 | third), ODD_CODES).any())


class Encoder:
    """Ids of texts. most: stretches that the table holds before it starts anew."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        special = [(k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.bars = [self._plain_bar(), special[-1][::-1] if special else ("", None)]
        self._clear()

    def _plain_bar(self) -> tuple[str, int | None]:
        """A text that, between stretches that begin with a space, always becomes one id of its own."""
        for bar in ("\n", " |"):
            ids = [self._alone([x])[0].tolist() for x in (" a b", f" a{bar} b", bar)]
            if len(ids[2]) == 1 and ids[1] == [ids[0][0], ids[2][0], *ids[0][1:]]:
                return bar, ids[2][0]
        return "", None

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.held = np.zeros(0, np.uint32), 0
        #: The bytes of each stretch by eights, where they start and how many bytes they are.
        self.bytes, self.bytes_at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _alone(self, many: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(many, add_special_tokens=False)]

    def _joined(self, part: list[str], bar: str, bar_id: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and numbers of ids of each text, from one run of them with bars between; None if a bar went missing."""
        ids = np.array(self.tokenizer.encode_batch_fast([bar.join(part)], add_special_tokens=False)[0].ids, np.uint32)
        bars = ids == bar_id
        ends = np.append(np.flatnonzero(bars), len(ids))
        if len(ends) != len(part):
            return None
        return ids[~bars], np.diff(np.append(-1, ends)) - 1

    def _ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of stretches that hold no bar."""
        plain = self.bars[0][0].strip(" ")
        bar, bar_id = self.bars[0] if all(s[0] == " " and plain not in s for s in stretches) else self.bars[1]
        got = self._joined(stretches, bar, bar_id) if bar_id is not None and not any(bar in s for s in stretches) else None
        if got is None:
            each = self._alone(stretches)
            got = np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        return got

    def _learn(self, keys: np.ndarray, stretches: list[bytes], eights: np.ndarray, n_eights: np.ndarray) -> None:
        words = [s.decode() for s in stretches]
        mark = self.bars[0][0].strip(" ")
        kind = np.array([0 if s[0] == " " and mark not in s else 2 if self.bars[1][0] and self.bars[1][0] in s else 1 for s in words])
        order, parts = np.argsort(kind, kind="stable"), []
        for k in range(3):
            mine = order[kind[order] == k]
            parts += [self._ids([words[i] for i in mine[j : j + 20_000]]) for j in range(0, len(mine), 20_000)]
        n = np.concatenate([p[1] for p in parts])
        at = self.held + np.cumsum(n) - n
        self.held += int(n.sum())
        self.pool = np.concatenate([self.pool, *(p[0] for p in parts)])
        bytes_at = (len(self.bytes) + np.cumsum(n_eights) - n_eights)[order]
        self.bytes = np.concatenate([self.bytes, eights])
        size = np.array([len(s) for s in stretches], np.int64)[order]
        every = [np.concatenate([x, y.astype(x.dtype)]) for x, y in ((self.keys, keys[order]), (self.at, at), (self.n, n), (self.bytes_at, bytes_at), (self.size, size))]
        order = np.argsort(every[0], kind="stable")
        self.keys, self.at, self.n, self.bytes_at, self.size = (x[order] for x in every)

    def _others(self, where: np.ndarray, eights: np.ndarray, n_eights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which stretches aren't those that the table holds at where."""
        same = self.size[where] == lengths
        held = self.bytes[ragged(self.bytes_at[where].astype(np.int64), np.where(same, n_eights, 0))]
        differs = np.zeros(len(eights), bool)
        differs[np.repeat(same, n_eights)] = held != eights[np.repeat(same, n_eights)]
        return np.flatnonzero(~same | np.logical_or.reduceat(differs, np.cumsum(n_eights) - n_eights))

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.searchsorted(self.keys, keys)
        return where, (self.keys[np.minimum(where, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids before each text (one more than texts)."""
        run, offsets = texts(column)
        if has_odd(run):
            return self._with_odd(column)
        if not len(run):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = SPACE[run]
        cut = np.zeros(len(run), bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(run)))
        eights, n_eights = run_words(run, starts, lengths)
        keys, first, which = np.unique(words_hashes(eights, n_eights, lengths), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._clear()
        where, known = self._known(keys)
        stretch = lambda k: run[starts[k] : starts[k] + lengths[k]].tobytes()
        if not known.all():
            new = first[~known]
            each = np.cumsum(n_eights) - n_eights
            self._learn(keys[~known], [stretch(k) for k in new.tolist()], eights[ragged(each[new], n_eights[new])], n_eights[new])
            where, _ = self._known(keys)
        at, n, pool = self.at[where][which].astype(np.int64), self.n[where][which].astype(np.int64), self.pool
        for k in self._others(where[which], eights, n_eights, lengths).tolist():
            ids, _ = self._ids([stretch(k).decode()])
            at[k], n[k], pool = len(pool), len(ids), np.concatenate([pool, ids])
        before = np.concatenate([[0], np.cumsum(n)])
        return pool[ragged(at, n)], before[np.searchsorted(starts, offsets)]

    def _with_odd(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values = [x or "" for x in column.to_pylist()]
        odd = np.array([bool(ODD.search(x)) for x in values])
        plain, bounds = self(pa.array(["" if o else x for x, o in zip(values, odd)], pa.string()))
        parts = [plain[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for k, ids in zip(np.flatnonzero(odd), self._alone([values[k] for k in np.flatnonzero(odd)])):
            parts[k] = ids
        return np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer and worker process, so tasks that follow find the table filled."""
    return Encoder(path)
