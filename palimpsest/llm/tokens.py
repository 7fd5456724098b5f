"""Exact encoding with a public tokenizer, each distinct piece encoded once a worker.

A text is cut only where the tokenizer's own rules end a token whatever follows, so
that the pieces' ids joined are the ids of the whole text. Arrow cuts a column of
texts and numbers its distinct pieces; the tokenizer sees new pieces alone, and ids
are gathered as arrays. Texts that hold anything outside those rules are given to the
tokenizer whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.llm.common import tokenizer_path

#: Pieces, and their ids, that a worker remembers, about; beyond that only those stay that
#: more than one call has met.
REMEMBERED, REMEMBERED_IDS = 600_000, 4_800_000
#: Pieces that are given to the tokenizer at once: what it returns for each takes some 1 kB.
AT_ONCE = 4096
#: Words in a text of lines.
LINES = 128
#: A longer piece is encoded each time it occurs.
LONGEST = 64

#: Stands at the cuts; a text that holds it is encoded whole.
_CUT = "\x01"
# white space but space and line end (a superset of what the tokenizers hold for it), and
# the one letter whose lower case is two characters, which the library splits by its
# place, composed or not
_ODD = "[\\x{130}\\x{307}\\t\\x0b\\f\\r\\x01\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
# marks behind a letter, up to the next cut: they are one token's worth of pattern
_MARKS = f"(\\p{{L}})([.,;:!?]+)({_CUT}|$)"
_RUNS = re.compile(r"\s+|\S+")
# white space but one space before a word
_SPACES = re.compile(r"(?!^ \S)\s|^$")
# whether there may be any among lines
_APART = re.compile(r"[ \n]\n|[^\n] |\n  ")


def load(name: str):
    """The tokenizer without truncation and padding, one thread a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


class PieceEncoder:
    """Ids of whole texts, equal to tokenizer.encode(text, add_special_tokens=False).

    spaced: the tokenizer keeps white space, joined to the next word where it is one
    space (byte-level pattern); else white space is dropped between words and case is
    folded."""

    def __init__(self, name: str, spaced: bool):
        self.tok, self.spaced = load(name), spaced
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # one pass over a text finds all that the cuts do not hold for
        self.odd = "|".join([_ODD, *map(re.escape, self.special), *(["[ \n][ \n]"] if spaced else [])])
        if spaced:
            (self.line,) = self.tok.encode("\n", add_special_tokens=False).ids
        self._start()

    def _forget(self) -> None:
        """Keep the pieces that more than one call has met, and none where those are too many."""
        kept = {k: p for k, p in self.known.items() if self.seen[p] > 1}
        place = np.fromiter(kept.values(), dtype=np.int64, count=len(kept))
        if 2 * len(kept) > REMEMBERED or 2 * int(self.size[place].sum()) > REMEMBERED_IDS:
            return self._start()
        ids = self._gather(place)
        size, n = self.size[place], len(kept)
        self._start()
        self._add(list(kept), ids, size)
        self.seen[:n] = 1  # to stay once more, a piece is met again

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.start, self.size, self.seen, self.pieces = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32), 0

    def release(self) -> None:
        """Forget all pieces: a worker outlives its tasks, and what it holds stays beside those
        of other queries."""
        self._start()
        pa.default_memory_pool().release_unused()

    def _gather(self, place: np.ndarray) -> np.ndarray:
        """Ids of the pieces at these places, one after the other."""
        sizes = self.size[place]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[place] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _add(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        total, n = len(ids), self.pieces + len(new)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(total, len(self.ids)), dtype="<u4")))
        if n > len(self.start):
            more = max(len(new), len(self.start))
            self.start, self.size, self.seen = (np.concatenate((x, np.zeros(more, dtype=x.dtype))) for x in (self.start, self.size, self.seen))
        self.ids[self.used : self.used + total] = ids
        self.start[self.pieces : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.pieces : n] = sizes
        self.known.update(zip(new, range(self.pieces, n), strict=True))
        self.used, self.pieces = self.used + total, n

    def _learn(self, new: list[str]) -> None:
        if self.spaced:  # words are told to the tokenizer as lines: one result for many of them
            alone = [k for k in new if _SPACES.search(k)] if _APART.search("\n".join(["", *new, ""])) else []
            new = list(set(new).difference(alone)) if alone else new
            for at in range(0, len(new), AT_ONCE):
                some = new[at : at + AT_ONCE]
                texts = ("\n".join([*some[k : k + LINES], ""]) for k in range(0, len(some), LINES))
                got = [self.tok.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts]
                ids = np.fromiter(chain.from_iterable(got), dtype="<u4", count=sum(map(len, got)))
                line = ids == self.line
                ends = np.flatnonzero(line)
                if len(ends) != len(some):
                    raise ValueError("the tokenizer joins line ends with words")
                self._add(some, ids[~line], np.diff(ends, prepend=-1) - 1)
            new = alone
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            got = [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            self._add(some, np.fromiter(chain.from_iterable(got), dtype="<u4", count=int(sizes.sum())), sizes)

    def _places(self, keys: list[str]) -> np.ndarray:
        """Where each piece's ids stand, learning those that are new."""
        found = self._find(keys)
        if (found < 0).any():
            if len(self.known) + int((found < 0).sum()) > REMEMBERED or self.used > REMEMBERED_IDS:
                self._forget()
                found = self._find(keys)
            missing = np.flatnonzero(found < 0).tolist()
            unknown = [keys[m] for m in missing]
            new = list(dict.fromkeys(unknown))
            self._learn(new)
            found[missing] = self._find(unknown)
            for k in new:
                if len(k) > LONGEST:
                    del self.known[k]
        self.seen[found] += 1
        return found

    def _find(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts one after the other, and how many each has.
        A null text counts as empty."""
        text = pc.fill_null(column, "")
        odd = pc.match_substring_regex(text, self.odd)
        plain = pc.if_else(odd, "", text)
        if self.spaced:
            cut = pc.replace_substring(pc.replace_substring(plain, " ", f"{_CUT} "), "\n", f"{_CUT}\n{_CUT}")
        else:
            cut = pc.replace_substring(pc.replace_substring(pc.ascii_lower(plain), "\n", _CUT), " ", _CUT)
        lists = pc.split_pattern(pc.replace_substring_regex(cut, _MARKS, f"\\1{_CUT}\\2\\3"), _CUT)
        coded = lists.flatten().dictionary_encode()
        place = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        ids = self._gather(place)
        at = np.concatenate(([0], np.cumsum(self.size[place])))[lists.offsets.to_numpy()]
        counts = np.diff(at)
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            parts, before = [], 0
            for r in rows.tolist():
                whole = self._whole(text[r].as_py())
                parts += [ids[before : at[r]], whole]
                before, counts[r] = at[r], len(whole)
            ids = np.concatenate([*parts, ids[before:]])
        return ids, counts

    def _whole(self, text: str) -> np.ndarray:
        """A text by runs of white space where the rules allow it, else in one piece."""
        if self.spaced and not re.search(r"[^\S \n]|\x01", text) and not any(s in text for s in self.special):
            return self._gather(self._places(self.runs(text)))
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    @staticmethod
    def runs(text: str) -> list[str]:
        """Pieces with runs of white space: all of a run but its last character is one
        token, the last goes to the next word if it is a space, else stands alone; at
        the end of the text the run is one token."""
        out, held = [], ""
        found = _RUNS.findall(text)
        for k, run in enumerate(found):
            if not run.isspace():
                out.append(held + run)
                held = ""
            elif k == len(found) - 1:
                out.append(run)
            else:
                if len(run) > 1:
                    out.append(run[:-1])
                held = " " if run[-1] == " " else ""
                if not held:
                    out.append(run[-1])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array a text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several texts with end_id behind each text's, and the new counts."""
    counts = counts + 1
    ends = np.cumsum(counts) - 1
    out = np.empty(len(ids) + len(counts), dtype="<u4")
    own = np.ones(len(out), dtype=bool)
    own[ends] = False
    out[own], out[ends] = ids, end_id
    return out, counts


@lru_cache(maxsize=4)
def encoder(name: str, spaced: bool) -> PieceEncoder:
    """One encoder a worker process, kept between tasks."""
    return PieceEncoder(name, spaced)


def byte_bpe() -> PieceEncoder:
    return encoder("byte_bpe_50k.json", True)


def word_bpe() -> PieceEncoder:
    return encoder("word_bpe_49k.json", False)
