"""Word-level reuse for the tokenizers library: pieces that its pre-tokenizer never joins are encoded once.

Texts are cut at blanks and told apart by Arrow, only different pieces go to the library, and NumPy puts
their ids together, so the work in Python follows the number of different pieces of a slice of texts.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP = 500_000  # a worker process keeps so many different pieces, and as many that were used before those
TOGETHER = 4096  # pieces whose encodings the library holds at a time
JOINED = 512  # plain pieces in one text for the library
SLICE = 1 << 22  # bytes of texts that are cut into words together
#: The characters that \s of the vocabularies' patterns takes.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: A blank after a character that is no white space starts a new piece of the byte-level pattern.
_PIECE = re.compile(f"(?<=[^{SPACES}])(?= )")
#: Plain pieces: for byte level a blank, then no white space; else words of letters, then those with one more mark,
#: which the pattern parts.
_PLAIN_KEPT = (f"^ [^{SPACES}]+$",)
_PLAIN_DROPPED = ("^[A-Za-zß-öø-ÿ]+$", "^[A-Za-zß-öø-ÿ]+[.,;:!?]$")
_ODD_BLANK = f"[{SPACES}] |^ | $"


def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def worker_state() -> dict:
    """What a Python worker keeps over its tasks, in a module of its own."""
    import sys
    import types

    return sys.modules.setdefault("caselake_worker_state", types.ModuleType("caselake_worker_state")).__dict__


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all rows, one after the other."""
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


class _Pieces:
    """ids of pieces: number of each piece, and where its ids stand."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def __len__(self) -> int:
        return len(self.number)

    def numbers(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, texts, itertools.repeat(-1)), np.int64, len(texts))

    def add(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.number)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(texts) > len(self.start):
            self.start, self.size = (np.concatenate([c, np.zeros_like(c)]) for c in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(texts)] = sizes
        self.start[n : n + len(texts)] = self.used + np.cumsum(sizes) - sizes
        self.number.update(zip(texts, range(n, n + len(texts))))
        self.used += len(ids)


class PieceEncoder:
    """ids of whole texts, equal to the library's encode(text, add_special_tokens=False).

    ``blank`` says what the vocabulary does with blanks: "kept" (byte level: a blank starts the next piece)
    or "dropped" (white space only separates). Both cut at blanks only, where no pre-token can go across.
    A text that holds one of the special tokens' strings goes to the library whole. Null texts have no ids."""

    def __init__(self, path: str, blank: str, keep: int = KEEP):
        self.blank, self.keep = blank, keep
        kept = worker_state().setdefault("encoders", {})
        if (path, blank) not in kept:
            kept[path, blank] = {"tokenizer": load(path), "pieces": _Pieces(), "old": _Pieces()}
        self.kept = kept[path, blank]
        self.tokenizer = self.kept["tokenizer"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, texts: list[str]) -> list[list[int]]:
        groups = (texts[k : k + TOGETHER] for k in range(0, len(texts), TOGETHER))
        return [e.ids for g in groups for e in self.tokenizer.encode_batch_fast(g, add_special_tokens=False)]

    def _joined(self, pieces: list[str], edge: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece), encoded many at a time: each piece has ``turns`` ids that are edges."""
        flat, sizes = [], []
        kept = self.blank == "kept"
        for k in range(0, len(pieces), JOINED * 8):
            groups = [pieces[g : g + JOINED] for g in range(k, min(k + JOINED * 8, len(pieces)), JOINED)]
            for group, ids in zip(groups, self._library([("" if kept else " ").join(g) for g in groups])):
                ids = np.array(ids, np.uint32)
                at = np.flatnonzero(edge[ids])
                # byte level: an edge begins a piece; else it ends one
                ends = np.append(at[turns::turns], len(ids)) if kept else at[turns - 1 :: turns] + 1
                if len(ends) != len(group) or ends[-1] != len(ids):
                    raise ValueError("the vocabulary does not keep pieces apart")
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(flat), np.concatenate(sizes)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece); plain pieces share calls of the library, since a call costs more than a word."""
        kinds = _PLAIN_KEPT if self.blank == "kept" else _PLAIN_DROPPED
        edge = self.kept.get("edge")
        if edge is None:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            edge = self.kept["edge"] = np.zeros(max(vocabulary.values()) + 1, bool)
            edge[[k for t, k in vocabulary.items() if (t.startswith("\u0120") if self.blank == "kept" else t.endswith("</w>"))]] = True
        left, column, size, parts, order = np.ones(len(pieces), bool), pa.array(pieces, pa.string()), np.zeros(len(pieces), np.int64), [], []
        for turns, kind in enumerate(kinds, 1):
            rows = np.flatnonzero(pc.match_substring_regex(column, kind).to_numpy(zero_copy_only=False) & left)
            if len(rows):
                left[rows] = False
                ids, size[rows] = self._joined([pieces[k] for k in rows.tolist()], edge, turns)
                parts.append(ids)
                order.append(rows)
        rows = np.flatnonzero(left)
        singly = self._library([pieces[k] for k in rows.tolist()])
        size[rows] = [len(x) for x in singly]
        order = np.concatenate([*order, rows])
        flat = np.concatenate([*parts, np.fromiter(itertools.chain.from_iterable(singly), np.uint32)])
        start = np.empty(len(pieces), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return ragged(flat, start, size), size

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of different pieces in the newer generation; the older one's are taken over, others are encoded."""
        if len(self.kept["pieces"]) > self.keep:
            self.kept["old"], self.kept["pieces"] = self.kept["pieces"], _Pieces()
        known, old = self.kept["pieces"], self.kept["old"]
        number = known.numbers(pieces)
        for source in ("old", "library"):
            rows = np.flatnonzero(number < 0)
            wanted = [pieces[k] for k in rows.tolist()]
            if source == "old":
                there = old.numbers(wanted)
                rows, there = rows[there >= 0], there[there >= 0]
                wanted, ids, sizes = [pieces[k] for k in rows.tolist()], ragged(old.flat, old.start[there], old.size[there]), old.size[there]
            elif wanted:
                ids, sizes = self._pieces(wanted)
            if wanted:
                at = len(known)
                known.add(wanted, ids, sizes)
                number[rows] = np.arange(at, at + len(wanted))
        return number

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) for texts without special strings or odd blanks."""
        words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        index, offsets = coded.indices.to_numpy().astype(np.int64), offsets - offsets[0]
        if self.blank == "kept":
            # the first word of a text has no blank before it
            first, own = np.unique(index[offsets[:-1]], return_inverse=True)
            pieces = [" " + w for w in coded.dictionary.to_pylist()]
            firsts = [pieces[k][1:] for k in first.tolist()]
            index[offsets[:-1]] = len(pieces) + own
            both = dict.fromkeys(pieces)
            again = [k for k, w in enumerate(firsts) if w in both]
            number = self._numbers(pieces + [w for w in firsts if w not in both])
            if again:
                # a first word that is also a later one with its blank
                place = {w: k for k, w in enumerate(pieces)}
                fill, at = np.zeros(len(firsts), np.int64), np.setdiff1d(np.arange(len(firsts)), again)
                fill[at], fill[again] = number[len(pieces) :], number[[place[firsts[k]] for k in again]]
                number = np.concatenate([number[: len(pieces)], fill])
        else:
            number = self._numbers(coded.dictionary.to_pylist())
        known, row = self.kept["pieces"], number[index]
        size = known.size[row]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[offsets]
        return ragged(known.flat, known.start[row], size), np.diff(ends)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if self.blank == "dropped":
            texts = pc.replace_substring(texts, "\n", " ")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if self.blank == "kept":
            whole |= pc.match_substring_regex(texts, _ODD_BLANK).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_words(texts)
        size, parts = np.zeros(len(texts), np.int64), {}
        for k in np.flatnonzero(whole).tolist():
            parts[k] = self._one(texts[k].as_py())
            size[k] = len(parts[k])
        ids, size[~whole] = self._by_words(texts.filter(pa.array(~whole)))
        end = np.cumsum(size)
        out = np.empty(end[-1], np.uint32)
        out[np.repeat(~whole, size)] = ids
        for k, x in parts.items():
            out[end[k] - len(x) : end[k]] = x
        return out, size

    def _one(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self._library([text])[0], np.uint32)
        different, row = np.unique(np.array(_PIECE.split(text), object), return_inverse=True)
        number = self._numbers(different.tolist())
        known = self.kept["pieces"]
        return ragged(known.flat, known.start[number][row], known.size[number][row])

    def encode_array(self, texts: pa.Array):
        """Slices (texts' number, ids, number of ids of each text) of a string array, in its order."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // SLICE
        at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, z in zip(at, at[1:]):
            if z > a:
                yield (z - a, *self._slice(texts.slice(a, z - a)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        out: list[bytes] = []
        for _, ids, size in self.encode_array(pa.array(texts, pa.string())):
            data, end = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(size)).tolist()
            out += [bytes(data[a:z]) for a, z in zip([0, *end], end)]
        return out
