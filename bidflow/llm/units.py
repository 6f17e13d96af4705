"""Token ids of a byte-level BPE (A) and a SentencePiece BPE (B) through a table of distinct units.

A unit starts at a space behind a character that is no white space. Neither tokenizer joins bytes across such
a place, so a unit has the same tokens wherever it stands and is encoded once.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from bidflow.llm.fragments import Tokens, expanded
from bidflow.llm.pieces import MARK, chunks_are_independent
from bidflow.llm.token_counts import byte_letters

#: Units kept per task, the first ones met. A unit longer than LONGEST_KEPT is not, which bounds the table's bytes.
TABLE_UNITS = 200_000
LONGEST_KEPT = 64

_GAP = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def units_of(text: str) -> list[str]:
    """The units of a text behind the space that both tokenizers put before it, each without its first space."""
    if not text:
        return []
    if _GAP.search(" " + text):
        return [u[1:] for u in _CUT.split(" " + text)]
    return text.split(" ")


class Tokenizers:
    """The two tokenizers, the bytes of their tokens, and the table of units."""

    def __init__(self, a_definition: bytes, b_model: bytes):
        import sentencepiece
        import zstandard
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(zstandard.decompress(a_definition).decode())
        # Special strings inside texts are ordinary text.
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=zstandard.decompress(b_model))
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.known: dict[str, int] = {}
        self.added: list[str] = []
        self.alone = 0
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.cuts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.right = np.zeros(0, bool)

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of units for A and B, how many each has, and whether the bytes of both are the unit's."""
        raw = [b" " + u.encode() for u in units]
        ends = np.cumsum([len(r) for r in raw])
        joined = b"".join(raw)
        text = joined.decode()
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        # A lone space at the end of a text: the library takes no empty text.
        b = np.array(self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.b.piece_to_id(MARK)], np.int64)
        if self._same(a, b, joined):
            return [a, b], [np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="right"), prepend=0) for ids, size in ((a, self.a_size), (b, self.b_size))], np.ones(len(units), bool)
        # Some unit's bytes are not kept: find it by encoding the two halves.
        if len(units) == 1:
            return [a, b], [np.array([len(a)]), np.array([len(b)])], np.zeros(1, bool)
        half = len(units) // 2
        left, right = self.encode(units[:half]), self.encode(units[half:])
        return [np.concatenate(p) for p in zip(left[0], right[0])], [np.concatenate(p) for p in zip(left[1], right[1])], np.concatenate([left[2], right[2]])

    def _same(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        return b"".join([self.a_bytes[i] for i in a.tolist()]) == raw and b"".join([self.b_bytes[i] for i in b.tolist()]) == raw

    def look_up(self, split: list[list[str]]) -> None:
        """Puts the units of texts into the table, up to its size for longer than until `forget`."""
        new = set(chain.from_iterable(split)).difference(self.known)
        # Only units that end with a visible character keep their tokens when another one follows.
        alone = [u for u in new if not u or u[-1].isspace() or MARK in u]
        together = list(new.difference(alone))
        # Long units come last, so that `forget` finds them behind the ones to keep.
        self.added = sorted(together, key=len) + alone
        together, self.alone = self.added[: len(together)], len(alone)
        found = [self.encode(units) for units in [together[i : i + 20_000] for i in range(0, len(together), 20_000)] + [[u] for u in alone]]
        self.known.update(zip(self.added, range(len(self.right), len(self.right) + len(new))))
        self.right = np.concatenate([self.right, *[right for _, _, right in found]])
        for k in (0, 1):
            self.ids[k] = np.concatenate([self.ids[k], *[ids[k] for ids, _, _ in found]])
            counts = np.concatenate([np.zeros(0, np.int64), *[counts[k] for _, counts, _ in found]])
            self.cuts[k] = np.concatenate([self.cuts[k], self.cuts[k][-1] + np.cumsum(counts)])

    def forget(self) -> None:
        """Drops the units of the last texts that are beyond the table's size or too long to keep."""
        before = len(self.right) - len(self.added)
        short = sum(len(u) <= LONGEST_KEPT for u in self.added[: len(self.added) - self.alone])
        keep = max(before, min(before + short, TABLE_UNITS))
        for unit in self.added[keep - before :]:
            del self.known[unit]
        self.added, self.alone = [], 0
        self.right = self.right[:keep]
        for k in (0, 1):
            self.cuts[k] = self.cuts[k][: keep + 1]
            self.ids[k] = self.ids[k][: self.cuts[k][-1]]

    def tokens(self, split: list[list[str]]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of texts given by their units, where those of each start for A and for B, and which texts keep their bytes.

        Texts that do not, or that are empty, have no tokens.
        """
        self.look_up(split)
        sizes = np.array([len(units) for units in split], np.int64)
        known = self.known
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        wrong = np.concatenate([[0], np.cumsum(~self.right[at])])
        fine = (wrong[ends[1:]] == wrong[ends[:-1]]) & (sizes > 0)
        at = at[np.repeat(fine, sizes)]
        ends = np.concatenate([[0], np.cumsum(np.where(fine, sizes, 0))])
        out, runs = [], []
        for k, size in ((0, self.a_size), (1, self.b_size)):
            number = np.diff(self.cuts[k])[at]
            ids = self.ids[k][expanded(self.cuts[k][at], number)]
            out += [ids, size[ids]]
            runs.append(np.concatenate([[0], np.cumsum(number)])[ends])
        self.forget()
        return Tokens(*out), runs[0], runs[1], fine


def load(a_path: str, b_path: str) -> tuple[bytes, bytes]:
    """The definitions of both tokenizers, compressed; fails if units would not be independent of each other.

    Spark ships a function of over a megabyte as a broadcast of its own, which each executor writes to disk
    again whenever its memory has dropped it; compressed, both definitions travel inside the task.
    """
    import zstandard

    with open(a_path, "rb") as f:
        a = f.read()
    with open(b_path, "rb") as f:
        b = f.read()
    parts = json.loads(a)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if parts["normalizer"] or not plain.items() <= parts["pre_tokenizer"].items() or not chunks_are_independent(b):
        raise ValueError("units are independent for a plain byte-level BPE and a piece BPE whose pieces do not cross white space")
    return zstandard.compress(a, 19), zstandard.compress(b, 19)
