"""Operator 7, token counts with a whole-token shortcut.

Before any data is read, each vocabulary string is shown to encode alone as one token, or left out. A
pre-token among the proven ones counts 1 without merging; the others are merged once per task and kept.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bidflow.llm.shared import pieces, table, text_of

#: Pre-tokens kept per task beside the proven ones, and the longest one kept.
TABLE_WORDS = 400_000
LONGEST_KEPT = 64
PIECE = 1 << 20
#: Texts of these characters are split here; the library takes the others whole, since Unicode tables differ
#: between versions of libraries. Covers Latin letters and general punctuation.
PLAIN = r"[\x00-ɏ̀-ͯḀ-ỿ‐-‧‰-⁞₠-₿]*"
# The pattern that the vocabulary file itself gives for its pre-tokens.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def whole_tokens(tokenizer, vocabulary: dict[str, int], suffix: str) -> frozenset[str]:
    """Pre-tokens that the tokenizer itself encodes as exactly one token."""
    letters = byte_letters()
    words = []
    for name in vocabulary:
        if name.endswith(suffix) and all(c in letters for c in name[: -len(suffix)]):
            try:
                words.append(bytes(letters[c] for c in name[: -len(suffix)]).decode())
            except UnicodeDecodeError:
                continue
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, encoded) if w and len(e.ids) == 1)


class Counter:
    """Counts tokens of texts exactly as the library does."""

    def __init__(self, definition: str, proven: frozenset[str], split: bool, special: tuple[str, ...], suffix: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.proven, self.split, self.special = proven, split, special
        self.words, self.plain = regex.compile(WORDS), regex.compile(PLAIN)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for name, i in vocabulary.items() if suffix and name.endswith(suffix)]] = True
        self.merged: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def merge(self, words: list[str]) -> dict[str, int]:
        """Token counts of pre-tokens, encoded together: the last token of each ends with the suffix."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) if len(ids) else ids
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids) - 1):
            return {w: self.whole(w) for w in words}
        return dict(zip(words, np.diff(ends, prepend=-1).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        out, split = [0] * len(texts), {}
        proven, known = self.proven, self.merged
        for i, text in enumerate(texts):
            if not self.split or not self.plain.fullmatch(text) or any(s in text for s in self.special):
                out[i] = self.whole(text)
            else:
                found = self.words.findall(unicodedata.normalize("NFC", text).lower())
                rest = [w for w in found if w not in proven]
                out[i] = len(found) - len(rest)
                split[i] = rest
        new = self.merge(list(set().union(*split.values()).difference(known)))
        for i, rest in split.items():
            out[i] += sum([known[w] if w in known else new[w] for w in rest])
        room = TABLE_WORDS - len(known)
        known.update(item for item in list(new.items())[: max(0, room)] if len(item[0]) <= LONGEST_KEPT)
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit).

    Null texts count as empty: no bytes, no tokens. Other columns are ignored, repeated rows give
    repeated results. No shuffle; a task holds one batch and tables of bounded size.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    parts = json.loads(definition)
    special = tuple(t["content"] for t in parts["added_tokens"])
    suffix = parts["model"].get("end_of_word_suffix") or ""
    rules = [r["type"] for r in (parts.get("normalizer") or {}).get("normalizers", [])]
    split = bool(suffix) and FILE_PATTERN in json.dumps(parts["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
    split = split and rules == ["NFC", "Replace", "Lowercase"]
    proven = whole_tokens(Tokenizer.from_str(definition), parts["model"]["vocab"], suffix) if split else frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(definition, proven, split, special, suffix)
        for batch in pieces(batches, "text", PIECE):
            texts = batch.column(1).to_pylist()
            n = counter.counts(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
