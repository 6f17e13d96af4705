"""Operator 3, SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers with the characters up to the next marker. If no piece of the
vocabulary has a marker behind another character, no merge crosses a chunk's start, so a chunk has the
same ids wherever it stands: each distinct one is segmented once and ids are joined by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bidflow.llm.shared import pieces, table, text_of

MARK = "▁"
#: Chunks kept per task, and the longest one kept; both bound memory, others are segmented once per piece of a batch.
TABLE_CHUNKS = 100_000
LONGEST_KEPT = 64
PIECE = 1 << 20
END_ID = 2


def chunks_are_independent(model: bytes) -> bool:
    """Whether the vocabulary and the normaliser allow segmentation by chunk."""
    import sentencepiece

    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(model)
    rule = spec.normalizer_spec
    plain = rule.name == "identity" and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces
    plain = plain and rule.add_dummy_prefix and rule.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return plain and not any(re.search(f"[^{MARK}]{MARK}", name) for name in names) and not any(p.type == 4 for p in spec.pieces)


class ChunkTable:
    """Ids of each distinct chunk, as text."""

    def __init__(self, model: bytes, by_chunk: bool):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_chunk = by_chunk
        self.known: dict[str, str] = {}
        #: Decoded forms of chunks that do not decode to themselves.
        self.odd: dict[str, str] = {}
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        # What a piece decodes to; None for byte pieces, which decode together, and for control pieces.
        special = [self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) for i in range(self.sp.vocab_size())]
        self.surface = [None if odd else self.sp.id_to_piece(i).replace(MARK, " ") for i, odd in enumerate(special)]

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first marker."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[-1] != " " and text[0] != " ":
            return text.split(" ")
        return [c[1:] for c in self.split.findall(MARK + text.replace(" ", MARK))]

    def decoded(self, ids: list[int]) -> str:
        """The decoded form of a chunk, without the space of its first marker."""
        parts = [self.surface[i] for i in ids]
        return self.sp.decode(ids) if None in parts else "".join(parts)[1:]

    def look_up(self, chunks: set[str]) -> dict[str, str]:
        """Ids of chunks; those that are not known are segmented, each once."""
        missing = list(chunks.difference(self.known))
        plain = [c.replace(MARK, " ") for c in missing]
        found = {}
        for chunk, text, ids in zip(missing, plain, self.sp.encode(plain, num_threads=1)):
            if not chunk:
                ids = [self.sp.piece_to_id(MARK)]
            found[chunk] = " ".join(map(str, ids))
            back = self.decoded(ids)
            if back != text:
                self.odd[chunk] = back
        room = TABLE_CHUNKS - len(self.known)
        self.known.update((c, found[c]) for c in missing[: max(0, room)] if len(c) <= LONGEST_KEPT)
        return found

    def encode(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """For each text its ids joined by spaces with the end id, their number, and the decoded text."""
        if not self.by_chunk:
            for text in texts:
                ids = self.sp.encode(text)
                yield " ".join(map(str, [*ids, END_ID])), len(ids) + 1, self.sp.decode(ids)
            return
        split = [self.chunks(text) for text in texts]
        found, known = self.look_up(set().union(*split)), self.known
        for text, chunks in zip(texts, split):
            joined = " ".join([known[c] if c in known else found[c] for c in chunks] + [str(END_ID)])
            if self.odd and not self.odd.keys().isdisjoint(chunks):
                back = " ".join([self.odd.get(c, c.replace(MARK, " ")) for c in chunks])
            else:
                back = text.replace(MARK, " ")
            yield joined, joined.count(" ") + 1, back
        self.odd = {c: v for c, v in self.odd.items() if c in known}


def id_lists(joined: list[str], counts: list[int]) -> pa.Array:
    flat = np.fromstring(" ".join(joined), np.int32, sep=" ")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, the end id last; null unless asked for), ids_sha256, decoded_sha256.

    Null texts count as empty and have the end id only. Other columns are ignored, rows are independent,
    repeated ones give repeated results. No shuffle; a task holds one batch and a table of bounded size.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    by_chunk = chunks_are_independent(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_table = ChunkTable(model, by_chunk)
        sha = hashlib.sha256
        for batch in pieces(batches, "text", PIECE):
            ids, counts, digests, decoded = [], [], [], []
            for joined, n, back in chunk_table.encode(batch.column(1).to_pylist()):
                counts.append(n)
                digests.append(sha(joined.encode()).hexdigest())
                decoded.append(sha(back.encode()).hexdigest())
                ids.append(joined)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()), id_lists(ids, counts) if with_ids else pa.nulls(len(ids), pa.list_(pa.int32())),
                    pa.array(digests, pa.string()), pa.array(decoded, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return rows.drop("ids")
