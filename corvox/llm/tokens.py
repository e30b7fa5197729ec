"""Token counts of whole texts by overlapping chunks.

A text of more than CHUNK characters is encoded in chunks that overlap, each with the offsets
of its pieces. Two neighbours are spliced at a boundary that both have in the overlap and that
is proven stable: no piece of the vocabulary holds the two characters on its sides next to
each other, so no merge crosses it and what lies left and right of it is encoded alike
whatever else stands there. If an overlap has none, it is widened, up to the rest of the text.
A text of one chunk has no boundary to splice at.

Cases: null or empty text has no tokens. Texts of any length are counted whole. Repeated rows
and ties have rows each. An empty table gives an empty result; extra columns, whatever their
names, are not read. A model that normalises texts could join across a cut and is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

LIMIT = 4096
CHUNK, OVERLAP = 4_000, 96
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
SPACE = "▁"


class Counter:
    """Counts of tokens by a sentencepiece model file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        with open(path, "rb") as f:
            spec = proto.ModelProto.FromString(f.read()).normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError(f"{path} normalises texts, so chunks of a text cannot be spliced")
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.joined = {x[i : i + 2] for x in names for i in range(len(x) - 1)}

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def ends(self, text: str, a: int, b: int) -> list[int]:
        """Offsets in the text at which the pieces of text[a:b] end. The model tells them in bytes."""
        part = text[a:b]
        ends = np.array([p.end for p in self.model.encode(part, return_type="proto").pieces], np.int64)
        points = np.cumsum((np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80)
        return (a + np.concatenate([[0], points])[ends]).tolist()

    def spliced(self, text: str) -> int:
        """Tokens of a text of several chunks."""
        total, start, a = 0, -1, 0  # counted up to start; the current chunk begins at a
        overlap, b = self.overlap, min(len(text), self.chunk)
        left = self.ends(text, a, b)
        while b < len(text):
            low = max(b - overlap, start + 1)
            right_a = max(low - 1, 0)
            right_b = min(len(text), right_a + max(self.chunk, 2 * overlap))
            right = self.ends(text, right_a, right_b)
            common = [p for p in sorted(set(left) & set(right)) if low <= p < b and self.stable(text, p)]
            if not common:
                if overlap >= len(text):
                    return len(self.model.encode(text))
                overlap *= 2
                if low == start + 1:  # nothing left of the overlap: the chunk itself grows
                    b = min(len(text), b + overlap)
                    left = self.ends(text, a, b)
                continue
            cut = common[-1]
            total += sum(start < p <= cut for p in left)
            start, a, b, left, overlap = cut, right_a, right_b, right, self.overlap
        return total + sum(p > start for p in left)

    def count(self, texts: list[str]) -> list[int]:
        one = iter(self.model.encode([t for t in texts if len(t) <= self.chunk], num_threads=1))
        return [self.spliced(t) if len(t) > self.chunk else len(next(one)) for t in texts]


def counted(docs: DataFrame, model: str, limit: int = LIMIT, **sizes: int) -> DataFrame:
    """One row of SCHEMA per document; `model` is a sentencepiece file that executors can read."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def make():
        counter = Counter(model, **sizes)

        def run(batch: pa.RecordBatch) -> dict:
            n = counter.count(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(batch.column("text")).cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}

        return run

    return map_slices(rows, make, SCHEMA, limit=1 << 20)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
