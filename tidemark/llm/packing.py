"""Hierarchical multi-length packing of documents into training sequences.

Documents become token ids plus a closing id. Full windows leave at once; what is
left of each document is routed by length to a context-size tier. Tiers are packed
from the longest: each piece of a tier opens a sequence of the tier's length, and
its gap is filled with the longest pieces of shorter tiers that fit, the last one cut
to end exactly there. So every sequence is a power of two long and nothing is padded.
Sequences of each tier are dealt in turn to step groups, which so hold equal mixes.

Everything happens where a document is read: no shuffle, and memory is bounded by a
pool of pieces and one document.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table

MAX_LEN = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
POOL_TOKENS = 1 << 20
STEP_TOKENS = 16 * MAX_LEN
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: The pre-tokenizer's pattern (a fixed value of byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's 12 words,  one\n\nand\tmore... \u00e9t\u00e9 \u4e2d\u6587 'll "
_WORKER: dict[str, Encoder] = {}


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter: itself where
    it is printable in Latin-1, else the next letters from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that the tokenizer file gives for whole texts.

    The file's vocabulary is run by a second implementation that is four times as
    fast; a probe shows that both agree, else the first one does everything, as it
    does for texts that hold one of its special tokens.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        try:
            import tiktoken

            letters = _byte_of_letter()
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in self.special}
            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            if fast.encode_ordinary(_PROBE) == self.tokenizer.encode(_PROBE, add_special_tokens=False).ids:
                self.fast = fast
        except (ImportError, KeyError):  # another kind of vocabulary
            pass

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")


class Packer:
    """Takes documents' ids; ``out`` gets rows of :data:`PIECES`."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> None:
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.next_sequence, self.next_step = base, base
        self.pool: list[tuple] = []  # (length, doc_id, start, ids, doc_tokens)
        self.pooled = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, top = len(ids), self.tiers[-1]
        full = n - n % top
        if full:
            self._deal([(top, [(top, doc_id, at, ids[at : at + top], n)]) for at in range(0, full, top)])
        if n > full:
            self.pool.append((n - full, doc_id, full, ids[full:], n))
            self.pooled += n - full
            if self.pooled >= POOL_TOKENS:
                self.flush()

    def flush(self) -> None:
        """Pack the pool: longest tier first, gaps filled from the shorter ones."""
        pool, self.pool, self.pooled = sorted(self.pool, key=lambda p: p[0]), [], 0
        lengths = [p[0] for p in pool]
        done: list[tuple[int, list]] = []
        while pool:
            lengths.pop()
            first = pool.pop()
            size = self.tiers[bisect.bisect_left(self.tiers, first[0])]
            held, gap = [first], size - first[0]
            while gap and pool:
                at = bisect.bisect_right(lengths, gap) - 1
                if at >= 0:
                    lengths.pop(at)
                    piece = pool.pop(at)
                else:  # all are longer: cut the shortest
                    lengths.pop(0)
                    n, doc, start, ids, total = pool.pop(0)
                    piece, rest = (gap, doc, start, ids[:gap], total), (n - gap, doc, start + gap, ids[gap:], total)
                    to = bisect.bisect_left(lengths, rest[0])
                    lengths.insert(to, rest[0])
                    pool.insert(to, rest)
                held.append(piece)
                gap -= piece[0]
            done += [(size, held)] if not gap else self._powers(held)
        self._deal(done)

    @staticmethod
    def _powers(held: list) -> list[tuple[int, list]]:
        """The last pieces of a pool, cut into sequences of powers of two."""
        left, out = sum(p[0] for p in held), []
        held = held[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            own, gap = [], size
            while gap:
                n, doc, start, ids, total = held.pop()
                if n > gap:
                    held.append((n - gap, doc, start + gap, ids[gap:], total))
                    n, ids = gap, ids[:gap]
                own.append((n, doc, start, ids, total))
                gap -= n
            out.append((size, own))
        return out

    def _deal(self, sequences: list[tuple[int, list]]) -> None:
        groups = max(1, -(-sum(s for s, _ in sequences) // self.step_tokens))
        for i, (size, held) in enumerate(sorted(sequences, key=lambda s: -s[0])):
            at = 0
            for n, doc, start, ids, total in held:
                crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
                self.out.append((doc, start, n, crc, total, self.next_sequence, at, size, self.next_step + i % groups))
                at += n
            self.next_sequence += 1
        self.next_step += groups


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text); :data:`PIECES`.

    Null and empty texts are the closing id alone; rows with the same doc_id, or none,
    are packed each on their own; long texts are cut into as many pieces as they need; no
    rows, no pieces; other columns, whatever their names, are ignored.
    Sequence and step ids begin with the task's number, so reruns over the same
    partitions agree.
    """
    ship(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in PIECES.split(", ")]

    def rows(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer_path not in _WORKER:
            _WORKER[tokenizer_path] = Encoder(tokenizer_path)
        encode, packer = _WORKER[tokenizer_path], Packer(TaskContext.get().partitionId() << 40, tiers)
        close = np.array([end_id], "<u4")

        def batch() -> pa.RecordBatch:
            cols, packer.out = list(zip(*packer.out, strict=True)), []
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc_id, np.concatenate([encode(text.as_py()), close]))
                if len(packer.out) >= 10_000:
                    yield batch()
        packer.flush()
        if packer.out:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(rows, PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())
