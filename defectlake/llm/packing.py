"""Packing documents into training sequences of several window sizes.

Every document goes to the tier of the smallest window that holds what full long windows leave of it. Tiers are packed
from the longest window to the shortest; gaps of longer windows are filled from shorter tiers, whole documents first and
then by a cut. Sequences of one step group have the same number of tokens in total. Tasks pack what they read, so that
nothing is shuffled and the last few tokens of a task go to short sequences of powers of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, values_of

WINDOWS = (1024, 512, 256, 128)
STEP_TOKENS = 8192
BUNDLE_TOKENS = 1 << 20
END_ID = 0
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step long"


def byte_bpe(vocabulary: str | None = None):
    """Encoder of the 50k byte-level BPE vocabulary, texts to id arrays.

    ``vocabulary`` is the rank file; the public one by default, whose ids equal those of the tokenizer file. Texts that hold
    the name of its special token go through the tokenizer file, which gives it one id; with other ranks it is ordinary text.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole: list = []

    def encode(text: str) -> np.ndarray:
        if vocabulary is None and SPECIAL in text:
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(coder.encode_ordinary(text), dtype="<u4")

    return encode


class Packer:
    """Pieces (document, start, length) that wait for a window, by tier."""

    def __init__(self, windows: tuple[int, ...] = WINDOWS):
        self.windows = sorted(windows, reverse=True)
        self.tiers: list[list[tuple[int, int, int]]] = [[] for _ in self.windows]
        self.full: list[list[tuple[int, int, int]]] = []
        self.held = 0  # ids that wait in tiers

    def _wait(self, doc: int, start: int, length: int) -> None:
        tier = max(i for i, w in enumerate(self.windows) if w >= length)
        self.tiers[tier].append((doc, start, length))
        self.held += length

    def route(self, doc: int, length: int) -> None:
        """Cut full long windows off a document; the rest waits in its tier."""
        start, longest = 0, self.windows[0]
        while length - start >= longest:
            self.full.append([(doc, start, longest)])
            start += longest
        if length > start:
            self._wait(doc, start, length - start)

    def _take(self, gap: int, tier: int) -> tuple[int, int, int]:
        """A piece of at most ``gap`` ids: a whole one of this tier or a shorter one, else the head of what waits."""
        pool = next((p for p in self.tiers[tier:] if p and p[-1][2] <= gap), None)
        if pool is None:
            pool = next(p for p in [*self.tiers[tier + 1 :], *self.tiers[tier::-1]] if p)
        doc, start, length = pool.pop()
        self.held -= length
        if length > gap:
            self._wait(doc, start + gap, length - gap)
        return doc, start, min(length, gap)

    def _fill(self, window: int, tier: int) -> list[tuple[int, int, int]]:
        out, gap = [], window
        while gap:
            out.append(self._take(gap, tier))
            gap -= out[-1][2]
        return out

    def pack(self, last: bool = False) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Full sequences as (window, pieces), longest windows first; ``last`` also lets go of what fills none, by powers of two."""
        out = [(self.windows[0], seq) for seq in self.full]
        self.full = []
        for tier, window in enumerate(self.windows):
            while self.held >= window and (self.tiers[tier] or last):
                out.append((window, self._fill(window, tier)))
        while last and self.held:
            window = 1 << (self.held.bit_length() - 1)
            out.append((window, self._fill(window, len(self.windows) - 1)))
        return out

    def waiting(self) -> set[int]:
        return {piece[0] for pool in self.tiers for piece in pool}


def pack_documents(docs: DataFrame, windows: tuple[int, ...] = WINDOWS, step_tokens: int = STEP_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents, one row each, with their ids as little-endian 32-bit numbers.

    ``window`` is the length of a sequence, always full: what is left of a task fills no window and goes to powers of two. ``step`` numbers
    groups of sequences of ``step_tokens`` tokens (the last group of a bundle may be shorter). A null or empty text is the
    end id alone; null and repeated doc_ids are documents of their own; other columns are not read. No rows give no rows.
    """

    def run(batches):
        lean_memory()
        encode = byte_bpe(vocabulary)
        base = TaskContext.get().partitionId() << 33
        packer, texts, count, numbers = Packer(windows), {}, 0, {"sequence": base, "step": base}

        def emit(last):
            rows, filled = [], 0
            for window, seq in packer.pack(last):
                at = 0
                for doc, start, length in seq:
                    doc_id, ids = texts[doc]
                    rows.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), numbers["sequence"], at, window, numbers["step"] + filled // step_tokens))
                    at += length
                numbers["sequence"] += 1
                filled += at
            numbers["step"] += -(-filled // step_tokens)
            waiting = packer.waiting()
            for doc in [d for d in texts if d not in waiting]:
                del texts[doc]
            for i in range(0, len(rows), 4000):
                columns = list(zip(*rows[i : i + 4000]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in PIECES.split(", ")])

        gathered = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1))):
                ids = np.append(encode((text or b"").decode()), np.array(END_ID, dtype="<u4"))
                texts[count] = (doc_id, ids)
                packer.route(count, len(ids))
                count, gathered = count + 1, gathered + len(ids)
                if gathered >= BUNDLE_TOKENS:
                    gathered = 0
                    yield from emit(False)
        yield from emit(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
