"""Encoding with a merge-type piece vocabulary and decoding back.

The encoder is an agenda of adjacent symbol pairs: of all pairs whose join is a piece, the
one with the best score is joined first (leftmost of equals), its neighbours give new pairs,
until the agenda is empty. Characters outside the vocabulary become their UTF-8 bytes.

Merges never cross a place where no piece has those two characters side by side, so a text
is cut there and every distinct segment is encoded once per worker and remembered. Each
segment that a worker meets for the first time is also encoded by the sentencepiece
library, a whole Arrow batch in one call, and a difference is an error; ``check="texts"``
compares whole texts instead. Decoding is the library's ``decode``.

Null texts are empty; an empty text has the begin and end ids only.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pultwerk.llm.common import whole_text

SPACE = "▁"
# segments that a worker remembers; when full, the memory starts anew
REMEMBERED = 1_000_000


class Pieces:
    """Vocabulary, agenda and memory of one worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.inner = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        # pieces that hold a space behind another character would let merges cross words
        self.words_part = not any(b == SPACE and a != SPACE for a, b in self.inner)
        self.memory: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def agenda(self, segment: str) -> list[str]:
        symbols: list[str | None] = list(segment)
        before = list(range(-1, len(symbols) - 1))
        after = [*range(1, len(symbols)), -1]
        scores, heap = self.scores, []

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                joined = symbols[a] + symbols[b]
                score = scores.get(joined)
                if score is not None:
                    heapq.heappush(heap, (-score, a, b, joined))

        for i in range(len(symbols) - 1):
            propose(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            # out of date if either symbol has been joined since
            if symbols[a] is None or symbols[b] is None or after[a] != b or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            propose(before[a], a)
            propose(a, after[a])
        return [s for s in symbols if s is not None]

    def encode_segment(self, segment: str) -> list[int]:
        out = []
        for symbol in self.agenda(segment):
            if symbol in self.ids:
                out.append(self.ids[symbol])
            else:
                out.extend(self.bytes[b] for b in symbol.encode())
        return out

    def cuts(self, word: str) -> list[str]:
        """The word cut where no piece has the two characters side by side."""
        inner, out, start = self.inner, [], 0
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in inner:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def words(self, text: str) -> list[str]:
        """Segments of a text behind its added first space; spaces start a segment."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.words_part:
            return [marked]
        if SPACE * 2 not in marked:
            return [SPACE + w for w in marked.split(SPACE)[1:]]
        # of a run of spaces none may be parted from the next
        out: list[str] = []
        for w in marked.split(SPACE)[1:]:
            if out and not out[-1].strip(SPACE):
                out[-1] += SPACE + w
            else:
                out.append(SPACE + w)
        return out

    def learn(self, words: set[str], check: bool) -> None:
        """Encodes the new words of a batch and compares their segments with the library."""
        if len(self.memory) + len(words) > REMEMBERED:
            self.memory, self.parts = {}, {}
        fresh: dict[str, bytes] = {}
        for word in words:
            if word in self.memory:
                continue
            blobs = []
            for part in self.cuts(word):
                blob = self.parts.get(part)
                if blob is None:
                    blob = self.parts[part] = fresh[part] = np.array(self.encode_segment(part), dtype="<u4").tobytes()
                blobs.append(blob)
            self.memory[word] = b"".join(blobs)
        if check and fresh:
            self.compare(fresh)

    def compare(self, fresh: dict[str, bytes]) -> None:
        """Segments stand behind a line break, which no piece of these vocabularies holds.

        So the space that the library puts in front of a text can't join them.
        """
        want = self.library.encode(["\n" + p.replace(SPACE, " ") for p in fresh], num_threads=1)
        prefix = self.library.encode("\n")
        for (part, blob), ids in zip(fresh.items(), want):
            got = prefix + np.frombuffer(blob, "<u4").tolist()
            if ids != got:
                raise ValueError(f"agenda and library differ on {part!r}: {got} and {ids}")


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_texts(texts: list[str], path: str, check: str = "segments") -> list[bytes]:
    """Ids of each text, begin and end id included, as little-endian unsigned 32-bit numbers."""
    vocabulary = pieces(path)
    lists = [vocabulary.words(t) if t else [] for t in texts]
    memory = vocabulary.memory
    fresh = {w for words in lists for w in words if w not in memory}
    if len(memory) + len(fresh) > REMEMBERED:
        fresh = {w for words in lists for w in words}
    vocabulary.learn(fresh, check == "segments")
    begin, end = (np.array([i], dtype="<u4").tobytes() for i in (vocabulary.library.bos_id(), vocabulary.library.eos_id()))
    known = vocabulary.memory.__getitem__
    out = [b"".join([begin, *map(known, words), end]) for words in lists]
    if check == "texts":
        want = vocabulary.library.encode(texts, num_threads=1, add_bos=True, add_eos=True)
        for text, blob, ids in zip(texts, out, want):
            if np.frombuffer(blob, "<u4").tolist() != ids:
                raise ValueError(f"agenda and library differ on {text[:200]!r}")
    return out


def coded(docs: DataFrame, model: str, key: str = "doc_id", check: str = "segments") -> DataFrame:
    """The key, the ids (binary, little-endian unsigned 32-bit) and the decoded text."""
    rows = docs.select(F.col(key), whole_text().alias("text"))

    def run(batches):
        for batch in batches:
            # slices keep the lists of a batch small when texts are long
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids = encode_texts(piece.column(1).to_pylist(), model, check)
                decoded = pieces(model).library.decode([np.frombuffer(b, "<u4").tolist() for b in ids])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids binary, decoded string")
