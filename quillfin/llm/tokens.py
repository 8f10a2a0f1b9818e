"""Token counts of whole documents with a public tokenizer.

Huge documents are encoded by the library as overlapping chunks, with the library's offsets of each token
(overlap resynchronisation). A chunk and a probe that begins before its end both encode their overlap: one knows what comes before,
the other what follows. Where both have the same tokens at the same places on either side of a place at
which a word of the tokenizer begins, the tokenizer is in the same state in both (it splits and merges from left to
right, within words): so the text is cut there, the chunk's tokens up to it are final, and the next chunk begins at it. If
there is no such place the overlap is widened, and in the end the chunk is doubled, so the work stays linear in the text.

Shorter documents are one chunk, encoded by words between ASCII white space: the tokenizer of
``word_bpe_49k.json`` drops white space before it forms words, neither its
normalisation nor its added tokens reach across it, so the ids of a text are
those of its words in turn; ids of words are remembered within a worker, of those that come a second time and up to
a fixed number of words of a bounded length. Tests hold all this against the library's result for
whole texts.

Null texts count as empty, with no tokens; rows with null ids keep them; repeated rows come out as often as
they came in; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

VOCABULARY = "word_bpe_49k.json"
#: Words, and pieces of words, remembered by a worker, beyond which the memory is emptied; the most bytes of those that are.
MEMO_WORDS, MEMO_BYTES = 200_000, 64
#: Places at which a word's first coming is noted; a power of two.
PLACES = 1 << 22
#: Words of printable ASCII and composed Latin-1 letters, which normalisation only lower-cases; a line may be between two.
SIMPLE = re.compile("[\n\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: The tokenizer's own split into pieces, for lower-case words of SIMPLE, and the line between two words.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")
#: Stands between packed ids of words; ids are far smaller, so it is found nowhere else.
BETWEEN = b"\xff\xff\xff\xff"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoded(NamedTuple):
    """Tokens: ids, where they begin and end in the text, and the number of the tokenizer's word that each is in."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    word: np.ndarray


class Memory(dict):
    """Packed ids by word, of words that come a second time: of a corpus's distinct words most come once, and a worker lives on
    after its task, with what it remembers."""

    def __init__(self):
        super().__init__()
        self.came = bytearray(PLACES)

    def keep(self, words: list, packed: list[bytes]) -> None:
        came = self.came
        for word, p in zip(words, packed):
            at = hash(word) % PLACES
            if not came[at]:
                came[at] = 1
            elif len(word) <= MEMO_BYTES:
                if len(self) >= MEMO_WORDS:
                    self.clear()
                    came = self.came = bytearray(PLACES)
                self[word] = p


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Ids of words, little-endian unsigned 32-bit, with a bounded memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.letters = byte_letters()
        self.latin = {chr(c): "".join(self.letters[b] for b in chr(c).encode()) for c in range(0x21, 0x100)}
        self.table = str.maketrans(self.latin)
        self.memo, self.pieces = Memory(), Memory()

    def _simple(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of SIMPLE, which are taken apart, looked up and put together all at once."""
        parts = PIECES.findall("\n".join(words).lower())
        got = list(map(self.pieces.get, parts))
        if None in got:
            fresh = list({p for p, g in zip(parts, got) if g is None} - {"\n"})
            ids: list[int] = []
            for p in "\n".join(fresh).translate(self.table).split("\n") if fresh else ():
                ids += [t.id for t in self.model.tokenize(p)]
                ids.append(0xFFFFFFFF)
            packed = packed_ids(ids).split(BETWEEN)
            new = dict(zip(fresh, packed))
            new["\n"] = BETWEEN
            self.pieces.keep(fresh, packed)
            got = [new[p] if g is None else g for p, g in zip(parts, got)]
        return b"".join(got).split(BETWEEN)

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of different words; see ``Memory`` for what is remembered."""
        whole = b"\n".join(words).decode("utf-8", "replace")
        easy, hard = words, []
        if not SIMPLE.fullmatch(whole) or ("<|" in whole and any(x in whole for x in self.special)):
            easy = []
            for w, s in zip(words, whole.split("\n")):
                (easy if SIMPLE.fullmatch(s) and not any(x in s for x in self.special) else hard).append(w)
            whole = b"\n".join(easy).decode()
        found = dict(zip(easy, self._simple(whole.split("\n")))) if easy else {}
        if hard:
            for w, e in zip(hard, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in hard], add_special_tokens=False)):
                found[w] = packed_ids(e.ids)
        self.memo.keep(list(found), list(found.values()))
        return found

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        out: list[bytes] = []
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            got = list(map(self.memo.get, part))
            if None in got:
                new = self._new(list({w for w, g in zip(part, got) if g is None}))
                got = [new[w] if g is None else g for w, g in zip(part, got)]
            out += got
        return out

    def encode(self, text: bytes) -> bytes:
        """Packed ids of a text."""
        return b"".join(self.encode_words(text.split()))

    def encode_with_offsets(self, text: str) -> Encoded:
        """The library's tokens of a text."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return Encoded(np.array(e.ids, dtype=np.uint32), spans[:, 0], spans[:, 1], np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64))


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def inert(text: str, at: int) -> bool:
    """Whether normalisation treats what is left and right of a place apart."""
    left, right = text[at - 1 : at], text[at : at + 1]
    return not unicodedata.combining(right) and unicodedata.normalize("NFC", left + right) == unicodedata.normalize("NFC", left) + unicodedata.normalize("NFC", right)


def common_boundary(text: str, one: Encoded, start: int, end: int, other: Encoded, begin: int, agree: int) -> int | None:
    """The last place, in a text's characters, where both encodings begin a word and have the same ``agree`` tokens on either side.

    ``one`` encodes the text from ``start`` to ``end``, ``other`` from ``begin``, which lies between, to beyond ``end``. What touches
    an end of either isn't compared.
    """
    first = int(np.searchsorted(one.begin + start, begin, side="right"))
    a = np.stack([one.ids[first:].astype(np.int64), one.begin[first:] + start, one.end[first:] + start])
    a = a[:, a[2] < end]
    n = a.shape[1]
    if n < 2 * agree:
        return None
    # each token's place among the other's, where it has one that is the same
    at = np.minimum(np.searchsorted(other.begin + begin, a[1]), max(len(other.ids) - 1, 0))
    same = (other.ids[at] == a[0]) & (other.begin[at] + begin == a[1]) & (other.end[at] + begin == a[2])
    same &= np.r_[True, at[1:] == at[:-1] + 1]
    run = np.convolve(same, np.ones(2 * agree, dtype=int), "valid") == 2 * agree
    for k in np.flatnonzero(run)[::-1].tolist():
        i, j = first + k + agree, int(at[k + agree])
        place = int(a[1, k + agree])
        if one.word[i] != one.word[i - 1] and other.word[j] != other.word[j - 1] and a[2, k + agree - 1] <= place and inert(text, place):
            return place
    return None


def splice(text: str, encode, chunk: int, overlap: int, agree: int = 4) -> np.ndarray:
    """Ids of ``text`` from overlapping chunks of characters; see the module. ``encode(str)`` gives an ``Encoded``."""
    out: list[np.ndarray] = []
    start, size = 0, chunk
    while True:
        end = start + size
        own = encode(text[start:end])
        if end >= len(text):
            out.append(own.ids)
            return np.concatenate(out)
        wide, place = overlap, None
        while place is None and wide < 2 * size:
            begin = max(start, end - wide)
            place = common_boundary(text, own, start, end, encode(text[begin : end + wide]), begin, agree)
            wide *= 8
        if place is None or place <= start:
            size *= 2  # nothing to splice at: a longer chunk
            continue
        out.append(own.ids[: int(np.searchsorted(own.begin + start, place))])
        start, size = place, chunk


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = 2048, chunk: int = 32_768, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_chunks), a row for each row of ``docs``."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes"))

    def run(batches):
        enc = encoder(path)
        for b in batches:
            size, count, chunks = [], [], []
            for t in b.column(1):
                data = t.as_buffer().to_pybytes()
                size.append(len(data))
                if len(data) <= chunk:
                    count.append(len(enc.encode(data)) // 4)
                    chunks.append(1)
                else:
                    calls = [0]

                    def encode(part):
                        calls[0] += 1
                        return enc.encode_with_offsets(part)

                    count.append(len(splice(data.decode("utf-8", "replace"), encode, chunk, overlap)))
                    chunks.append(calls[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array([c > limit for c in count], pa.bool_()), pa.array(chunks, pa.int64())],
                names=["id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
            )

    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")
