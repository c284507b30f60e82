"""Byte-level BPE token ids and counts of whole texts, huge ones by overlapping chunks.

The vocabulary is that of byte_bpe_50k.json; its ids are those the file's own
library gives, with <|endoftext|> inside a text read as the special token.

Texts of more than ``CHUNK`` characters are encoded as overlapping chunks; the
token boundaries of both encodings in the overlap are compared, and they are
spliced at a place that both have, after which the next token is the same, and
that is proved to be a boundary of the whole text's encoding. If there is none,
the overlap is doubled, up to the whole rest of the text. Long runs without a
gap inside a text are encoded the same way by smaller chunks, as merging takes
time with the square of a run.

Besides the ends of special tokens, two kinds of places are proved. (1) The pattern that cuts a text before merging
takes letters, digits, other signs and white space into parts of their own, with
at most one space in front of a part and letters after an apostrophe. So it
always cuts where one of the kinds but white space ends, the apostrophe left
aside, whatever stands further left or right. (2) Within a run of one kind, all
of it is one part. A sequence of tokens is the encoding of a part exactly if each
two neighbours are the encoding of the two: merges within a token don't depend
on its neighbours, and the first merge across a boundary would be the first
across that boundary for the two alone, too. Tokens left of the place are
neighbours in the left encoding, those right of it in the right one, and the two
that meet are neighbours in the left one, as its next token is the same.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk, and of the first overlap; of a text, and of a run without a gap in it.
CHUNK, OVERLAP = 1 << 16, 512
FINE, FINE_OVERLAP = 1024, 64
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_SPACE, _SOLID = re.compile(r"\s"), re.compile(r"\S")
#: White space on whose class all libraries agree: Unicode's property, which the four separators from U+001C on have not.
_PLAIN_SPACE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


def _kind(c: str) -> str:
    """L, N, S (white space), U (unassigned) or P (all others), as the pattern's classes."""
    k = unicodedata.category(c)
    return "S" if c.isspace() else "U" if k == "Cn" else k[0] if k[0] in "LN" else "P"


def stable(before: str, after: str) -> bool:
    """Whether the pattern cuts between the two whatever stands around them."""
    a, b = _kind(before), _kind(after)
    return a != b and a != "S" and "U" not in (a, b) and before != "'"


def inside(text: str, place: int, begin: int, end: int) -> bool:
    """Whether the place lies within one part of the pattern, in text[begin:end] as in every longer text and in one that begins at the place or before."""
    lo, hi = place - 3, place + 2
    if lo < begin or hi + 1 > end:
        return False
    around = text[lo:hi]
    kinds = {_kind(c) for c in around}
    if len(kinds) > 1 or ("U" in kinds and len(set(around)) > 1):
        return False
    return kinds != {"S"} or _PLAIN_SPACE.issuperset(text[lo : hi + 1])


def has_long_run(text: str) -> bool:
    """Whether some FINE characters may have no change between white space and others; always true of 2 * FINE that have none."""
    for at in range(0, len(text) - FINE + 1, FINE):
        other = _SOLID if text[at].isspace() else _SPACE
        if not other.search(text, at, at + FINE):
            return True
    return False


class ByteTokens:
    """Ids are arrays of unsigned 16-bit numbers."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.lengths = [0] * (max(ranks.values()) + 2)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.lengths[SPECIAL_ID] = len(SPECIAL)

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text in one piece."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(np.uint16)

    def whole(self, text: str) -> np.ndarray:
        return self.by_chunks(text, FINE, FINE_OVERLAP, self.plain) if has_long_run(text) else self.plain(text)

    def encode(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Token ids; none for null and ''."""
        if not text:
            return np.zeros(0, np.uint16)
        return self.whole(text) if len(text) <= chunk else self.by_chunks(text, chunk, overlap, self.whole)

    def by_chunks(self, text: str, chunk: int, overlap: int, encode: Callable[[str], np.ndarray]) -> np.ndarray:
        """Encode [begin, begin + chunk), then chunks that begin ``overlap`` earlier, and splice."""
        out, begin, end = [], 0, chunk
        ids = encode(text[:end])
        while end < len(text):
            wide = overlap
            while True:
                start = self._boundary(text, ids, begin, end, wide)
                stop = min(len(text), max(start, end) + chunk)
                right = encode(text[start:stop]) if start > begin else None
                cut = self._splice(text, ids, begin, right, start, end) if start > begin else None
                if cut:
                    out.append(ids[: cut[0]])
                    ids, begin, end = right[cut[1] :], cut[2], stop
                    break
                if start == begin:  # no proved place in all of the chunk: it doubles
                    end = min(len(text), begin + 2 * (end - begin))
                    ids = encode(text[begin:end])
                    break
                wide *= 2
        out.append(ids)
        return np.concatenate(out)

    def _boundary(self, text: str, left: np.ndarray, begin: int, end: int, wide: int) -> int:
        """The last token boundary of text[begin:end] that has ``wide`` characters or more after it and is one of characters, or begin. In a run of one repeated pattern both encodings then agree from their start."""
        if end - wide <= begin:
            return begin
        raw = text[max(begin, end - 2 * wide - 16) : end].encode("utf-8")
        enough = len(text[end - wide : end].encode("utf-8"))
        back = 0
        for i in left[::-1]:
            back += self.lengths[i]
            if back > len(raw):
                break
            if back >= enough and (back == len(raw) or raw[-back] & 0xC0 != 0x80):
                return end - len(raw[len(raw) - back :].decode("utf-8"))
        return end - wide

    def _splice(self, text: str, left: np.ndarray, left_at: int, right: np.ndarray, right_at: int, end: int) -> tuple[int, int, int] | None:
        """(tokens of left before, tokens of right before, place): a proved place in [right_at, end) at which both have a boundary and after which the next token is the same."""
        lengths = self.lengths
        raw = text[right_at:end].encode("utf-8")
        # Byte offsets from right_at: boundaries of right within the overlap, of left counted back from its end.
        span = len(raw)
        at, rights = 0, {}
        for k, i in enumerate(right[: span + 1].tolist()):
            if at > span:
                break
            rights[at] = (k, i)
            at += lengths[i]
        at, lefts = span, []
        first = max(0, len(left) - span)
        for k, i in zip(range(len(left) - 1, first - 1, -1), left[first:][::-1].tolist(), strict=True):
            at -= lengths[i]
            if at < 0 or k == 0:
                break
            if at in rights and rights[at][1] == i and raw[at] & 0xC0 != 0x80:
                lefts.append((at, k))
        # From the middle of the overlap outwards both sides know the most of their surroundings.
        for b, k in sorted(lefts, key=lambda x: abs(2 * x[0] - span)):
            place = right_at + len(raw[:b].decode("utf-8"))
            proved = stable(text[place - 1], text[place]) or inside(text, place, left_at, end) or text.startswith(SPECIAL, place) or text.endswith(SPECIAL, 0, place)
            if proved and SPECIAL not in text[max(0, place - len(SPECIAL) + 1) : place + len(SPECIAL) - 1]:
                return k, rights[b][0], place
        return None


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with n_bytes and n_tokens (long) of each whole text, in a single map.

    A null text has 0 of either; columns of these names are replaced.
    """
    kept = docs.drop("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(ranks_path, pattern)
        for b in batches:
            at = b.schema.get_field_index(text_col)
            n = [len(tokens.encode(b.column(at)[i].as_py(), chunk, overlap)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(n, pa.int64())], names=[f.name for f in schema.fields])

    out = kept.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    schema = T.StructType([*out.schema.fields, T.StructField("n_tokens", T.LongType())])
    return out.mapInArrow(run, schema)


_loaded: dict[tuple[str, str], ByteTokens] = {}


def loaded(ranks_path: str, pattern: str) -> ByteTokens:
    """One per Python worker and vocabulary."""
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = ByteTokens(ranks_path, pattern)
    return _loaded[ranks_path, pattern]
