"""SentencePiece BPE encoding and decoding as shortest paths of a transducer.

Three machines are compiled from the model file: the normaliser (space to
U+2581, one in front), the pieces (a trie over characters whose accepting
states emit a piece id) with byte fallback for characters that no piece has,
and an acceptor of piece pairs. Byte-pair merging is no sum of piece weights, so
piece scores as arc weights would give other ids than the model's own; but the
sequence that merging gives is the only one all of whose adjacent pairs are
what merging makes of the pair alone. The pair acceptor has weight 0 for such
pairs and infinity for others, pieces that merging cannot reach have infinity,
and the shortest path in the tropical semiring of the composition with an input
is the model's own encoding.

Merging never crosses a space or a character without piece, so the composition
is done by unit (spaces with what follows them) and remembered per unit.
"""

from __future__ import annotations

import re
from array import array

SPACE = "▁"
#: Units, and piece pairs, that one Python worker remembers; units twice, in a young and an old generation.
REMEMBERED, PAIRS = 100_000, 400_000


class PieceTransducer:
    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool = True):
        """kinds: 1 normal, 2 unknown, 3 control, 6 byte, as in the model file."""
        self.pieces, self.dummy_prefix = pieces, dummy_prefix
        self.bytes = [-1] * 256
        self.unknown = kinds.index(2) if 2 in kinds else 0
        for i, k in enumerate(kinds):
            if k == 6:
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if i >= 0}
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        self.rank = {i: -scores[i] for i in self.ids.values()}
        self.texts = ["" if k == 3 else p.replace(SPACE, " ") for p, k in zip(pieces, kinds, strict=True)]
        for i, b in self.byte_of.items():
            self.texts[i] = bytes([b]).decode("utf-8", "surrogateescape")
        self.runs = {len(p): i for p, i in self.ids.items() if set(p) == {SPACE} and len(p) > 1}
        # Spaces with others in one piece only as the first character: then units are independent.
        self.whole = any(SPACE in p[1:] for p in self.ids if set(p) != {SPACE})
        self._trie()
        self.pair_ok: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.unit = re.compile(" *[^ \n]+| +|\n" if "\n" not in self.ids and not any("\n" in p for p in self.ids) else " *[^ ]+| +")

    def _trie(self) -> None:
        """state -> {character: state}; accepts[state] = piece. Runs of spaces are left to ``_spaces``."""
        self.arcs: list[dict[str, int]] = [{}]
        self.accepts = [-1]
        self.split: dict[int, tuple[int, int]] = {}
        for p, i in sorted(self.ids.items(), key=lambda x: (self.rank[x[1]], x[1])):
            if len(p) > 1:
                if i in self.runs.values():
                    continue
                halves = self._merged(p, i)
                if halves is None:
                    continue  # merging never makes it
                self.split[i] = halves
            at = 0
            for c in p:
                nxt = self.arcs[at].get(c)
                if nxt is None:
                    nxt = len(self.arcs)
                    self.arcs[at][c] = nxt
                    self.arcs.append({})
                    self.accepts.append(-1)
                at = nxt
            self.accepts[at] = i

    def _merged(self, text: str, whole: int) -> tuple[int, int] | None:
        """The last merge that makes ``text`` one piece."""
        parts = [self.ids.get(c, -1) for c in text]
        strings = list(text)
        last = None
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                j = self.ids.get(strings[k] + strings[k + 1])
                if j is not None and (best is None or self.rank[j] < best[0]):
                    best = (self.rank[j], k, j)
            if best is None:
                return None
            _, k, j = best
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [j]
            strings[k : k + 2] = [strings[k] + strings[k + 1]]
        return last if parts == [whole] else None

    def _pair(self, u: int, v: int) -> bool:
        """Whether merging leaves the boundary of u and v: no merge across it comes before the merges that make u's end and v's begin."""
        limit, rank = float("inf"), self.rank
        while True:
            j = self.ids.get(self.pieces[u] + self.pieces[v])
            if j is not None and rank[j] < limit:
                return False
            # Undo the later of the two last merges; its rank bounds what may come across the boundary before it.
            su, sv = self.split.get(u), self.split.get(v)
            if su is None and sv is None:
                return True
            # Of equal ranks the left one is merged first, so the right one is undone first.
            if sv is None or (su is not None and rank[u] > rank[v]):
                # A merge across that ranks as u's own would be to its right, so later.
                limit, u = rank[u], su[1]
            else:
                # One that ranks as v's own would be to its left, so earlier.
                limit, v = rank[v] + 1e-9, sv[0]

    def _spaces(self, n: int) -> list[int]:
        """n spaces alone. All their merges rank alike, so that the leftmost comes first."""
        one, out = self.ids.get(SPACE), []
        if not self.runs:
            return [one] * n
        top = max(self.runs)
        out += [self.runs[top]] * (n // top)
        parts = [1] * (n % top)
        merged = True
        while merged:
            merged = False
            for k in range(len(parts) - 1):
                if parts[k] + parts[k + 1] in self.runs:
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                    merged = True
                    break
        return out + [one if k == 1 else self.runs[k] for k in parts]

    def _path(self, text: str) -> list[int]:
        """The shortest path over the composition with ``text``; each position keeps its one finite state."""
        arcs, accepts, ok = self.arcs, self.accepts, self.pair_ok
        n = len(text)
        # piece that ends at i in the encoding of text[:i], and where it begins
        last: list[int] = [-1] * (n + 1)
        begin = [0] * (n + 1)
        reached = [False] * (n + 1)
        reached[0] = True
        for i in range(n):
            if not reached[i]:
                continue
            before = last[i]
            at, j = 0, i
            while j < n:
                nxt = arcs[at].get(text[j])
                if nxt is None:
                    break
                at = nxt
                j += 1
                piece = accepts[at]
                if piece < 0 or reached[j]:
                    continue
                if before >= 0:
                    key = before << 20 | piece
                    good = ok.get(key)
                    if good is None:
                        if len(ok) > PAIRS:
                            ok.clear()
                        good = ok[key] = self._pair(before, piece)
                    if not good:
                        continue
                last[j], begin[j], reached[j] = piece, i, True
            if text[i] not in arcs[0]:  # byte fallback: nothing merges across it
                last[i + 1], begin[i + 1], reached[i + 1] = -2, i, True
        out: list[int] = []
        i = n
        while i:
            if last[i] == -2:
                raw = text[begin[i]].encode("utf-8", "surrogatepass")
                out += [self.bytes[b] for b in reversed(raw)] if self.bytes[0] >= 0 else [self.unknown]
            else:
                out.append(last[i])
            i = begin[i]
        return out[::-1]

    def _unit(self, unit: str) -> bytes:
        n = len(unit) - len(unit.lstrip(SPACE))
        if n == len(unit):
            ids = self._spaces(n)
        elif n <= 1:
            ids = self._path(unit)
        else:
            # The last space merges with what follows, if at all, before spaces merge with spaces.
            ids = self._path(unit[n - 1 :])
            ids = self._spaces(n) + ids[1:] if ids[0] == self.ids.get(SPACE) else self._spaces(n - 1) + ids
        return array("i", ids).tobytes()

    def encode(self, text: str | None) -> array:
        """Piece ids. Null and '' give none."""
        out = array("i")
        if not text:
            return out
        memory = self.memory
        text = (" " if self.dummy_prefix else "") + text
        if self.whole or SPACE in text:
            text = text.replace(SPACE, " ") if not self.whole else text
        units = [text] if self.whole else self.unit.findall(text)
        got = list(map(memory.get, units))
        if None in got:
            if len(memory) > REMEMBERED:
                self.old, self.memory = memory, {}
                memory = self.memory
            old = self.old
            for k, x in enumerate(got):
                if x is None:
                    u = units[k]
                    x = memory.get(u)
                    if x is None:
                        x = old.get(u) or self._unit(u.replace(" ", SPACE))
                        if len(u) <= 64:
                            memory[u] = x
                    got[k] = x
        out.frombytes(b"".join(got))
        return out

    def decode(self, ids) -> str:
        """The text of ids: bytes are joined, U+2581 is a space, the one in front goes. Bytes that are no UTF-8 become U+FFFD."""
        text = "".join(map(self.texts.__getitem__, ids))
        if not text.isascii():  # bytes of 0x80 and more stand as lone surrogates until all are there
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def load(path: str) -> PieceTransducer:
    """Compile the machines from a SentencePiece BPE model with identity normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as M

    m = M.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only BPE models with identity normalisation and escaped spaces are compiled")
    return PieceTransducer([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], n.add_dummy_prefix)
