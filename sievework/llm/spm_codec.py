"""SentencePiece BPE encoding by a prefix table, and decoding.

A text is escaped as the model asks and cut where no piece can reach across (line
feeds that no piece holds, before each run of space marks, and between characters
that no piece joins, such as letters and punctuation). Byte-pair merging gives each
prefix of a unit exactly one last piece: the one that stays unmerged next to the last
piece of the prefix before it. The table of last pieces is filled only where a search
leads that takes the longest piece first, as the automaton of all pieces gives it,
then the shorter ones it begins with: a way to the unit's end on which each piece
stays unmerged next to the one before is the encoding, because the table has no
second one. For the same reason a prefix from which no piece goes on is left for
good, and the search takes no more than one test for each prefix and piece.

Units repeat a lot, so their ids are kept in a bounded memo for each worker. The
units of many texts that are not in it are searched together, a step of all of them
at a time on arrays; long ones and those with characters of no longer piece go alone.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
#: Units kept by a worker, and the longest one kept.
MEMO_UNITS = 200_000
MEMO_CHARS = 64
#: Pair tests kept by a worker, and slots (a power of two) for those of searches on arrays.
MEMO_PAIRS = 300_000
PAIR_SLOTS = 1 << 18
#: Characters of the texts whose units are searched together, and the fewest units for arrays.
TOGETHER = 1 << 20
FEW = 100


_ALWAYS, _NEVER = float("inf"), float("-inf")
assert array("I").itemsize == 4 and sys.byteorder == "little"


def _joined(pieces) -> list[set[str]]:
    """The two largest sets of characters, marks aside, that stand beside each other
    in pieces: no piece joins a character of a set with one outside it."""
    above: dict[str, str] = {}

    def root(c: str) -> str:
        while above.setdefault(c, c) != c:
            above[c] = c = above[above[c]]
        return c

    for piece in pieces:
        chars = piece.lstrip(MARK)
        for c in chars:
            above[root(c)] = root(chars[0])
    sizes = Counter(map(root, above))
    return [{c for c in above if root(c) == r} for r, n in sizes.most_common(2) if n > 1]


class PieceCodec:
    """Encoder and decoder for one BPE model file."""

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with an identity normaliser are supported")
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with leading space marks are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        kinds = type(model.pieces[0])
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        if len(byte_ids) < 256:
            raise ValueError("only models with byte fallback are supported")
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space mark after another character")
        self.byte_ids = byte_ids
        self.begin = next(i for i, p in enumerate(model.pieces) if p.piece == "<s>")
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.machine = ahocorasick.Automaton()
        self.singles: dict[str, tuple] = {}
        # By the beginnings of pieces: the entry of the longest piece that each begins with.
        self.longest: dict[str, tuple] = {}
        for piece in sorted(self.score):
            for size in range(2, len(piece) + 1):
                head = piece[:size]
                if head not in self.longest:
                    shorter = self.longest.get(head[:-1]) or self._single(head[0])
                    self.longest[head] = self._entry(head, [self.ids[head]], shorter) if head in self.score else shorter
            if len(piece) > 1:
                self.machine.add_word(piece, len(piece))
        self.reach = max(map(len, self.score))
        self.slots = None
        alone = "" if any("\n" in p for p in self.score) else "\n"
        sets = ["".join(map(re.escape, sorted(x - {alone}))) for x in _joined(self.score)]
        runs = "|".join(f"[{x}]+" for x in [*sets, f"^{MARK}{alone}{''.join(sets)}"])
        self.unit = re.compile(f"{MARK}*(?:{runs})|{MARK}+" + ("|\n" if alone else ""))
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs = 0
        self.edges: dict[str, list | None] = {}
        self.shown = [None] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.shown[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == kinds.BYTE:
                self.shown[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.shown[i] = " ⁇ ".encode()
            else:
                self.shown[i] = b""

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging by its definition: the best scored pair first, the
        leftmost of equals. Only tests use it, on short strings."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _spines(self, piece: str):
        """The piece's outer tokens while it is merged by itself, innermost first:
        along its right edge and along its left edge, each with the score of its
        next merge and the level at which that merge's other half is ready. None
        if merging does not give the piece."""
        known = self.edges.get(piece, 0)
        if known != 0:
            return known
        parts = [(c, _ALWAYS, None, None, None) for c in piece]  # text, level, score, halves
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i][0] + parts[i + 1][0])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                break
            x, y = parts[where], parts[where + 1]
            parts[where : where + 2] = [(x[0] + y[0], min(best, x[1], y[1]), best, x, y)]
        found = None
        if len(parts) == 1:
            found = []
            for inner, outer in ((4, 3), (3, 4)):
                at, path = parts[0], [(piece, None, None)]
                while at[3] is not None:
                    path.append((at[inner][0], at[2], at[outer][1]))
                    at = at[inner]
                found.append(path[::-1])
        self.edges[piece] = found
        return found

    def apart(self, left: str, right: str) -> bool:
        """Whether merging left + right gives just these two pieces (right alone,
        if left is empty). Both sides are merged outwards from the boundary, the
        better scored step first and the left one of equals; a pair across the
        boundary that comes first joins them."""
        b = self._spines(right)
        if b is None or not left:
            return b is not None
        a, b = self._spines(left)[0], b[1]
        i = j = 0
        level = _ALWAYS
        while True:
            x, up, other = a[i]
            y, vp, another = b[j]
            nl = _NEVER if up is None else up if other >= level else min(up, other)
            nr = _NEVER if vp is None else vp if another >= level else min(vp, another)
            c = self.score.get(x + y)
            if c is not None and c > nl and c >= nr:
                return False
            if nl == nr == _NEVER:
                return True
            if nl >= nr:
                i, level = i + 1, min(level, nl)
            else:
                j, level = j + 1, min(level, nr)

    def _stable(self, left: str, right: str, known: dict[str, bool]) -> bool:
        """apart(), kept in the right piece's own memo."""
        if self.pairs >= MEMO_PAIRS:
            self.pairs = 0
            for entry in (*self.longest.values(), *self.singles.values()):
                entry[2].clear()
        self.pairs += 1
        answer = known[left] = self.apart(left, right)
        return answer

    @staticmethod
    def _entry(piece: str, ids: list[int], shorter: tuple | None) -> tuple:
        """Text, characters, memo of pair tests, packed ids, next shorter beginning that is a piece."""
        return piece, len(piece), {}, array("I", ids).tobytes(), shorter

    def _single(self, char: str) -> tuple:
        """The entry of one character: its own id, or those of its bytes."""
        entry = self.singles.get(char)
        if entry is None:
            ids = [self.ids[char]] if char in self.ids else [self.byte_ids[b] for b in char.encode()]
            entry = self.singles[char] = self._entry(char, ids, None)
        return entry

    def _entries(self, unit: str) -> list[tuple]:
        """The entries of the unit's pieces."""
        longest, begun, reach = self.longest, self.machine.longest_prefix, self.reach
        path, left, at, end = [], "", 0, len(unit)
        dead: set[int] = set()
        while at < end:
            size = begun(unit[at : at + reach])
            entry = longest[unit[at : at + size]] if size > 1 else self._single(unit[at])
            while True:
                known = entry[2]
                fits = known.get(left)
                if fits is None:
                    fits = self._stable(left, entry[0], known)
                if fits and at + entry[1] not in dead:
                    break
                entry = entry[4]
                while entry is None:  # no piece goes on from here
                    dead.add(at)
                    gone = path.pop()
                    at -= gone[1]
                    left = path[-1][0] if path else ""
                    entry = gone[4]
            path.append(entry)
            left = entry[0]
            at += entry[1]
        return path

    def pieces(self, unit: str) -> list[str]:
        return [entry[0] for entry in self._entries(unit)]

    def _arrays(self) -> None:
        """The automaton of the pieces that hold only characters with an id, as arrays.
        A piece is its id here, and one id more stands for the beginning of a unit."""
        chars = sorted({c for p in self.longest for c in p if c in self.ids})
        code = {c: k for k, c in enumerate(chars, 1)}
        self.codes = np.zeros(sys.maxunicode + 1, np.uint16)
        self.codes[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        heads = [*chars, *(h for h in self.longest if all(c in code for c in h))]
        node = {h: k for k, h in enumerate(heads, 1)}
        parents = {h[:-1] for h in heads}
        rows = {h: k for k, h in enumerate(sorted(parents - {""}), 2)}  # row 0 leads nowhere, 1 is the root's
        self.goto = np.zeros((len(rows) + 2, len(chars) + 1), np.min_scalar_type(len(heads)))
        self.row = np.zeros(len(heads) + 1, np.int32)
        self.best = np.zeros(len(heads) + 1, np.int32)
        self.entry = {}
        n = len(self.shown)
        self.size, self.shorter = np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
        for h, k in node.items():
            self.goto[rows[h[:-1]] if len(h) > 1 else 1, code[h[-1]]] = k
            self.row[k] = rows.get(h, 0)
            entry = self.longest.get(h) or self._single(h)
            i = self.best[k] = self.ids[entry[0]]
            self.entry[int(i)] = entry
            self.size[i] = entry[1]
            if entry[4] is not None:
                self.shorter[i] = self.ids[entry[4][0]]
        self.entry[n] = ("",)
        self.slots = np.full(PAIR_SLOTS, -1, np.int64)

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_stable() of many pairs of ids. A pair's slot holds the last pair that came there."""
        key = left.astype(np.int64) * len(self.size) + right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - PAIR_SLOTS.bit_length())).astype(np.int64)
        held = self.slots[slot]
        ok = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            pairs, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            answers = np.zeros(len(pairs), bool)
            for k, pair in enumerate(pairs.tolist()):
                a, b = divmod(pair, len(self.size))
                text, _, known, *_ = self.entry[b]
                fits = known.get(self.entry[a][0])
                answers[k] = self._stable(self.entry[a][0], text, known) if fits is None else fits
            self.slots[slot[new][first]] = pairs << 1 | answers
            ok[new] = answers[back]
        return ok

    def _first(self, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Ids of the longest pieces that begin at these places."""
        node = self.goto[1, flat[at]]
        open, depth = np.arange(len(at)), 1
        while len(open):
            after = self.goto[self.row[node[open]], flat[at[open] + depth]]
            open, after = open[after > 0], after[after > 0]
            node[open] = after
            depth += 1
        return self.best[node]

    def _search(self, units: list[str]) -> list[bytes | None]:
        """Packed ids of many units, as _entries() finds them; None for those with a
        character that has no code, and for the last few whose search is not over."""
        if self.slots is None:
            self._arrays()
        flat = self.codes[np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        end = np.cumsum(sizes + 1) - 1
        begin = end - sizes
        flat[end] = 1
        failed = np.zeros(len(units), bool)
        failed[np.searchsorted(end, np.flatnonzero(flat == 0))] = True
        flat[end] = 0
        last = np.full(len(flat), len(self.shown), np.int32)  # piece that ends before a place
        dead = np.zeros(len(flat), bool)
        unit = np.flatnonzero(~failed)
        at = begin[unit]
        right = self._first(at, flat)
        while len(unit) >= FEW:
            ok = right >= 0
            ok[ok] = ~dead[at[ok] + self.size[right[ok]]]
            ok[ok] = self._fits(last[at[ok]], right[ok])
            on, off = np.flatnonzero(ok), np.flatnonzero(~ok)
            at[on] += self.size[right[on]]
            last[at[on]] = right[on]
            right[off] = np.where(right[off] >= 0, self.shorter[right[off]], -1)
            back = off[right[off] < 0]
            dead[at[back]] = True
            right[back] = last[at[back]]
            at[back] -= self.size[right[back]]
            right[back] = self.shorter[right[back]]
            begun = on[at[on] < end[unit[on]]]
            right[begun] = self._first(at[begun], flat)
            more = at < end[unit]
            unit, at, right = unit[more], at[more], right[more]
        failed[unit] = True
        unit = np.flatnonzero(~failed)
        at, steps = end[unit], []
        while len(unit):
            steps.append((unit, last[at]))
            at = at - self.size[last[at]]
            unit, at = unit[at > begin[unit]], at[at > begin[unit]]
        if not steps:
            return [None] * len(units)
        whose = np.concatenate([u for u, _ in reversed(steps)])
        ids = np.concatenate([i for _, i in reversed(steps)])[np.argsort(whose, kind="stable")].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(whose, minlength=len(units)))).tolist()
        return [None if f else ids[a:b] for f, a, b in zip(failed.tolist(), [0, *stops], stops)]

    def _learn(self, units: set[str]) -> list[str]:
        """See that the memo holds these units; the long ones, not to be kept, are returned."""
        new = units.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_UNITS:
            # Two generations: what is still in use moves on to the new one.
            self.older, self.memo, new = self.memo, {}, units
        if self.older:
            self.memo.update((u, self.older[u]) for u in new.intersection(self.older))
            new = new.difference(self.older)
        long = [u for u in new if len(u) > MEMO_CHARS]
        short = list(new.difference(long))
        packed = self._search(short) if len(short) >= FEW else [None] * len(short)
        self.memo.update(zip(short, packed))
        for unit in [*long, *(u for u, p in zip(short, packed) if p is None)]:
            self.memo[unit] = b"".join([entry[3] for entry in self._entries(unit)])
        return long

    def _encoded(self, texts: list[str], ends: bool) -> list[bytes]:
        first, last = (struct.pack("<I", i) if ends else b"" for i in (self.begin, self.end))
        prefix = MARK if self.dummy_prefix else ""
        cut = [self.unit.findall(prefix + text.replace(" ", MARK)) if text else [] for text in texts]
        long = self._learn(set(chain.from_iterable(cut)))
        packed = self.memo.__getitem__
        out = [b"".join([first, *map(packed, units), last]) for units in cut]
        for unit in long:
            del self.memo[unit]
        return out

    def encode_many(self, texts, ends: bool = True):
        """Ids of each text as little-endian unsigned 32-bit integers."""
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars >= TOGETHER:
                yield from self._encoded(some, ends)
                some, chars = [], 0
        yield from self._encoded(some, ends)

    def encode_packed(self, text: str, ends: bool = True) -> bytes:
        return self._encoded([text], ends)[0]

    def decode_packed(self, packed: bytes) -> str:
        """The text of packed ids; begin and end ids give nothing."""
        ids = memoryview(packed).cast("I") if packed else []
        raw = b"".join(map(self.shown.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids_le", ends: bool = True) -> DataFrame:
    """Add the ids of every text as packed little-endian uint32 (`out_col`).

    Null counts as the empty text, which has only the begin and end ids. Other
    columns stay; a column already named out_col is replaced. The model file is
    opened where the code runs, so it must exist on every worker.
    """

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        c = codec(model_path)
        return pa.array(c.encode_many((t.as_py() or "" for t in texts), ends), pa.binary())

    return docs.withColumn(out_col, packed(F.col(text_col)))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids_le", out_col: str = "decoded") -> DataFrame:
    """Add the text of packed ids; null ids give the empty text."""

    @F.arrow_udf("string")
    def shown(ids: pa.Array) -> pa.Array:
        c = codec(model_path)
        return pa.array((c.decode_packed(x.as_py() or b"") for x in ids), pa.string())

    return df.withColumn(out_col, shown(F.col(ids_col)))


def unpack_ids(packed: bytes) -> list[int]:
    return list(memoryview(packed).cast("I"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece_codec(spark, sf_dir):
    model = default_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, model), model)
    return both.select(
        "doc_id",
        F.expr("octet_length(ids_le) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
