"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

The distinct words of a block are laid end to end as one flat numpy array of symbols. A round looks up the rank of
each new pair of neighbours, takes the least rank of each word (its leftmost place on a tie), merges in all words at once, and
compacts; words without a pair left drop out. That is the library's order, best pair first and leftmost on ties, word by word,
because no piece crosses the start of a run of spaces. Words met before, told apart by 128 bits of
hash, come from a bounded table.

Where pieces do cross such starts, or a word is very long, the text is one word or goes through a heap with the same order.

The model file is a path parameter and is opened where the work runs. Its pieces, scores and kinds are read through the
library; encoding and decoding are done here.

Edge cases: null text is empty, and has only begin and end ids; characters without a piece become byte pieces (or the
unknown id if the model has none); invalid byte sequences decode to U+FFFD; very long texts are encoded whole, block by block of
their words; repeated rows and ids are encoded each; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .store import mapped

SPACE = "▁"
TABLE_WORDS = 600_000
LONG_WORD = 400
NONE = np.int64(2**62)


class Pieces:
    """A BPE piece model."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.bos, self.eos, self.unk = m.bos_id(), m.eos_id(), m.unk_id()
        piece = [m.id_to_piece(i) for i in range(n)]
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(piece) if plain[i]}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(piece[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.text = [p.replace(SPACE, " ").encode() if plain[i] else self.byte_of.get(i, b"" if m.is_control(i) else " ⁇ ".encode()) for i, p in enumerate(piece)]
        # symbols: pieces, then characters that are no piece
        self.symbols = dict(self.ids)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        keys, ranks = [], []
        for p in self.ids:
            for j in range(1, len(p)):
                a, b = p[:j], p[j:]
                if (a in self.ids or len(a) == 1) and (b in self.ids or len(b) == 1):
                    keys.append(self.symbol(a) << 32 | self.symbol(b))
                    ranks.append(order[self.score[p]] << 32 | self.ids[p])
        at = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.array(keys, np.int64)[at], np.array(ranks, np.int64)[at]
        self.first = len(piece)
        self._forget()
        self.slots = _Slots(len(self.keys))
        self.slots.add(self.keys.view(np.uint64), 0)
        size = np.array([len(t) for t in self.text], np.int64)
        self.spelled, self.spelled_size = np.frombuffer(b"".join(self.text), np.uint8), size
        self.spelled_at = np.cumsum(size) - size

    def _forget(self) -> None:
        """Empty the table of words: two hashes of each, where its ids begin, how many; all ids."""
        self.known = _Slots(TABLE_WORDS)
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def symbol(self, s: str) -> int:
        if s not in self.symbols:
            self.symbols[s] = len(self.text) + len(self.symbols)
        return self.symbols[s]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank << 32 | merged piece of each pair, NONE where there is none."""
        keys = left << np.int64(32) | right
        at = self.slots.find(keys.view(np.uint64), self.keys.view(np.uint64))
        return np.where(at >= 0, self.ranks[at], NONE)

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge in each word (``word``: ascending number of each symbol's word) until no pair is left."""
        done: list[tuple] = []
        place = np.arange(len(sym))
        best = np.full(len(sym), NONE, np.int64)  # of each symbol with the next one
        todo = np.flatnonzero(word[1:] == word[:-1])
        best[todo] = self.rank(sym[todo], sym[todo + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(best, starts)
            size = np.diff(np.append(starts, len(sym)))
            over = least == NONE
            if over.any():
                live = np.repeat(~over, size)
                done.append((place[~live], sym[~live], word[~live]))
                sym, word, place, best = sym[live], word[live], place[live], best[live]
                if not len(sym):
                    break
                least, size = least[~over], size[~over]
            hits = np.flatnonzero(best == np.repeat(least, size))
            if len(hits) > len(size):  # the leftmost of a word
                hits = hits[np.concatenate([[True], word[hits][1:] != word[hits][:-1]])]
            sym[hits] = best[hits] & 0xFFFFFFFF
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            hits = hits - np.arange(len(hits))  # their places after compaction, as each word loses one symbol
            sym, word, place, best = sym[keep], word[keep], place[keep], best[keep]
            best[hits] = NONE
            right = hits[hits + 1 < len(sym)]
            right = right[word[right] == word[right + 1]]
            left = hits[hits > 0] - 1
            left = left[word[left] == word[left + 1]]
            todo = np.concatenate([right, left])
            best[todo] = self.rank(sym[todo], sym[todo + 1])
        if not done:
            return sym, word
        place, sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        at = np.argsort(place, kind="stable")
        return sym[at], word[at]

    def _heap(self, w: str) -> list[str]:
        """The same order on one long word, in n log n."""
        s: list[str | None] = list(w)
        nxt, prv = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < len(s):
                both = s[i] + s[nxt[i]]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(s)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if s[i] is None or nxt[i] >= len(s) or s[i] + s[nxt[i]] != both:
                continue
            j = nxt[i]
            s[i], s[j], nxt[i] = both, None, nxt[j]
            if nxt[j] < len(s):
                prv[nxt[j]] = i
            offer(i)
            offer(prv[i])
        return [x for x in s if x is not None]

    def spell(self, s: str) -> list[int]:
        """Ids of a symbol: its piece, else its bytes, else unknown."""
        if s in self.ids:
            return [self.ids[s]]
        return [self.bytes[b] for b in s.encode()] if self.bytes else [self.unk]

    def _ids(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words whose UTF-8 bytes, ``sizes`` each, are ``raw``; how many each has."""
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(sizes)
        chars = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
        chars_of = np.diff(chars, prepend=0)
        code = np.frombuffer(raw.decode().replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        kinds, which = np.unique(code, return_inverse=True)
        symbols = np.array([self.symbol(chr(c)) for c in kinds.tolist()], np.int64)[which]
        word = np.repeat(np.arange(len(sizes)), chars_of)
        long_ = chars_of > LONG_WORD
        sym, word = self.merge_rounds(symbols[~long_[word]], word[~long_[word]])
        odd = np.flatnonzero(sym >= self.first)
        if len(odd):  # characters that are no piece
            kinds, which = np.unique(sym[odd], return_inverse=True)
            name = {i: s for s, i in self.symbols.items() if i >= self.first}
            spelled = [self.spell(name[x]) for x in kinds.tolist()]
            size = np.array([len(x) for x in spelled])
            many = np.ones(len(sym), np.int64)
            many[odd] = size[which]
            put = _spread((np.cumsum(many) - many)[odd], many[odd])
            take = _spread((np.cumsum(size) - size)[which], many[odd])
            sym, word = np.repeat(sym, many), np.repeat(word, many)
            sym[put] = np.concatenate(spelled)[take]
        if long_.any():
            by = [(word, sym)]
            for w in np.flatnonzero(long_).tolist():
                text = code[chars[w] - chars_of[w] : chars[w]].tobytes().decode("utf-32-le")
                ids = [i for s in self._heap(text) for i in self.spell(s)]
                by.append((np.full(len(ids), w), np.array(ids)))
            word, sym = (np.concatenate(x) for x in zip(*by, strict=True))
            order = np.argsort(word, kind="stable")
            word, sym = word[order], sym[order]
        return sym.astype(np.int32), np.bincount(word, minlength=len(sizes))

    def encode_flat(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and n + 1 offsets into them, of texts whose bytes are data[off[i]:off[i + 1]]; each nonempty one begins with the
        space that the model puts before a text."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        begin = np.zeros(len(data) + 1, bool)
        if not self.crossing:
            gap = data == 32
            begin[:-1] = gap
            begin[1:-1] &= ~gap[:-1]
        begin[off] = True
        starts = np.flatnonzero(begin[:-1])
        ends = np.append(starts[1:], len(data))
        h1, h2 = (flat.span_hashes(data, starts, ends, w) for w in (0, 1))
        _, first, which = np.unique(h1, return_index=True, return_inverse=True)
        if (h2[first][which] != h2).any():  # two words, one hash
            _, first, which = np.unique(np.stack([h1, h2]), axis=1, return_index=True, return_inverse=True)
        u1, u2 = h1[first], h2[first]
        found = self.known.find(u1, self.h1)
        new = np.flatnonzero(found < 0)
        if len(new) + len(self.h1) > TABLE_WORDS:
            self._forget()
            found, new = np.full(len(u1), -1), np.arange(len(u1))
        clash = (found >= 0) & (self.h2[found] != u2) if len(self.h2) else np.zeros(len(u1), bool)
        if clash.any():
            self._forget()
            found, new = np.full(len(u1), -1), np.arange(len(u1))
        if len(new):
            s, e = starts[first[new]], ends[first[new]]
            raw = data[_spread(s, e - s)].tobytes()
            ids, many = self._ids(raw, e - s)
            found[new] = np.arange(len(new)) + len(self.h1)
            self.at = np.append(self.at, len(self.store) + np.cumsum(many) - many)
            self.size = np.append(self.size, many)
            self.store = np.append(self.store, ids)
            had = len(self.h1)
            self.h1, self.h2 = np.append(self.h1, u1[new]), np.append(self.h2, u2[new])
            if len(new) <= TABLE_WORDS:
                self.known.add(u1[new], had)
        w = found[which]
        many = self.size[w]
        ids = self.store[_spread(self.at[w], many)]
        ends = np.append(0, np.cumsum(many))[np.searchsorted(starts, off)]
        if len(self.h1) > TABLE_WORDS:
            self._forget()
        return ids, ends

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, with begin and end ids."""
        data, off = flat.flatten(spaced(pa.array(texts, pa.string())))
        ids, at = self.encode_flat(data, off)
        return [[self.bos, *ids[a:b].tolist(), self.eos] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode_flat(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ids: control ids vanish, byte pieces join to characters, the first space goes."""
        raw = self.spelled[_spread(self.spelled_at[ids], self.spelled_size[ids])].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = _replaced(raw)
        return raw[1:] if raw[:1] == b" " else raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64)).decode()


class _Slots:
    """An open hash table from 64-bit keys, held by the caller in one array, to their places in it; numpy throughout."""

    def __init__(self, n: int):
        self.mask = (1 << max(10, (3 * n).bit_length())) - 1
        self.slot = np.full(self.mask + 1, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (flat.mix(keys) & flat.U(self.mask)).astype(np.int64)

    def add(self, keys: np.ndarray, first: int) -> None:
        """Distinct new keys; their places are first, first + 1, ..."""
        want, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.slot[want[todo]] == -1]
            self.slot[want[free]] = free + first
            todo = todo[self.slot[want[todo]] != todo + first]
            want[todo] = (want[todo] + 1) & self.mask

    def find(self, keys: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not."""
        out = np.full(len(keys), -1, np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            s = self.slot[at[todo]]
            used = s >= 0
            todo, s = todo[used], s[used]
            hit = held[s] == keys[todo]
            out[todo[hit]] = s[hit]
            todo = todo[~hit]
            at[todo] = (at[todo] + 1) & self.mask
        return out


def _spread(at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, ..., many[i] of them, for each i."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + many, many)


def spaced(col: pa.Array) -> pa.Array:
    """Texts as the model takes them: its space mark is a space, and nonempty ones get one in front."""
    col = pc.fill_null(col, "")
    if pc.any(pc.match_substring(col, SPACE)).as_py():
        col = pc.replace_substring(col, SPACE, " ")
    return pc.if_else(pc.equal(pc.binary_length(col), 0), "", pc.binary_join_element_wise(" ", col, ""))


def _replaced(raw: bytes) -> bytes:
    return raw.decode(errors="replace").encode()


@cache
def model(path: str) -> Pieces:
    return Pieces(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        ends = [np.array([x], "<u4").tobytes() for x in (pieces.bos, pieces.eos)]
        for b in batches:
            data, off = flat.flatten(spaced(flat.column(b, "text")))
            for i, j in flat.runs(off, 2 * flat.BLOCK_BYTES):
                ids, at = pieces.encode_flat(data[off[i] : off[j]], off[i : j + 1] - off[i])
                out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                whole = []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    raw = ids[x:y].astype("<u4").tobytes().join(ends)
                    whole.append(np.frombuffer(raw, "<u4"))
                    out["n_tokens"].append(y - x + 2)
                    out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(pieces.decode_flat(whole[-1])).hexdigest())
                values = pa.array(np.concatenate(whole).astype(np.int32))
                sizes = np.concatenate([[0], np.cumsum(out["n_tokens"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [flat.column(b, "id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(sizes), values), pa.array(out["n_tokens"], pa.int64()), *(pa.array(out[x], pa.string()) for x in ("ids_sha256", "decoded_sha256"))],
                    ["id", "ids", *out],
                )

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array<int>), n_tokens, ids_sha256, decoded_sha256 (of decode(ids))."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = mapped(rows, _encode(path), "id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([flat.column(b, "id"), pa.array([pieces.decode(x or []) for x in flat.column(b, "ids").to_pylist()], pa.string())], ["id", "text"])

    rows = tokens.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).alias("ids"))
    return mapped(rows, run, "id long, text string").withColumnRenamed("id", id_col)
