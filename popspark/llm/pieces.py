"""Byte-pair encoding and decoding with a SentencePiece model, by rounds of merges over flat arrays of symbols.

A text is cut where no piece of the vocabulary can span, so its parts (words) are encoded apart and those seen before
are remembered. All new words of a batch lie in one array of symbols. In each round every word merges its best pair at
all its places at once, from the left; the arrays are compacted, and words without a pair left are done.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import ship

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a blank, U+2581.
BLANK = "▁"
#: Distinct words whose ids a task remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 150_000, 64
#: Texts that are encoded, and ids that are decoded, at once.
TEXTS, IDS = 200, 500_000
#: Slots of a table of pairs.
SLOTS = 1 << 19
#: The rank of a pair that no piece spells.
NONE = np.int32(2**31 - 1)


class Pieces:
    """The tables of a model: pieces, ranks, pairs that merge, and bytes to decode to.

    Only byte-pair models with byte fallback, a blank put in front and no other change of the text are supported; for
    others ValueError is raised.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: no byte-pair model with byte fallback, a leading blank and texts as they are")
        self.size = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        scores = np.array([p.score for p in model.pieces])
        self.rank = np.append(np.unique(-scores, return_inverse=True)[1].astype(np.int32), NONE)  # the last one is that of no piece
        self.none = self.size
        self.first_byte = next(i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE)
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        #: A character's symbol: its piece, or one beyond all pieces.
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self._pairs(normal)
        self._cuts(normal)
        shown = [b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else bytes([i - self.first_byte]) if p.type == kinds.BYTE else p.piece.replace(BLANK, " ").encode() for i, p in enumerate(model.pieces)]
        self.shown_size = np.array(list(map(len, shown)))
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.is_control = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.blank_first = np.array([p.type == kinds.NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.known: dict[str, bytes] = {}

    def _pairs(self, normal: dict[str, int]) -> None:
        """All two symbols that spell a piece, and the pieces at whose merge a pair as good or better can arise."""
        of = lambda s: normal.get(s) if len(s) > 1 else int(self.symbol[ord(s)])
        rows = [(a, b, i) for piece, i in normal.items() for k in range(1, len(piece)) if (a := of(piece[:k])) is not None and (b := of(piece[k:])) is not None]
        left, right, merged = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        self.tables, keys, names = [], left << 32 | right, merged
        while len(keys):  # a table of slots by a hash of the two symbols; those that find theirs taken go to the next one
            slots, first = np.unique(self._slot(keys, len(self.tables)), return_index=True)
            held, piece = np.full(SLOTS, -1), np.full(SLOTS, self.none, np.int32)
            held[slots], piece[slots] = keys[first], names[first]
            self.tables.append((held, piece))
            keys, names = np.delete(keys, first), np.delete(names, first)
        self.unsafe = np.zeros(self.size + 1, bool)
        for side in (left, right):
            inner = side < self.size
            self.unsafe[side[inner][self.rank[merged[inner]] <= self.rank[side[inner]]]] = True

    def _cuts(self, normal: dict[str, int]) -> None:
        """Where a text can be cut: between two characters that stand together in no piece."""
        self.inside = np.unique([ord(p[k - 1]) << 21 | ord(p[k]) for p in normal for k in range(1, len(p))])
        spans = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in normal)
        pairs = [(chr(x >> 21), chr(x & 0x1FFFFF)) for x in self.inside.tolist()]
        alone = {*map(chr, range(128))}.difference(*pairs)  # in no piece but of their own
        marks = {c for _, c in pairs if not c.isalnum() and c != BLANK}  # those that follow none but each other and blanks
        while more := {c for b, c in pairs if c in marks and b not in marks and b != BLANK}:
            marks -= more
        # Blanks: pieces of them rank last and alike, so a run is merged from the left, after all else. Where no other
        # piece begins with two, its first m, the longest piece, are cut off as long as more than m follow.
        only = {len(p): int(self.rank[i]) for p, i in normal.items() if len(p) > 1 and not p.strip(BLANK)}
        m = max(only, default=0)
        even = set(only.values()) == {int(self.rank[: self.size].max())} and not any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in normal)
        if even:
            ids = self.encode_words([BLANK * n for n in range(1, 4 * m)])
            even = all(ids[n - 1] == ids[m - 1] + ids[n - m - 1] and len(ids[m - 1]) == 4 for n in range(m + 1, 4 * m))
        runs = f"{BLANK}{{{m}}}(?={BLANK}{{{m + 1}}})|" if even else ""
        a, m = ("".join(map(re.escape, sorted(x))) for x in (alone, marks))
        self.words = re.compile("[\\s\\S]+" if spans or not (alone and marks) else f"{runs}[{a}]+|{BLANK}*[{m}]*[^{BLANK}{m}{a}]+|{BLANK}*[{m}]+|{BLANK}+")

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return (keys * np.int64(0x9E3779B97F4A7C1 + 2 * table) >> np.int64(40)) & np.int64(SLOTS - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols spell, or none."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys, 0)
        held, piece = self.tables[0]
        found = np.where(held[slot] == keys, piece[slot], self.none)
        rest = np.flatnonzero((held[slot] != keys) & (held[slot] >= 0))
        for k, (held, piece) in enumerate(self.tables[1:], 1):
            slot = self._slot(keys[rest], k)
            hit = held[slot] == keys[rest]
            found[rest[hit]] = piece[slot[hit]]
            rest = rest[~hit]
        return found

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words, none of them empty, as 32-bit integers in bytes."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.zeros(len(codes), bool)
        ends[np.cumsum(sizes) - 1] = True
        # Parts of words between which no piece can span are merged as words of their own.
        last = ends.copy()
        if len(codes) > 1:
            pairs = codes[:-1].astype(np.int64) << 21 | codes[1:]
            at = np.minimum(np.searchsorted(self.inside, pairs), len(self.inside) - 1)
            last[:-1] |= self.inside[at] != pairs
        symbols, held = self.merge(self.symbol[codes], last)
        # Back to words: each part's symbols stay in order, so a word is a run of parts.
        word_of_part = np.cumsum(ends)[np.flatnonzero(last)] - ends[np.flatnonzero(last)]
        word = np.repeat(word_of_part, held)
        lost = symbols >= self.size  # characters without a piece become the bytes of their code in UTF-8
        if lost.any():
            each = np.ones(len(symbols), np.int64)
            raw = [chr(c).encode() for c in (symbols[lost] - self.size).tolist()]
            each[lost] = list(map(len, raw))
            symbols, word = np.repeat(symbols, each), np.repeat(word, each)
            symbols[np.repeat(lost, each)] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.first_byte
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        data = symbols.astype("<i4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def merge(self, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols after all merges, and how many each word has left; last marks the last symbol of each word.

        The best pair of a word is that of the least rank. It merges at all its places at once, of overlapping ones the
        left one, as one merge after another would. Only where the new piece may itself take part in a pair as good
        would that differ; there a word merges its leftmost place alone.
        """
        n_words = int(last.sum())
        sizes = np.diff(np.flatnonzero(last), prepend=-1)
        names, done, last = np.arange(n_words), [], last.copy()
        merged = np.full(len(symbols), self.none, np.int32)
        inner = np.flatnonzero(~last)
        merged[inner] = self.lookup(symbols[inner], symbols[inner + 1])
        rank = self.rank[merged]
        while len(symbols):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.all():
                over = np.repeat(~live, sizes)
                done.append((names[~live], sizes[~live], symbols[over]))
                symbols, last, merged, rank = symbols[~over], last[~over], merged[~over], rank[~over]
                names, sizes, best = names[live], sizes[live], best[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            word = np.searchsorted(np.cumsum(sizes), at, side="right")
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            run = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = word[1:] != word[:-1]
            risky = np.zeros(len(sizes), bool)
            risky[word[self.unsafe[merged[at]]]] = True
            take = ((at - run) % 2 == 0) & (leftmost | ~risky[word])
            at, word = at[take], word[take]
            symbols[at], last[at] = merged[at], last[at + 1]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            sizes = sizes - np.bincount(word, minlength=len(sizes))
            symbols, last, merged, rank = symbols[kept], last[kept], merged[kept], rank[kept]
            at = at - np.arange(len(at))  # where the new symbols are now
            near = np.concatenate([at, at[at > 0] - 1])
            merged[near] = self.none
            inner = near[~last[near]]
            merged[inner] = self.lookup(symbols[inner], symbols[inner + 1])
            rank[near] = self.rank[merged[near]]
        if not done:
            return symbols, np.zeros(0, np.int64)
        names, sizes, flat = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(names, kind="stable")
        starts, held = (np.cumsum(sizes) - sizes)[order], sizes[order]
        moved = np.repeat(starts - (np.cumsum(held) - held), held) + np.arange(len(flat))
        return flat[moved], held

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers in bytes; none for a null or empty text."""
        split = [self.words.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        used = set().union(*split)
        if len(self.known) + len(used) > REMEMBERED:  # those in use stay
            self.known = {w: self.known[w] for w in used & self.known.keys()}
        new = list(used - self.known.keys())
        self.known.update(zip(new, self.encode_words(new)) if new else ())
        found = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return found

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of runs of ids, whose sizes are given. Of each the first blank goes, if a piece begins with it."""
        each = self.shown_size[ids]
        ends = np.concatenate([[0], np.cumsum(each)])
        data = self.shown[np.repeat(self.shown_at[ids] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        out, at = [], 0
        for n in sizes.tolist():
            a, b, first = ends[at], ends[at + n], at
            while first < at + n and self.is_control[ids[first]]:
                first += 1
            if first < at + n and self.blank_first[ids[first]]:
                a += 1
            out.append(_text(data[a:b]) if n else "")
            at += n
        return out


def _text(data: bytes) -> str:
    """Bytes as text; each byte that is no part of a character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + _text_rest(data[e.start + 1 :])


def _text_rest(data: bytes) -> str:
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), "�"]
            data = data[e.start + 1 :]
    return "".join(out)


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """A model's tables, read once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def model_path(model: str | None = None) -> str:
    """The path given, by default that of the public model of 32,000 pieces."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    return model


def encode(docs: DataFrame, model: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids, an array, for each row of docs, without ids of begin or end.

    A null or empty text has no ids. Texts of any length are encoded whole, in one row; rows are independent, so
    repeated ones come out alike and an empty table gives an empty one. Other columns of docs aren't read.
    """
    ship(docs.sparkSession)
    path = model_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in batches:
            found = [ids for at in range(0, batch.num_rows, TEXTS) for ids in pieces.encode(batch.column("text").slice(at, TEXTS).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(ids: Column, model: str | None = None) -> Column:
    """The text of a column of ids; empty for none. Ids beyond the model fail."""
    path = model_path(model)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        sizes = np.fromiter((0 if x is None else len(x) for x in column), np.int64, len(column))
        lots, out = np.cumsum(sizes) // IDS, []
        for lot in np.unique(lots):  # rows that begin within the same IDS ids
            some = np.flatnonzero(lots == lot)
            flat = np.concatenate([column.iloc[k] for k in some if sizes[k]] or [np.zeros(0, np.int32)]).astype(np.int64)
            out += loaded(path).decode(flat, sizes[some])
        return pd.Series(out, dtype=object)

    return run(ids)
