"""SentencePiece BPE, encoding and decoding, by vectorised merge rounds.

A text is cut at single blanks between other characters, where no piece can reach across. The parts repeat, so each different
part of a batch is encoded once; the symbols of all parts lie in one flat array. In a round each word takes its best pair, the
leftmost ones merge at once, the array is compacted, until no pair remains. The ids of a text are its parts' ids in order.

Merging all occurrences of a word's best pair at once equals merging them one after another unless the merged piece is part of
a piece of the same or a better rank ("restless" pieces, told from the vocabulary): of those only the leftmost merges in a round.

Texts: null and empty ones have no ids. Any characters are allowed; those without a piece become byte pieces. U+2581 in a text
is, as in the library, the same as a blank. Ids decode as the library's do: control ids are skipped, broken bytes are U+FFFD.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "▁"
#: A blank at which a text may be cut: neither neighbour is white space or the piece model's own blank.
_CUT = re.compile("(?<=[^\\s\u180e\u2581]) (?=[^\\s\u180e\u2581])")
#: White space but blanks and line ends, and what else no cut stands beside.
_RARE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u2581\u3000]")
#: Characters of a text that are cut into parts at a time.
_SLICE = 1 << 20
#: Rounds after which what isn't finished is merged by a queue instead: long words take as many rounds as they have ranks.
ROUNDS = 200
#: Characters of texts whose parts are encoded at a time.
_CHUNK = 2 << 20
#: Different parts, and characters of them, that a worker remembers before it begins anew.
_KNOWN, _KNOWN_CHARS = 250_000, 8 << 20
_NONE = np.iinfo(np.int32).max


def cut_text(text: str) -> Iterator[list[str]]:
    """The parts of a text, a bounded number at a time; joined by blanks they are the text."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + _SLICE)
        end = cut.start() if cut else len(text)
        piece = text if end - at == len(text) else text[at:end]
        plain = not ("  " in piece or "\n " in piece or " \n" in piece or piece[0] == " " or piece[-1] == " " or _RARE.search(piece))
        yield piece.split(" ") if plain else _CUT.split(piece)
        at = cut.end() if cut else len(text)


class Parts:
    """Numbers the different parts of texts in order of appearance."""

    def __init__(self) -> None:
        self.index: defaultdict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__

    def number(self, text: str | None) -> np.ndarray:
        """The numbers of the text's parts."""
        if not text:
            return np.empty(0, np.int32)
        found = [np.fromiter(map(self.index.__getitem__, parts), np.int32, len(parts)) for parts in cut_text(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def __iter__(self) -> Iterator[str]:
        return iter(self.index)

    def __len__(self) -> int:
        return len(self.index)


def gathered(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lengths): where the items of the given rows of a ragged array lie, row after row."""
    size = np.diff(offsets)[rows]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[rows] - (ends - size), size), size


class PieceModel:
    """The tables of a BPE piece model with byte fallback and without normalisation; others raise ValueError."""

    def __init__(self, blob: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(blob)
        kind = proto.ModelProto.SentencePiece
        norm, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != proto.TrainerSpec.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and blanks before words is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("a model that adds a blank and leaves texts as they are otherwise is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(model.pieces)
        self.pieces = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in normal):
            raise ValueError("a piece reaches across a blank")
        self.control = np.array([p.type == kind.CONTROL for p in model.pieces])
        self.byte_ids = np.zeros(256, np.int32)
        self.id_bytes = []
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.id_bytes.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == kind.UNKNOWN:
                self.id_bytes.append(trained.unk_surface.encode())
            else:
                self.id_bytes.append(b"" if p.type == kind.CONTROL else p.piece.replace(BLANK, " ").encode())
        self.leads = np.array([p.type == kind.NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.id_sizes = np.array([len(b) for b in self.id_bytes], np.int64)
        # each piece's bytes, then the same as the first of a text: without the blank that encoding adds
        self._binary = pa.array([*self.id_bytes, *(b[1:] if lead else b for b, lead in zip(self.id_bytes, self.leads, strict=True))], pa.large_binary())
        # a symbol is a piece, or size + code point for a character without one
        self.width = self.size + 0x110000
        self.letters = np.arange(self.size, self.width, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        symbol = lambda s: normal.get(s, self.size + ord(s) if len(s) == 1 else None)
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        ranks = {s: r for r, s in enumerate(scores)}
        self.restless = np.zeros(self.width, bool)
        pairs, beside = {}, set()
        for p, i in normal.items():
            rank = ranks[model.pieces[i].score]
            beside.update(zip(p, p[1:], strict=False))
            for at in range(1, len(p)):
                sides = symbol(p[:at]), symbol(p[at:])
                if None in sides:
                    continue
                pairs[sides[0] * self.width + sides[1]] = rank, i
                for s in sides:
                    if s < self.size and len(self.pieces[s]) > 1 and ranks[model.pieces[s].score] >= rank:
                        self.restless[s] = True
        self.pairs = pairs
        self.pair_keys = np.array([*sorted(pairs), np.iinfo(np.int64).max])
        self.pair_ranks = np.array([*(pairs[k][0] for k in sorted(pairs)), _NONE], np.int32)
        self.pair_pieces = np.array([*(pairs[k][1] for k in sorted(pairs)), 0], np.int32)
        self.neighbours = np.array([*sorted((ord(a) << 21) | ord(b) for a, b in beside), np.iinfo(np.int64).max])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of pairs of symbols; _NONE where there is no such piece."""
        keys = left.astype(np.int64)
        keys *= self.width
        keys += right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE), self.pair_pieces[at]

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of each part with a blank before it, flat, and where each part's begin."""
        points = np.frombuffer("".join(BLANK + p.replace(" ", BLANK) for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        first = np.zeros(len(points), bool)
        first[np.cumsum(sizes) - sizes] = True
        keys = (points[:-1] << 21) | points[1:]
        first[1:] |= self.neighbours[np.searchsorted(self.neighbours, keys)] != keys  # no piece holds these two side by side
        part = np.repeat(np.arange(len(parts), dtype=np.int64), sizes)
        symbols, where = self._merged(self.letters[points], first)
        return self._as_ids(symbols, part[where], len(parts))

    def _merged(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of flat words. Returns the symbols that remain, in order, and the place where each began."""
        place = np.arange(len(symbols), dtype=np.int32)
        word = np.cumsum(first, dtype=np.int32)
        rank = np.full(len(symbols), _NONE, np.int32)
        made = np.zeros(len(symbols), np.int32)
        inner = np.flatnonzero(~first[1:])
        rank[inner], made[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(word)])
            if (best == _NONE).any():
                rest = np.repeat(best != _NONE, size)
                done.append((symbols[~rest], place[~rest]))
                symbols, place, word, rank, made = symbols[rest], place[rest], word[rest], rank[rest], made[rest]
                best, size = best[best != _NONE], size[best != _NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            leftmost = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            group = np.cumsum(leftmost) - 1
            alone = np.logical_or.reduceat(self.restless[made[hit]], np.flatnonzero(leftmost))[group]
            hit = hit[leftmost | ~alone]
            count = np.arange(len(hit))
            start = np.r_[True, hit[1:] != hit[:-1] + 1]  # of overlapping pairs every second one merges
            hit = hit[(count - np.maximum.accumulate(np.where(start, count, 0))) % 2 == 0]
            symbols[hit] = made[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            now = hit - np.arange(len(hit))  # each merge before moves the place by one
            symbols, place, word, rank, made = symbols[stay], place[stay], word[stay], rank[stay], made[stay]
            left = now - 1
            anew = np.r_[now, left[(left >= 0) & (left != np.r_[-1, now[:-1]])]]
            inside = anew + 1 < len(word)
            inside[inside] = word[anew[inside]] == word[anew[inside] + 1]
            rank[anew[~inside]] = _NONE
            anew = anew[inside]
            rank[anew], made[anew] = self._pairs(symbols[anew], symbols[anew + 1])
        if len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(word)], strict=True):
                keep = self._queued(symbols[a:b])
                done.append((symbols[a:b][keep], place[a:b][keep]))
        if not done:
            return symbols, place
        symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return symbols[order], place[order]

    def _queued(self, symbols: np.ndarray) -> np.ndarray:
        """Merges of one long word, best and leftmost first, in place; returns which places remain."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), np.ones(n, bool)
        value = symbols.tolist()
        rank, made = (x.tolist() for x in self._pairs(symbols[:-1], symbols[1:]))
        queue = [(rank[i], i, value[i], value[i + 1], made[i]) for i in range(n - 1) if rank[i] != _NONE]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, piece = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or value[i] != left or value[j] != right:
                continue
            value[i], alive[j] = piece, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (pair := self.pairs.get(value[a] * self.width + value[b])):
                    heapq.heappush(queue, (pair[0], a, value[a], value[b], pair[1]))
        symbols[:] = value
        return alive

    def _as_ids(self, symbols: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: characters without a piece become their UTF-8 bytes."""
        lacks = np.flatnonzero(symbols >= self.size)
        if len(lacks):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[lacks] - self.size).tolist()]
            size = np.ones(len(symbols), np.int64)
            size[lacks] = [len(r) for r in raw]
            at = np.cumsum(size) - size
            ids = np.repeat(symbols, size)
            ids[np.repeat(at[lacks], size[lacks]) + gathered(np.r_[0, np.cumsum(size[lacks])], np.arange(len(lacks)))[0] - np.repeat(np.cumsum(size[lacks]) - size[lacks], size[lacks])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            symbols, part = ids, np.repeat(part, size)
        return symbols.astype(np.int32), np.r_[0, np.cumsum(np.bincount(part, minlength=n))]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Strings of lists of ids, null ids passed over; ids outside the vocabulary raise."""
        flat = ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py())
        # a null row may have items in the buffers; it is treated as empty
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = ids.offsets.to_numpy()[:-1].astype(np.int64) - ids.offsets[0].as_py()
        places = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        row = np.repeat(np.arange(len(size)), size)
        values = flat.take(pa.array(places))
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        values, row = values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), row[valid]
        if len(values) and (values.min() < 0 or values.max() >= self.size):
            raise ValueError("an id outside the vocabulary")
        control = self.control[values]
        # bytes before and after a control id never make one character: what stands between control ids is decoded alone
        runs = 1 + np.bincount(row[control], minlength=len(size))
        run, first = (row + np.cumsum(control))[~control], np.unique(row[~control], return_index=True)[1]
        values = values[~control]
        values[first] += self.size
        offsets = np.r_[0, np.cumsum(np.bincount(run, minlength=runs.sum()))]
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), self._binary.take(pa.array(values)))
        joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
        try:
            out = joined.cast(pa.string())
        except pa.ArrowInvalid:
            out = pa.array([b.decode("utf-8", "presswork_each_byte") for b in joined.to_pylist()], pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(runs)], pa.int32()), out), "") if control.any() else out


codecs.register_error("presswork_each_byte", lambda e: ("\ufffd", e.start + 1))


class Encoder:
    """Encodes whole texts and remembers the parts it has met, up to a bound that results don't depend on."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.parts, self.chars = Parts(), 0
        self.ids, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of each text, flat, and where each text's begin."""
        if len(self.parts) > _KNOWN or self.chars > _KNOWN_CHARS:
            self._forget()
        rows = [self.parts.number(t) for t in texts]
        known = len(self.offsets) - 1
        if new := list(itertools.islice(self.parts, known, None)):
            self.chars += sum(map(len, new))
            ids, offsets = self.model.encode(new)
            self.offsets = np.r_[self.offsets, offsets[1:] + len(self.ids)]
            self.ids = np.r_[self.ids, ids]
        places, size = gathered(self.offsets, np.concatenate(rows) if rows else np.empty(0, np.int32))
        ends = np.r_[0, np.cumsum(size)][np.cumsum([0, *map(len, rows)])]
        return self.ids[places], ends


@functools.lru_cache(maxsize=4)
def encoder(blob: bytes) -> Encoder:
    return Encoder(loaded(blob))


@functools.lru_cache(maxsize=4)
def loaded(blob: bytes) -> PieceModel:
    return PieceModel(blob)


def model_bytes(path: str) -> bytes:
    """A model file's content. It travels with the plan: executors need no file."""
    with open(path, "rb") as f:
        return f.read()


def chunks(texts: list[str | None], most: int = _CHUNK) -> Iterator[list[str | None]]:
    """Texts in runs of bounded length, one at least."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def _id_lists(texts: pa.Array, model: bytes) -> Iterator[pa.Array]:
    """The ids of texts, a bounded run of rows at a time."""
    for run in chunks(texts.to_pylist()):
        ids, offsets = encoder(model).encode(run)
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _joined(runs: Iterator[pa.Array], kind: pa.DataType) -> pa.Array:
    out = list(runs)
    return pa.concat_arrays(out) if out else pa.array([], kind)


def piece_ids(text: Column, model: bytes) -> Column:
    """Ids of each text; an empty list for null and empty ones. No begin or end ids, no sampling."""
    return F.arrow_udf(lambda texts: _joined(_id_lists(texts, model), pa.list_(pa.int32())), "array<int>")(text)


def piece_text(ids: Column, model: bytes) -> Column:
    """The text of each list of ids; an empty one for null and empty lists."""

    def decode(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // (_CHUNK // 4))) + 1).tolist(), len(lists)]
        return _joined((loaded(model).decode(lists.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a), pa.string())

    return F.arrow_udf(decode, "string")(ids)


def round_trip(text: Column, model: bytes) -> Column:
    """`ids` of each text and the `text` that they decode to, in one pass."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def both(texts: pa.Array) -> pa.Array:
        return _joined((pa.StructArray.from_arrays([ids, loaded(model).decode(ids)], fields=list(kind)) for ids in _id_lists(texts, model)), kind)

    return F.arrow_udf(both, "ids array<int>, text string")(text)
