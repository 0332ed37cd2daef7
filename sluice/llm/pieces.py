"""SentencePiece (BPE) encoding with offsets, and decoding.

1. *Normalisation.* The model's compiled character map (a double-array trie followed by its
   replacement strings) is walked for the longest matching prefix at every character; each
   normalised byte records the original byte it came from. White space follows the model's
   flags (dummy prefix, extra spaces, the visible space U+2581).
2. *Merging.* No piece joins something else to a following U+2581, and characters that occur in
   no longer piece never merge, so the text falls into short segments that can be merged on
   their own; every task keeps a bounded table of segments it has met. The new segments of a slice
   of texts merge together, a step of all of them at a time; long ones are cut before, between
   neighbours that stand together in no piece. Within a segment the best-scored neighbours merge
   first, the leftmost of equals. Characters outside the vocabulary become byte pieces (a model
   without them is refused).
3. *Projection.* Normalised lengths of the pieces add up to normalised offsets, which the
   recorded alignment turns into original byte spans.

Defined cases: null and empty texts have no pieces, only the end id if asked for; they decode
to the empty text. Repeated rows give repeated results; an empty table gives no rows; texts of any length are
encoded whole. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
The model (a file of fixed size) is read once on the driver and shipped with the task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.base import give_back

SPACE = "▁"
#: segments a task remembers, and their characters (mean)
TABLE, LETTERS = 100_000, 24
#: characters of a segment that merges together with others, and widths that share a table
SHORT, WIDTHS = 48, (4, 8, 12, 16, 24, 48)
#: a character that is no piece counts as this plus its code point; neighbours as one number, by a shift
ODD, SHIFT = 1 << 20, np.int64(22)


class CharMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size:] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest entry that starts at ``at``, and how many bytes it takes;
        one unchanged character if there is none."""
        best, took = None, 0
        if self.units:
            pos = _offset(self.units[0])
            for i in range(at, len(data)):
                pos ^= data[i]
                unit = self.units[pos]
                if unit & 0x800000FF != data[i]:
                    break
                pos ^= _offset(unit)
                if unit >> 8 & 1:
                    best, took = self.units[pos] & 0x7FFFFFFF, i + 1 - at
        if best is not None:
            return self.strings[best:self.strings.index(b"\0", best)], took
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at:at + n], n


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class PieceModel:
    """Vocabulary, flags, encoder and decoder of one BPE model file."""

    def __init__(self, blob: bytes, table: int = TABLE) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        model.ParseFromString(blob)
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("only BPE models are supported")
        kinds = proto.ModelProto.SentencePiece
        self.names = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces)
                    if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        if any(t in (kinds.USER_DEFINED, kinds.UNUSED) for t in self.kind):
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = self.kind.index(kinds.UNKNOWN)
        self.unknown_text = model.trainer_spec.unk_surface
        self.end = model.trainer_spec.eos_id
        self.byte = {int(n[1:-1], 16): i for i, n in enumerate(self.names) if self.kind[i] == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.control = {i for i, t in enumerate(self.kind) if t == kinds.CONTROL}
        flags = model.normalizer_spec
        self.dummy, self.squeeze, self.escape = (flags.add_dummy_prefix, flags.remove_extra_whitespaces,
                                                 flags.escape_whitespaces)
        self.map = CharMap(flags.precompiled_charsmap)
        if model.trainer_spec.treat_whitespace_as_suffix or not self.escape:
            raise ValueError("white space must be escaped and stand before words")
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        merging = {c for n in self.ids if len(n) > 1 for c in n}
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in merging)
        single = f"[{alone}]|" if alone else ""
        self.cut = re.compile(f"{single}{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+").findall
        self.pairs = {x + y for n in self.ids for x, y in zip(n, n[1:])}
        self.digits = [str(i) for i in range(len(self.names))]
        #: normalised bytes of a piece; without byte pieces an unknown character has any width
        self.width = [1 if i in self.byte_of else len(n.encode()) for i, n in enumerate(self.names)]
        if not self.byte:
            raise ValueError("the model needs byte pieces")
        self._tables()
        self.most = table
        self.forget()
        #: ids whose text is their name
        self.plain = [i not in self.byte_of and i not in self.control and i != self.unknown
                      for i in range(len(self.names))]
        self.shown = [n.replace(SPACE, " ") for n in self.names]
        self.widths = np.array(self.width, np.int64)
        #: bytes of each id; those of control ids are in no text
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"\xff" if i in self.control
                    else self.unknown_text.encode() if i == self.unknown else t.encode() for i, t in enumerate(self.shown)]
        #: original bytes of a piece, where every U+2581 was a space
        self.bytes = np.array([1 if i in self.byte_of else len(t.encode()) for i, t in enumerate(self.shown)], np.int64)

    def _tables(self) -> None:
        """Symbols of characters, scores of symbols, and which two neighbours join to what."""
        top = max((ord(c) for n in self.ids for c in n), default=0)
        self.symbols = np.arange(top + 1, dtype=np.int64) + ODD
        for n, i in self.ids.items():
            if len(n) == 1:
                self.symbols[ord(n)] = i
        symbol = self.ids | {c: int(self.symbols[ord(c)]) for n in self.ids for c in n}
        self.scores = np.full(len(self.names) + 1, -np.inf)
        for n, i in self.ids.items():
            self.scores[i] = self.score[n]
        joins = {symbol[n[:k]] << int(SHIFT) | symbol[n[k:]]: i for n, i in self.ids.items()
                 for k in range(1, len(n)) if n[:k] in symbol and n[k:] in symbol}
        # open addressing: a key lies at its place or in the next free one after it
        self.mask = (4 << max(1, len(joins)).bit_length()) - 1
        self.pair = np.full(self.mask + 1, -1, np.int64)
        self.joined = np.full(self.mask + 1, -1, np.int32)
        for key, at in zip(joins, self._place(np.array(list(joins), np.int64)).tolist()):
            while self.pair[at] >= 0:
                at = at + 1 & self.mask
            self.pair[at], self.joined[at] = key, joins[key]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(40)).astype(np.int64) & self.mask

    # normalisation -----------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if not self.map.units and not self.squeeze:
            return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text; for each of its bytes, and its end, the original byte offset."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            at = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
            lead = np.zeros(3 if self.dummy else 0, np.int64)
            return self.normalise(text), np.concatenate([lead, at, [len(raw)]])
        space = SPACE.encode()
        out, origin, at, size = bytearray(), [], 0, len(data)
        blank = self.squeeze
        if self.squeeze:
            while at < size and (step := self.map.longest(data, at))[0] == b" ":
                at += step[1]
        if at < size and self.dummy:
            out += space
            origin += [at] * 3
        while at < size:
            piece, took = self.map.longest(data, at)
            if blank:
                piece = piece.lstrip(b" ")
            if piece:
                blank = self.squeeze and piece.endswith(b" ")
                piece = piece.replace(b" ", space)
                out += piece
                origin += [at] * len(piece)
            at += took
        end = size
        if self.squeeze:
            while out.endswith(space):
                del out[-3:]
                end = origin[-3]
                del origin[-3:]
        return out.decode("utf-8", "replace"), np.array([*origin, end], np.int64)

    # encoding ----------------------------------------------------------------------

    def forget(self) -> None:
        """Empty the table of segments: ``flat[start:start + size]`` are the ids of each."""
        self.table: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start, self.size, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that neighbours join to, -1 where there is none."""
        keys = left << SHIFT | right
        at = self._place(keys)
        met = self.pair[at]
        out = np.where(met == keys, self.joined[at], -1)
        open_ = np.nonzero((met != keys) & (met >= 0))
        while len(open_[0]):
            at[open_] = at[open_] + 1 & self.mask
            met = self.pair[at[open_]]
            hit = met == keys[open_]
            out[tuple(x[hit] for x in open_)] = self.joined[at[tuple(x[hit] for x in open_)]]
            open_ = tuple(x[~hit & (met >= 0)] for x in open_)
        return out

    def _merge(self, parts: np.ndarray, size: np.ndarray) -> None:
        """Merge the symbols of each row (``size`` of them, then 0) in place: best-scored neighbours
        first, leftmost of equals. A step merges one pair of every row that still has one."""
        n, width = parts.shape
        if width < 2:
            return
        cols = np.arange(width)
        rows, now = np.arange(n), parts
        marks = np.full((n, width), -1, np.int32)
        marks[:, :-1] = np.where(cols[1:] < size[:, None], self._join(now[:, :-1], now[:, 1:]), -1)
        while True:
            best = self.scores[marks].argmax(axis=1)
            made = marks[np.arange(len(rows)), best]
            if (made < 0).any():
                parts[rows] = now
                go = made >= 0
                rows, now, marks, best, made = rows[go], now[go], marks[go], best[go], made[go]
            if not len(rows):
                return
            size[rows] -= 1
            line = np.arange(len(rows))
            after = cols >= best[:, None]
            # what stands after the pair moves up by one; the last column, now free, is 0 and joins nothing
            moved = np.zeros_like(now)
            moved[:, :-1] = now[:, 1:]
            now = np.where(after, moved, now)
            now[line, best] = made
            moved = np.full_like(marks, -1)
            moved[:, :-1] = marks[:, 1:]
            marks = np.where(after, moved, marks)
            left = size[rows]
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side + 1 < left))
                a = side[ok]
                marks[ok, a] = self._join(now[ok, a], now[ok, a + 1])
            gone = np.flatnonzero(best + 1 >= left)
            marks[gone, best[gone]] = -1

    def _merge_long(self, parts: list) -> list[str]:
        """The same with a queue, for long segments."""
        score, n = self.score, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-score[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in score]
        heapq.heapify(queue)
        while queue:
            _, i, joined = heapq.heappop(queue)
            left = parts[i]
            j = after[i]
            if left is None or j >= n or left + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := joined + parts[k]) in score:
                    heapq.heappush(queue, (-score[p], i, p))
            h = before[i]
            if h >= 0 and (p := parts[h] + joined) in score:
                heapq.heappush(queue, (-score[p], h, p))
        return [p for p in parts if p is not None]

    def _cores(self, segment: str) -> list[str]:
        """A long segment cut between neighbours that stand together in no piece."""
        cuts = [0, *(i for i in range(1, len(segment)) if segment[i - 1:i + 1] not in self.pairs), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, segments: list[str]) -> None:
        """Merge segments that are not in the table and put them there."""
        cores, many = segments, None
        if max(map(len, segments)) > SHORT:
            each = [[s] if len(s) <= SHORT else self._cores(s) for s in segments]
            cores, many = [c for e in each for c in e], np.array([len(e) for e in each])
        size = np.array([len(c) for c in cores])
        begin = np.cumsum(size) - size
        points = np.frombuffer("".join(cores).encode("utf-32-le"), np.uint32).astype(np.int64)
        top = len(self.symbols) - 1
        symbols = np.where(points <= top, self.symbols[np.minimum(points, top)], points + ODD)
        # the merged symbols of a core lie from its beginning on
        for low, width in zip((0, *WIDTHS), WIDTHS):
            rows = np.flatnonzero((size > low) & (size <= width))
            if len(rows):
                at = begin[rows, None] + np.arange(width)
                parts = np.where(np.arange(width) < size[rows, None], symbols[np.minimum(at, len(symbols) - 1)], 0)
                left = size[rows]
                self._merge(parts, left)
                put = np.arange(width) < left[:, None]
                symbols[at[put]] = parts[put]
                size[rows] = left
        for k in np.flatnonzero(size > SHORT).tolist():
            made = [self.ids.get(p, ODD + ord(p[0])) for p in self._merge_long(list(cores[k]))]
            symbols[begin[k]:begin[k] + len(made)] = made
            size[k] = len(made)
        if many is not None:
            first = np.cumsum(many) - many
            ids, count = symbols[_runs(begin, size)], np.add.reduceat(size, first)
        else:
            ids, count = symbols[_runs(begin, size)], size
        odd = np.flatnonzero(ids >= ODD)
        if len(odd):
            raw = [chr(c - ODD).encode() for c in ids[odd].tolist()]
            wide = np.ones(len(ids), np.int64)
            wide[odd] = [len(b) for b in raw]
            ids = np.repeat(ids, wide)
            ids[ids >= ODD] = [self.byte[b] for r in raw for b in r]
            count = np.add.reduceat(wide, np.cumsum(count) - count)
        self.table.update(zip(segments, range(len(self.table), len(self.table) + len(segments))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.size = np.concatenate([self.size, count])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.letters += len(points)

    def pieces(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts, one text after the other, and where each begins (and the last ends)."""
        cuts = list(map(self.cut, normal))
        if len(self.table) > self.most or self.letters > LETTERS * self.most:
            self.forget()
        new = list(set().union(*cuts).difference(self.table))
        if new:
            self._learn(new)
        count = np.array([len(c) for c in cuts], np.int64)
        seg = np.fromiter(map(self.table.__getitem__, chain.from_iterable(cuts)), np.int64, int(count.sum()))
        size = self.size[seg]
        ends = np.append(0, np.cumsum(size))
        return self.flat[_runs(self.start[seg], size)], ends[np.append(0, np.cumsum(count))]

    def traces(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts, one after the other: ids, where each text begins among them (and the last
        ends), and the original byte spans ``[begin, end)`` of the pieces. No end ids."""
        texts = [t or "" for t in texts]
        plain = not self.map.units and not self.squeeze
        # where each U+2581 was a space, the widths of the pieces add up to original offsets
        known = {k: self.aligned(t) for k, t in enumerate(texts) if not plain or SPACE in t}
        ids, at = self.pieces([known[k][0] if k in known else self.normalise(t) for k, t in enumerate(texts)])
        total = np.append(0, np.cumsum(self.bytes[ids]))
        begins, ends = (x - np.repeat(total[at[:-1]] + self.dummy, np.diff(at)) for x in (total[:-1], total[1:]))
        begins[at[:-1][np.diff(at) > 0]] = 0
        for k, (_, origin) in known.items():
            a, b = at[k], at[k + 1]
            stop = np.cumsum(self.widths[ids[a:b]])
            begins[a:b], ends[a:b] = origin[np.append(0, stop[:-1])[:b - a]], origin[stop]
        return ids, at, begins, ends

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        ids = self.pieces([self.normalise(text or "")])[0].tolist()
        return ids + [self.end] if end else ids

    def trace(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the end id, and the original byte spans ``[begin, end)`` of the pieces before it."""
        ids, _, begins, ends = self.traces([text])
        return [*ids.tolist(), self.end], begins, ends

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans ``[begin, end)`` of the pieces (without an end id)."""
        return self.trace(text)[1:]

    # decoding ----------------------------------------------------------------------

    def _surface(self, ids) -> str:
        """Text of ids with every U+2581 as a space; runs of byte pieces decode together."""
        raw = self.raw
        try:
            # other pieces are whole characters, so this fails where a run of byte pieces does, or at a control id
            return b"".join([raw[i] for i in ids]).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], bytearray()
        plain, shown = self.plain, self.shown
        for i in ids:
            if plain[i] and not run:
                out.append(shown[i])
                continue
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_loose(run))
                run = bytearray()
            if i == self.unknown:
                out.append(self.unknown_text)
            elif i not in self.control:
                out.append(shown[i])
        if run:
            out.append(_loose(run))
        return "".join(out)

    def decode(self, ids) -> str:
        first = next((i for i in ids if i not in self.control), None)
        text = self._surface(ids[:-1] if len(ids) and ids[-1] == self.end else ids)
        lead = first is not None and first not in self.byte_of and self.names[first].startswith(SPACE)
        if lead and self.squeeze:
            return text.lstrip(" ")
        return text[1:] if lead and self.dummy else text


def _loose(run: bytearray) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at:at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def _model(blob: bytes) -> PieceModel:
    return PieceModel(blob)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[k], begin[k] + 1, ...``, ``size[k]`` numbers, for each k."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


def _traced(blob: bytes, batches):
    """A few hundred rows at a time, with what :meth:`PieceModel.traces` finds: ids and spans of long
    texts do not pile up, and segments and freed memory go back when the rows end."""
    model = _model(blob)
    for batch in batches:
        for part in _slices(batch):
            texts = part.column("text").to_pylist()
            yield model, part, texts, *model.traces(texts)
    model.forget()
    give_back()


def _ended(model: PieceModel, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each text."""
    return np.insert(ids, at[1:], model.end), at + np.arange(len(at))


def _encode_batches(blob: bytes):
    def run(batches):
        for model, part, _, ids, at, begins, ends in _traced(blob, batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), _lists(*_ended(model, ids, at)), _lists(begins, at), _lists(ends, at)],
                names=["doc_id", "ids", "begins", "ends"])
    return run


def _digest_batches(blob: bytes):
    def run(batches):
        sha = hashlib.sha256
        for model, part, _, ids, at, begins, ends in _traced(blob, batches):
            spans = np.stack([begins, ends], axis=1).astype("<i8")
            ids, to = _ended(model, ids, at)
            ids, show = ids.tolist(), model.digits.__getitem__
            own = [ids[a:b] for a, b in zip(to.tolist(), to[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(to), pa.int64()),
                 pa.array([sha(" ".join(map(show, i)).encode()).hexdigest() for i in own], pa.string()),
                 pa.array([sha(model.decode(i).encode()).hexdigest() for i in own], pa.string()),
                 pa.array([sha(spans[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
    return run


def _slices(batch: pa.RecordBatch, rows: int = 500):
    """A few hundred rows at a time, so that ids of long texts do not pile up."""
    return [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)]


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))


def _kind(documents: DataFrame) -> str:
    return documents.schema["doc_id"].dataType.simpleString()


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, begins, ends``: ids with the end id; byte spans of the pieces before it."""
    return documents.select("doc_id", "text").mapInArrow(
        _encode_batches(Path(model_path).read_bytes()),
        f"doc_id {_kind(documents)}, ids array<int>, begins array<int>, ends array<int>")


def encode_for_training(documents: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, begins, ends, round_trip``: ids with the end id; byte spans of the
    pieces before it; whether the ids decode to the text (they do, unless it holds U+2581)."""
    blob = Path(model_path).read_bytes()

    def run(batches):
        for model, part, texts, ids, at, begins, ends in _traced(blob, batches):
            ids, to = _ended(model, ids, at)
            own, cuts = ids.tolist(), to.tolist()
            back = [model.decode(own[a:b]) == (t or "") for a, b, t in zip(cuts, cuts[1:], texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), pa.array(np.diff(to), pa.int64()),
                 _lists(ids, to), _lists(begins, at), _lists(ends, at), pa.array(back, pa.bool_())],
                names=["doc_id", "source", "n_tokens", "ids", "begins", "ends", "round_trip"])
    return documents.select("doc_id", "source", "text").mapInArrow(
        run, f"doc_id {_kind(documents)}, source string, n_tokens long, ids array<int>, begins array<int>, "
             "ends array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids decode to the empty text."""
    blob = Path(model_path).read_bytes()

    def run(batches):
        model = _model(blob)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind(encoded)}, text string")


def encoding_digests(documents: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256`` of every row, without materialising ids
    and spans; the last digest is of begin and end of each piece as little-endian 64-bit numbers."""
    return documents.select("doc_id", "text").mapInArrow(
        _digest_batches(Path(model_path).read_bytes()),
        f"doc_id {_kind(documents)}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
