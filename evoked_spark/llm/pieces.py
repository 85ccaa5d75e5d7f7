"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation is a path through the lattice of pieces.  Giant documents are
cut into chunks at fixed offsets.  What a chunk must know of the text before it
is its boundary state: the piece that covers or ends at the cut and how far it
reaches over.  For every entry state the chunk finds the best weight of
reaching every exit state; these transfer matrices are combined by the max-plus
product, which is associative, in a tree of bounded fan-out, and on the way
back down every chunk learns its own entry and exit state and traces its pieces
alone.

Weights by model type: a unigram model adds piece scores.  In a BPE model two
neighbouring pieces weigh 0 if merging their joined text gives these two pieces
again, and minus infinity if not; the only path of weight 0 is the one that the
merges produce.  No piece of the usual models crosses from a word into the next
blank, so every such place is a free state of its own; what lies between the
first and the last of them in a chunk doesn't depend on the chunk's cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Characters of a chunk, matrices combined at a time, pairs of pieces remembered by a worker.
CHUNK, FANOUT, REMEMBERED = 32_768, 64, 500_000
MARK = "▁"
#: The free state, between two words; pieces of a path are (end, piece id), with UNKNOWN for a character without a piece.
FREE, UNKNOWN = -1, -2
Matrix = dict[tuple[int, int], float]


class Pieces:
    """A SentencePiece model, given as the bytes of its file: identity normaliser, unigram or BPE."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are supported: others change the text")
        self.prefix = " " if spec.normalizer_spec.add_dummy_prefix else ""
        spec.normalizer_spec.add_dummy_prefix = False  # the prefix is added here, so that parts of a text can be encoded
        self.library = SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.bpe = spec.trainer_spec.model_type == 2
        kinds = proto.ModelProto.SentencePiece
        self.text = [p.piece.replace(MARK, " ") for p in spec.pieces]
        self.score = [p.score for p in spec.pieces]
        self.byte = {i: int(p.piece[3:5], 16) for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.in_byte_run = np.zeros(len(self.text), bool)
        for i, b in self.byte.items():
            if b < 128:
                self.text[i] = chr(b)
            else:
                self.in_byte_run[i] = True
        self.unk = self.library.unk_id()
        self.ids = {self.text[i]: i for i, p in enumerate(spec.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.longest = max(map(len, self.ids))
        words_only = not any(re.search("[^ ] ", t) for t in self.ids)
        self.unit = re.compile(f" *[^ {MARK}]+| +|{MARK}" if words_only else f"[^{MARK}]+|{MARK}")
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.made: dict[int, bool] = {}

    def unknown(self, char: str) -> list[int]:
        return [self.of_byte[b] for b in char.encode()] if self.of_byte else [self.unk]

    # between two free states

    def encode_free(self, text: str) -> list[int]:
        """Ids of a part that begins and ends in the free state; U+2581 is kept as a character, so that decoding gives it back."""
        first, *others = text.split(MARK)
        ids = self.library.encode(first)
        for part in others:
            ids += self.unknown(MARK) + self.library.encode(part)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; equal to the library's wherever the text has no U+2581."""
        return self.encode_free(self.prefix + text) if text else []

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes of one character follow each other."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if not self.in_byte_run[ids].any():  # each id is text of its own
            return "".join(map(self.text.__getitem__, ids.tolist()))[len(self.prefix) :]
        out, run = [], bytearray()
        for i, part in zip(ids.tolist(), map(self.text.__getitem__, ids.tolist())):
            if self.in_byte_run[i]:
                run.append(self.byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(part)
        return "".join([*out, run.decode("utf-8", "replace")])[len(self.prefix) :]

    # the lattice

    def weight(self, before: int, piece: int) -> float | None:
        """What ``piece`` adds behind ``before``; None if it can't follow."""
        if not self.bpe:
            return self.score[piece] if piece >= 0 else min(self.score) - 10
        if before < 0 or piece < 0:
            return 0.0
        pair = (before, piece)
        if pair not in self.neighbours:
            if len(self.neighbours) > REMEMBERED:
                self.neighbours.clear()
            self.neighbours[pair] = self.library.encode(self.text[before] + self.text[piece]) == [before, piece]
        return 0.0 if self.neighbours[pair] else None

    def reachable(self, piece: int) -> bool:
        """Whether merging ever makes this piece."""
        if self.bpe and piece not in self.made:
            self.made[piece] = self.library.encode(self.text[piece]) == [piece]
        return not self.bpe or self.made[piece]

    def pieces_at(self, text: str, at: int) -> Iterator[int]:
        if text[at] == MARK:
            yield UNKNOWN
            return
        for stop in range(at + 1, min(at + self.longest, len(text)) + 1):
            piece = self.ids.get(text[at:stop])
            if piece is not None and self.reachable(piece):
                yield piece
        if text[at] not in self.ids:
            yield UNKNOWN

    def length(self, piece: int) -> int:
        return 1 if piece == UNKNOWN else len(self.text[piece])

    def scan(self, text: str, begin: int, stop: int, entries: dict[int, int]) -> dict[tuple[int, int], dict[int, tuple[float, int]]]:
        """Best paths from each entry state over text[begin:stop]; a state is mapped to its piece's end.

        Gives, for every (end, piece) reached and every entry that reaches it, the weight and the piece before.
        Pieces may end behind ``stop``; those that do, or end there, aren't followed further.
        """
        nodes: dict[tuple[int, int], dict[int, tuple[float, int]]] = {}
        by_end: dict[int, list[int]] = {}
        for state, end in entries.items():
            piece = FREE if state == FREE else state // 64 - 3
            nodes.setdefault((end, piece), {})[state] = (0.0, FREE)
            if piece not in by_end.setdefault(end, []):
                by_end[end].append(piece)
        for at in range(begin, stop):
            if at not in by_end:
                continue
            after = list(self.pieces_at(text, at))
            for piece in by_end[at]:
                paths = nodes[at, piece]
                for nxt in after:
                    w = self.weight(piece, nxt)
                    if w is None:
                        continue
                    end = at + self.length(nxt)
                    node = nodes.setdefault((end, nxt), {})
                    if not node:
                        by_end.setdefault(end, []).append(nxt)
                    for state, (total, _) in paths.items():
                        if state not in node or node[state][0] < total + w:
                            node[state] = (total + w, piece)
        return nodes

    def states(self, text: str, cut: int, low: int, high: int) -> dict[int, int]:
        """The states at ``cut`` inside one unit text[low:high], each with the end of its piece."""
        found = {}
        for start in range(max(low, cut - self.longest), cut):
            for piece in self.pieces_at(text[:high], start):
                end = start + self.length(piece)
                if end >= cut:
                    found[(piece + 3) * 64 + end - cut] = end
        return found

    def trace(self, nodes: dict, end: int, piece: int, state: int, begin: int, text: str) -> list[int]:
        """Ids of the path into (end, piece) that started from ``state`` at or behind ``begin``."""
        out = []
        while end - self.length(piece) >= begin if piece != FREE else False:
            start = end - self.length(piece)
            out.append(self.unknown(text[start]) if piece == UNKNOWN else [piece])
            end, piece = start, nodes[end, piece][state][1]
        return list(chain.from_iterable(reversed(out)))

    # one chunk: text[begin:stop] of a window of text that reaches over both cuts

    def _parts(self, text: str, begin: int, stop: int) -> tuple[list[int], list[tuple[int, int]]]:
        bounds = [m.span() for m in self.unit.finditer(text)]
        return [a for a, _ in bounds if begin <= a <= stop] + ([stop] if stop == len(text) else []), bounds

    def transfer(self, text: str, begin: int, stop: int) -> Matrix:
        """Best weight from every state at ``begin`` to every state at ``stop``."""
        free, bounds = self._parts(text, begin, stop)
        around = lambda cut: next(((a, b) for a, b in bounds if a < cut < b), None)
        first, last = around(begin), around(stop)
        entries = self.states(text, begin, *first) if first else {FREE: begin}
        exits = self.states(text, stop, *last) if last else {FREE: stop}
        if not free:  # both cuts in one unit
            nodes = self.scan(text[: first[1]], begin, stop, entries)
            return {(s, x): nodes[end, x // 64 - 3][s][0] for x, end in exits.items() if (end, x // 64 - 3) in nodes for s in nodes[end, x // 64 - 3]}
        into, out_of = {FREE: 0.0}, {FREE: 0.0}
        if first:
            nodes = self.scan(text[: first[1]], begin, first[1], entries)
            into = {}
            for (end, _), paths in nodes.items():
                for s, (w, _) in paths.items() if end == first[1] else ():
                    into[s] = max(w, into.get(s, w))
        if last:
            nodes = self.scan(text[: last[1]], last[0], stop, {FREE: last[0]})
            out_of = {x: nodes[end, x // 64 - 3][FREE][0] for x, end in exits.items() if FREE in nodes.get((end, x // 64 - 3), ())}
        return {(s, x): a + b for s, a in into.items() for x, b in out_of.items()}

    def pieces(self, text: str, begin: int, stop: int, entry: int, leave: int) -> list[int]:
        """Ids of the pieces that start in the chunk, on the best path between the given states."""
        free, bounds = self._parts(text, begin, stop)
        first = next(((a, b) for a, b in bounds if a < begin < b), None)
        last = next(((a, b) for a, b in bounds if a < stop < b), None)
        entries = {entry: begin if entry == FREE else begin + entry % 64}
        end, piece = stop + leave % 64, leave // 64 - 3
        if not free:
            return self.trace(self.scan(text[: first[1]], begin, stop, entries), end, piece, entry, begin, text)
        ids = []
        if first:
            nodes = self.scan(text[: first[1]], begin, first[1], entries)
            best = max((paths[entry][0], p) for (e, p), paths in nodes.items() if e == first[1] and entry in paths)[1]
            ids += self.trace(nodes, first[1], best, entry, begin + entry % 64 if entry != FREE else begin, text)
        ids += self.encode_free(text[free[0] : free[-1]])
        if last:
            ids += self.trace(self.scan(text[: last[1]], last[0], stop, {FREE: last[0]}), end, piece, FREE, last[0], text)
        return ids


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product."""
    by_entry: dict[int, list[tuple[int, float]]] = {}
    for (mid, x), w in b.items():
        by_entry.setdefault(mid, []).append((x, w))
    out: Matrix = {}
    for (s, mid), w in a.items():
        for x, v in by_entry.get(mid, ()):
            if out.get((s, x), -np.inf) < w + v:
                out[s, x] = w + v
    return out


def best_states(parts: list[Matrix], entry: int, leave: int) -> list[tuple[int, int]]:
    """Entry and exit state of each of the parts on the best path from ``entry`` to ``leave``."""
    reached, back = {entry: 0.0}, []
    for m in parts:
        after, origin = {}, {}
        for (s, x), w in m.items():
            if s in reached and (x not in after or after[x] < reached[s] + w):
                after[x], origin[x] = reached[s] + w, s
        reached = after
        back.append(origin)
    out = []
    for origin in reversed(back):
        out.append((origin[leave], leave))
        leave = origin[leave]
    return out[::-1]


_MATRIX = "matrix array<struct<s:int,x:int,w:double>>"
_pack = lambda m: [{"s": s, "x": x, "w": w} for (s, x), w in m.items()]
_unpack = lambda rows: {(r["s"], r["x"]): r["w"] for r in rows}


def _chunk_states(chunks: DataFrame, model: bytes, scratch: Scratch) -> DataFrame:
    """``(row, idx, entry, leave)`` for ``chunks(row, idx, text, begin, stop)``."""

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pieces(model)
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "idx": batch["idx"], "matrix": [_pack(own.transfer(t, b, e)) for t, b, e in zip(batch["text"], batch["begin"], batch["stop"])]})

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "idx": batch["up"], "matrix": [_pack(reduce(product, [_unpack(p["matrix"]) for p in parts])) for parts in batch["parts"]]})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                states = best_states([_unpack(p["matrix"]) for p in r.parts], r.entry, r.leave)
                out += [(r.row, p["idx"], s, x) for p, (s, x) in zip(r.parts, states)]
            yield pd.DataFrame(out, columns=["row", "idx", "entry", "leave"])

    def siblings(level: DataFrame) -> DataFrame:
        """At most FANOUT matrices in a row, in order."""
        up = F.expr(f"idx div {FANOUT}").cast("int")
        return level.groupBy("row", up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "matrix"))).alias("parts"))

    levels = [scratch.save(chunks.select("row", "idx", "text", "begin", "stop").mapInPandas(transfers, f"row long, idx int, {_MATRIX}"))]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        levels.append(scratch.save(siblings(levels[-1]).mapInPandas(combined, f"row long, idx int, {_MATRIX}")))
    known = levels[-1].select("row", "idx", F.lit(FREE).alias("entry"), F.lit(FREE).alias("leave"))
    for level in reversed(levels[:-1]):
        inside = siblings(level).join(known.withColumnRenamed("idx", "up").hint("merge"), ["row", "up"])
        known = scratch.save(inside.mapInPandas(spread, "row long, idx int, entry int, leave int"))
    return known


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what is made of them never fills a worker's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[i:j] for i, j in zip(offsets[:-1], offsets[1:]))


def encoded(docs: DataFrame, model: bytes, text_col: str = "text", carry: list[str] | None = None, chunk: int = CHUNK, verify: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``rec`` (the columns of each row, or those in ``carry``), ``n_chunks`` and ``ids`` of the whole text.

    Texts of at most ``chunk`` characters are one chunk and stay where they
    are; the chunks of longer ones are spread over the cluster.  ``verify``
    adds ``round_trip``: decoding the ids, where they are made, gives the text
    back (no second trip of ids and texts through Python).  A null or
    empty text has no ids.  Repeated rows are encoded each; an empty table
    gives an empty result.
    """
    scratch, around = scratch or Scratch(docs.sparkSession), 64
    names = docs.columns if carry is None else carry
    rec = F.struct(*[F.col(f"`{c}`") for c in names])
    own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"rec.`{text_col}`").cast("string"), F.lit("")) if text_col in names else F.col("text")
    apart = text_col not in names  # a text that is carried isn't kept twice
    rows = docs.select(rec.alias("rec"), *[own.alias("text")] * apart, F.monotonically_increasing_id().alias("row"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model)
        for part in _slices(batches):
            texts = part.column("text").to_pylist() if apart else pc.struct_field(part.column("rec"), text_col).to_pylist()
            ids = [own.encode(t or "") for t in texts]
            values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids))))
            offsets = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32))
            made = {"rec": part.column("rec"), "n_chunks": pa.array([1] * len(ids), pa.int32()), "ids": pa.ListArray.from_arrays(offsets, values)}
            if verify:
                made["round_trip"] = pa.array([own.decode(i) == (t or "") for i, t in zip(ids, texts)], pa.bool_())
            yield pa.record_batch(made)

    checked = [T.StructField("round_trip", T.BooleanType())] if verify else []
    out = T.StructType([rows.schema["rec"], T.StructField("n_chunks", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *checked])
    short = rows.where(F.length(text) <= chunk).drop("row").mapInArrow(whole, out)

    prefix = Pieces(model).prefix
    giants = scratch.save(rows.where(F.length(text) > chunk))
    body = F.concat(F.lit(prefix), text)
    size = F.length(body)
    cut = giants.select("row", body.alias("body"), size.alias("size"), F.explode(F.sequence(F.lit(0), (F.ceil(size / chunk) - 1).cast("int"))).alias("idx"))
    low = F.greatest(F.col("idx") * chunk - around, F.lit(0))
    high = F.least((F.col("idx") + 1) * chunk + around, F.col("size"))
    chunks = cut.select("row", "idx", F.substring("body", low + 1, high - low).alias("text"), (F.col("idx") * chunk - low).alias("begin"), (F.least((F.col("idx") + 1) * chunk, F.col("size")) - low).alias("stop"))
    chunks = scratch.save(chunks.repartition("row", "idx"))
    states = _chunk_states(chunks, model, scratch)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pieces(model)
        for batch in batches:
            ids = [np.array(own.pieces(r.text, r.begin, r.stop, r.entry, r.leave), np.int32) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"row": batch["row"], "idx": batch["idx"], "ids": ids})

    traced = chunks.join(states.hint("merge"), ["row", "idx"]).mapInPandas(pieces, "row long, idx int, ids array<int>")
    joined = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("idx", "ids"))).alias("parts"))
    joined = joined.select("row", F.size("parts").alias("n_chunks"), F.flatten("parts.ids").alias("ids"))
    long = giants.join(joined.hint("merge"), "row").select("rec", *[text.alias("text")] * apart, "n_chunks", "ids")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model)
        for part in _slices(batches, 16):
            texts = (part.column("text") if apart else pc.struct_field(part.column("rec"), text_col)).to_pylist()
            same = [own.decode(ids) == (t or "") for ids, t in zip(_lists(part.column("ids")), texts)]
            yield pa.record_batch({"rec": part.column("rec"), "n_chunks": part.column("n_chunks"), "ids": part.column("ids"), "round_trip": pa.array(same, pa.bool_())})

    return short.unionAll(long.mapInArrow(compared, out) if verify else long.select("rec", "n_chunks", "ids"))


def decoded(rows: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids; the exact inverse of :func:`encoded` (null becomes empty)."""

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model)
        for part in _slices(batches):
            column = part.column(part.schema.get_field_index(ids_col))
            texts = [own.decode(ids) for ids in _lists(column)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(text, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
