"""Byte-level BPE: batched merge rounds in numpy, and decoding.

A text is cut at the vocabulary's special tokens and then into pieces by the byte-level pattern. All
new pieces of a batch lie in one flat array of symbols; each round looks up every neighbouring pair
by binary search over the sorted pair keys, takes the lowest rank of each piece and merges all its
places at once. Pieces seen before come from a table per task that is bounded in pieces and in characters.

Defined results: null and empty texts have no ids and decode to the empty text. Repeated rows have equal ids. A very
long text is encoded whole; its pieces are not remembered beyond the table's bounds. An empty table gives an empty
one. New columns must not be columns of the table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from fundlens.llm.shared import with_columns

SHIFT = 20  # ids are below 2**20
NONE = np.iinfo(np.int64).max
KNOWN = 200_000  # pieces a task remembers before it starts anew
KNOWN_CHARS = 4_000_000  # characters of them
BYTES = 1 << 20  # text that is encoded at a time, or one longer text
#: Fixed value: the published byte-level pattern, with white space as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_tokenizer(path: str) -> dict:
    """Arrays of a byte-level BPE file: pair keys in order, their ranks and products, bytes of each id."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, symbols = data["model"]["vocab"], byte_symbols()
    merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    keys = np.array([vocab[a] << SHIFT | vocab[b] for a, b in merges], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    spelled = {i: bytes(symbols[c] for c in t) for t, i in vocab.items() if all(c in symbols for c in t)}
    spelled |= {i: t.encode() for t, i in added.items()}
    raw = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    first = np.zeros(256, dtype=np.int64)
    for c, b in symbols.items():
        first[b] = vocab[c]
    return {
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "products": np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order],
        "first": first,
        "bytes": np.frombuffer(b"".join(raw), dtype=np.uint8),
        "ends": np.cumsum([len(r) for r in raw]),
        "special": added,
    }


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of the runs ``flat[start : start + size]``."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


def _look_up(table: dict, ids: np.ndarray, piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and product of the pairs that begin at the places ``at``; pieces end in pairs without rank."""
    after = np.minimum(at + 1, len(ids) - 1)
    key = ids[at] << SHIFT | ids[after]
    place = np.minimum(np.searchsorted(table["keys"], key), len(table["keys"]) - 1)
    good = (table["keys"][place] == key) & (piece[at] == piece[after]) & (after > at)
    return np.where(good, table["ranks"][place], NONE), table["products"][place]


def merge_pieces(table: dict, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and the number of ids of each piece.

    Ranks of pairs are kept between rounds; only the pairs at merged places are looked up again.
    """
    ids = table["first"][np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    done_ids, done_piece = [], []
    if len(ids):
        rank, product = _look_up(table, ids, piece, np.arange(len(ids)))
    while len(ids):
        begin = np.flatnonzero(np.diff(piece, prepend=-1))
        lowest = np.minimum.reduceat(rank, begin)
        size = np.diff(begin, append=len(ids))
        active = np.repeat(lowest < NONE, size)
        where = np.flatnonzero(active & (rank == np.repeat(lowest, size)))
        # in a run of equal neighbours every second place merges, from the left
        fresh = np.diff(where, prepend=-2) > 1
        run = np.flatnonzero(fresh)
        offset = np.arange(len(where)) - np.repeat(run, np.diff(run, append=len(where)))
        where = where[offset % 2 == 0]
        done_ids.append(ids[~active])
        done_piece.append(piece[~active])
        ids[where] = product[where]
        changed = np.zeros(len(ids), dtype=bool)
        changed[where] = True
        changed[np.maximum(where - 1, 0)] = True
        keep = active
        keep[where + 1] = False
        ids, piece, rank, product, changed = ids[keep], piece[keep], rank[keep], product[keep], changed[keep]
        at = np.flatnonzero(changed)
        if len(at):
            rank[at], product[at] = _look_up(table, ids, piece, at)
    if not done_ids:
        return np.empty(0, dtype=np.uint32), np.zeros(len(pieces), dtype=np.int64)
    ids, piece = np.concatenate(done_ids), np.concatenate(done_piece)
    order = np.argsort(piece, kind="stable")
    return ids[order].astype(np.uint32), np.bincount(piece, minlength=len(pieces))


class Encoder:
    """Encodes batches of texts; remembers the ids of at most ``KNOWN`` pieces between batches."""

    def __init__(self, table: dict):
        self.table, self.pattern = table, regex.compile(PATTERN)
        special = sorted(table["special"], key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat = np.empty(0, dtype=np.uint32)
        self.starts = self.sizes = np.empty(0, dtype=np.int64)
        self.add([], [np.array([i], dtype=np.uint32) for i in self.table["special"].values()])

    def add(self, pieces: list[str], ready: list[np.ndarray]) -> None:
        ids, sizes = merge_pieces(self.table, [p.encode() for p in pieces])
        ids = np.concatenate([*ready, ids]).astype(np.uint32)
        sizes = np.concatenate([np.array([len(r) for r in ready], dtype=np.int64), sizes]).astype(np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes]).astype(np.int64)
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def split(self, text: str) -> list[str | int]:
        """Pieces of a text; a special token is given as its place in the table."""
        if not self.cut or not self.cut.search(text):
            return self.pattern.findall(text)
        places = {t: k for k, t in enumerate(self.table["special"])}
        out: list[str | int] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [places[part]] if k % 2 else self.pattern.findall(part)
        return out

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        if len(self.known) > KNOWN or self.chars > KNOWN_CHARS:
            self.forget()
        known, n, new, places, counts = self.known, len(self.sizes), [], [], []
        for text in texts:
            before = len(places)
            for p in self.split(text or ""):
                at = p if type(p) is int else known.get(p)
                if at is None:
                    known[p] = at = n + len(new)
                    new.append(p)
                places.append(at)
            counts.append(len(places) - before)
        if new:
            self.add(new, [])
            self.chars += sum(map(len, new))
        at = np.array(places, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        sizes = np.bincount(owner, weights=self.sizes[at], minlength=len(texts)).astype(np.int64)
        return gather(self.flat, self.starts[at], self.sizes[at]), sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, sizes = self.encode_flat(texts)
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []


def decode_ids(table: dict, ids: np.ndarray) -> str:
    ends = table["ends"]
    starts = np.concatenate([[0], ends[:-1]])
    return gather(table["bytes"], starts[ids], ends[ids] - starts[ids]).tobytes().decode("utf-8", "replace")


def _encoder(table):
    own = Encoder(table.value)
    return lambda texts: [pa.array([i.astype("<u4").tobytes() for i in own.encode(texts)], pa.binary())]


def _decoder(table):
    return lambda rows: [
        pa.array([decode_ids(table.value, np.frombuffer(r or b"", dtype="<u4")) for r in rows], pa.string())
    ]


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text, packed as little-endian 32-bit integers.

    The driver reads the file ``tokenizer`` and sends its arrays, about two megabytes, to the tasks.
    """
    table = docs.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer))
    return with_columns(docs, text, partial(_encoder, table), f"`{ids}` binary")


def decoded(rows: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that packed ids stand for; null ids give the empty text."""
    table = rows.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer))
    return with_columns(rows, ids, partial(_decoder, table), f"`{text}` string")


def _both(batches: Iterator[pa.RecordBatch], table, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    own = Encoder(table.value)
    for batch in batches:
        rest = batch.remove_column(at)
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size) // BYTES
        ends = [*np.flatnonzero(np.diff(block)) + 1, batch.num_rows] if batch.num_rows else []
        for start, stop in zip([0, *ends], ends, strict=False):
            ids = own.encode(batch.column(at).slice(start, stop - start).to_pylist())
            packed = pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())
            texts = pa.array([decode_ids(table.value, i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*rest.slice(start, stop - start).columns, packed, texts], names=names)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` and ``decoded`` in one pass, so that a task has one Python worker; ``text`` itself is left out."""
    table = docs.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer))
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = StructType([*kept, *StructType.fromDDL(f"`{ids}` binary, `{decoded}` string").fields])
    names = [f.name for f in schema.fields]
    return docs.mapInArrow(partial(_both, table=table, at=docs.columns.index(text), names=names), schema)
