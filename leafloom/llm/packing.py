"""Packing by sums of squares: documents become sequences of at most LENGTH tokens with hardly any padding.

A document's tokens, with the end token, are cut into full sequences from its start; what is left is one piece, shorter than a
sequence. Pieces are placed as they come: N[h] counts the open sequences that hold h tokens, and a piece goes where the sum of
N[h] * N[h] over all levels is least afterwards, into an open sequence or a new one (of equal sums: the fullest). A sequence of
which SLACK tokens at most are free is closed and counts no more.

Each task packs the documents that it reads, without any exchange. Pieces of sequences that stay open go on with their ids: they are
dealt evenly to groups of about GROUP_TOKENS and packed in the same way again. What is open after that is laid end to end, shortest
level first, and cut at sequence ends, and the last sequence of a group is cut at powers of two, which need no padding. So padding is
at most SLACK a sequence, and most documents that fit into a sequence stay whole.

Tokens come from the tokenizers library. Text is cut at spaces and line feeds beforehand, where the vocabulary's pre-tokenizer drops them
and never looks across; so each word is encoded once a task and then looked up. Strings of special tokens are ordinary text.

Edge cases: a null or empty text is the end token alone. Repeated rows and null doc_ids are packed like others. A text of any length
is cut as above. An empty table gives an empty result. Other columns of the input are not read and cannot clash.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import cut, give_back, table

VOCABULARY, END = "word_bpe_49k.json", 1
#: Tokens of a sequence, and how many of them may stay free in a closed one.
LENGTH, SLACK = 2048, 4
#: Tokens that the second packing puts into a group: their ids have two bytes each.
GROUP_TOKENS = 1 << 24
#: Words whose ids a worker remembers (in some 200 MB), the longest of them, and of those that stay when there are too many.
MOST_WORDS, LONGEST_WORD, KEPT_LENGTH = 1 << 20, 64, 7
#: Words that are encoded at once.
TOGETHER = 256
#: Where a word is letters or digits and then only these, up to its end, the pre-tokenizer cuts between the two as well.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# -- tokens --------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def stem_and_marks(w: str) -> tuple[str, ...]:
    stem = w.rstrip(MARKS)
    return (stem, w[len(stem) :]) if len(stem) < len(w) and stem.isalnum() else (w,)


def lowered(t: str) -> str:
    """In lower case where that is what the normalizer does later on, in any order of its steps: in texts of Latin-1."""
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return t
    return t.lower()


class Encoder:
    """Texts to ids (16 bits each, in bytes), word by word."""

    def __init__(self, path: str):
        self.tok, self.known = _tokenizer(path), {"": b""}
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        ends = np.zeros(1 << 16, dtype=bool)  # ids that end a piece of the pre-tokenizer
        ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.ends = ends

    def _learn(self, words: list[str]) -> None:
        """Encodes words, many as one text. Words of letters are a piece each, and their last ids tell them apart; for others the
        places of tokens do."""
        plain = [w for w in words if w.isalpha()]
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        others = [w for w in words if not w.isalpha()]
        for some, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u2")
            last = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
            if len(last) != len(some):  # a letter that the pre-tokenizer takes for none
                others += some
                continue
            held = ids.tobytes()
            self.known.update(zip(some, map(held.__getitem__, map(slice, [0, *last], last)), strict=False))
        for at in range(0, len(others), TOGETHER):
            self._learn_by_place(others[at : at + TOGETHER])

    def _learn_by_place(self, some: list[str]) -> None:
        e = self.tok.encode(" ".join(some), add_special_tokens=False)
        found, end, ids = [], -1, None
        rest = iter(some)
        for i, (begin, _) in zip(e.ids, e.offsets, strict=True):
            while begin > end:  # the space behind a word ends it
                end += 1 + len(next(rest))
                found.append(ids := [])
            ids.append(i)
        found.extend([] for _ in rest)  # words that leave no token
        self.known.update((w, array("H", x).tobytes()) for w, x in zip(some, found, strict=True))

    def _long(self, w: str) -> bytes:
        return array("H", self.tok.encode(w, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        parts = [lowered(t or "").replace("\n", " ").split(" ") for t in texts]
        known = self.known
        new = {w for w in set().union(*(set(p).difference(known) for p in parts)) if len(w) <= LONGEST_WORD}
        if len(known) + len(new) > MOST_WORDS:
            kept = {w: x for w, x in known.items() if len(w) <= KEPT_LENGTH}  # short words come often
            self.known = known = kept if len(kept) + len(new) < MOST_WORDS // 2 else {"": b""}
            new = {w for w in set().union(*(set(p).difference(known) for p in parts)) if len(w) <= LONGEST_WORD}
        cut_up = {w: stem_and_marks(w) for w in new if not w.isalpha()}
        whole = {x for y in cut_up.values() for x in y if x not in known}
        self._learn(list(whole.union(new.difference(cut_up))))
        known.update((w, known[y[0]] + known[y[1]]) for w, y in cut_up.items() if len(y) == 2)
        for p in parts:
            try:
                yield b"".join(map(known.__getitem__, p))
            except KeyError:  # long words
                yield b"".join([known[w] if w in known else self._long(w) for w in p])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker: what it knows does not change what it gives."""
    return Encoder(path)


def crc(ids: bytes) -> int:
    """Of ids in 16 bits, the CRC-32 of them in 32 bits, least byte first."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


# -- packing -------------------------------------------------------------------------------------------------------------


class Packer:
    """Open sequences by level. `place` gives the sequence and the place in it of a piece of `size` tokens, less than `length`."""

    def __init__(self, length: int = LENGTH, slack: int = SLACK):
        self.length, self.full = length, length - slack
        self.at: list[list[int]] = [[] for _ in range(length + 1)]  # the open sequences of a level; N[h] is their number
        # what the sum of squares gains where a sequence leaves a level, (N[h] - 1)^2 - N[h]^2, or comes to one, (N[h] + 1)^2 - N[h]^2;
        # a new sequence leaves none, and levels from `full` on are not counted
        self.leave = np.full(length + 1, np.iinfo(np.int64).max // 4)
        self.come = np.ones(length + 1, dtype=np.int64)
        self.leave[0], self.come[self.full :] = 0, 0
        self.made = 0

    def _count(self, level: int) -> None:
        n = len(self.at[level])
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.come[level] = 2 * n + 1

    def place(self, size: int) -> tuple[int, int]:
        room = self.length - size
        change = self.leave[: room + 1] + self.come[size:]
        level = room - int(change[::-1].argmin())
        if level:
            sequence = self.at[level].pop()
            self._count(level)
        else:
            sequence = self.made
            self.made += 1
        after = level + size
        if after < self.full:
            self.at[after].append(sequence)
            self._count(after)
        return sequence, level

    def open(self) -> Iterator[int]:
        """Open sequences, from the lowest level on."""
        for held in self.at:
            yield from held


def powers(n: int) -> Iterator[int]:
    """The powers of two that sum up to `n`, the largest first."""
    while n:
        p = 1 << n.bit_length() - 1
        yield p
        n -= p


def laid_out(pieces: list[tuple], length: int, first: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens) end to end in sequences of `length` from the number `first` on, cut where one ends; the last one in
    powers of two. Yields (doc_id, start, ids, doc_tokens, sequence, offset)."""
    total = sum(len(p[2]) // 2 for p in pieces)
    sizes = iter([length] * (total // length) + list(powers(total % length)))
    sequence, size, offset = first - 1, 0, 0
    for doc, start, ids, tokens in pieces:
        while ids:
            if offset == size:
                sequence, size, offset = sequence + 1, next(sizes), 0
            take = min(size - offset, len(ids) // 2)
            yield doc, start, ids[: 2 * take], tokens, sequence, offset
            ids, start, offset = ids[2 * take :], start + take, offset + take


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(*more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([(f.split()[0], pa.int64()) for f in PIECE.split(", ")] + list(more))


def first_packing(path: str, length: int, slack: int):
    """Pieces of the documents of a task. Those of sequences that stay open have no sequence but their ids, and their place in the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, task = _schema(("ids", pa.binary()), ("task", pa.int32()), ("place", pa.int64())), TaskContext.get().partitionId()
        base, words, packer = task << 40, encoder(path), Packer(length, slack)
        whole = 0  # full sequences have even numbers, those of pieces odd ones
        held: dict[int, list[tuple]] = {}
        end, place = array("H", [END]).tobytes(), 0
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    tokens, start = len(ids) // 2, 0
                    while tokens - start >= length:
                        piece = ids[2 * start : 2 * (start + length)]
                        rows.append((doc, start, length, crc(piece), tokens, base + 2 * whole, 0, None, task, None))
                        whole, start = whole + 1, start + length
                    if start < tokens:
                        piece = ids[2 * start :]
                        sequence, level = packer.place(tokens - start)
                        held.setdefault(sequence, []).append((doc, start, piece, tokens, level, place))
                        place += 1
                        if level + tokens - start >= packer.full:
                            rows += [(d, s, len(i) // 2, crc(i), t, base + 2 * sequence + 1, o, None, task, None) for d, s, i, t, o, _ in held.pop(sequence)]
            yield _batch(rows, schema)
        rest = [(d, s, len(i) // 2, None, t, None, None, i, task, p) for sequence in held.values() for d, s, i, t, _, p in sequence]
        for at in range(0, len(rest), 4096):
            yield _batch(rest[at : at + 4096], schema)
        give_back()

    return run


def second_packing(length: int, slack: int):
    """The pieces of a group, packed once more; what is open then is laid end to end."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("task", "ascending"), ("place", "ascending")])  # as ever, however they arrive
        pieces = list(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True))
        base, packer, held = (1 << 62) + (group.column("group")[0].as_py() << 40), Packer(length, slack), {}
        for p in pieces:
            sequence, level = packer.place(len(p[2]) // 2)
            held.setdefault(sequence, []).append((*p, sequence, level))
        rest = [p[:4] for s in packer.open() for p in held.pop(s)]
        out = [p for s in held.values() for p in s]
        out += laid_out(rest, length, packer.made)
        done = [(d, s, len(i) // 2, crc(i), t, base + q, o) for d, s, i, t, q, o in out]
        return pa.Table.from_batches([_batch(done, _schema())])

    return run


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """A row for each piece of each row of `docs`: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. The order of
    rows in the input's partitions decides what meets; it must be the same when a task is run again, as it is for files and tables."""
    path = path or public_tokenizers.path(VOCABULARY)
    done = cut(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(first_packing(path, length, slack), f"{PIECE}, ids binary, task int, place long"))
    rest = done.where("sequence_id IS NULL")
    groups = max(1, (rest.agg(F.sum("length")).first()[0] or 0) // GROUP_TOKENS)
    again = rest.select("doc_id", "start", "ids", "doc_tokens", "task", "place", F.pmod(F.xxhash64("task", "place"), F.lit(groups)).alias("group")).groupBy("group").applyInArrow(second_packing(length, slack), PIECE)
    return done.where("sequence_id IS NOT NULL").select(*(f.split()[0] for f in PIECE.split(", "))).union(again)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))
