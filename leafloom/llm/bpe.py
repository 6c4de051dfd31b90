"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

A rank file (base64 token, space, rank) becomes a vocabulary over the 256 printable stand-ins of the bytes and a list of
merges; the merges are found from the ranks alone, as each token is the join of the two parts that its own lower ranks
leave. Nothing is trained. Encoding splits by the pattern, maps bytes to stand-ins, merges, and can return where each
token lies in the text; a token that holds only some bytes of a character reports the whole character's place. Decoding
reverses the byte table: ids become bytes, and characters that tokens have cut are whole again once the bytes are joined.

Where no places are asked for and the pattern is PATTERN, texts are encoded word by word, each word once a step, and a worker
remembers the ids of words. Texts are cut only where PATTERN always cuts, whatever lies on both sides: before a space that a
character other than white space follows; in words that are new, between a letter and a mark or line feed, and behind a line feed
that stands alone. So ids are those of the whole text. What is remembered has a bound; longer words are encoded anew each step.

Edge cases: a null or empty text has no tokens, and decodes to empty bytes. Repeated rows give repeated results. An empty
table gives an empty result. Ids outside the vocabulary raise ValueError when decoded. Every other column is kept; a new
column whose name exists already raises ValueError before anything runs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from leafloom.llm.common import table, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text that are encoded at once: the library keeps some hundred bytes a token while it works.
STEP_BYTES = 1 << 20
#: Bytes of text that are cut into words at once; a longer text stands alone.
WORDS_BYTES = 1 << 22
#: Words whose ids a worker remembers (in some 200 MB), and the longest of them.
MOST_WORDS, LONGEST_WORD = 1 << 20, 64
#: Words that are encoded as one text.
TOGETHER = 256
#: Where PATTERN cuts within a word: between a letter of Latin-1 and a mark of ASCII or line feed, and behind a line feed that stands alone.
WITHIN = re.compile(r"(?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])(?=[!-/:-@\[-`{-~\n])|(?<=\S\n)(?=\S)")


def byte_table() -> dict[int, str]:
    """A printable character for each byte: the byte's own in Latin-1 where that prints, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes `token`: what is left when all merges of lower rank are done."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], top)) < top]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2:
        raise ValueError(f"no merge of lower rank makes {token!r}")
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """The tokenizer and, by id, each token's bytes; built once a worker."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, stand_in = read_ranks(path), byte_table()
    name = lambda token: "".join(map(stand_in.__getitem__, token))
    merges = [tuple(map(name, halves(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tok = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok, {r: t for t, r in ranks.items()}


def steps(texts: list[str]) -> Iterator[list[str]]:
    """`texts` in runs of about STEP_BYTES; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > STEP_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode_texts(tok, texts: list[str], offsets: bool = False) -> Iterator:
    """For each text its ids, or its ids and (start, end) places in code points."""
    for run in steps(texts):
        if offsets:
            for e in tok.encode_batch(run, add_special_tokens=False):
                yield e.ids, e.offsets
        else:
            for e in tok.encode_batch_fast(run, add_special_tokens=False):
                yield e.ids


def _no_cut(word: str) -> bool:
    """Whether PATTERN may not cut before the space in front of `word`: where nothing or white space follows that space."""
    return not word or word[0].isspace()


def joined(words: Iterable[str]) -> Iterator[str]:
    """`words` of a text, those joined between which PATTERN may not cut."""
    run: list[str] = []
    for w in words:
        if run and not _no_cut(w):
            yield " ".join(run)
            run = []
        run.append(w)
    yield " ".join(run)


class Words:
    """Texts to ids, word by word. `known` has the ids (an array's bytes) of words with the space in front of them, `bare` those of ends
    of words."""

    def __init__(self, tok, by_id: dict[int, bytes]):
        self.tok, self.known, self.bare = tok, {}, {}
        self.spaced = np.zeros(max(by_id, default=0) + 1, dtype=bool)  # ids that begin with a space
        self.spaced[[i for i, t in by_id.items() if t.startswith(b" ")]] = True

    def _ids(self, parts: list[str]) -> Iterator[bytes]:
        return (array("i", ids).tobytes() for ids in encode_texts(self.tok, parts))

    def _together(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Encodes words, many as one text: a word's first id begins with a space, and no other of its ids does."""
        single, others = [w for w in words if " " not in w], [w for w in words if " " in w]
        groups = [single[at : at + TOGETHER] for at in range(0, len(single), TOGETHER)]
        for some, held in zip(groups, self._ids([f" {' '.join(g)}" for g in groups]), strict=True):
            first = (4 * np.flatnonzero(self.spaced[np.frombuffer(held, np.int32)])).tolist()
            if len(first) == len(some):
                yield from zip(some, map(held.__getitem__, map(slice, first, [*first[1:], len(held)])), strict=True)
            else:  # a vocabulary that knows no space
                others += some
        yield from zip(others, self._ids([f" {w}" for w in others]), strict=True)

    def _found(self, words: list[str]) -> list[bytes]:
        """The ids of different words; of those that are not too long they are remembered."""
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        if len(self.known) + len(self.bare) + 2 * len(new) > MOST_WORDS:  # what these texts use stays
            self.known, self.bare = {w: x for w, x in zip(words, found, strict=True) if x is not None}, {}
        cut = {w: c for w in new if not w.isalpha() and len(c := WITHIN.split(w)) > 1}
        ends = set().union(*(c[1:] for c in cut.values()))
        bare = {e: self.bare[e] for e in ends if e in self.bare}
        ends = [e for e in ends if e not in bare]
        bare.update(zip(ends, self._ids(ends), strict=True))
        stems = {c[0] for c in cut.values()}
        learned = {w: self.known[w] for w in stems if w in self.known}
        learned.update(self._together([w for w in stems.union(w for w in new if w not in cut) if w not in learned]))
        learned.update([(w, b"".join([learned[c[0]], *map(bare.__getitem__, c[1:])])) for w, c in cut.items()])
        self.known.update((w, x) for w, x in learned.items() if len(w) <= LONGEST_WORD)
        self.bare.update((e, bare[e]) for e in ends if len(e) <= LONGEST_WORD)
        return [learned[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def encode(self, texts: pa.Array) -> pa.Array:
        """For each text its ids, in a list."""
        parts = pc.split_pattern(texts, " ")
        words, codes, heads = self._coded(parts)
        if any(map(_no_cut, pc.utf8_slice_codeunits(words, 0, 1).unique().to_pylist())):
            parts = pa.array([list(joined(t.split(" "))) for t in texts.to_pylist()], parts.type)
            words, codes, heads = self._coded(parts)
        found = [*self._found(words.to_pylist()), *self._ids(heads)]
        ends = np.cumsum([0, *map(len, found)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
        sizes = np.concatenate([[0], np.cumsum(np.diff(ends)[codes])])
        return pa.ListArray.from_arrays(pa.array(sizes[parts.offsets.to_numpy() - parts.offsets[0].as_py()], pa.int32()), lists.take(pa.array(codes)).flatten())

    @staticmethod
    def _coded(parts: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
        """The different words behind spaces, by number; the numbers of all words; the first words of texts, which no space precedes: they
        are numbered behind the others."""
        flat, first = parts.flatten(), parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        coded = flat.dictionary_encode()
        codes, heads = coded.indices.to_numpy(), {}
        behind = np.ones(len(codes), dtype=bool)
        behind[first] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[codes[behind]] = True
        words, codes = coded.dictionary.filter(pa.array(used)), (np.cumsum(used) - 1)[codes]
        codes[first] = [len(words) + heads.setdefault(h, len(heads)) for h in flat.take(pa.array(first)).to_pylist()]
        return words, codes, list(heads)


@lru_cache(maxsize=4)
def words_of(path: str, pattern: str) -> Words:
    """One for all tasks of a worker: what it knows does not change what it gives."""
    return Words(*codec(path, pattern))


def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """`texts`, nulls empty, in slices of about WORDS_BYTES."""
    texts = texts.cast(pa.large_string()).fill_null("")
    step = np.cumsum(pc.binary_length(texts).to_numpy()) // WORDS_BYTES
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def ids_of(path: str, pattern: str, texts: pa.Array) -> pa.Array:
    """For each text its ids, in a list: word by word where it is known where the pattern cuts, else each text as a whole."""
    if pattern != public_tokenizers.PATTERN:
        return pa.array(encode_texts(codec(path, pattern)[0], texts.to_pylist()), pa.list_(pa.int32()))
    return words_of(path, pattern).encode(texts)


@lru_cache(maxsize=4)
def strings_of(path: str, pattern: str) -> tuple[pa.Array, pa.Array]:
    """By id, its decimal and its token's bytes; null where there is none."""
    _, by_id = codec(path, pattern)
    ids = range(max(by_id, default=0) + 1)
    return pa.array([str(i) if i in by_id else None for i in ids], pa.large_string()), pa.array([by_id.get(i) for i in ids], pa.large_binary())


def strung(ids: pa.Array, strings: pa.Array, separator: str | bytes) -> pa.Array:
    """For each list of ids, their strings with a separator between them."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, strings.take(ids.values)), pa.scalar(separator, strings.type))


def decode_ids(by_id: dict[int, bytes], ids: list[int]) -> bytes:
    try:
        return b"".join(map(by_id.__getitem__, ids))
    except KeyError as e:
        raise ValueError(f"id {e.args[0]} is not in the vocabulary") from None


def _quiet() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core


def _added(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    if clash := {f.name for f in fields} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return T.StructType([*df.schema.fields, *fields])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", offsets: str | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`df` with the array `ids`, and with `offsets` also an array of (start, end) places in code points."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = _added(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(offsets, T.ArrayType(span))] if offsets else []))

    def run(batches):
        _quiet()
        tok, _ = codec(path, pattern)
        for b in batches:
            if offsets:
                found = list(encode_texts(tok, [t or "" for t in b.column(text).to_pylist()], True))
                new = [pa.array([x[0] for x in found], pa.list_(pa.int32()))]
                new.append(pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            else:
                new = [pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(ids_of(path, pattern, p) for p in parts_of(b.column(text)))])]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`df` with the bytes that `ids` stand for; null ids give empty bytes."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    schema = _added(df, [T.StructField(out, T.BinaryType())])

    def run(batches):
        _, by_id = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([decode_ids(by_id, x or []) for x in b.column(ids).to_pylist()], pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`df` without `text`, with n_tokens, the SHA-256 of the decimal ids joined by commas and of the decoded bytes, and whether
    those are the text's own. Encoding and decoding meet in one pass, so that ids do not cross to the JVM and back."""
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    kept = df.drop(text)
    others = kept.columns
    schema = _added(kept, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        _quiet()
        decimals, tokens = strings_of(path, pattern)
        for b in batches:
            n, of_ids, of_bytes, same = [], [], [], []
            for texts in parts_of(b.column(text)):
                ids = ids_of(path, pattern, texts)
                back = strung(ids, tokens, b"")
                n += ids.value_lengths().to_pylist()
                of_ids += [hashlib.sha256(x.as_buffer()).hexdigest() for x in strung(ids, decimals, ",")]
                of_bytes += [hashlib.sha256(x.as_buffer()).hexdigest() for x in back]
                same += pc.equal(back, texts.cast(pa.large_binary())).to_pylist()
            new = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), *new], names=schema.names)

    return df.mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip."""
    docs = table(spark, sf_dir, "documents")
    return round_trip(docs.select("doc_id", text_of().alias("text")))
