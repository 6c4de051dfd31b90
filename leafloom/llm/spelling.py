"""Spelling variants: words at distance one are found by tries, and each rarer word is led to the form that is written far more often.

The vocabulary is sorted and cut into shards, each a compact trie: nodes in document order with their label (a piece of a word), the
end of their subtree and the number of occurrences. A word's automaton of distance one has the states (places read, edits made).
It is intersected with each shard depth first: a branch ends as soon as no state is left, which for shards of other beginnings is
at the root. Accepting nodes are the neighbours.

Shards go to the executors in waves of WAVE_BYTES, so that no broadcast grows with the vocabulary: only what one wave holds passes the
driver at a time, and each word is looked up in the shards of every wave. (A word longer than SHARD_BYTES is a shard of its own; no
other way is needed.) Each wave leaves a row for each word with neighbours, and these are summed up by word.
A form occurs at least RATIO times as often as its word, so that chains of forms are short; their ends are found by doubling.

Edge cases: a null text is empty; a null doc_id counts as the empty string in the hash. Words of equal counts are no forms of
each other; of equally frequent forms the first in code-point order is taken. Repeated rows count each time. An empty table gives an
empty result. Only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import cut, discard, give_back, table, text_of, work_path

#: Bytes of words in a shard, and of shards in a wave.
SHARD_BYTES, WAVE_BYTES = 1 << 19, 1 << 23
#: Words that a task looks up.
TASK_WORDS = 20_000
LEAST_LENGTH, LEAST_COUNT, RATIO, DROP = 6, 5, 5, 199
LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- tries ---------------------------------------------------------------------------------------------------------------


class Trie:
    """Nodes in document order: label, end (the number behind the subtree) and count (0: no word ends here). Node 0 is the root."""

    __slots__ = ("counts", "ends", "labels")

    def __init__(self, labels: list[str], ends: array, counts: array):
        self.labels, self.ends, self.counts = labels, ends, counts

    @staticmethod
    def of(words: list[str], counts: list[int]) -> Trie:
        """words: distinct, in code-point order."""
        labels, ends, held = [], array("i"), array("q")
        todo = [(0, len(words), 0, "")] if words else []
        open_: list[tuple[int, int]] = []  # node and the last word of each node on the way down
        if not words:
            return Trie([""], array("i", [1]), array("q", [0]))
        while todo:
            lo, hi, depth, label = todo.pop()
            while open_ and open_[-1][1] <= lo:
                ends[open_.pop()[0]] = len(labels)
            open_.append((len(labels), hi))
            labels.append(label)
            ends.append(0)
            depth += len(label)
            ends_here = len(words[lo]) == depth
            held.append(counts[lo] if ends_here else 0)
            at, kids = lo + ends_here, []
            while at < hi:
                first, begin = words[at][depth], at
                while at < hi and words[at][depth] == first:
                    at += 1
                kids.append((begin, at, depth, commonprefix([words[begin][depth:], words[at - 1][depth:]])))
            todo.extend(reversed(kids))
        for node, _ in open_:
            ends[node] = len(labels)
        return Trie(labels, ends, held)

    def dump(self) -> bytes:
        head = array("i", [len(self.labels)]).tobytes()
        return head + self.ends.tobytes() + self.counts.tobytes() + ",".join(self.labels).encode()

    @staticmethod
    def load(blob: bytes) -> Trie:
        n = array("i", blob[:4])[0]
        ends, counts = array("i", blob[4 : 4 + 4 * n]), array("q", blob[4 + 4 * n : 4 + 12 * n])
        return Trie(blob[4 + 12 * n :].decode().split(","), ends, counts)

    def near(self, w: str) -> Iterator[int]:
        """The nodes of words that differ from `w` by exactly one code point inserted, deleted or replaced.

        States are (place in w, edits). Of the ways to spell the same edit (a letter taken from a run of equal ones) only the last is
        followed, so that each node comes once."""
        labels, ends, counts, size, starts = self.labels, self.ends, self.counts, len(w), w.startswith
        todo = [(0, 0, 0)]
        while todo:
            node, i, edits = todo.pop()
            if counts[node] and i == size - 1 + edits:  # one edit made and all read, or the last letter left to delete
                yield node
            kid, stop = node + 1, ends[node]
            while kid < stop:
                label = labels[kid]
                n = len(label)
                if starts(label, i):
                    todo.append((kid, i + n, edits))
                    if edits:
                        break  # no other child begins with this letter
                elif not edits:
                    k = 0
                    while i + k < size and label[k] == w[i + k]:
                        k += 1
                    if i + k < size:
                        if starts(label[k + 1 :], i + k + 1):
                            todo.append((kid, i + n, 1))  # replaced
                        if starts(label[k:], i + k + 1):
                            todo.append((kid, i + n + 1, 1))  # deleted from w
                    if starts(label[k + 1 :], i + k):
                        todo.append((kid, i + n - 1, 1))  # inserted into w
                kid = ends[kid]

    def word(self, node: int) -> str:
        """The word that ends at `node`."""
        at, out = 0, []
        while at != node:
            at += 1
            while self.ends[at] <= node:
                at = self.ends[at]
            out.append(self.labels[at])
        return "".join(out)


# -- words ---------------------------------------------------------------------------------------------------------------


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: lower-case runs of letters, some of them with a letter lost (by a hash of key and run), that are long and frequent
    enough. Runs that are too short before a letter is lost are so afterwards."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(text_of(text), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    hashed = runs.select(lower.alias("w"), F.crc32(F.encode(F.concat("k", F.lit(":"), lower), "UTF-8")).alias("h"))
    at = F.pmod("h", F.length("w")).cast("int")
    lost = F.when(F.col("h") % DROP == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    return hashed.select(lost.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def shards(vocabulary: DataFrame, parts: int) -> DataFrame:
    """The vocabulary in order, cut to tries: size (in bytes) and trie."""

    def run(batches):
        held, counts, size = [], [], 0

        def made():
            blob = Trie.of(held, counts).dump()
            return pa.RecordBatch.from_arrays([pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], names=["size", "trie"])

        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if held and size + len(w) > SHARD_BYTES:
                    yield made()
                    held, counts, size = [], [], 0
                held.append(w)
                counts.append(n)
                size += len(w)
        if held:
            yield made()

    return vocabulary.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(run, "size long, trie binary")


_TRIES: dict[str, list[Trie]] = {}


def _loaded(name: str, held) -> list[Trie]:
    """The tries of a wave, read once a worker; the wave before goes."""
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = [Trie.load(b) for b in held.value]
    return _TRIES[name]


def looked_up(name: str, held):
    """Of each word (word, n): near, the number of its neighbours in the wave `held`, and the most frequent one with its count."""

    def run(batches):
        tries = _loaded(name, held)
        for b in batches:
            out = []
            for w in b.column("word").to_pylist():
                near, best, form = 0, 0, None
                for t in tries:
                    found = list(t.near(w))
                    near += len(found)
                    top = max(found, key=lambda x: (t.counts[x], -x), default=None)
                    if top is not None and t.counts[top] >= best:
                        this = t.word(top)
                        if t.counts[top] > best or this < form:
                            best, form = t.counts[top], this
                if near:
                    out.append((w, near, best, form))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best", "form"])
        give_back()

    return run


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best and form (the most frequent neighbour) of the words that have neighbours. vocabulary: word, n; it is read often."""
    spark = vocabulary.sparkSession
    whole = vocabulary.agg(F.count("*").alias("words"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("bytes")).first()
    tries = cut(shards(vocabulary, max(1, whole["bytes"] // (4 * SHARD_BYTES))).withColumn("shard", F.monotonically_increasing_id()))
    asked = vocabulary.select("word").repartition(max(2 * spark.sparkContext.defaultParallelism, whole["words"] // TASK_WORDS))
    waves: list[list[int]] = [[]]
    size = 0
    for s in tries.select("shard", "size").orderBy("shard").toLocalIterator():  # a number and a size for each shard
        if waves[-1] and size + s["size"] > WAVE_BYTES:
            waves.append([])
            size = 0
        waves[-1].append(s["shard"])
        size += s["size"]
    path = work_path(spark, "neighbours")
    for no, ids in enumerate(waves):
        held = spark.sparkContext.broadcast([bytes(r["trie"]) for r in tries.where(F.col("shard").isin(ids)).orderBy("shard").collect()])  # WAVE_BYTES at most
        asked.mapInArrow(looked_up(f"{path}/{no}", held), "word string, near long, best long, form string").write.mode("append").parquet(path)
        held.destroy()
    best = F.min(F.struct((-F.col("best")).alias("less"), "form")).alias("b")
    out = cut(spark.read.parquet(path).groupBy("word").agg(F.sum("near").alias("n_near"), best)).select("word", "n_near", (-F.col("b.less")).alias("best"), "b.form")
    discard(spark, path)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms (word, form) from each word. Every step at least RATIO-folds the count, so the chains
    have no circle, and each round doubles the way that is gone."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("from"), F.col("root").alias("to"))
        stepped = cut(now.join(further, F.col("root") == F.col("from"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each word of `docs`: word, form, root, n, n_near, form_n."""
    vocabulary = cut(words(docs, key, text))
    near = neighbours(vocabulary).withColumnRenamed("word", "of")
    is_form = F.col("best") >= RATIO * F.col("n")
    known = vocabulary.join(near, F.col("word") == F.col("of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("best")).alias("form_n"))
    known = cut(known)
    ends = roots(known.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return known.join(ends, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their neighbours counted, their form and the root that it leads to."""
    return grouped(table(spark, sf_dir, "documents", "doc_id", "text"))


#: From the definitions: two words are near if one is the other without a letter, or both are alike without the letter at one place.
#: CRC-32 is folded over the bytes by its polynomial.
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) AS v FROM range(256) AS r(i))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')) AS run FROM documents),
d AS (SELECT k, translate(run, '{_UPPER}', '{_LOWER}') AS w, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(k || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295)) AS h FROM d, crc),
l AS (SELECT CASE WHEN h % {DROP} = 0 THEN left(w, (h % length(w))::INT) || w[(h % length(w))::INT + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM l WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
x AS (SELECT word, n, i, left(word, i::INT - 1) || word[i + 1:] AS s FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM x a JOIN v b ON a.s = b.word UNION SELECT DISTINCT b.word, a.word, a.n FROM x a JOIN v b ON a.s = b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND a.word <> b.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= {RATIO} * v.n THEN (SELECT min(other) FROM p WHERE p.word = v.word AND p.m = b.m) END AS form, CASE WHEN b.m >= {RATIO} * v.n THEN b.m END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
c AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM f JOIN c ON f.form = c.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c ON f.word = c.word
"""
