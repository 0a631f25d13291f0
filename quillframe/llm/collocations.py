"""Phrase collocation mining: identical pieces as multiplicities, n-grams counted out of core in duckdb per hash bucket, parts looked up by shuffled requests.

1. Texts are cut into pieces and pieces into words, in Arrow columns. Identical pieces of a language
   become one row with a multiplicity, first inside a batch, then by Spark.
2. Distinct pieces are stored in chunks of some WORDS words. In a chunk numpy ranks n-grams (an n-gram's
   rank is that of its first n - 1 words and its last word) and adds the multiplicities of equal
   ones; a row per hash bucket carries what the chunk has for it, packed. A bucket's task adds the
   weights in duckdb, which spills into the task's own scratch folder beyond MEMORY. First bigrams are
   counted by a 40-bit hash, and each bucket answers every chunk with those of its hashes
   that have ``least`` occurrences or more (a collision answers yes once too often, never no).
   Then phrases of 1 to ``longest`` words are counted by their words: longer ones only where all their
   bigrams had that answer, which no phrase of ``least`` occurrences fails. Phrases of ``least``
   occurrences stay; parts of a candidate occur at least as often as it does, so nothing that is
   asked for later is lost. The empty phrase counts a language's words.
3. Each candidate sends a lookup request per part. Requests and counts meet by a shuffle on
   (lang, part); a part that more than a fair share of requests ask for is joined by broadcast (at
   most 4 x partitions such parts, see ``graph.joined_back``). Scores are exact decimals.
4. A candidate's shorter phrases of two words or more take the largest count of what holds them; those
   with 100 * count >= share * own are dropped. A language's first rows come from the
   first ones of salted parts, so no task sees all of a language.

A hash bucket holds distinct phrases of each batch once, so no word or phrase, however frequent, makes
one large. The scratch folder is deleted with its task; a lost executor's buckets are counted anew.

Defined results: a null text is empty; empty texts and pieces without words give nothing; a null
language is ``und`` and counts with that name. Repeated rows count again. Ties are settled as the
contract says (cuts by place, rows by count and phrase). An empty table gives an empty result. Only the
named columns are used, so other names can't clash.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, sliced, trimmed, written
from .graph import joined_back

#: Words of a chunk; memory of duckdb in a task; buckets for each shuffle partition.
WORDS = 1_000_000
MEMORY = "256MB"
BUCKETS = 4
#: A-Z are lowered, what ends a piece becomes a line feed, and a tab a space; all are single bytes of UTF-8.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(lang: pa.Array, text: pa.Array) -> pa.Table:
    """lang, piece and its multiplicity m; words of a piece with one space between."""
    own = pa.Array.from_buffers(text.type, len(text), [text.buffers()[0], text.buffers()[1], pa.py_buffer((text.buffers()[2] or pa.py_buffer(b"")).to_pybytes().translate(TABLE))], offset=text.offset)
    cut = pc.split_pattern(own, "\n")
    row, piece = pc.list_parent_indices(cut), cut.flatten()
    full = pc.not_equal(piece, "")
    row, piece = row.filter(full), piece.filter(full)
    if pc.any(pc.match_substring(piece, "  ")).as_py():
        piece = pc.replace_substring_regex(piece, " +", " ")
    piece = pc.utf8_trim(piece, " ")
    t = pa.table({"lang": lang.take(row), "piece": piece, "m": pa.array(np.ones(len(piece), np.int64))})
    return t.filter(pc.not_equal(t["piece"], "")).group_by(["lang", "piece"]).aggregate([("m", "sum")]).select(["lang", "piece", "m_sum"])


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(it, 500):
        for out in pieces(b.column(0), b.column(1)).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays(out.columns, names=["lang", "piece", "m"])


def _ranked(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each distinct key's first row, every row's rank, and the summed weights."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    rank = np.empty(len(k), np.int64)
    rank[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], rank, np.add.reduceat(weight[order], at) if len(at) else weight[:0]


class Chunk:
    """The words of pieces side by side: number, language, multiplicity, and words from here to the piece's end."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        words = _one(pc.split_pattern(t["piece"], " "))
        flat, size = words.flatten(), np.diff(words.offsets.to_numpy())
        self.words, self.langs = _one(flat.dictionary_encode()), _one(t["lang"].dictionary_encode())
        self.word, self.lang = self.words.indices.to_numpy().astype(np.int64), np.repeat(self.langs.indices.to_numpy().astype(np.int64), size)
        self.weight = np.repeat(t["m"].to_numpy(), size)
        self.left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words.dictionary.to_pylist()], np.uint64)
        self.seeds = np.array([xxhash.xxh64_intdigest(w, 1) for w in self.langs.dictionary.to_pylist()], np.uint64)

    def hashed(self, at: np.ndarray, n: int) -> np.ndarray:
        """64-bit hashes of the n words (and the language) from each place on."""
        h = self.seeds[self.lang[at]]
        for k in range(n):
            with np.errstate(over="ignore"):
                h = (h ^ self.hashes[self.word[at + k]]) * _STEP
            h ^= h >> np.uint64(29)
        return h

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bigrams and their 40-bit hashes."""
        at = np.flatnonzero(self.left >= 2)
        return at, (self.hashed(at, 2) >> np.uint64(24)).astype(np.int64)

    def phrases(self, at: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """lang, phrase, weight and hash of the distinct n-grams at these places."""
        rank, sums = self.lang[at], self.weight[at]
        for k in range(n):
            first, rank, sums = _ranked(rank * len(self.hashes) + self.word[at + k], self.weight[at])
        i = at[first]
        parts = [self.words.dictionary.take(self.words.indices.take(pa.array(i + k))) for k in range(n)]
        return self.langs.dictionary.take(pa.array(self.lang[i])), pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0], sums, self.hashed(i, n)

    def totals(self) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """The empty phrase of each language: its words."""
        first, _, sums = _ranked(self.lang, self.weight)
        own = self.lang[first]
        return self.langs.dictionary.take(pa.array(own)), pa.array([""] * len(own), pa.string()), sums, self.seeds[own]


def _one(x):
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) and x.num_chunks != 1 else x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


def _body(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _opened(body) -> pa.Table:
    with pa.ipc.open_stream(body.as_buffer()) as r:
        return r.read_all()


def _chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src (a number of its own) and body of each chunk."""
    held: list[pa.RecordBatch] = []
    size, src = 0, TaskContext.get().partitionId() << 32

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([src], pa.int64()), pa.array([_body(pa.Table.from_batches(held))], pa.binary())], names=["src", "body"])

    for b in it:
        held.append(b)
        size += b.column(1).nbytes
        if size > 6 * WORDS:
            yield sent()
            held, size, src = [], 0, src + 1
    if size:
        yield sent()


def _dealt(t: pa.Table, bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, body) of a table's rows."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    t = t.take(pa.array(order)).combine_chunks()
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, _body(t.slice(edges[k], edges[k + 1] - edges[k]))


def _asked(it: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, src and body: a chunk's bigram hashes (sorted, as differences) and their weights."""
    for b in it:
        for src, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            c = Chunk(_opened(body))
            at, h = c.bigrams()
            first, _, sums = _ranked(h, c.weight[at])
            h = h[first]
            bucket = h % buckets
            order = np.argsort(bucket, kind="stable")
            step = np.diff(h[order], prepend=0)
            step[np.flatnonzero(np.diff(bucket[order], prepend=-1))] = h[order][np.flatnonzero(np.diff(bucket[order], prepend=-1))]
            out = list(_dealt(pa.table({"step": step, "n": sums[order]}), bucket[order], buckets))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([src] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "src", "body"])


@contextmanager
def _duck():
    with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as c:
        yield c


def _answered(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """src and body: those of a chunk's hashes in a bucket that have least occurrences or more."""
    schema = pa.schema([("src", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

    def opened() -> Iterator[pa.RecordBatch]:
        for b in it:
            for src, body in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                t = _opened(body)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(t.num_rows, src)), pa.array(np.cumsum(t["step"].to_numpy())), t["n"].combine_chunks()], schema=schema)

    with _duck() as c:
        packed = pa.RecordBatchReader.from_batches(schema, opened())  # noqa: F841  read by name below
        c.execute("CREATE TEMP TABLE t AS SELECT * FROM packed")
        found = c.sql(f"SELECT src, h FROM t SEMI JOIN (SELECT h FROM t GROUP BY h HAVING sum(n) >= {int(least)}) f USING (h)").to_arrow_reader(100_000)
        for b in found:
            src, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((h, src))
            src, h = src[order], h[order]
            at = np.flatnonzero(np.diff(src, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(src[at]), pa.array([_body(pa.table({"h": x})) for x in np.split(h, at[1:])], pa.binary())], names=["src", "answer"])


def _packed(it: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket and body: a chunk's phrases with their weights; columns: body, answers."""
    for b in it:
        for body, answers in zip(b.column(0), b.column(1), strict=True):
            c = Chunk(_opened(body))
            kinds = [c.totals(), c.phrases(np.arange(len(c.word)), 1)]
            often = [_opened(x)["h"].to_numpy() for x in answers.values] if answers.is_valid else []
            at, h = c.bigrams()
            good = np.zeros(len(c.word) + longest, bool)
            good[at[np.isin(h, np.concatenate(often))] if often else []] = True
            at = np.flatnonzero(good)
            for n in range(2, longest + 1):
                at = at[good[at + n - 2]]
                if not len(at):
                    break
                kinds.append(c.phrases(at, n))
            t = pa.table({"lang": pa.concat_arrays([k[0] for k in kinds]), "phrase": pa.concat_arrays([k[1] for k in kinds]), "n": pa.array(np.concatenate([k[2] for k in kinds]))})
            bucket = ((np.concatenate([k[3] for k in kinds]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            out = list(_dealt(t, bucket, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "body"])


def _counted(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase and n of a bucket's phrases with least occurrences or more, and of empty phrases."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def opened() -> Iterator[pa.RecordBatch]:
        for b in it:
            for body in b.column(1):
                yield from _opened(body).to_batches()

    with _duck() as c:
        packed = pa.RecordBatchReader.from_batches(schema, opened())  # noqa: F841  read by name below
        found = c.sql(f"SELECT lang, phrase, sum(n)::BIGINT AS n FROM packed GROUP BY ALL HAVING sum(n) >= {int(least)} OR phrase = ''")
        yield from (b.cast(schema) for b in found.to_arrow_reader(20_000))


def counts(docs: DataFrame, *, longest: int = 4, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, n: occurrences of every phrase of up to ``longest`` words that has ``least`` or more, and of all words as the empty phrase."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = rows.mapInArrow(_cut, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))
    chunks = written(cut.mapInArrow(trimmed(_chunks), "src long, body binary"), "chunks")
    p = partitions(spark)
    buckets = BUCKETS * p
    asked = chunks.mapInArrow(trimmed(lambda it: _asked(it, buckets)), "bucket int, src long, body binary").repartition(p, "bucket")
    answers = asked.mapInArrow(trimmed(lambda it: _answered(it, least)), "src long, answer binary").groupBy("src").agg(F.collect_list("answer").alias("answers"))  # a few a bucket
    packed = chunks.join(answers.hint("merge"), "src", "left").select("body", "answers").mapInArrow(trimmed(lambda it: _packed(it, longest, buckets)), "bucket int, body binary").repartition(p, "bucket")
    return packed.mapInArrow(trimmed(lambda it: _counted(it, least)), "lang string, phrase string, n long")


def _inside(longest: int) -> str:
    """SQL for the contiguous shorter phrases of two words or more of the array w."""
    return f"filter(flatten(transform(sequence(2, {max(longest - 1, 2)}), n -> transform(sequence(1, greatest(size(w) - n + 1, 1)), i -> if(n < size(w), array_join(slice(w, i, n), ' '), null)))), x -> x is not null)"


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of every phrase of two words or more; phrases is a table as counts gives it."""
    cand = phrases.withColumn("w", F.split("phrase", " ")).filter("size(w) > 1").withColumnRenamed("n", "a")
    part = F.expr("array(struct(array_join(slice(w, 1, k), ' ') as part, 0 as side), struct(array_join(slice(w, k + 1, size(w) - k), ' ') as part, 1 as side))")
    asked = cand.withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)"))).withColumn("p", F.explode(part)).select("lang", "phrase", "a", "k", F.col("p.part").alias("part"), F.col("p.side").alias("side"))
    asked = written(asked, "requests")
    held = asked.groupBy("lang", "part").agg(F.count("*").alias("asked")).join(phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("held")), ["lang", "part"])
    held = written(held, "replies")
    told = joined_back(asked, held, ["lang", "part"], "asked")
    cuts = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("held"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("held"))).alias("r"))
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def mine(docs: DataFrame, *, longest: int = 4, least: int = 30, share: int = 80, first: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` collocations."""
    spark = docs.sparkSession
    phrases = written(counts(docs, longest=longest, least=least, text=text, lang=lang), "phrases")
    total = phrases.filter("phrase = ''").select(F.col("lang").alias("of"), "n")
    phrases = phrases.filter("phrase <> ''")
    longer = phrases.withColumn("w", F.split("phrase", " ")).filter("size(w) > 2").select("lang", F.explode(F.array_distinct(F.expr(_inside(longest)))).alias("phrase"), F.col("n").alias("inside"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("inside").alias("inside"))
    kept = scored(phrases).join(longer, ["lang", "phrase"], "left").filter(f"inside is null or cast(inside as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {int(share)}")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(partitions(spark)))
    kept = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return kept.join(total, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS m FROM p GROUP BY ALL
), g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: w[i:i + n - 1])))) AS g, m FROM w
), f AS (
  SELECT lang, g, array_to_string(g, ' ') AS phrase, sum(m)::BIGINT AS a FROM g GROUP BY lang, g HAVING sum(m) >= 30
), total AS (
  SELECT lang, sum(m * len(w))::BIGINT AS n FROM w GROUP BY lang
), cuts AS (
  SELECT lang, g, phrase, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1
), s AS (
  SELECT c.lang, c.phrase, c.a, min({'score': ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT, 'k': c.k, 'l': x.a, 'r': y.a}) AS b
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:] GROUP BY ALL
), longer AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda n: list_transform(range(1, len(g) - n + 2), lambda i: g[i:i + n - 1])))) AS g FROM f WHERE len(g) > 2
), inside AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, max(a) AS most FROM longer GROUP BY ALL
)
SELECT s.lang, (row_number() OVER (PARTITION BY s.lang ORDER BY b.score DESC, s.a DESC, s.phrase))::INT AS rank, s.phrase, s.a, b.l AS l, b.r AS r, total.n, b.score AS score
FROM s JOIN total USING (lang) LEFT JOIN inside ON inside.lang = s.lang AND inside.phrase = s.phrase
WHERE inside.most IS NULL OR 100 * inside.most < 80 * s.a
QUALIFY rank <= 2000
"""
