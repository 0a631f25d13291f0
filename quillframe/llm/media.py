"""Media columns: payloads in a deduplicated store of content-defined chunks.

A payload is laid out as a grey image (binary PGM, 8-bit samples, 24 columns), which is what is
stored. A gear hash rolls over its bytes::

    h = (h << 1) + gear[byte]            (64 bits, so it sees the last 64 bytes)

and a chunk ends where the hash's top bits are zero, at LEAST bytes or more and at MOST at the
latest. Cuts depend on content alone, so an insertion moves only the cuts around it. Chunks are
named by the first half of their SHA-256.

``put`` lists the names of each row's chunks, and Spark deduplicates them: exact copies of a
medium are one row, each name has one owner (the least medium and place that holds it, by
``groupBy``), and names that an existing store holds are left out by an anti-join. Only then do
bytes move, once: media to their owners' plan. The store has a pack for each distinct medium: the ordered list of
its chunks' names, and one compressed frame of the chunks it owns, so a stream's chunks stay
together. ``get`` rebuilds every medium from its ordered list: chunks are cut out of the frame that holds
them and each is checked against its name. A medium that owns all of its chunks needs no
shuffle for that; for the others the chunks that they ask for (a pack knows which it lends) are joined by name, put
in order, one medium at a time. Then every medium is verified by its own SHA-256.

Frames are compressed with a dictionary that is trained on a bounded sample of payloads
(DICTIONARY_ROWS); that changes the size of the store, never a result.

Defined results: a null text is an empty one: no bytes, one block of padding. Equal texts have
equal values. Rows of any length are stored whole. Repeated rows get repeated results. A chunk
that is missing or differs raises an error. Only the named columns are used, so names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, sliced, strings, written

BLOCK, PAD, COLUMNS = 576, b"\xff", 24
#: Chunks have 256 bytes at least, some 1.3 kB on average and 8 KiB at most.
LEAST, BITS, MOST = 256, 10, 8 << 10
DICTIONARY_ROWS, DICTIONARY_BYTES, LEVEL = 2000, 112 << 10, 15

#: The gear table: 256 numbers of a fixed generator.
GEAR = np.random.Generator(np.random.PCG64(20_240_607)).integers(0, 2**64, 256, dtype=np.uint64)


def payload(data: bytes) -> bytes:
    """data padded to a positive multiple of BLOCK."""
    return data + PAD * (BLOCK - len(data) if len(data) < BLOCK else -len(data) % BLOCK)


def medium(p: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (COLUMNS, len(p) // COLUMNS) + p


def samples(m: bytes) -> bytes:
    """The payload of a medium."""
    kind, shape, top, p = m.split(b"\n", 3)
    w, h = map(int, shape.split())
    if kind != b"P5" or top != b"255" or w * h != len(p):
        raise ValueError("not a medium of this kind")
    return p


def gear(data: bytes) -> np.ndarray:
    """The rolling hash behind each byte."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16, 32):  # sums over 2k bytes from sums over k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return h


def chunks(data: bytes, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[bytes]:
    """data in content-defined chunks; least is 64 or more."""
    ends = np.flatnonzero(gear(data) >> np.uint64(64 - bits) == 0) + 1
    out, a = [], 0
    while a < len(data):
        i = np.searchsorted(ends, a + least)
        b = min(int(ends[i]) if i < len(ends) else len(data), a + most, len(data))
        out.append(data[a:b])
        a = b
    return out


def feature(p: bytes) -> str:
    """Mean, deviation, entropy of samples and a 64-bit average hash of 64 equal stretches."""
    x = np.frombuffer(p, np.uint8)
    n = np.bincount(x, minlength=256) / len(x)
    v = np.arange(256)
    mean = float(n @ v)
    some = n[n > 0]
    bits = x.reshape(64, -1).mean(axis=1) > mean
    return f"{mean:.6f};{np.sqrt(max(0.0, float(n @ (v * v)) - mean * mean)):.6f};{max(0.0, float(-(some @ np.log2(some)))):.6f};{int(np.packbits(bits).view('>u8')[0]):016x}"


def _dictionary(df: DataFrame, key: str, text: str) -> bytes:
    """A compression dictionary of bounded size from a bounded sample; empty where the sample is too small."""
    some = df.select(F.xxhash64(key).alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(DICTIONARY_ROWS)
    rows = df.join(F.broadcast(some.select(F.col("k").alias("_k")).distinct()), F.col(key) == F.col("_k")).select(F.substring(text, 1, 20_000).alias("t")).limit(DICTIONARY_ROWS).collect()
    parts = [medium(payload((r.t or "").encode())) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def _sha(b: bytes) -> bytes:
    return hashlib.sha256(b).digest()


_PACK = "medium binary, chunks array<binary>, own array<int>, sizes array<int>, whole boolean, lent array<int>, data binary"
_OWNED = "transform(own, k -> chunks[k])"


def _ids(medium) -> F.Column:
    """A medium's name in joins: the first half of its SHA-256."""
    return F.substring(medium, 1, 16).alias("id")


def put(df: DataFrame, *, key: str = "doc_id", text: str = "text", store: DataFrame | None = None, dictionary: bytes | None = None, how: tuple[int, int, int] | None = None) -> tuple[DataFrame, DataFrame, bytes]:
    """(lists, store, dictionary) of df's media.

    lists: key, n_bytes, medium (SHA-256), chunks (their names, in order) and sizes. store: packs,
    one a medium: medium, chunks, own (places of the chunks it owns), sizes (of those), whole
    (whether it owns all), lent (which of its own, by their order, media that aren't whole ask for)
    and data. With an existing store, and its dictionary, only media and chunks that it doesn't hold are added.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    if (store is None) != (dictionary is None):
        raise ValueError("an existing store comes with its dictionary")
    dictionary = _dictionary(df, key, text) if dictionary is None else dictionary
    shipped = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    how = how or (LEAST, BITS, MOST)
    rows = df.select(F.col(key), F.col(text))

    def listed(it):
        for b in it:
            if b.num_rows:
                n, names, lists, sizes = [], [], [], []
                for t in strings(b.column(1)):
                    data = t.encode("utf-8", "surrogatepass")
                    m = medium(payload(data))
                    c = chunks(m, *how)
                    n.append(len(data))
                    names.append(_sha(m))
                    lists.append([_sha(x)[:16] for x in c])
                    sizes.append([len(x) for x in c])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))], names=[key, "n_bytes", "medium", "chunks", "sizes"])

    def bodies(it):
        press, _ = _codec(shipped.value)
        for b in it:
            if b.num_rows:
                media = [medium(payload(t.encode("utf-8", "surrogatepass"))) for t in strings(b.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array([_sha(m)[:16] for m in media], pa.binary()), pa.array([press.compress(m) for m in media], pa.binary())], names=["id", "body"])

    def packed(it):
        press, unpress = _codec(shipped.value)
        for b in it:
            if b.num_rows:
                sizes, own, whole, lent, body = (b.column(k).to_pylist() for k in range(2, 7))
                for k, (z, o, w, x) in enumerate(zip(sizes, own, whole, body, strict=True)):
                    if not w:
                        m, ends = unpress.decompress(x), np.cumsum(z).tolist()
                        body[k] = press.compress(b"".join([m[ends[i] - z[i] : ends[i]] for i in o]))
                        sizes[k] = [z[i] for i in o]
                        lent[k] = lent[k][: len(o)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), b.column(4), pa.array(lent, pa.list_(pa.int32())), pa.array(body, pa.binary())], names=["medium", "chunks", "own", "sizes", "whole", "lent", "data"])

    lists = rows.mapInArrow(listed, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, medium binary, chunks array<binary>, sizes array<int>")
    lists = written(lists, "lists")
    media = lists.groupBy(_ids("medium")).agg(F.first("medium").alias("medium"), F.first("chunks").alias("chunks"), F.first("sizes").alias("sizes"))
    if store is not None:
        media = media.join(store.select(_ids("medium")), "id", "left_anti")
    refs = media.select("id", F.posexplode("chunks").alias("at", "name"))
    if store is not None:
        refs = refs.join(store.select(F.explode(F.expr(_OWNED)).alias("name")), "name", "left_anti")
    owner = refs.groupBy("name").agg(F.min(F.struct("id", "at")).alias("o"), (F.count("*") > 1).alias("shared"))
    own = owner.groupBy("o.id").agg(F.sort_array(F.collect_list(F.struct("o.at", "shared"))).alias("held"))
    plan = media.join(own, "id", "left").withColumn("held", F.coalesce("held", F.expr("filter(array(named_struct('at', 0, 'shared', true)), x -> false)")))
    plan = plan.withColumn("own", F.expr("transform(held, x -> x.at)")).withColumn("whole", F.size("own") == F.size("chunks"))
    # a name that another place holds too is asked for there, for what isn't its owner isn't whole; and a medium that isn't whole asks for its own
    plan = plan.withColumn("lent", F.expr("if(whole, transform(filter(held, x -> x.shared), x -> x.at), sequence(0, size(own)))"))
    found = rows.select(text).mapInArrow(bodies, "id binary, body binary").groupBy("id").agg(F.first("body").alias("body"))
    packs = plan.hint("merge").join(found, "id").select("medium", "chunks", "sizes", "own", "whole", "lent", "body").mapInArrow(packed, _PACK)
    packs = written(packs, "packs", compression="none")
    if store is not None:  # new media may ask for any of its chunks
        packs = store.withColumn("lent", F.expr("filter(sequence(0, size(own)), k -> k < size(own))")).unionByName(packs)
    return lists, packs, dictionary


def get(store: DataFrame, dictionary: bytes, features=None) -> DataFrame:
    """medium (SHA-256) and what features (bytes -> tuple) makes of the verified bytes of each medium of the store; by default the bytes."""
    spark = store.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(dictionary)
    f, fields = features or ((lambda m: (m,)), [("data", "binary", pa.binary())])
    schema = "medium binary, " + ", ".join(f"{n} {t}" for n, t, _ in fields)

    def made(names, media):
        cols = list(zip(*[f(m) for m in media], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array(c, t) for c, (*_, t) in zip(cols, fields, strict=True))], names=["medium", *(n for n, *_ in fields)])

    def verified(m: bytes, name: bytes) -> bytes:
        if _sha(m) != name:
            raise ValueError(f"the stored bytes of {name.hex()} differ or are missing")
        return m

    def walked(name: bytes, chunks: list[bytes], own: list[int], sizes: list[int], frame: bytes) -> bytes:
        """The medium from its ordered list: each chunk is cut from the frame that holds it and checked against its name."""
        parts, at = {}, 0
        for k, n in zip(own, sizes, strict=True):
            parts[k] = frame[at : at + n]
            at += n
            if _sha(parts[k])[:16] != chunks[k]:
                raise ValueError(f"a chunk of {name.hex()} differs")
        return verified(b"".join([parts[k] for k in range(len(chunks))]), name)

    def alone(it):
        _, unpress = _codec(shipped.value)
        for b in sliced(it, 200):
            if b.num_rows:
                rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                yield made([r[0] for r in rows], [walked(*r[:4], unpress.decompress(r[4])) for r in rows])

    def lending(it):
        press, unpress = _codec(shipped.value)
        for b in it:
            names, data = [], []
            for own, sizes, lent, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m, ends = unpress.decompress(d), np.cumsum(sizes).tolist()
                for k in lent:
                    part = m[ends[k] - sizes[k] : ends[k]]
                    if _sha(part)[:16] != own[k]:
                        raise ValueError(f"the chunk {own[k].hex()} differs")
                    names.append(own[k])
                    data.append(press.compress(part))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], names=["name", "data"])

    def joined(it):
        _, unpress = _codec(shipped.value)
        now, parts = None, []
        for b in it:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is not None and name != now:
                    yield made([now], [verified(b"".join(parts), now)])
                    parts = []
                now = name
                if data is None:
                    raise ValueError(f"a chunk of {name.hex()} is missing")
                parts.append(unpress.decompress(data))
        if now is not None:
            yield made([now], [verified(b"".join(parts), now)])

    alike = store.filter("whole").select("medium", "chunks", "own", "sizes", "data").mapInArrow(alone, schema)
    refs = store.filter("not whole").select("medium", F.posexplode("chunks").alias("at", "name"))
    lent = store.filter("size(lent) > 0").select(F.expr(_OWNED).alias("names"), "sizes", "lent", "data").mapInArrow(lending, "name binary, data binary")
    # a chunk that more than one in 4 x partitions of all references ask for is broadcast: 4 x partitions of MOST bytes at most
    share = 4 * partitions(spark)
    hot = refs.groupBy("name").count().filter(F.col("count") * share > refs.count()).select("name")
    refs = refs.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "name", "left")
    common = F.broadcast(lent.join(F.broadcast(hot), "name", "left_semi"))
    parts = refs.filter("hot").join(common, "name", "left").union(refs.filter("hot is null").join(lent.hint("merge"), "name", "left"))
    parts = parts.select("medium", "at", "data").repartition(partitions(spark), "medium").sortWithinPartitions("medium", "at")
    return alike.union(parts.select("medium", "data").mapInArrow(joined, schema))


def _described(m: bytes) -> tuple:
    p = samples(m)
    return len(p), hashlib.sha256(p).digest(), zlib.crc32(p[-32:]), len(m), feature(p)


def query(docs: DataFrame) -> DataFrame:
    lists, store, dictionary = put(docs)
    fields = [("payload_bytes", "long", pa.int64()), ("payload", "binary", pa.binary()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("feature", "string", pa.string())]
    found = get(store, dictionary, (_described, fields))
    out = lists.select("doc_id", "n_bytes", "medium").join(found, "medium")
    return out.select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload")).alias("payload_sha256"), "tail_crc32", "media_bytes", F.lower(F.hex("medium")).alias("media_sha256"), "feature")
