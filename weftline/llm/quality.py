"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and perplexity quantiles."""

from __future__ import annotations

import contextlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_ids, by_rows, byte_texts, few, id_set, lean, measured, row_set, saved, shared_dir, small_batches

#: Bytes in an n-gram.
ORDER = 5
#: Trusted documents' quantile of a language above which documents are rejected.
QUANTILE = 0.995
#: Bytes at the language's mean that every document counts besides its own, so that short texts aren't judged on noise.
PRIOR_BYTES = 200
#: n-gram types in a model shard, and n-grams that are looked up in one.
SHARD_TYPES, SHARD_LOOKUPS = 1_000_000, 8_000_000
#: Bytes of text, of all languages, that a task holds for counting, and bytes of text of one language that are scored together.
CHUNK, SCORED = 16 << 20, 16 << 20
#: Bytes of text and of distinct n-grams, of all languages, that a task gathers for scoring.
GATHERED = 64 << 20
#: Bytes of text whose n-grams are put in order at once (some 30 bytes each).
SORTED = 2 << 20
#: Orders whose tables go to every shard: at most 65,792 n-grams for each language and fold.
LOW = 2
#: Quantiles are looked for among blocks of so many steps first.
COARSE = 512
#: Perplexity quantiles are exact to this step in nats a byte.
STEP = 1e-4

_PAD = b"\x02" * (ORDER - 1)
_PLAIN = bytes(48 if 48 <= b <= 57 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))  # digits as 0, blanks as spaces


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) & 1 if doc_id is not None else 0


def codes(data: bytes) -> np.ndarray:
    """The n-gram that ends at each byte, after padding, its first byte highest."""
    b = np.frombuffer(_PAD + data, np.uint8).astype(np.int64)
    n = len(data)
    out = b[:n].copy()
    for k in range(1, ORDER):
        out = (out << 8) | b[k : k + n]
    return out


def codes_of(texts: list[bytes]) -> np.ndarray:
    """The codes of several texts, one after the other."""
    out, at = np.empty(sum(map(len, texts)), np.int64), 0
    for t in texts:
        out[at : at + len(t)] = codes(t)
        at += len(t)
    return out


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, fold, k, code, c): counts of the trusted texts' n-grams, and of what continues them at lower orders.

    Tasks count blocks of text and hand out one row for each n-gram in a block; rows are combined before they
    are shuffled by n-gram. Order ORDER has occurrences, lower ones the number of distinct bytes before.
    """
    small_batches(trusted.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[bytes]] = {}
        sizes: dict[tuple[str, int], int] = {}
        total = 0

        def flush(key: tuple[str, int]) -> Iterator[pa.RecordBatch]:
            nonlocal total
            own = held.pop(key)
            total -= sizes.pop(key)
            while own:
                some = [own.pop()]
                size = len(some[0])
                while own and size + len(own[-1]) <= SORTED:
                    some.append(own.pop())
                    size += len(some[-1])
                code, n = np.unique(codes_of(some), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(code), pa.string()), pa.array(np.full(len(code), key[1], np.int32)), pa.array(code), pa.array(n.astype(np.int64))],
                    ["lang", "fold", "code", "c"],
                )

        for b in batches:
            for doc_id, text, lang in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                if not text:
                    continue
                key = (lang, fold_of(doc_id))
                held.setdefault(key, []).append(text.translate(_PLAIN))
                sizes[key] = sizes.get(key, 0) + len(text)
                total += len(text)
                if total >= CHUNK:
                    yield from flush(max(sizes, key=sizes.get))
        for key in list(held):
            yield from flush(key)

    keys = ["lang", "fold", "code"]
    top = trusted.mapInArrow(lean(each), "lang string, fold int, code long, c long").groupBy(*keys).agg(F.sum("c").alias("c"))
    top = saved(few(top), "ngrams")
    every, order = top.select("lang", "fold", F.lit(ORDER).alias("k"), "code", "c"), top
    for k in range(ORDER - 1, 0, -1):
        order = order.select("lang", "fold", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        every = every.union(order.select("lang", "fold", F.lit(k).alias("k"), "code", "c"))
    return every


def discounts(counts: DataFrame) -> dict[tuple[str, int, int], tuple[float, float, float]]:
    """Modified Kneser-Ney's discounts for counts of 1, 2 and more, by language, fold and order."""
    few = counts.where("c <= 4").groupBy("lang", "fold", "k", "c").count().collect()  # 4 rows for each language, fold and order
    seen: dict = {}
    for r in few:
        seen.setdefault((r["lang"], r["fold"], r["k"]), {})[r["c"]] = r["count"]
    out = {}
    for key, n in seen.items():
        n1, n2, n3, n4 = (n.get(c, 0) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        plain = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        out[key] = tuple(min(max(d, 0.05), c - 0.05) for c, d in zip((1, 2, 3), plain, strict=True))
    return out


class Model:
    """Log probabilities of a shard's n-grams in one language and fold, with the backoff of its contexts."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], discount: dict[int, tuple[float, float, float]]) -> None:
        self.logp: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.back: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lower = None  # order and probabilities of the order below
        for k in range(1, ORDER + 1):
            code, c = tables.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            sort = np.argsort(code)
            code, c = code[sort], c[sort]
            d = np.array([0.0, *discount.get(k, (0.5, 1.0, 1.5))])[np.minimum(c, 3)]
            context, inverse = np.unique(code >> 8, return_inverse=True)
            total, mass = np.bincount(inverse, c, len(context)), np.bincount(inverse, d, len(context))
            gamma = mass / np.maximum(total, 1)
            if lower is None:
                below = np.full(len(code), 1 / 256)
            else:
                below = lower[1][np.searchsorted(lower[0], code & ((1 << 8 * (k - 1)) - 1))] if len(code) else np.zeros(0)
            p = (c - d) / np.maximum(total[inverse], 1) + gamma[inverse] * below if len(code) else np.zeros(0)
            self.logp[k], self.back[k] = (code, np.log(p).astype(np.float32)), (context, np.log(gamma).astype(np.float32))
            lower = (code, p)

    def score(self, code: np.ndarray) -> np.ndarray:
        """The log probability of each code's last byte after its others."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            known, logp = self.logp[k]
            part = code[left] & ((1 << 8 * k) - 1)
            hit = np.zeros(len(left), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                hit = known[at] == part
                out[left[hit]] += logp[at[hit]]
            left, part = left[~hit], part[~hit]
            if not len(left):
                return out
            context, back = self.back[k]
            if len(context):
                at = np.minimum(np.searchsorted(context, part >> 8), len(context) - 1)
                out[left] += np.where(context[at] == part >> 8, back[at], 0)
        out[left] -= math.log(256)
        return out


def shard_of(code, shards: int):
    """The shard of an n-gram, by the two bytes before its last: all that its probability takes shares them.

    code is an array of longs or a Column.
    """
    if isinstance(code, np.ndarray):
        return ((code >> 8) & 0xFFFF) * 40503 % 65536 * shards // 65536
    mixed = F.shiftright(code, 8).bitwiseAND(F.lit(0xFFFF)) * F.lit(40503) % F.lit(65536)
    return F.floor(mixed * F.lit(shards) / F.lit(65536)).cast("int")


@contextlib.contextmanager
def _wide_rows(spark: SparkSession) -> Iterator[None]:
    """A few rows at once to readers and workers, for the jobs run within: those on rows of several MB."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "8"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _packed(sorted_codes: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(sorted_codes, prepend=0).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64))


_CHUNK_SCHEMA = "chunk long, lang string, key int, ids array<long>, rows array<long>, sizes array<long>, data binary, types binary, n_types long"


def _chunks(docs: DataFrame, names: list[str], models: set[tuple[str, int]]) -> DataFrame:
    """Documents of one language and model, some 16 MB together: their compressed texts, and their distinct n-grams.

    key is 2 * the language's place in names + the model's fold, or -1 where there is no model.
    """
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary(), pa.int64()]
        fields = [x.split()[0] for x in _CHUNK_SCHEMA.split(", ")]
        held: dict[tuple[str, int], dict] = {}
        total = 0

        def merge(own: dict) -> None:
            nonlocal total
            if own["fresh"]:
                total -= own["types"].nbytes
                own["types"] = np.union1d(own["types"], codes_of(own["texts"][own["merged"] :]))
                own["merged"], own["fresh"] = len(own["texts"]), 0
                total += own["types"].nbytes

        def flush(at: tuple[str, int]) -> pa.RecordBatch:
            nonlocal chunk, total
            own = held.pop(at)
            merge(own)
            total -= own["size"] + own["types"].nbytes
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(own["texts"]))
            row = (chunk, at[0], at[1], own["ids"], own["rows"], own["sizes"], data, _packed(own["types"]), len(own["types"]))
            chunk += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], fields)

        for b in batches:
            for doc_id, text, lang in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                fold = 1 - fold_of(doc_id)
                fold = fold if (lang, fold) in models else 1 - fold
                at = (lang, 2 * names.index(lang) + fold if (lang, fold) in models else -1)
                own = held.setdefault(at, {"ids": [], "rows": [], "sizes": [], "texts": [], "size": 0, "types": np.zeros(0, np.int64), "merged": 0, "fresh": 0})
                plain = text.translate(_PLAIN)
                for column, x in (("ids", doc_id), ("rows", np.uint64(xxhash.xxh64_intdigest(text, 42)).astype(np.int64)), ("sizes", len(plain)), ("texts", plain)):
                    own[column].append(x)
                own["size"] += len(plain)
                total += len(plain)
                if at[1] >= 0:
                    own["fresh"] += len(plain)
                    if own["fresh"] >= SORTED:
                        merge(own)
                if own["size"] >= SCORED:
                    yield flush(at)
                elif total >= GATHERED:
                    yield flush(max(held, key=lambda x: held[x]["size"] + held[x]["types"].nbytes))
        for at in list(held):
            yield flush(at)

    return docs.mapInArrow(lean(each), _CHUNK_SCHEMA)


def _looked_up(chunks: DataFrame, counts: DataFrame, discount: dict, names: list[str], shards: int) -> DataFrame:
    """(chunk, shard, logp): log probabilities, 32-bit, of a chunk's n-grams of a shard, in their order.

    Counts and lookups are dealt by shard and sorted, counts first; a task makes a shard's model, of a bounded
    size, and streams the lookups past it.
    """
    spark = chunks.sparkSession
    number = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)]), F.col("lang"))
    rows = counts.select(((number * 2 + F.col("fold")) * 8 + F.col("k")).cast("int").alias("key"), "k", "code", "c")
    low = rows.where(F.col("k") <= LOW).toArrow()  # at most 65,792 rows for each language and fold
    held = spark.sparkContext.broadcast(tuple(low.column(x).to_numpy() for x in ("key", "code", "c")))

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, key, types in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                code = _unpacked(types.as_py())
                shard = shard_of(code, shards)
                own = np.unique(shard)
                blobs = [_packed(code[shard == s]) for s in own.tolist()]
                n = len(own)
                columns = [own.astype(np.int32), np.ones(n, np.int32), np.full(n, key, np.int32), np.full(n, chunk), np.zeros(n, np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs, pa.binary())], ["shard", "kind", "key", "code", "c", "blob"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low_key, low_code, low_c = held.value
        shard, parts, models = None, [], None

        def build() -> dict[int, Model]:
            key, code, c = (np.concatenate(x) for x in zip(*parts, (low_key, low_code, low_c), strict=True))
            tables: dict[int, dict] = {}
            for x in np.unique(key).tolist():
                some = key == x
                tables.setdefault(x // 8, {})[x % 8] = (code[some], c[some])
            return {m: Model(t, {k: d for (name, fold, k), d in discount.items() if 2 * names.index(name) + fold == m}) for m, t in tables.items()}

        for b in batches:
            at, kind, key, code, c = (b.column(i).to_numpy() for i in range(5))
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(at)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if s == e:
                    continue
                if at[s] != shard:
                    shard, parts, models = int(at[s]), [], None
                if kind[s] == 0:
                    parts.append((key[s:e], code[s:e], c[s:e]))
                    continue
                if models is None:
                    models = build()
                    parts = []
                logp = [models[int(key[i])].score(_unpacked(b.column(5)[i].as_py())).astype(np.float32).tobytes() for i in range(s, e)]
                yield pa.RecordBatch.from_arrays([pa.array(code[s:e]), pa.array(at[s:e]), pa.array(logp, pa.binary())], ["chunk", "shard", "logp"])

    asked = chunks.where("n_types > 0").select("chunk", "key", "types").mapInArrow(lean(lookups), "shard int, kind int, key int, code long, c long, blob binary")
    known = rows.where(F.col("k") > LOW).select(shard_of(F.col("code"), shards).alias("shard"), F.lit(0).alias("kind"), "key", "code", "c", F.lit(None).cast("binary").alias("blob"))
    dealt = known.union(asked).repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(lean(solve), "chunk long, shard int, logp binary")


def scores(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, row, lang, n, nll): bytes, and negative log likelihood in nats, by the other fold's model of the language.

    Both folds of the trusted text are whole, so every document is scored by a model that hasn't seen it. The
    model stays a table of counts. Documents are gathered in chunks, and each chunk's distinct n-grams are
    joined with the counts, sharded by the two bytes before an n-gram's last; the log probabilities come back
    to the chunk and are summed over its documents. So no part of the model but the unigrams and bigrams (of
    bounded number) is on the driver or in a broadcast. Chunks are a bucketed table, which is read again where
    its log probabilities are dealt: texts aren't shuffled. row is the XXH64 (seed 42) of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts, size = measured(few(ngram_counts(trusted)), "counts")
    discount = discounts(counts)
    names = sorted({key[0] for key in discount})
    name, at = f"weftline_chunks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/weftline-chunks-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    made = _chunks(docs.select("doc_id", "text", "lang"), names, {key[:2] for key in discount})
    made.write.option("path", at).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    try:
        with _wide_rows(spark):
            chunks = spark.table(name)
            asked = chunks.agg(F.coalesce(F.sum("n_types"), F.lit(0))).first()[0]
            shards = min(65536, max(math.ceil(size["n"] / SHARD_TYPES), math.ceil(asked / SHARD_LOOKUPS), 4 * spark.sparkContext.defaultParallelism))

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                import zstandard

                for b in batches:
                    lang, key, ids, rows, sizes, data, types, found = (b.column(i) for i in range(8))
                    for i in range(b.num_rows):
                        n = sizes[i].values.to_numpy()
                        text = zstandard.ZstdDecompressor().decompress(data[i].as_py()) if n.sum() else b""
                        nll = np.zeros(len(n))
                        if key[i].as_py() >= 0:
                            code = _unpacked(types[i].as_py())
                            logp, shard = np.full(len(code), np.nan, np.float32), shard_of(code, shards)
                            for x in found[i].as_py() or ():
                                logp[shard == x["shard"]] = np.frombuffer(x["logp"], np.float32)
                            ends = np.cumsum(n)
                            for k, (lo, hi) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
                                if hi > lo:
                                    nll[k] = -logp[np.searchsorted(code, codes(text[lo:hi]))].sum(dtype=np.float64)
                            if np.isnan(nll).any():
                                raise RuntimeError("a chunk's n-grams came back without their log probabilities")
                        columns = [ids[i].values, rows[i].values, pa.array([lang[i].as_py()] * len(n), pa.string()), pa.array(n), pa.array(nll, mask=np.full(len(n), key[i].as_py() < 0))]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "lang", "n", "nll"])

            answers = None
            if names:
                answers = _looked_up(chunks, counts, discount, names, shards).repartition(buckets, "chunk")
                answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "logp")).alias("found")).hint("shuffle_hash")
                chunks = chunks.join(answers, "chunk", "left")
            else:
                chunks = chunks.withColumn("found", F.lit(None).cast("array<struct<shard: int, logp: binary>>"))
            chunks = chunks.select("lang", "key", "ids", "rows", "sizes", "data", "types", "found")
            return saved(chunks.mapInArrow(lean(each), "doc_id long, row long, lang string, n long, nll double"), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _threshold(levels: DataFrame, quantile: float) -> DataFrame:
    """(lang, limit): of each language's (lang, bin), the least bin that so large a part doesn't exceed, in nats.

    Counts of bins are summed to blocks of COARSE bins first: a language has at most some hundred blocks, and
    only the bins of one of them are put in order after that.
    """
    bins = levels.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("bin") / COARSE))
    blocks = bins.groupBy("lang", "block").agg(F.sum("n").alias("n"))
    upto, whole = Window.partitionBy("lang").orderBy("block"), Window.partitionBy("lang")
    blocks = blocks.select("lang", "block", "n", F.sum("n").over(upto).alias("upto"), (F.sum("n").over(whole) * quantile).alias("need"))
    at = blocks.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("lang", "block", (F.col("upto") - F.col("n")).alias("before"), "need")
    inside = bins.join(F.broadcast(at), ["lang", "block"])  # a row for each language
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("lang").orderBy("bin")))
    return inside.where(F.col("upto") >= F.col("need")).groupBy("lang").agg((F.min("bin") * STEP).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep) of every document.

    Trusted are the documents that labels give quality 1. perplexity is that of a byte, drawn towards the
    language's mean by PRIOR_BYTES; threshold is the trusted documents' quantile of it in the language, and
    documents above are not kept. A language (null counts as one) without trusted text has no model: its
    documents have a null perplexity and are kept. Null and empty texts have the language's mean, and are kept.
    Null doc_ids are scored; rows that repeat are scored each, and count each. Empty tables give no rows.
    """
    out, _ = _classified(docs, labels, quantile)
    return out.drop("row")


def _classified(docs: DataFrame, labels: DataFrame, quantile: float) -> tuple[DataFrame, DataFrame]:
    """classify's rows with their row keys, and the (doc_id, row) of those that go."""
    good = id_set(labels.where("quality = 1").select(F.col("doc_id").cast("long")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    scored = scores(rows, by_ids(rows, good, "left_semi"))
    sure = by_ids(scored.where("nll IS NOT NULL"), good, "left_semi")
    mean = sure.groupBy("lang").agg((F.sum("nll") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    level = (F.col("nll") + PRIOR_BYTES * F.col("mean")) / (F.col("n") + PRIOR_BYTES)
    mean = F.broadcast(mean)  # a row for each language
    limit = _threshold(sure.join(mean, "lang").select("lang", F.ceil(level / STEP).alias("bin")), quantile)
    out = scored.join(mean, "lang", "left").join(F.broadcast(limit), "lang", "left").withColumn("level", level)
    keep = F.coalesce(F.col("level") <= F.col("limit"), F.lit(True))
    out = out.select("doc_id", "row", "lang", F.col("n").alias("n_bytes"), F.exp("level").alias("perplexity"), F.exp("limit").alias("threshold"), keep.alias("keep"))
    return out, out.where("NOT keep").select("doc_id", "row")


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs without the rejected rows: those of that doc_id (which may be null) and text."""
    return by_rows(docs, row_set(_classified(docs, labels, quantile)[1]), "left_anti")
