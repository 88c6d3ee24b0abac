"""What the text operators share: tables in the shared folder and texts as numpy arrays.

Texts reach Python as Arrow batches.  ``blocks`` cuts a batch into runs of documents of a
few MB, so memory does not follow the batch size, and ``Words`` holds the words of such a
run as byte positions, so the operators work on whole arrays instead of word by word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

#: Bytes of text that one numpy pass holds; a longer document is a run of its own.
BLOCK_BYTES = 2 << 20

# XXH64, fixed values
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)
#: Spans above this many bytes are hashed one by one.
LONG_SPAN = 2048

#: ``[\x20\x09-\x0D]``: the bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where all run on one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not found and held.isDefined():
        found = held.get()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not held.isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """A small table, written to the shared folder and read again; Spark deletes it with its last use."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """A larger table, kept as Parquet in the shared folder until the application ends."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/spillway-{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(own)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """Adds a 64-bit key for each row, which is the same whenever the row is read again: a hash of its file and its place there.

    What does not come straight from files is written first.
    """
    key = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)
    try:
        return docs.select("*", key)
    except AnalysisException:
        return store(docs).select("*", key)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: what sizes the number of partitions."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Nulls as empty texts, in one array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of rows with about ``limit`` bytes each."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield at, end
        at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry: the end)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and n else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if n else 0)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of documents.

    data: all bytes; bounds: where each document begins in it; start, end: each word's bytes;
    first: index of each document's first word (one more entry: all words); doc: of each word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.bounds = text_bytes(texts)
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~SPACE[data]
        # a document's first byte begins a word even where the one before ends without a space
        breaks = np.zeros(len(data) + 1, bool)
        breaks[self.bounds] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | breaks))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | breaks))
        self.first = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with one space after each word, and each word's start and end there."""
        size = self.end - self.start
        start = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=start[1:])
        out = np.full(start[-1], 0x20, np.uint8)
        keep = np.ones(start[-1], bool)
        keep[start[1:] - 1] = False
        out[keep] = self.data[~SPACE[self.data]]
        return out, start[:-1], start[:-1] + size

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end, seed)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(lane: np.ndarray) -> np.ndarray:
    return _rotl(lane * P2, 31) * P1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each span of bytes, all spans in one pass."""
    with np.errstate(over="ignore"):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        halves = np.ndarray((len(padded) - 7,), "<u4", padded, strides=(1,))
        size = end - start
        at, s = start.astype(np.int64), np.uint64(seed)
        out = np.full(len(at), s + P5, np.uint64)
        left = size.copy()
        long = np.flatnonzero(size > LONG_SPAN)
        left[long] = 0
        wide = np.flatnonzero(left >= 32)
        if len(wide):
            lanes = [np.full(len(wide), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            live, where = np.arange(len(wide)), wide
            while len(live):
                for k in range(4):
                    lanes[k][live] = _rotl(lanes[k][live] + words[at[where] + 8 * k] * P2, 31) * P1
                at[where] += 32
                left[where] -= 32
                more = left[where] >= 32
                live, where = live[more], where[more]
            h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                h = (h ^ _round(lane)) * P1 + P4
            out[wide] = h
        out += size.astype(np.uint64)
        live = np.flatnonzero(left >= 8)
        while len(live):
            out[live] = _rotl(out[live] ^ _round(words[at[live]]), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        out[live] = _rotl(out[live] ^ (halves[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
        live = np.flatnonzero(left >= 1)
        while len(live):
            out[live] = _rotl(out[live] ^ (padded[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] >= 1]
        out ^= out >> np.uint64(33)
        out *= P2
        out ^= out >> np.uint64(29)
        out *= P3
        out ^= out >> np.uint64(32)
        for i in long:
            out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * P2
        x = x ^ (x >> np.uint64(29))
        x = x * P3
        return x ^ (x >> np.uint64(32))


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each document; first: where each document's values begin, and their number."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.int64 if values.dtype != float else float)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


#: Lower case and class of each code point of the first plane, from Python's own tables.
_PLANE = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(1 << 16)]
LOWER_POINT = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in _PLANE], np.uint32)
IS_LETTER = np.array([x.isalpha() for x in _PLANE])
del _PLANE


class Letters:
    """Words of letters, in lower case, of a run of documents, as positions of code points.

    points: all code points; bounds: where each document begins; start, end, first, count,
    doc: as in ``Words``.
    """

    def __init__(self, texts: pa.Array):
        rows = texts.to_pylist()
        raw = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        small = np.minimum(raw, 0xFFFF)
        self.raw = raw
        self.points = LOWER_POINT[small]
        letter = IS_LETTER[small]
        far = np.flatnonzero(raw > 0xFFFF)
        if len(far):  # beyond the first plane
            kinds, which = np.unique(raw[far], return_inverse=True)
            signs = [chr(c) for c in kinds.tolist()]
            letter[far] = np.array([x.isalpha() for x in signs])[which]
            self.points[far] = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in signs], np.uint32)[which]
        self.letter = letter
        self.bounds = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)), out=self.bounds[1:])
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = letter
        breaks = np.zeros(len(raw) + 1, bool)
        breaks[self.bounds] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | breaks))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | breaks))
        self.first = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(rows)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return hash_spans(np.ascontiguousarray(self.points, np.uint32).view(np.uint8), self.start * 4, self.end * 4)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words: their hashes, an occurrence of each, and the distinct word of each occurrence."""
        return np.unique(self.hashes(), return_index=True, return_inverse=True)

    def word(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")


#: Bytes of a text to learn from, at most: longer ones are scored, not learned from.
LEARNED_BYTES = 1 << 18


def held_out(id: str, fold: int, held: int) -> Column:
    """Whether an id is of the fold that nothing is learned from; a null id is not."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % fold == held, F.lit(False))


def first_of_each(docs: DataFrame, known: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text) and the columns of ``known``, a bounded table with distinct ids: one row for each id.

    Of rows that share an id, the one whose text hashes lowest; none whose text is above ``LEARNED_BYTES``.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), body.alias("text")).where(F.octet_length("text") <= LEARNED_BYTES)
    one = rows.join(F.broadcast(known), "id").groupBy(*known.columns).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return one.select(*known.columns, F.col("first.text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, size: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label): at most ``size`` labelled rows to learn from, none of the held-out fold, each id once.

    Ids are taken in the order of a hash; only ids and labels are ordered.  Of contrary
    labels for one id the higher counts.  Texts are bounded as in ``first_of_each``, so what
    is learned from has at most ``size`` times ``LEARNED_BYTES`` bytes.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out("id", fold, held)).groupBy("id").agg(F.max("label").alias("label"))
    return first_of_each(docs, known.orderBy(F.xxhash64("id"), "id").limit(size), id, text)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last one the constant) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w
