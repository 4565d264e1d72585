"""Importance resampling towards a target corpus, on hashed word n-grams.

Features of a text are its runs of one to three consecutive words, joined by one space; a feature's
bucket is its CRC-32 modulo ``BUCKETS``.  A bucket's gain compares its share in the target corpus
with its share in the source; a document weighs the sum of its features' gains, plus Gumbel noise
drawn from a hash of its id; the highest scores are drawn, which samples without replacement in
proportion to the weights' exponentials.

Aho-Corasick dictionary.  A task works through its texts in blocks.  Words are bounded by single
spaces there, and the automaton holds `` word `` for every distinct word of the block with the
payload (bytes, CRC) of the word, each computed once.  Two matches share a space at most and a
word holds none, so one scan emits the payloads of a text's words in order.  No n-gram is ever
built: ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)`` composes the payloads of adjacent words, and
``shift`` is linear, hence four table look-ups (``_Shift``), vectorised over a block.

Plan: two scans.  The first gives every task's counts of buckets (at most ``BUCKETS`` rows a task,
summed by a partial aggregate); the sums are ``BUCKETS`` rows whatever the corpus, so the gains go to
the driver and back as one array of that length.  The second scores.  Documents are ranked by a
range partition on (score, id) and counts of its partitions, never in one window.

Words are the runs of digits, letters a-z (A-Z lower-cased) and all characters beyond U+007F.
Defined results: a null text has no words, weight 0 and cannot be drawn; nor can texts of fewer than
``MIN_WORDS`` words.  A null id takes part with the empty string in its hash and comes last among
equal scores; repeated rows are documents of their own and get ranks next to each other.  Very long
texts are whole; a block is one text then.  An empty source gives no rows, an empty target equal shares.
"""

from __future__ import annotations

import functools
import math
import zlib
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.session import materialize

BUCKETS = 10_000
LONGEST = 3            # words in a feature
MIN_WORDS = 20
PERCENT = 5
SEED = 42
BLOCK_BYTES = 4_000_000
# Bytes to words: digits, a-z and bytes of characters beyond U+007F stay, A-Z become a-z, all else a space.
_KEEP = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_POLYNOMIAL = 0xEDB88320  # CRC-32, bits reversed


# ---------------------------------------------------------------- composition of CRCs

class _Shift:
    """crc(a) -> its part of crc(a + b) for a ``b`` of given length, over arrays.

    Tables of the shift by one byte, and by each power of two of bytes, built by squaring: 4 x 256
    values each.  Lengths below ``SHORT`` have a table of their own; longer ones are put together
    from the powers.
    """

    SHORT = 64

    def __init__(self):
        import numpy as np

        byte = np.arange(256, dtype="u4")
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(_POLYNOMIAL), byte >> 1)
        low = np.arange(256, dtype="u4")
        one = np.stack([byte, low, low << 8, low << 16])  # by byte of the crc, least significant first
        zero = np.stack([low << (8 * k) for k in range(4)])
        short = [zero]
        for _ in range(1, self.SHORT):
            short.append(self.applied(one, short[-1]))
        self.short = np.stack(short)
        self.powers = [one]
        while len(self.powers) < 32:
            self.powers.append(self.applied(self.powers[-1], self.powers[-1]))

    @staticmethod
    def applied(table, crc):
        return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]

    def __call__(self, crc, length):
        import numpy as np

        few = np.minimum(length, self.SHORT - 1)
        t = self.short
        out = t[few, 0, crc & 255] ^ t[few, 1, (crc >> 8) & 255] ^ t[few, 2, (crc >> 16) & 255] ^ t[few, 3, crc >> 24]
        rest = length - few
        for k in range(int(rest.max(initial=0)).bit_length()):
            on = np.flatnonzero((rest >> k) & 1)
            out[on] = self.applied(self.powers[k], out[on])
        return out


@functools.cache
def _shift() -> _Shift:
    return _Shift()


def compose(crc, word_crc, word_length):
    """CRC of ``<text of crc> <word>`` from both CRCs and the word's length in bytes."""
    import numpy as np

    shift, one = _shift(), np.ones(len(crc), "i8")
    return shift(shift(crc, one) ^ np.uint32(zlib.crc32(b" ")), word_length) ^ word_crc


# ---------------------------------------------------------------- dictionary and scan

def dictionary(words):
    """Aho-Corasick automaton of `` word `` for every distinct word, with payload length << 32 | crc."""
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for w in words:
        a.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
    if words:
        a.make_automaton()
    return a


def scan(texts: list[bytes]):
    """Of a block of texts (UTF-8): (number of words of each, CRC and length of every word in order)."""
    import numpy as np

    bare = [b" ".join(t.translate(_KEEP).split()) for t in texts]
    words: set[bytes] = set()
    for t in bare:
        words.update(t.split())
    automaton, payload = dictionary(words), itemgetter(1)
    found = [np.fromiter(map(payload, automaton.iter(f" {t.decode('latin-1')} ")), "i8") if t else np.empty(0, "i8") for t in bare]
    all_words = np.concatenate(found) if found else np.empty(0, "i8")
    return np.array([len(f) for f in found], "i8"), (all_words & 0xFFFFFFFF).astype("u4"), all_words >> 32


def features(counts, crc, length):
    """[(text of each feature, its bucket)] for one, two and three words."""
    import numpy as np

    text = np.repeat(np.arange(len(counts)), counts)
    out, run = [(text, crc % BUCKETS)], crc
    for n in range(1, LONGEST):
        same = text[n:] == text[:-n] if len(text) > n else np.empty(0, bool)
        # ``run`` holds the features of n words, one for each position; those of n + 1 go on with the next word.
        run = compose(run[:len(same)], crc[n:], length[n:])
        out.append((text[n:][same], (run % BUCKETS)[same]))
    return out


def _blocks(batches):
    """(ids, texts) of blocks of at most ``BLOCK_BYTES``, or of one longer text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        at = 0
        while at < len(sizes):
            end, total = at + 1, sizes[at]
            while end < len(sizes) and total + sizes[end] <= BLOCK_BYTES:
                total += sizes[end]
                end += 1
            yield batch.column(0).slice(at, end - at), [t.as_py() or b"" for t in texts.slice(at, end - at)]
            at = end


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket, repeats counted; buckets without any are absent."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        n = np.zeros(BUCKETS, "i8")
        for _, block in _blocks(batches):
            for _, bucket in features(*scan(block)):
                n += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(n[used])], ["bucket", "n"])

    d = texts.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """Gain of every bucket from the two tables of ``bucket_counts``: ``BUCKETS`` numbers."""
    both = (source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
            .unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
            .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect())  # at most BUCKETS rows
    n = {r["bucket"]: (r["s"], r["t"]) for r in both}
    all_s, all_t = (float(sum(x[k] for x in n.values()) + BUCKETS) for k in (0, 1))

    def gain(s: int, t: int) -> int:
        return math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t)))

    return [gain(*n.get(b, (0, 0))) for b in range(BUCKETS)]


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(gain, "i8")
        for ids, block in _blocks(batches):
            counts, crc, length = scan(block)
            n, weight = np.zeros(len(block), "i8"), np.zeros(len(block), "i8")
            for text, bucket in features(counts, crc, length):
                n += np.bincount(text, minlength=len(block))
                # summed as doubles, which hold these integers exactly
                weight += np.bincount(text, table[bucket], minlength=len(block)).astype("i8")
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(n), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


# ---------------------------------------------------------------- scores and the draw

def with_score(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with ``score``: the weight plus Gumbel noise from the id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the drawn rows by (score down, id up), else null.

    Sorted by a range partition and written once; a row's rank is its place in its partition plus the
    rows of the partitions before, which are counted (one number a partition).
    """
    scored = materialize(scored, "scored")
    may = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    sorted_ = materialize(scored.filter(may).repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "drawn")
    parts = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    n_drawn = sorted_.count() * percent // 100  # a number
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = sorted_.join(parts, "_part").select(*scored.columns, F.when(place <= n_drawn, place).alias("rank"))
    return ranked.unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn
    towards the texts of ``target`` (text)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return draw(with_score(weigh(docs, gain), seed), percent, min_words)
