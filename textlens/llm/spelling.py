"""Spelling variants: words of the corpus one edit apart, grouped under their frequent form.

Vocabulary: letter runs of every text, one of each document's runs in ``HOLES`` with a letter
deleted (by a hash, so that variants exist), counted by a partial aggregate; words of at least
``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences stay.  Two words are near if one insertion,
deletion or replacement makes one the other.

Bit-sliced position index (``Index``): for each (position, letter) a bitset over the words that have
the letter there.  A query word runs through its positions once; all words are tracked together by
whole-word operations on four bitsets: no error so far, and exactly one error so far with the word's
letters at the same position (replaced), one further (inserted) or one back (deleted).

An index over the whole vocabulary would cost its square, so words meet in blocks.  Near words of
lengths L and L or L - 1 differ at one place e of L: their first e letters and their last
L - 1 - e are equal.  A block is a window of places with the letters outside it: its words agree
outside, and only the places inside are run through.  The windows are the halves of the word; a
block of more than ``BLOCK`` words is split into the halves of its window, down to one place, where
at most one word for each letter and a shorter one can meet.  A pair's place is its first different
position, so the pair is found in one block only, and counts add up without removing duplicates.
No pair leaves a block: each word reports its number of near words there and the most frequent one.

Plan: count (shuffle of distinct words), blocks (one shuffle, four rows a word), sums by word, and one
self-join for each doubling of the way to the root (a form is ten times as frequent as its word, so
a way has at most log10 of the corpus steps).  A word's near words are bounded by its letters times
the alphabet, hence no key is hot beyond that.

Defined results: null and empty texts have no words; a null id hashes as the empty string; repeated
rows count again; a run that loses its letter may fall below ``MIN_LETTERS``; ties between equally
frequent near words go to the smallest in code-point order; very long words take one more bit of
the recurrence a letter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import ascii_lower
from textlens.session import materialize

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
HOLES = 31
MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10      # a form is at least so many times as frequent
BLOCK = 2048    # words in one index; at least the size of the alphabet and one


# ---------------------------------------------------------------- vocabulary

def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) for every letter run of every text, with its letter deleted where the hash says so."""
    lower = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), ascii_lower(F.col(text_col)).alias("text"))
    run = lower.select("id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    holed = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.pmod("h", F.lit(HOLES)) == 0, holed).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    words = runs(docs, id_col, text_col).filter(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# ---------------------------------------------------------------- index and recurrence

class Index:
    """Bit-sliced position index over the words of one block.

    ``words`` are of ``length`` or ``length - 1`` letters and agree outside the window of places
    [``start``, ``end``); bit i of every set stands for words[i].
    """

    def __init__(self, words: list[str], length: int, start: int, end: int):
        self.words, self.length, self.start, self.end = words, length, start, end
        self.all = (1 << len(words)) - 1
        self.at: dict[tuple[int, str], int] = {}
        self.long = 0
        for i, w in enumerate(words):
            bit = 1 << i
            self.long |= bit * (len(w) == length)
            for p in range(start, min(end + 1, len(w))):
                self.at[p, w[p]] = self.at.get((p, w[p]), 0) | bit

    def near(self, w: str) -> int:
        """Bitset of the words one edit from ``w`` whose first difference is inside the window.

        Two words of ``length - 1`` letters are not compared: they meet in their own block.
        """
        get, whole = self.at.get, len(w) == self.length
        exact, replaced, longer, shorter = self.all, 0, 0, 0
        for p in range(self.start, min(self.end, len(w))):
            c = w[p]
            here = get((p, c), 0)
            new = exact & ~here              # first difference at p
            if whole:
                replaced = (replaced & here) | new & self.long
                # a word without w[p]: from here on it holds w's letters one place back
                shorter = (shorter & (get((p - 1, c), 0) if p > self.start else 0)) | new & ~self.long
            else:
                # a word with one letter more: w[p] stands one place further
                longer = (longer | new & self.long) & get((p + 1, c), 0)
            exact &= here
        if not whole:
            if self.end > len(w):            # all of w is equal; the other word has one more at the end
                longer |= exact & self.long
            return longer
        return replaced | shorter


def scan_block(rows: list[tuple[str, int]], length: int, start: int, end: int) -> list[tuple[str, int, str, int]]:
    """(word, number of near words, the most frequent of them, its n) for the words of a block that have any."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))  # then the lowest bit is the most frequent word
    index = Index([w for w, _ in rows], length, start, end)
    out = []
    for w, _ in rows:
        hits = index.near(w)
        if hits:
            best = rows[(hits & -hits).bit_length() - 1]
            out.append((w, hits.bit_count(), *best))
    return out


# ---------------------------------------------------------------- blocks

def _keyed(windows: DataFrame) -> DataFrame:
    """(word, n, length, start, end, outside): ``outside`` are the letters before and behind the window."""
    tail = F.col("length") - F.col("end")
    return windows.withColumn("outside", F.concat(F.substring("word", F.lit(1), F.col("start")), F.lit("_"),
                                                  F.substring("word", F.length("word") - tail + 1, tail)))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row twice, with the halves of its window."""
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    half = F.array(F.struct(F.col("start").alias("start"), mid.alias("end")), F.struct(mid.alias("start"), F.col("end").alias("end")))
    return _keyed(rows.select("word", "n", "length", F.inline(half)))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, length, start, end, outside): all blocks of at most ``block`` words (or of one place)."""
    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("length"))
    level = _halves(whole.select("*", F.lit(0).alias("start"), F.col("length").alias("end")))
    key, ready = ["length", "start", "end", "outside"], []
    while True:
        level = materialize(level, "word_blocks")
        large = materialize(level.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
                            .filter((F.col("_n") > block) & (F.col("end") - F.col("start") > 1)).drop("_n"), "large_blocks")
        if large.isEmpty():
            ready.append(level)
            break
        ready.append(level.join(large, key, "left_anti"))
        level = _halves(level.join(large, key, "left_semi"))
    return _union(ready)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near ones; ``words`` is (word, n)."""
    key = ["length", "start", "end", "outside"]
    dealt = blocks(words, block).repartition(*key).sortWithinPartitions(*key).select(*key, "word", "n")

    def run(batches):
        import pyarrow as pa

        def found(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in
                                               enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))],
                                              ["word", "n_near", "best", "best_n"])

        now, members, out = None, [], []
        for batch in batches:
            for *k, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    if len(members) > 1:
                        out += scan_block(members, *now[:3])
                    now, members = k, []
                members.append((word, n))
            yield found(out)
            out = []
        if len(members) > 1:
            yield found(scan_block(members, *now[:3]))

    hits = dealt.mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("best")))
    return (hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
            .select("word", "n_near", F.col("_b.best").alias("best"), (-F.col("_b.neg")).alias("best_n")))


# ---------------------------------------------------------------- forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; ``forms`` is (word, form).  Each round doubles the steps taken."""
    way = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(way.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                                  F.col("_next").isNotNull().alias("_moved")), "roots")
        way = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            return way


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of the vocabulary."""
    words = materialize(vocabulary(docs, id_col, text_col), "vocabulary")
    near = near_words(words, block)
    takes = F.col("best_n") >= RATIO * F.col("n")
    known = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "variants")
    way = roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(way, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
