"""N-gram Jaccard join with signature trees: all links with Jaccard >= 0.8 between the 5-word
shingle sets of all documents, as connected components.

1. **Sets.**  One Arrow pass hashes words and shingles with numpy over whole batches.  A
   document's set is the distinct 64-bit shingle hashes; ``sid`` is a hash of the set, so
   equal sets are one vertex from here on and copies cost nothing more.
2. **Lone sets leave.**  Linked sets overlap in at least 80 % of either.  So in hash order
   the heads of ``HEAD`` of both sets share a known number of shingles (prefix lemma).  A
   set whose head holds fewer shingles that other sets also have cannot link; an aggregate
   by shingle (counts and smallest and largest sid, combined map-side) finds them.
3. **Keys.**  For the sets that stay, shingles are ordered by how many sets hold them; two
   linked sets share one of their rarest 20 %.  These are the keys: sets meet only under a
   common key, and frequent passages are last in that order, so they are hardly ever keys.
4. **Leaders.**  Under every key the smallest (then the largest) sid is a leader; each set
   is verified against the leader it meets most often.  Large groups of near copies become
   one component here, with one pair per set and not one per two sets.
5. **Signature trees.**  Only keys that still hold different components go on.  Under each,
   the sets form a tree: leaves are sets with a bitmap of their shingles, inner nodes hold
   the OR of their bitmaps, their size range and their smallest bit count.  A dual
   traversal drops node pairs whose sizes exclude 80 %, or whose common bits bound the
   overlap below it; pairs inside a component are skipped.  Surviving leaf pairs are
   verified on the full sets.  A key with more than ``GROUP`` sets is dealt to several
   tasks as pairs of blocks.
6. Components of the verified links, labelled with the smallest doc_id.

No step collects sets or links on the driver or in one task; every filter is a necessary
condition for a link, so no link is lost (up to collisions of 64-bit hashes).

Defined results: null and blank texts have an empty set, 0 shingles, and link with nothing;
a text of fewer than five words is one shingle; repeated rows and ids keep their rows; the
smallest doc_id ignores nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.operators.components import components
from textlens.session import materialize, materialize_bucketed

N = 5
PERCENT = 80
HEAD = 0.04           # length of a head beyond the 20 % that the lemma needs, as a share of the set
BITS = 2048           # bitmap of a set in the tree
WIDE = 1 << 16        # bitmap of a set between two leaves, travelling as 16-bit marks
LEAF, FAN = 16, 8     # sets in a leaf node, children of an inner node
GROUP = 2_000         # sets of one key in one task
HOOKS = 1             # rounds of one pair per key and component before all pairs
SLOTS = 1 << 18       # 64-bit words of the bitmap of marked rows, at most so many rows to broadcast
SHIP = 1_000_000      # surviving set ids that travel with the second Arrow pass
CHUNK = 1 << 20       # bytes hashed at a time


# ---------------------------------------------------------------- shingle sets

def _mix(x):
    """A 64-bit finaliser (splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Shingler:
    """Shingle hashes of a batch of texts given as one buffer of bytes with offsets."""

    def __init__(self):
        import numpy as np

        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.lower = np.arange(1, 257, dtype="uint64")
        self.lower[65:91] += np.uint64(32)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.step = _mix(np.arange(1, N + 1, dtype="uint64") * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        self.power = self.unpower = np.ones(1, "uint64")

    def _powers(self, n: int) -> None:
        import numpy as np

        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.base))])
                self.unpower = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.inverse))])

    def sets(self, data, at):
        """Sorted distinct shingle hashes of the texts data[at[i]:at[i+1]]."""
        import numpy as np

        n = len(data)
        if n == 0:
            return [np.empty(0, "uint64")] * (len(at) - 1)
        self._powers(n)
        word = ~self.space[data]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[at] = True
        before = np.concatenate([[False], word[:-1]]) & ~edge[:n]
        after = np.concatenate([word[1:], [False]]) & ~edge[1:]
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.lower[data] * self.power[:n])])
            words = _mix((sums[last + 1] - sums[first]) * self.unpower[first])
            bounds = np.searchsorted(first, at)
            full = np.zeros(max(0, len(words) - N + 1), "uint64")
            for k in range(N):
                full += words[k:k + len(full)] * self.step[k]
            full = _mix(full)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a >= N:
                    out.append(np.unique(full[a:b - N + 1]))
                elif b > a:
                    out.append(_mix((words[a:b] * self.step[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
                else:
                    out.append(np.empty(0, "uint64"))
        return out

    def batch(self, texts):
        """Sets of an Arrow string array, hashed in chunks of about CHUNK bytes."""
        import numpy as np
        import pyarrow as pa

        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        _, offsets, body = texts.buffers()
        at = np.frombuffer(offsets, "int64")[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(body, "uint8") if body is not None else np.empty(0, "uint8")
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
            yield from self.sets(data[at[i]:at[j]], at[i:j + 1] - at[i])
            i = j


def _sid(s) -> int:
    """64-bit id of a set; 0 for the empty one."""
    import numpy as np

    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = _mix(np.array([_mix(s ^ np.uint64(0xA0761D6478BD642F)).sum() + np.uint64(len(s))], "uint64"))
    return int(x.view("int64")[0]) or 1


def least_overlap(n):
    """Shingles that a set of ``n`` has in common with any set it links with, at least."""
    return -(-n * PERCENT // 100)


def head_length(n: int) -> int:
    """Length of a set's head in hash order."""
    return min(n, n - least_overlap(n) + 1 + int(HEAD * n))


def shingle_sets(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n, sid, head): size, id and lowest hashes of every document's set."""
    def run(batches):
        import pyarrow as pa

        own = _Shingler()
        for batch in batches:
            n, sid, head = [], [], []
            for s in own.batch(batch.column(1)):
                n.append(len(s))
                sid.append(_sid(s))
                head.append(s[:head_length(len(s))].view("int64"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(sid, pa.int64()),
                                              pa.array(head, pa.list_(pa.int64()))], ["doc_id", "n", "sid", "head"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n int, sid long, head array<long>")


def full_sets(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """(sid, n, shingles, marks), one row per sid of ``keep``."""
    ids = None
    if keep.count() <= SHIP:
        import numpy as np
        ids = np.sort(np.array([r["sid"] for r in keep.select("sid").collect()], "int64"))  # at most SHIP numbers

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = _Shingler()
        for batch in batches:
            sid, n, sets, marks = [], [], [], []
            for s in own.batch(batch.column(0)):
                x = _sid(s)
                if ids is not None:
                    i = np.searchsorted(ids, x)
                    if i == len(ids) or ids[i] != x:
                        continue
                sid.append(x)
                n.append(len(s))
                sets.append(s.view("int64"))
                marks.append((s >> np.uint64(16)).astype("uint16").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(sets, pa.list_(pa.int64())),
                                              pa.array(marks, pa.binary())], ["sid", "n", "shingles", "marks"])

    out = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        run, "sid long, n int, shingles array<long>, marks binary")
    if ids is None:
        out = out.join(keep.select("sid"), "sid", "left_semi")
    # Copies of one set: any of them, combined map-side first.
    return out.groupBy("sid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("marks").alias("marks"))


# ---------------------------------------------------------------- who can link at all

def _shared(postings: DataFrame) -> DataFrame:
    """(token, df) of the tokens that occur in more than one set."""
    g = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("sid").alias("a"), F.max("sid").alias("b"))
    return g.filter("a <> b").select("token", "df")


def candidates(sets: DataFrame) -> DataFrame:
    """(sid) of the sets whose head shares enough tokens with other sets."""
    # 40 bits of a hash: a collision can only keep a set that would have left.
    heads = sets.filter("n > 0").select("sid", F.explode("head").alias("token")).withColumn(
        "token", F.col("token").bitwiseAND(F.lit((1 << 40) - 1)))
    common = heads.join(_shared(heads).select("token"), "token").distinct().groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    sizes = sets.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"))
    # A partner has at least 80 % of the size, and both heads share what the shorter one guarantees.
    needed = 1 + F.floor(F.lit(HEAD) * F.floor(F.col("n") * PERCENT / 100))
    return common.join(sizes, "sid").filter(F.col("c") >= needed).select("sid")


def keys(full: DataFrame) -> DataFrame:
    """(token, sid): each set's rarest 20 % of shingles, without those that no other set holds."""
    postings = full.select("sid", "n", F.explode("shingles").alias("token"))
    known = postings.join(_shared(postings.select("sid", "token")), "token")
    per = known.groupBy("sid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    lone = F.col("n") - F.size("t")
    room = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - lone
    return per.filter(room > 0).select("sid", F.explode(F.slice("t", F.lit(1), room.cast("int"))).alias("x")).select("x.token", "sid")


# ---------------------------------------------------------------- links

def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    side = lambda c: full.select(F.col("sid").alias(c), F.col("shingles").alias(f"_{c}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("_a", "_b"))
    return j.withColumn("_i", both).filter(
        100 * F.col("_i") >= PERCENT * (F.size("_a") + F.size("_b") - F.col("_i"))).select("a", "b")


def leader_pairs(k: DataFrame, pick) -> DataFrame:
    """(a, b): each set and the leader it meets under most of its keys."""
    lead = k.groupBy("token").agg(pick("sid").alias("b"))
    met = k.join(lead, "token").filter("sid <> b").groupBy("sid", "b").agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy("sid").agg(F.max(F.struct("c", "b")).alias("x")).select(F.col("sid").alias("a"), F.col("x.b").alias("b"))


def bitmaps(marks):
    """Bitmaps of BITS bits, as rows of 64-bit words, of sets given by their 16-bit marks."""
    import numpy as np

    on = np.zeros((len(marks), BITS), bool)
    for r, m in enumerate(marks):
        on[r, np.frombuffer(m, "uint16") % BITS] = True
    return np.packbits(on, axis=1).view("uint64")


class Tree:
    """Signature tree over sets of one key: arrays per level, leaves first, sets of one component together."""

    def __init__(self, n, bits, comp):
        import numpy as np

        count = np.bitwise_count(bits).sum(1).astype("int64")
        self.order = np.lexsort((count, n, comp))
        n, bits, comp, count = n[self.order], bits[self.order], comp[self.order], count[self.order]
        # Per level: least and largest size, least bit count, OR of the bitmaps, least and largest component.
        self.levels = [(n, n, count, bits, comp, comp)]
        size = LEAF
        while len(self.levels[-1][0]) > 1:
            low, high, count, bits, first, last = self.levels[-1]
            cut = np.arange(0, len(low), size)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(count, cut),
                                np.bitwise_or.reduceat(bits, cut, axis=0), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)))
            size = FAN

    def _possible(self, level: int, i, j):
        """Positions among the node pairs (i, j) of a level that may hold a link between two components."""
        import numpy as np

        low, high, count, bits, first, last = self.levels[level]
        ok = (100 * high[i] >= PERCENT * low[j]) & (100 * high[j] >= PERCENT * low[i])
        ok &= ~((first[i] == last[i]) & (first[j] == last[j]) & (first[i] == first[j]))
        at = np.flatnonzero(ok)
        i, j = i[at], j[at]
        common = np.bitwise_count(bits[i] & bits[j]).sum(1).astype("int64")
        # At least count - common bits of a set lie outside the other node: as many shingles differ.
        far = np.zeros(len(at), bool)
        for x in (i, j):
            far |= 100 * (count[x] - common) > (100 - PERCENT) * high[x]
        return at[~far]

    def pairs(self):
        """Pairs of positions in the input that may link and are of different components."""
        import numpy as np

        i = j = np.zeros(1, "int64")
        for level in range(len(self.levels) - 1, 0, -1):
            ok = self._possible(level, i, j)
            i, j = i[ok], j[ok]
            fan = LEAF if level == 1 else FAN
            below = len(self.levels[level - 1][0])
            a = np.repeat(i, fan * fan) * fan + np.tile(np.repeat(np.arange(fan), fan), len(i))
            b = np.repeat(j, fan * fan) * fan + np.tile(np.tile(np.arange(fan), fan), len(j))
            ok = (a < below) & (b < below) & ((a <= b) if level > 1 else (a < b))
            i, j = a[ok], b[ok]
        if len(self.levels) == 1:
            return np.empty(0, "int64"), np.empty(0, "int64")
        ok = self._possible(0, i, j)
        return self.order[i[ok]], self.order[j[ok]]


def close(i, j, n, marks):
    """Which pairs of sets still pass with bitmaps of WIDE bits made of their 16-bit marks.

    A bit of x that y lacks is a shingle that y lacks; so few bits collide at this width
    that hardly any pair below the threshold passes.
    """
    import numpy as np

    ok = np.zeros(len(i), bool)
    if not len(i):
        return ok
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = at[:len(i)], at[len(i):]
    for a in range(0, len(used), 256):  # 16 MB of bitmaps at a time for the first side of the pairs
        own = [np.frombuffer(marks[u], "uint16") for u in used[a:a + 256]]
        wide = np.zeros((len(own), WIDE), bool)
        for r, m in enumerate(own):
            wide[r, m] = True
        for p in np.flatnonzero((x >= a) & (x < a + 256)):
            other = np.frombuffer(marks[used[y[p]]], "uint16")
            inside = int(wide[x[p] - a][other].sum())  # marks of y that x has, at least the overlap
            ok[p] = 100 * inside >= PERCENT * (n[i[p]] + n[j[p]] - inside)
    return ok


def hooks(i, j, comp):
    """Of the pairs (i, j), one for each component that has a smaller neighbour: with the smallest."""
    import numpy as np

    up = comp[i] > comp[j]
    x, y = np.where(up, i, j), np.where(up, j, i)
    by = np.lexsort((comp[y], comp[x]))
    x, y = x[by], y[by]
    _, first = np.unique(comp[x], return_index=True)
    return x[first], y[first]


def tree_pairs(members: DataFrame, every: bool) -> DataFrame:
    """Distinct pairs (a, b) that the trees of all keys leave, or (``every`` false) per key one for
    each component; ``members`` has token, sid, n, comp, marks.

    Rows of a key lie together (repartitioned and sorted by key); one key's rows in one
    task are bounded by the dealing in ``links``.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush(rows):
            sid, n, comp = (np.concatenate(c) for c in list(zip(*rows))[:3])
            marks = [m for r in rows for m in r[3]]
            i, j = Tree(n, bitmaps(marks), comp).pairs()
            ok = close(i, j, n, marks)
            i, j = i[ok], j[ok]
            if not every:
                i, j = hooks(i, j, comp)
            return np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])

        def emit(parts):
            a, b = (np.concatenate(c) if parts else np.empty(0, "int64") for c in (zip(*parts) if parts else ((), ())))
            both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), "int64")
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        open_key, rows = None, []
        for batch in batches:
            key, sid, n, comp = (batch.column(c).to_numpy() for c in range(4))
            marks = batch.column(4).to_pylist()
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            parts = []
            for x, y in zip(cut[:-1], cut[1:]):
                if x == y:
                    continue
                if rows and key[x] != open_key:
                    parts.append(flush(rows))
                    rows = []
                open_key = key[x]
                rows.append((sid[x:y], n[x:y].astype("int64"), comp[x:y], marks[x:y]))
            yield emit(parts)
        if rows:
            yield emit([flush(rows)])

    out = members.select("token", "sid", "n", "comp", "marks").mapInArrow(run, "a long, b long")
    return out.distinct()


def _components(full: DataFrame, links: DataFrame) -> DataFrame:
    return materialize(components(full.select(F.col("sid").alias("id")), links).select(
        F.col("id").alias("sid"), F.col("group_id").alias("comp")), "ngram_components")


def _members(k: DataFrame, comp: DataFrame, full: DataFrame) -> DataFrame:
    """The sets under keys that hold more than one component, each key's sets side by side.

    Near copies have dozens of rare shingles in common, and each of these keys has the same sets: one
    of them stays.  Keys have the same sets if their number and two hashes over them agree (128 bits).
    A key of more than GROUP sets is dealt as pairs of blocks of about GROUP sets.
    """
    c = k.join(comp, "sid")
    each = c.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y"),
                                  F.bit_xor(F.xxhash64("sid")).alias("one"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("two"))
    mixed = each.filter("x <> y").groupBy("size", "one", "two").agg(F.min("token").alias("token"))
    m = c.join(mixed.select("token", F.ceil(F.col("size") / GROUP).cast("int").alias("blocks")), "token")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    m = m.select("token", "sid", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    key = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    m = m.select(key.alias("token"), "sid", "comp").join(full.select("sid", "n", "marks"), "sid")
    return m.repartition("token").sortWithinPartitions("token")


def links(full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified links (a, b), components (sid, comp)) of the sets ``full``.

    The links span every component.  First the leaders', then ``HOOKS`` rounds of one tree
    pair per key and component, which join what belongs together; the last round verifies
    every pair that the trees still leave between different components.
    """
    # By sid as the aggregate has left them, so that the joins with components shuffle no keys.
    buckets = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = materialize_bucketed(keys(full), "ngram_keys", buckets, "sid", dealt=True)
    found = materialize(verified(leader_pairs(k, F.min).unionByName(leader_pairs(k, F.max)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), full), "ngram_links")
    comp = _components(full, found)
    for i in range(HOOKS + 1):
        every = i == HOOKS
        more = materialize(verified(tree_pairs(_members(k, comp, full), every), full), "ngram_links")
        if not more.isEmpty():
            found = found.unionByName(more)
            comp = _components(full, found)
    return found, comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    sets = materialize(shingle_sets(docs, id_col), "ngram_sets")
    keep = materialize(candidates(sets), "ngram_candidates")
    # In buckets by sid: the joins that follow read the sets there, and shuffle none of them but a pair's first.
    # The aggregate has dealt them by sid already, into as many parts.
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = materialize_bucketed(full_sets(docs, keep), "ngram_full", buckets, "sid", dealt=True)
    _, comp = links(full)
    d = sets.select("doc_id", "n", "sid").join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    first = d.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("first"))
    out = d.join(first, "comp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Rows are told apart by doc_id and text, so a repeated id loses only the rows that are
    copies; of rows equal in both, repeated rows, any one stays.  A null doc_id is the
    smallest.  Documents without words link with nothing, and all of them stay.
    """
    copy = F.xxhash64(F.coalesce("text", F.lit("")))
    near = near_duplicates(docs.select(F.struct(F.col("doc_id"), copy.alias("copy")).alias("row"), "text"), "row")
    rows = near.filter("n_shingles > 0").groupBy("doc_id").agg(F.first("component_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    # The rows that are not alone in their component or not alone as they are; written, since both parts below read it.
    marks = materialize(rows.withColumn("_away", F.col("doc_id") != F.col("first")).filter("_away OR rows > 1").select(
        F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.copy").alias("_copy"), "_away"), "ngram_marks")
    # A row that misses their bitmap is not among them and stays where it is, so that the join shuffles the texts of
    # the others only.  More marks than bits would shuffle more texts, but lose none.
    slot = lambda c: (F.pmod(c, F.lit(SLOTS)).alias("_slot"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({c}, 40) & 63 AS int))").alias("_bit"))
    bitmap = marks.select(*slot("_copy")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    dealt = docs.withColumn("_text", copy).select("*", *slot("_text")).join(F.broadcast(bitmap), "_slot", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    some = dealt.filter(hit).select(*docs.columns, "_text")
    marked = some.join(marks, F.col("_text").eqNullSafe(F.col("_copy")) & some["doc_id"].eqNullSafe(F.col("_id")), "left")
    # Only repeated rows are shuffled for this, each task's copies combined first.
    once = marked.filter("NOT _away").dropDuplicates(["doc_id", "_text"])
    return dealt.filter(~hit).select(*docs.columns).unionByName(
        marked.filter("_away IS NULL").select(*docs.columns)).unionByName(once.select(*docs.columns))
