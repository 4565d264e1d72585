"""Best-fit packing of documents into training sequences by bin completion.

1. Tokenise (Arrow batches, ``mapInArrow``) and cut: a document longer than a sequence
   becomes full pieces, its first piece takes the remainder.  Pieces are written once.
2. Pieces of equal length are interchangeable, so the problem is its length histogram: at
   most ``capacity`` rows whatever the corpus size.  Only those reach the driver.
3. ``bin_completion`` packs the histogram: best-fit decreasing gives the first incumbent;
   a branch and bound then fixes the largest open length, enumerates undominated fillings
   of the room beside it, applies a filling as often as the counts allow, and prunes every
   node whose waste cannot beat the incumbent.  It ends at the lower bound or after
   ``NODES`` nodes; the incumbent is a full packing at any time.
4. The packing is a list of (filling, times).  Pieces get a rank within their length
   (windows over (length, bucket), so a length that holds a third of all rows is ranked
   in many tasks) and find their sequence and offset by a search in that list.

Encoding: byte-level BPE never merges across the start of a piece of its split pattern,
and a single space between two non-space characters always starts one, so a text is the
concatenation of its space-separated parts, each encoded with its leading space.  Parts
repeat, so each task keeps a bounded cache of part -> ids; texts with other spacing are
encoded whole.

Defined results: a null text is empty, and an empty text is one piece holding the end
token; every input row is packed, repeated rows too; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.session import materialize

CAPACITY = 1024
END_ID = 2
NODES = 800          # branch-and-bound nodes on the histogram
TRY = 16             # nodes between two best-fit completions
FILLINGS = 8         # fillings tried per node, best first
CACHE = 300_000      # cached parts per task
BUCKETS = 64         # ranking windows per length


# ---------------------------------------------------------------- token ids

class _Irregular(Exception):
    """Spacing for which the parts of a text do not encode independently."""


class _Parts(dict):
    """part -> its ids as little-endian unsigned 32-bit bytes; emptied when full."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Irregular
        if len(self) >= CACHE:
            self.clear()
        self[part] = out = self.encode(self.lead + part)
        return out


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer: str, ranks: str | None):
    """text -> ids as bytes.  ``ranks`` names the same vocabulary for a faster encoder, used
    for Latin text only; everything else goes through ``tokenizer`` itself."""
    import numpy as np
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer)
    full.encode_special_tokens = True
    if ranks is None:
        def encode(text: str) -> bytes:
            return np.asarray(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    else:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text: str) -> bytes:
            if text.isascii() or max(text) < "ɐ":
                return np.asarray(fast.encode_ordinary(text), "<u4").tobytes()
            return np.asarray(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    first, later = _Parts(encode, ""), _Parts(encode, " ")

    def whole(text: str) -> bytes:
        if not text:
            return b""
        head, *tail = text.split(" ")
        try:
            return first[head] + b"".join(map(later.__getitem__, tail))
        except _Irregular:
            return encode(text)

    return whole


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, the remainder first."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY,
           end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece; ``ids`` are little-endian 32-bit bytes."""
    def run(batches):
        import pyarrow as pa

        encode, end = _encoder(tokenizer, ranks), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "") + end
                at = 0
                for k, n in enumerate(cut(len(data) // 4, capacity)):
                    own = data[4 * at:4 * (at + n)]
                    for col, v in zip(rows, (i, k, at, n, zlib.crc32(own), own if keep_ids else None)):
                        col.append(v)
                    at += n
            out = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                   *(pa.array(c, pa.int64()) for c in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out, names = [*out, pa.array(rows[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    d = docs.select(F.col(id_col).alias("doc_id"), F.col("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


# ---------------------------------------------------------------- the histogram's packing

Plan = list[tuple[tuple[int, ...], int]]  # (lengths in one sequence, how many such sequences)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for every k up to half, lengths over capacity - k need a sequence
    each, other lengths over half as well, and lengths from k to half that find no room
    beside the latter need more."""
    import numpy as np

    n, half = np.zeros(capacity + 2, "int64"), capacity // 2
    for x, c in counts.items():
        n[x] = c
    many, size = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    k = np.arange(half + 1)
    big, mid = many[capacity] - many[capacity - k], many[capacity - k] - many[half]
    room = mid * capacity - (size[capacity - k] - size[half])
    small = size[half] - np.where(k > 0, size[np.maximum(k - 1, 0)], 0)
    return int((big + mid + np.maximum(0, -((room - small) // capacity))).max(initial=0))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on the histogram: equal items move into equal bins together."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []  # sorted rooms that have bins

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if not bins[room]:
            bisect.insort(rooms, room)
        bins[room][filling] = bins[room].get(filling, 0) + n

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                each = capacity // x
                if left >= each:
                    put(capacity - each * x, (x,) * each, left // each)
                    left %= each
                if left:
                    put(capacity - left * x, (x,) * left, 1)
                    left = 0
                continue
            room = rooms[at]
            filling, n = bins[room].popitem()
            if not bins[room]:
                rooms.pop(at)
            # A best-fit bin takes this length until it no longer fits.
            each = min(room // x, left)
            used = min(n, left // each)
            if n > used:
                put(room, filling, n - used)
            put(room - each * x, (*filling, *(x,) * each), used)
            left -= each * used
    return [(f, n) for by in bins.values() for f, n in by.items()]


def _refines(fine: tuple[int, ...], coarse: tuple[int, ...]) -> bool:
    """Whether the items of ``fine`` fit into slots of the sizes ``coarse`` (then coarse dominates)."""
    def fit(i: int, slots: list[int]) -> bool:
        if i == len(fine):
            return True
        for j in range(len(slots)):
            if slots[j] >= fine[i] and slots[j] not in slots[:j]:
                slots[j] -= fine[i]
                if fit(i + 1, slots):
                    return True
                slots[j] += fine[i]
        return False

    return fit(0, list(coarse))


def fillings(counts: dict[int, int], largest: int, capacity: int, limit: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of a sequence that holds ``largest``, least waste and fewest items first.

    For waste 0, 1, 2, ...: sets of one, two and three further lengths by a search of the
    missing length, then greedy sets; a set whose items fit into an earlier set's is dropped.
    """
    room = capacity - largest
    left = dict(counts)
    left[largest] -= 1
    usable = sorted((x for x, c in left.items() if c and x <= room), reverse=True)
    if not usable:
        return [()]
    found: list[tuple[int, ...]] = []

    def add(f: tuple[int, ...]) -> None:
        if len(found) < limit and not any(_refines(f, g) for g in found):
            found.append(f)

    for total in range(room, max(0, room - 64), -1):
        if left.get(total, 0):
            add((total,))
            break  # one item of that size holds whatever else would fit there
        for a in usable:
            b = total - a
            if b <= 0:
                continue
            if b > a:
                break
            if left.get(b, 0) > (a == b):
                add((a, b))
        if len(found) < limit:
            for i, a in enumerate(usable[:64]):
                for b in usable[i:i + 64]:
                    c = total - a - b
                    if 0 < c <= b and left.get(c, 0) > (a == c) + (b == c) and left[b] > (a == b):
                        add((a, b, c))
        if found:
            break
    greedy, rest = [], room
    for x in usable:
        n = min(left[x], rest // x)
        greedy += [x] * n
        rest -= n * x
    add(tuple(greedy))
    return sorted(found, key=lambda f: (room - sum(f), len(f)))


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """A packing of the histogram into as few sequences as the search finds."""
    counts = {x: c for x, c in counts.items() if c}
    best = best_fit(counts, capacity)
    fewest, floor, total = sum(n for _, n in best), lower_bound(counts, capacity), sum(x * c for x, c in counts.items())
    # Each open node: (counts left, fillings chosen, their number, their waste).
    stack: list[tuple[dict[int, int], Plan, int, int]] = [(counts, [], 0, 0)]
    while stack and nodes and fewest > floor:
        nodes -= 1
        left, plan, used, waste = stack.pop()
        if waste > (fewest - 1) * capacity - total:
            continue
        if not left:
            if used < fewest:
                best, fewest = plan, used
            continue
        if used + lower_bound(left, capacity) >= fewest:
            continue
        if nodes % TRY == 0:  # best fit on what is left: a better incumbent on the way down
            rest = best_fit(left, capacity)
            if used + sum(n for _, n in rest) < fewest:
                best = [*plan, *rest]
                fewest = sum(n for _, n in best)
        largest = max(left)
        for f in reversed(fillings(left, largest, capacity)):
            one = (largest, *f)
            need = {x: one.count(x) for x in one}
            times = min(left[x] // k for x, k in need.items())
            after = {x: c - need.get(x, 0) * times for x, c in left.items() if c > need.get(x, 0) * times}
            stack.append((after, [*plan, (one, times)], used + times, waste + times * (capacity - sum(one))))
    return best


# ---------------------------------------------------------------- placing the pieces

def _ranked(p: DataFrame) -> DataFrame:
    """Add ``rank``: 0-based and gapless within each length."""
    b = p.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    sizes = b.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    return (b.withColumn("_i", F.row_number().over(own) - 1).join(sizes, ["length", "_b"])
            .withColumn("rank", F.col("_from") + F.col("_i")).drop("_b", "_i", "_from"))


def pack(p: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``p`` (pieces with a ``length``) with sequence_id and offset; ``p`` is read more than once."""
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = bin_completion(counts, capacity, nodes)  # histogram: at most ``capacity`` rows
    slots, taken, sequence = [], defaultdict(int), 0
    for filling, times in plan:
        at = 0
        for x in sorted(set(filling), reverse=True):
            k = filling.count(x)
            slots.append((x, taken[x], sequence, at, k))
            taken[x] += k * times
            at += k * x
        sequence += times
    slots.sort()
    width = 1 << 40

    def place(batches):
        import numpy as np
        import pyarrow as pa

        s = np.array(slots, dtype="int64").reshape(-1, 5)
        keys = s[:, 0] * width + s[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            hit = s[np.searchsorted(keys, length * width + rank, side="right") - 1]
            i = rank - hit[:, 1]
            cols = {n: batch.column(j) for j, n in enumerate(batch.schema.names) if n != "rank"}
            cols |= {"sequence_id": pa.array(hit[:, 2] + i // hit[:, 4]), "offset": pa.array(hit[:, 3] + i % hit[:, 4] * length)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema.fields)
    return _ranked(p).select(*p.columns, F.col("rank").cast("long").alias("rank")).mapInArrow(
        place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY,
                   keep_ids: bool = False) -> DataFrame:
    """Documents -> packed pieces (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return pack(materialize(pieces(docs, tokenizer, ranks, capacity, keep_ids=keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the token ids of every sequence, for ``keep_ids`` pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    s = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    return s.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
