"""Class weights of terms from blocks of documents (SURVEY T-NB, T-base): what naive Bayes is made of.

Documents are dealt into blocks by id; a block is one row with its postings as a sparse matrix over the terms
that occur in it, written once as a bucketed table.  A term is its 64-bit hash.  Postings never leave their
block: what is shuffled is one row for each block and term in it, and on the second way only for terms that more
than one block holds.

1. Document frequencies: each block counts its terms, an aggregate by term sums them, and the sums of terms of
   several blocks go back to these blocks.  A term of one block is known there.
2. Weights: idf, norms and tf-idf values are the block's own.  ``W``, the sum of the values of a class, goes the
   same way (``class_sums``).

Several models are made at once: a model is a ``key`` (a hold-out split, a fold of a cross-validation) with its
own idf, norms and vocabulary.  A document carries for each key the number of its rows that train a class, that
train without a class, and that are held out.

Defined results: a row without an id is no document; rows that share their id and counts are one document; all
documents of one id share a norm; null and empty texts have no terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import tokens, unigrams_bigrams
from textlens.session import materialize_bucketed

BLOCK_BYTES = 8 << 20         # text in a block, on average, of a large corpus
LEAST_BYTES = 256 << 10       # and at least, of one that could not keep all cores busy otherwise
MOST_BLOCKS = 100_000         # Spark's bound on buckets; blocks grow beyond it
MOST_PLACES = 4_096           # where the sums of terms of several blocks meet
# sizes: postings of each document; gap: the place of a posting's term less that of the one before in the document
FIELDS = ["block", "ids", "own", "counts", "sizes", "gap", "tf", "terms"]


def term_hashes(text_col: str):
    """Hashes of the tokens and token pairs of a text, in order."""
    return F.coalesce(F.transform(unigrams_bigrams(tokens(F.col(text_col))), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))


def rows_of(table):
    """The rows of an Arrow batch or table as dicts of numpy arrays (lists), buffers (binary; but ``ids`` stay Arrow) and scalars."""
    import numpy as np

    for i in range(table.num_rows):
        row = {}
        for name in table.schema.names:
            v = table.column(name)[i]
            row[name] = (v.values if name == "ids" else np.asarray(v.values) if hasattr(v, "values")
                         else v.as_buffer() if hasattr(v, "as_buffer") else v.as_py())
        yield row


def packed(x) -> bytes:
    """Numbers from 0 on, each in as few bytes as the largest needs; one value of a table, where a list would take three
    times the memory while it is read."""
    import numpy as np

    return x.astype(np.min_scalar_type(x.max() if len(x) else 0)).tobytes()


def unpacked(buffer, n: int, kind: str):
    """The ``n`` numbers of ``packed``."""
    import numpy as np

    return np.frombuffer(buffer, f"u{len(buffer) // n}").astype(kind) if n else np.empty(0, kind)


def _gaps(doc, idx):
    """``idx``, ascending in each document, as small numbers, which take half the disk."""
    import numpy as np

    same = np.append(False, doc[1:] == doc[:-1]) if len(doc) else np.empty(0, bool)
    return np.where(same, np.diff(idx, prepend=0), idx)


def _summed(doc, gap):
    """The ``idx`` of ``_gaps``."""
    import numpy as np

    if not len(doc):
        return np.empty(0, "i4")
    sums, first = np.cumsum(gap, dtype="i8"), np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return (sums - np.repeat(sums[first] - gap[first], np.diff(np.append(first, len(doc))))).astype("i4")


def np_columns(x):
    """The columns of a matrix, each laid out on its own."""
    import numpy as np

    return map(np.ascontiguousarray, x.T)


def flat(table, name: str):
    """The values of a list column of all rows, one after another."""
    import numpy as np

    column = table.column(name).combine_chunks()
    return np.asarray(column.flatten()) if len(column) else np.empty(0, column.type.value_type.to_pandas_dtype())


class Block:
    """Postings of some documents; ``counts`` is (documents, keys, classes + 2)."""

    def __init__(self, row: dict, n_keys: int, n_classes: int, n_train=None):
        import numpy as np

        self.block, self.ids, self.own, self.n_keys, self.n_classes = row["block"], row["ids"], row["own"], n_keys, n_classes
        self.doc = np.repeat(np.arange(len(self.own), dtype="i4"), row["sizes"])
        self.idx, self.tf = _summed(self.doc, unpacked(row["gap"], len(self.doc), "i4")), unpacked(row["tf"], len(self.doc), "i4")
        self.terms = np.frombuffer(row["terms"], "i8")
        self.counts = np.asarray(row["counts"], "f8").reshape(len(self.own), n_keys, n_classes + 2)
        self.train, self.held = self.counts[:, :, :-1].sum(2), self.counts[:, :, -1]
        self.n_train = n_train
        if "df" in row:
            self.df = unpacked(row["df"], len(self.terms) * n_keys, "i8").reshape(-1, n_keys)
            self.shared = np.frombuffer(row["shared"], "?")

    def own_df(self):
        """(terms, keys): training rows of the block that hold the term."""
        import numpy as np

        return np.stack([np.bincount(self.idx, self.train[self.doc, k], len(self.terms)) for k in range(self.n_keys)], 1).astype("i8")

    def idf(self, key: int):
        """The idf of every term; 0 where the key does not know it."""
        import numpy as np

        df = self.df[:, key]
        return np.where(df > 0, np.log((1.0 + self.n_train[key]) / (1.0 + df)) + 1.0, 0.0)

    def norms(self, raw, rows):
        """The norm of every id, by its number in ``own``, each document taken ``rows`` times; 1 for an id without terms."""
        import numpy as np

        norm = np.sqrt(np.bincount(self.own[self.doc], rows[self.doc] * raw * raw, len(self.own)))
        return np.where(norm > 0, norm, 1.0)

    def values(self, key: int, rows):
        """tf-idf of every posting, each document taken ``rows`` times into the norm of its id; 0 where the key does not know the term."""
        raw = self.tf * self.idf(key)[self.idx]
        return raw / self.norms(raw, rows)[self.own[self.doc]]

    def sums(self, key: int):
        """(terms, classes): W of the block's own documents."""
        import numpy as np

        v = self.values(key, self.train[:, key])
        return np.stack([np.bincount(self.idx, v * self.counts[self.doc, key, c], len(self.terms)) for c in range(self.n_classes)], 1)


def place_schema(columns: list[str], kind: str) -> str:
    return "place int, block int, term array<bigint>" + "".join(f", {c} array<{kind}>" for c in columns)


def to_places(block: int, bounds: list[int], columns: list[str], terms, made):
    """One row for each place, of the block's ``terms`` (ascending) from one of ``bounds`` to the next, and their ``made``, one array a column."""
    import numpy as np
    import pyarrow as pa

    cut = np.concatenate([[0], np.searchsorted(terms, np.array(bounds, "i8")), [len(terms)]])
    for p in range(len(bounds) + 1):
        ends = pa.array(cut[p:p + 2] - cut[p], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([block], pa.int32()), *(
            pa.ListArray.from_arrays(ends, pa.array(x[cut[p]:cut[p + 1]])) for x in (terms, *made))], ["place", "block", "term", *columns])


def met(each: DataFrame, columns: list[str], kind: str, least: int = 2) -> DataFrame:
    """(block, term, columns..., first), arrays: the sums over all blocks of ``to_places``, sent back to every block of a term
    that at least ``least`` blocks hold, by term in each row; ``first`` in one of them."""
    def add(key, table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("block").combine_chunks()
        lengths = np.asarray(table.column("term").combine_chunks().value_lengths())
        term, block = flat(table, "term"), np.repeat(table.column("block").to_numpy(), lengths)
        order = np.argsort(term, kind="stable")
        new = np.append(True, np.diff(term[order]) != 0)[:len(term)]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(term)))
        kept = np.repeat(count >= least, count)
        block = block[order][kept]
        back = np.argsort(block, kind="stable")  # by block, there by term
        known, first = np.unique(block[back], return_index=True)
        ends = pa.array(np.append(first, len(block)), pa.int32())
        made = [term[order][kept][back]]
        for c in columns:
            made.append((np.repeat(np.add.reduceat(flat(table, c)[order], start), count) if len(start) else flat(table, c))[kept][back])
        return pa.table({"block": pa.array(known, pa.int32()), **{c: pa.ListArray.from_arrays(ends, pa.array(x)) for c, x in zip(
            ["term", *columns, "first"], [*made, new[kept][back]])}})

    lists = place_schema(columns, kind).removeprefix("place int, ")
    return each.groupBy("place").applyInArrow(add, f"{lists}, first array<boolean>")


class TermBlocks:
    """The blocks of ``rows`` (id, text, counts ARRAY<INT>), with the document frequencies of all keys.

    ``totals`` is (keys, classes), the sum of W over all terms, and ``n_terms`` the vocabulary of each key: with
    the training rows of a key, ``n_train``, the only numbers that the driver holds.
    """

    def __init__(self, rows: DataFrame, n_keys: int, n_classes: int, n_train: list):
        self.n_keys, self.n_classes, self.n_train = n_keys, n_classes, n_train
        self.id_field = rows.schema["id"]
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.n_blocks = min(max(1, -(-size // BLOCK_BYTES), min(cores, size // LEAST_BYTES)), MOST_BLOCKS)
        self.blocks = self._built(rows)
        self.table = self._with_df()
        self._numbers()

    def _built(self, rows: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(self.n_blocks)).cast("int").alias("block")
        width = self.n_keys * (self.n_classes + 2)
        # The texts are shuffled, their terms are taken out of them where the block is.
        dealt = (rows.filter("id IS NOT NULL").select(block, "id", "text", "counts").repartition(self.n_blocks, "block")
                 .select("block", "id", "counts", term_hashes("text").alias("hashes")))

        def build(key, table):
            import numpy as np
            import pyarrow as pa

            table = table.combine_chunks()
            code = table.column("id").combine_chunks().dictionary_encode().indices.to_numpy()
            counts = np.asarray(table.column("counts").combine_chunks().flatten(), "i4").reshape(len(table), width)
            hashes = table.column("hashes").combine_chunks()
            _, first, doc = np.unique(np.column_stack([code, counts]), axis=0, return_index=True, return_inverse=True)
            terms, idx = np.unique(np.asarray(hashes.flatten(), "i8"), return_inverse=True)
            at = np.repeat(doc.ravel(), np.asarray(hashes.value_lengths())) * len(terms) + idx
            at, tf = np.unique(at, return_counts=True)
            doc, idx = np.divmod(at, max(len(terms), 1))
            values = [key[0].as_py(), table.column("id").combine_chunks().take(pa.array(first)), code[first], counts[first].ravel(),
                      np.bincount(doc, minlength=len(first)).astype("i4"), packed(_gaps(doc, idx)), packed(tf), terms.tobytes()]
            types = [pa.int32(), pa.list_(table.schema.field("id").type), *[pa.list_(pa.int32())] * 3, *[pa.binary()] * 3]
            return pa.table({name: pa.array([v], t) for name, v, t in zip(FIELDS, values, types)})

        schema = (f"block int, ids array<{self.id_field.dataType.simpleString()}>, own array<int>, counts array<int>, sizes array<int>, "
                  "gap binary, tf binary, terms binary")
        return materialize_bucketed(dealt.groupBy("block").applyInArrow(build, schema), "term_blocks", self.n_blocks, "block", dealt=True)

    def _shared_sums(self, table: DataFrame, columns: list[str], kind: str, values) -> DataFrame:
        """(block, term, columns..., first), arrays: ``values(block)``, a block's terms and one array a column, summed over
        all blocks and sent to every block of a term that several hold; ``first`` in one of them.

        A block's terms go as one row for each place, a range of hashes, not one for each term.
        """
        n_keys, n_classes, n_train, n_places = self.n_keys, self.n_classes, self.n_train, min(self.n_blocks, MOST_PLACES)
        bounds = [(p << 64) // n_places - (1 << 63) for p in range(1, n_places)]

        def deal(batches):
            for batch in batches:
                for row in rows_of(batch):
                    b = Block(row, n_keys, n_classes, n_train)
                    terms, made = values(b)
                    yield from to_places(b.block, bounds, columns, terms, made)

        return met(table.mapInArrow(deal, place_schema(columns, kind)), columns, kind)

    def _with_df(self) -> DataFrame:
        n_keys, n_classes, n_train = self.n_keys, self.n_classes, self.n_train
        columns = [f"d{k}" for k in range(n_keys)]
        back = self._shared_sums(self.blocks, columns, "bigint", lambda b: (b.terms, list(np_columns(b.own_df()))))

        def join(key, left, right):
            import numpy as np
            import pyarrow as pa

            row = next(rows_of(left))
            b = Block(row, n_keys, n_classes, n_train)
            b.df, mine, shared = b.own_df(), np.ones(len(b.terms), bool), np.zeros(len(b.terms), bool)
            at = np.searchsorted(b.terms, flat(right, "term"))
            for k, c in enumerate(columns):
                b.df[at, k] = flat(right, c)
            shared[at], mine[at] = True, flat(right, "first")
            totals = np.array([b.sums(k).sum(0) for k in range(n_keys)])
            values = [packed(b.df.ravel()), shared.tobytes(), totals.ravel(), (b.df[mine] > 0).sum(0)]
            types = [pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            return pa.table({"block": pa.array([row["block"]], pa.int32()), **{name: pa.array([v], t) for name, v, t in zip(
                ("df", "shared", "totals", "n_terms"), values, types)}})

        made = self.blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
            join, "block int, df binary, shared binary, totals array<double>, n_terms array<bigint>")
        self.counted = materialize_bucketed(made, "term_block_df", self.n_blocks, "block", dealt=True)
        return self.blocks.join(self.counted.select("block", "df", "shared"), "block")

    def _numbers(self) -> None:
        """``totals`` and ``n_terms``, summed over the blocks: one number a key and class."""
        import numpy as np

        def summed(column, size):
            out = np.zeros(size)
            for r in self.counted.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
                out[r["i"]] = r["x"]
            return out

        self.totals = summed("totals", self.n_keys * self.n_classes).reshape(self.n_keys, self.n_classes)
        self.n_terms = summed("n_terms", self.n_keys)

    def class_sums(self) -> DataFrame:
        """(term, block, df0..., w0...): W of each block's own documents, one column a key and class."""
        n_keys, n_classes, n_train = self.n_keys, self.n_classes, self.n_train
        df, w = [f"df{k}" for k in range(n_keys)], [f"w{i}" for i in range(n_keys * n_classes)]

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for row in rows_of(batch):
                    b = Block(row, n_keys, n_classes, n_train)
                    sums = [x for k in range(n_keys) for x in np_columns(b.sums(k))]
                    yield pa.RecordBatch.from_arrays([pa.array(b.terms), pa.array(np.full(len(b.terms), b.block, "i4")), *map(
                        pa.array, np_columns(b.df)), *map(pa.array, sums)], ["term", "block", *df, *w])

        return self.table.mapInArrow(run, "term bigint, block int" + "".join(f", {c} bigint" for c in df) + "".join(f", {c} double" for c in w))

    def held_out(self, score, schema: str) -> DataFrame:
        """The rows that ``score(block, key, values, W)`` makes of every block and key: an Arrow record batch.  ``values``
        are the tf-idf of the block's postings as held-out rows, ``W`` (terms, classes) the sums over all blocks."""
        n_keys, n_classes, n_train = self.n_keys, self.n_classes, self.n_train
        columns = [f"w{i}" for i in range(n_keys * n_classes)]
        back = self._shared_sums(self.table, columns, "double", lambda b: (
            b.terms[b.shared], [x for k in range(n_keys) for x in np_columns(b.sums(k)[b.shared])]))

        def run(key, left, right):
            import numpy as np
            import pyarrow as pa

            b = Block(next(rows_of(left)), n_keys, n_classes, n_train)
            at, out = np.searchsorted(b.terms, flat(right, "term")), []
            for k in range(n_keys):
                w = b.sums(k)
                for c in range(n_classes):
                    w[at, c] = flat(right, f"w{k * n_classes + c}")
                out.append(score(b, k, b.values(k, b.held[:, k]), w))
            return pa.Table.from_batches(out)

        return self.table.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)
