"""The most similar vectors for every vector, by additive quantisation.

1. Codebooks of full-dimensional codewords are fitted on a bounded sample by one task,
   each on the residuals of those before it; the driver holds the codewords only. A vector is encoded by beam search over all
   codebooks; the norm of what the code decodes to is stored with it.
2. The first codeword names the cell a vector lives in; its beam also names the next
   best cells, which it probes as a query. Codewords between which sampled partners
   get lost share a cell, until no cell loses more than a few of them: a hot group of
   similar vectors takes many codewords, but ends up in one cell.
3. Inside a cell, lookup tables of query-codeword products score every stored code.
   Pairs whose scored similarity is below a cut are passed over. The cut lies under
   the errors seen on sampled close pairs.
4. The rest is reranked exactly, and each vector keeps its best partners.

A cell with more members than one task should hold is cut into blocks of stored
vectors, and its queries go to each block. Equal vectors are searched once and
share the result. Vectors travel as 16-bit floats once per cell they live in or
probe. Pairs travel once: a task hands on the k best of each id in a cell, which
are gathered by id; copies are put in where they are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.operators.records import canonical_id
from quarrylens.session import cut_lineage

DIMENSION = 384
#: Vectors a cell is meant to hold; the first codebook has as many words as that takes ...
CELL_ROWS = 500
#: ... up to this many, beyond which cells grow.
MOST_CELLS = 4_096
#: Expected rows of the training sample for each word of the first codebook, drawn by a hash of the id; at least LEAST_SAMPLE.
SAMPLE_PER_CELL = 12
LEAST_SAMPLE = 12_000
#: Words of the other codebooks, and their number.
CODEWORDS = 256
CODEBOOKS = 4
BEAM = 3
#: Cells each vector probes besides its own.
EXTRA_PROBES = 1
#: Share of the sampled partners of each cell that its members must meet; below it, cells are joined.
CELL_RECALL = 0.95
#: Close pairs of one batch of queries from which on each side's k best are picked before the pairs are made.
DENSE_ROWS = 50_000
#: Pairs of one cell of which the k best of each id are taken at once.
PENDING_PAIRS = 300_000
#: Stored vectors of one block of a cell (30 MB).
BLOCK_ROWS = 20_000
#: Vectors encoded at once: their tables of products take up to 100 MB.
ENCODE_ROWS = 1_024
#: Vectors sent to one task of the search, on average (15 MB).
TASK_ROWS = 20_000


@dataclass
class Quantizer:
    books: list[np.ndarray]
    """codebooks of codewords x dimension"""
    cut: float = -1.0
    joined: np.ndarray | None = None
    """cell of each first codeword, where codewords share cells"""

    def __post_init__(self) -> None:
        self.flat = np.concatenate(self.books)
        self.starts = np.cumsum([0, *[len(b) for b in self.books]])
        self.gram = {(i, j): self.books[i] @ self.books[j].T for j in range(len(self.books)) for i in range(j)}
        self.norms = [np.einsum("kd,kd->k", b, b) for b in self.books]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes (n, codebooks), norms of the decoded vectors, cells (n, probes) from best to worst.

        All products of the vectors with codewords are taken once; the beam then only
        adds table entries: |x - sum c|^2 = |x|^2 - 2 x.c + |c|^2 + 2 c.c'.
        """
        n = len(x)
        if n > ENCODE_ROWS:
            parts = [self.encode(x[at:at + ENCODE_ROWS], beam) for at in range(0, n, ENCODE_ROWS)]
            return tuple(np.concatenate(p) for p in zip(*parts))
        products = self.tables(x)
        error = self.norms[0][None] - 2 * products[0]
        width = min(max(beam, EXTRA_PROBES + 1), error.shape[1])
        best = np.argpartition(error, width - 1, axis=1)[:, :width]
        score = np.take_along_axis(error, best, 1)
        order = np.argsort(score, axis=1, kind="stable")
        best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
        cells = best[:, :EXTRA_PROBES + 1].astype(np.int64)
        codes = best[:, :, None]
        for j in range(1, len(self.books)):
            keep, k = codes.shape[1], len(self.books[j])
            gain = self.norms[j][None, None] - 2 * products[j][:, None]
            for i in range(j):
                gain = gain + 2 * self.gram[i, j][codes[:, :, i]]
            total = (score[:, :, None] + gain).reshape(n, keep * k)
            width = min(beam, total.shape[1])
            best = np.argpartition(total, width - 1, axis=1)[:, :width]
            score = np.take_along_axis(total, best, 1)
            order = np.argsort(score, axis=1, kind="stable")
            best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], axis=2)
        if self.joined is not None:
            cells = self.joined[cells]
        final = codes[:, 0]
        norm2 = sum(self.norms[j][final[:, j]] for j in range(len(self.books)))
        for (i, j), gram in self.gram.items():
            norm2 = norm2 + 2 * gram[final[:, i], final[:, j]]
        return final.astype(np.uint16), np.sqrt(np.maximum(norm2, 1e-12)).astype(np.float32), cells

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Products of queries with all codewords, by codebook."""
        return np.split(queries @ self.flat.T, self.starts[1:-1], axis=1)

    def scores(self, tables: list[np.ndarray], codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Similarity of each query to each stored code, read from the tables."""
        out = np.take(tables[0], codes[:, 0], axis=1)
        for j in range(1, codes.shape[1]):
            out += np.take(tables[j], codes[:, j], axis=1)
        return out / norms[None]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * np.einsum("kd,kd->k", c, c)
    return np.concatenate([(x[at:at + ENCODE_ROWS] @ c.T - half).argmax(1) for at in range(0, len(x), ENCODE_ROWS)])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        counts = np.bincount(near, minlength=k)
        filled = counts > 0
        sums = np.zeros_like(c)
        for at in range(0, len(x), 8 * ENCODE_ROWS):
            part = near[at:at + 8 * ENCODE_ROWS]
            order = np.argsort(part, kind="stable")
            words, starts = np.unique(part[order], return_index=True)
            sums[words] += np.add.reduceat(x[at:at + 8 * ENCODE_ROWS][order], starts, axis=0)
        c[filled] = sums[filled] / counts[filled][:, None]
    return c.astype(np.float32)


def fit(sample: np.ndarray, threshold: float, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, cells: int | None = None,
        seed: int = 7) -> Quantizer:
    """Residual codebooks from unit vectors, the first of `cells` words, and a cut below the scores of sampled pairs at the threshold."""
    rng = np.random.default_rng(seed)
    rest, books = sample.copy(), []
    for j in range(codebooks):
        book = _kmeans(rest, (cells or codewords) if j == 0 else codewords, 8 if j == 0 else 3, rng)
        near = _nearest(rest, book)
        for at in range(0, len(rest), ENCODE_ROWS):
            rest[at:at + ENCODE_ROWS] -= book[near[at:at + ENCODE_ROWS]]
        books.append(book)
    model = Quantizer(books)
    codes, norms, _ = model.encode(sample[:4000])
    probe = sample[:1500]
    exact = probe @ sample[:4000].T
    scored = model.scores(model.tables(probe), codes, norms)
    close = scored[(exact >= threshold) & (exact < 0.9999)]
    # pairs just at the threshold, made of sampled vectors and random directions: the hardest there are
    noise = rng.standard_normal(probe.shape).astype(np.float32)
    noise -= (noise * probe).sum(1, keepdims=True) * probe
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    made = threshold * probe + np.float32(np.sqrt(max(0.0, 1 - threshold**2))) * noise
    made_codes, made_norms, _ = model.encode(made)
    hard = np.array([model.scores(model.tables(probe[i:i + 1]), made_codes[i:i + 1], made_norms[i:i + 1])[0, 0] for i in range(len(probe))])
    lows = [np.quantile(hard, 0.002), *([np.quantile(close, 0.002)] if len(close) >= 20 else [])]
    model.cut = float(min(lows)) - 0.02
    return model


def join_cells(model: Quantizer, sample: np.ndarray, threshold: float, k: int, least: float = CELL_RECALL) -> np.ndarray:
    """Cell of each first codeword, such that every cell's sampled vectors meet `least` of their k best partners.

    Partners in the sample are farther than those in all vectors, so the sample
    loses more of them. A cell that loses too many is joined with the one it loses most to.
    """
    cells = model.encode(sample)[2]
    left, right = [], []
    for at in range(0, len(sample), 1024):
        exact = sample[at:at + 1024] @ sample.T
        exact[np.arange(len(exact)), np.arange(at, at + len(exact))] = -2.0
        best = np.argpartition(exact, -min(k, len(sample) - 1), axis=1)[:, -min(k, len(sample) - 1):]
        rows, cols = np.nonzero(np.take_along_axis(exact, best, 1) >= threshold)
        left.append(rows + at)
        right.append(best[rows, cols])
    a, b = cells[np.concatenate(left)], cells[np.concatenate(right)]
    n = len(model.books[0])
    joined = np.arange(n)
    while len(a):
        x, y = joined[a], joined[b]
        lost = ~((x[:, :1] == y).any(1) | (y[:, :1] == x).any(1))
        loses = np.bincount(x[lost, 0], minlength=n)
        bad = np.flatnonzero(loses > (1 - least) * np.bincount(x[:, 0], minlength=n))
        if not len(bad):
            break
        worst = bad[loses[bad].argmax()]
        other = np.bincount(y[lost & (x[:, 0] == worst), 0], minlength=n).argmax()
        joined[joined == max(worst, other)] = min(worst, other)
    return joined


def _fitted(drawn: DataFrame, dimension: int, threshold: float, k: int, cells: int) -> tuple[Quantizer, np.ndarray] | None:
    """The model and the share of the sample in each cell, made by one task, so that no vector reaches the driver.

    Of an id drawn more than once one vector counts, so the sample stays as large as planned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, bytes] = {}
        for batch in batches:
            for key, vector in zip(batch.column("id").to_pylist(), _floats(batch.column("vector"), dimension)):
                rows[key] = max(vector.tobytes(), rows.get(key, b""))
        if len(rows) < 2:
            return
        sample = np.empty((len(rows), dimension), np.float32)
        for i, key in enumerate(sorted(rows)):
            x = np.frombuffer(rows.pop(key), np.float32)
            sample[i] = x / np.float32(np.linalg.norm(x.astype(np.float64)))
        model = fit(sample, threshold, codewords=min(CODEWORDS, max(2, len(sample) // 16)), cells=min(cells, max(2, len(sample) // SAMPLE_PER_CELL)))
        model.joined = join_cells(model, sample[::-(-len(sample) // LEAST_SAMPLE)], threshold, k)
        share = np.bincount(model.encode(sample)[2][:, 0]) / len(sample)
        yield pa.RecordBatch.from_arrays(
            [pa.array([[b.tobytes() for b in model.books]], pa.list_(pa.binary())), pa.array([model.cut]),
             pa.array([model.joined.astype(np.int64).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())],
            names=["books", "cut", "joined", "share"])

    made = drawn.repartition(1).mapInArrow(run, "books array<binary>, cut double, joined binary, share binary").collect()
    if not made:
        return None
    books = [np.frombuffer(b, np.float32).reshape(-1, dimension) for b in made[0]["books"]]
    return Quantizer(books, made[0]["cut"], np.frombuffer(made[0]["joined"], np.int64)), np.frombuffer(made[0]["share"], np.float64)


def _packed(col: str) -> Column:
    """Id as bytes: 16 for a UUID; other ids get a mark before (and behind, where that made 16)."""
    text = F.col(col)
    other = F.concat(F.lit("x"), text, F.when(F.octet_length(text) == 15, F.lit("\0")).otherwise(F.lit("")))
    return F.when(text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.unhex(F.replace(text, F.lit("-"), F.lit("")))).otherwise(
        F.encode(other, "UTF-8"))


def _unpacked(col: str) -> Column:
    hexed = F.lower(F.hex(col))
    uuid = F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    other = F.decode(F.col(col), "UTF-8")
    return F.when(F.octet_length(col) == 16, uuid).otherwise(F.rtrim(F.substring(other, 2, 1 << 30), F.lit("\0")))


def _sided(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A checkpointed narrow frame: broadcast if it is counted small, else left to a sort-merge join."""
    return F.broadcast(df) if df.count() <= most_rows else df.hint("merge")


def _floats(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)


def usable_vectors(chunks: DataFrame, id_col: str = "id", vector_col: str = "embedding", at_col: str = "ingested_at",
                   dimension: int = DIMENSION) -> DataFrame:
    """key, id, at, vector of rows with exactly `dimension` finite numbers that are not all zero."""
    v = F.col(vector_col)
    good = (
        (F.size(v) == dimension)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return chunks.select(canonical_id(id_col).alias("id"), F.col(at_col).alias("at"), v.cast("array<float>").alias("vector")).filter(
        F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def _fingerprint() -> list:
    return [F.xxhash64("vector").alias("h1"), F.xxhash64(F.reverse("vector")).alias("h2")]


def similar_pairs(chunks: DataFrame, k: int = 5, threshold: float = 0.75, dimension: int = DIMENSION, cell_rows: int = CELL_ROWS,
                  block_rows: int = BLOCK_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """id, other, similarity: for each record its k most similar others at or above the threshold.

    Only the newest version of an id counts, and only with a usable vector; a null
    delivery time is older than any other, and of versions of one time one with the
    greatest fingerprint holds. Equal similarities (to six decimals) go to the smaller id. Records with equal vectors
    count as different records; each gets its own row set. Rows with a null id,
    null, short or zero vectors take no part; an empty input gives an empty result.
    Approximate: a partner is missed only if neither lies in a cell the other
    probes, or if its scored similarity falls below the calibrated cut. The rule is
    the same at every size: the first codebook has one word for `cell_rows` vectors,
    up to MOST_CELLS.
    """
    near = _similar(chunks, k, threshold, dimension, cell_rows, block_rows, task_rows)
    return near.select(_unpacked("id").alias("id"), _unpacked("other").alias("other"), "similarity")


def similar_edges(chunks: DataFrame, k: int = 5, threshold: float = 0.75, dimension: int = DIMENSION) -> DataFrame:
    """a, b: the pairs of `similar_pairs`, each once, the smaller id first."""
    near = _similar(chunks, k, threshold, dimension, CELL_ROWS, BLOCK_ROWS, TASK_ROWS)
    once = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    named = once.select(_unpacked("a").alias("a"), _unpacked("b").alias("b"))
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _similar(chunks: DataFrame, k: int, threshold: float, dimension: int, cell_rows: int, block_rows: int, task_rows: int) -> DataFrame:
    """`similar_pairs` with packed ids."""
    spark = chunks.sparkSession
    out_schema = "id binary, other binary, similarity double"
    # newest version of each id over all rows, usable or not: narrow rows only
    at = F.coalesce(F.col("ingested_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at")
    every = chunks.select(canonical_id("id").alias("id"), at).filter(F.col("id").isNotNull())
    latest = every.groupBy("id").agg(F.max("at").alias("newest"), F.count("*").alias("n"))
    repeated = cut_lineage(latest.filter("n > 1").select("id", "newest"))
    usable = usable_vectors(chunks.withColumn("ingested_at", at), dimension=dimension)
    fresh = usable.join(_sided(repeated), "id", "left").filter(F.col("newest").isNull() | (F.col("at") == F.col("newest")))
    marked = fresh.select(_packed("id").alias("id"), "vector", *_fingerprint())
    prints = F.struct("h1", "h2")
    narrow = cut_lineage(marked.groupBy("id").agg(F.max(prints).alias("p"), (F.max(prints) != F.min(prints)).alias("tied")))
    tied = cut_lineage(narrow.filter("tied").select("id", F.col("p.h1").alias("k1"), F.col("p.h2").alias("k2")))
    if not tied.isEmpty():
        marked = marked.join(_sided(tied), "id", "left").filter(F.col("k1").isNull() | (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).drop("k1", "k2")
    narrow = narrow.select("id", "p.h1", "p.h2")
    n_vectors = narrow.count()
    if n_vectors < 2:
        return spark.createDataFrame([], out_schema)
    groups = narrow.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n_equal"))
    equal = cut_lineage(groups.filter("n_equal > 1"))
    copies = cut_lineage(narrow.join(_sided(equal.select("h1", "h2", "first_id")), ["h1", "h2"]).select("first_id", "id"))
    redundant = copies.filter("id <> first_id").select("id")

    cells = min(MOST_CELLS, max(2, n_vectors // cell_rows))
    sample_rows = max(LEAST_SAMPLE, SAMPLE_PER_CELL * cells)
    rate = min(1.0, sample_rows / n_vectors)
    drawn = usable.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))).select("id", "vector")
    model, share = _fitted(drawn, dimension, threshold, k, cells) or _fitted(
        usable.select("id", "vector").limit(LEAST_SAMPLE), dimension, threshold, k, cells)
    shared = spark.sparkContext.broadcast((model.books, model.cut, model.joined))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Quantizer(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _floats(batch.column("vector"), dimension).astype(np.float64)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            half = x.astype(np.float16)
            for at in range(0, len(x), ENCODE_ROWS):
                part = slice(at, at + ENCODE_ROWS)
                codes, norms, cells = model.encode(x[part])
                n, probes = cells.shape
                # a probe whose codeword shares a cell with an earlier one asks nothing new
                new = np.stack([~(cells[:, :i] == cells[:, i:i + 1]).any(1) for i in range(probes)], axis=1)
                row, probe = np.nonzero(new)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, n).take(rows),
                        pa.array(cells[row, probe]),
                        pa.array(probe > 0),
                        pa.array([r.tobytes() for r in half[part]], pa.binary()).take(rows),
                        pa.array([r.tobytes() for r in codes], pa.binary()).take(rows),
                        pa.array(norms[row]),
                    ],
                    names=["id", "cell", "is_probe", "vector", "code", "norm"],
                )

    encoded = (
        marked.join(_sided(redundant), "id", "left_anti").select("id", "vector")
        .mapInArrow(encode, "id binary, cell long, is_probe boolean, vector binary, code binary, norm float")
    )
    # Cells expected to be too large for one task: their stored vectors go to blocks by a hash, their
    # queries to every block. The sample's estimate only balances the load, results do not depend on it.
    share = share * n_vectors
    large = {int(c): int(-(-share[c] // block_rows)) for c in np.flatnonzero(share > block_rows)}
    if large:
        blocks = F.coalesce(F.create_map(*[F.lit(x) for c, b in large.items() for x in (int(c), int(b))])[F.col("cell")], F.lit(1))
        with_blocks = encoded.withColumn("blocks", blocks)
        stored = with_blocks.filter("NOT is_probe").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        asking = with_blocks.filter("is_probe OR blocks > 1").withColumn("is_probe", F.lit(True)).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        placed = stored.withColumn("alone", F.col("blocks") > 1).unionByName(asking.withColumn("alone", F.lit(True))).drop("blocks")
    else:
        placed = encoded.withColumn("block", F.lit(0)).withColumn("alone", F.lit(False))
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_vectors * (1 + EXTRA_PROBES) // task_rows))
    sorted_cells = placed.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "is_probe")
    found = sorted_cells.mapInArrow(_search(shared, dimension, k, threshold), "id binary, other binary, similarity double")
    return _top(found, k) if equal.isEmpty() else _top_with_copies(found, copies, k)


def _search(shared, dimension: int, k: int, threshold: float):
    """Search of sorted partitions: per (cell, block) first the stored vectors, then the queries, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Quantizer(*shared.value)
        base: list[tuple] = []
        ready: tuple | None = None
        current: tuple | None = None
        asks_itself = True
        # of the current cell: ids, the stored ones first, and pairs of numbers of ids with their similarity
        names: list[np.ndarray] = []
        pairs: list[tuple] = []

        def unpack(batch: pa.RecordBatch) -> tuple:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float16).reshape(n, dimension).astype(np.float32)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(n, -1)
            return np.array(batch.column("id").to_pylist(), dtype=object), x, codes, batch.column("norm").to_numpy()

        def compare(ids, x, stored) -> Iterator[pa.RecordBatch]:
            s_ids, s_x, s_codes, s_norms = stored
            # the best similarities of each stored vector so far, one more than k as it may meet itself
            top = None
            for at in range(0, len(ids), 256):
                q = x[at:at + 256]
                near = model.scores(model.tables(q), s_codes, s_norms) >= model.cut
                columns = np.flatnonzero(near.any(axis=0))
                if not len(columns):
                    continue
                exact = q @ s_x[columns].T
                exact[~near[:, columns]] = -2.0
                close = exact >= threshold - 1e-4
                if top is not None or np.count_nonzero(close) > DENSE_ROWS:
                    # where most pairs are close, only those go on that can be among the k best of either side, ties included
                    top = np.full((len(s_ids), k + 1), -2.0, np.float32) if top is None else top
                    seen = np.concatenate([top[columns], exact.T], axis=1)
                    top[columns] = np.partition(seen, seen.shape[1] - k - 1, axis=1)[:, -k - 1:]
                    own = np.partition(exact, -min(k + 1, len(columns)), axis=1)[:, -min(k + 1, len(columns))]
                    close &= (exact >= own[:, None] - 1e-5) | (exact >= top[columns].min(axis=1)[None] - 1e-5)
                rows, cols = np.nonzero(close)
                values, cols = exact[rows, cols], columns[cols]
                values = np.round(values.astype(np.float64), 6)
                keep = values >= threshold
                keep &= ids[at:at + 256][rows] != s_ids[cols]
                left, right, values = rows[keep], cols[keep], values[keep]
                if len(left):
                    if not names:
                        names.append(s_ids)
                    left += at if ids is s_ids else sum(map(len, names))
                    if ids is not s_ids:
                        names.append(ids[at:at + 256])
                    pairs.extend([(left, right, values), (right, left, values)])
                    if sum(len(p[0]) for p in pairs) > PENDING_PAIRS:
                        yield from settle()

        def settle() -> Iterator[pa.RecordBatch]:
            if pairs:
                yield _best(np.concatenate(names), *(np.concatenate(p) for p in zip(*pairs)), k)
            names.clear()
            pairs.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if base:
                ready = tuple(np.concatenate(p) for p in zip(*base))
                base.clear()
                if asks_itself:
                    yield from compare(ready[0], ready[1], ready)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
            probe = batch.column("is_probe").to_numpy(zero_copy_only=False)
            alone = batch.column("alone").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(probe.astype(np.int8)) != 0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                where = (int(cell[a]), int(block[a]))
                if where != current:
                    yield from flush()
                    yield from settle()
                    current, ready = where, None
                data = unpack(batch.slice(a, b - a))
                if not probe[a]:
                    asks_itself = not alone[a]
                    base.append(data)
                    continue
                yield from flush()
                if ready is not None:
                    yield from compare(data[0], data[1], ready)
        yield from flush()
        yield from settle()

    return run


def _best(names: np.ndarray, left: np.ndarray, right: np.ndarray, values: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best partners of each left id among these rows of numbers of names, ties to the smaller id."""
    used, numbers = np.unique(np.concatenate([left, right]), return_inverse=True)
    order = np.argsort(names[used], kind="stable")
    ids = names[used][order]
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    ids, (left, right) = ids[new], np.split(place[numbers], 2)
    # a pair met twice counts once, with its greater similarity
    order = np.lexsort((-values, right, left))
    left, right, values = left[order], right[order], values[order]
    first = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    left, right, values = left[first], right[first], values[first]
    order = np.lexsort((right, -values, left))
    left, right, values = left[order], right[order], values[order]
    begins = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    keep = np.arange(len(left)) - np.repeat(begins, np.diff([*begins, len(left)])) < k
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[left[keep]].tolist(), pa.binary()), pa.array(ids[right[keep]].tolist(), pa.binary()), pa.array(values[keep])],
        names=["id", "other", "similarity"])


def _ranked(pairs: DataFrame, most: int) -> DataFrame:
    """The best partners of each id with their _rank from 1."""
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return pairs.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best partners of each id. Rows are sent once, by id; a pair found in two cells counts once."""
    once = pairs.repartition("id").groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    return _ranked(once, k).drop("_rank")


def _top_with_copies(found: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """As `_top`, and copies of a vector get their representative's partners, and each other.

    Only the k + 1 smallest ids of a group can be among anyone's k best, so a group
    of n copies adds at most n * k rows of its own. A representative found with itself
    stands for the copies as partners of each other. Where copies are few enough to be
    broadcast, all of this happens where the pairs of an id were gathered.
    """
    w = Window.partitionBy("first_id").orderBy("id")
    first = cut_lineage(copies.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= k + 1).select(
        F.col("first_id").alias("of"), F.col("id").alias("copy")))
    itself = first.filter("of = copy").select(F.col("of").alias("id"), F.col("of").alias("other"), F.lit(1.0).alias("similarity"))
    best = _top(found.unionByName(itself), k + 1)
    # a partner with copies stands for its smallest ids
    partners = best.join(_sided(first), F.col("other") == F.col("of"), "left").select(
        "id", F.coalesce("copy", "other").alias("other"), "similarity", (F.col("id") == F.col("other")).alias("own"))
    # of k + 1 partners a copy leaves itself out, if it is among them, or else the last
    own = F.collect_list(F.when(F.col("own"), F.col("other"))).over(Window.partitionBy("id"))
    listed = _ranked(partners, k + 1).withColumn("own", own)
    members = copies.select(F.col("first_id").alias("of"), F.col("id").alias("member"))
    asked = listed.join(_sided(members), F.col("id") == F.col("of"), "left").filter(
        F.when(F.col("member").isNull(), F.col("_rank") <= k).otherwise(
            (F.col("other") != F.col("member")) & ((F.col("_rank") <= k) | F.array_contains("own", F.col("member")))))
    return asked.select(F.coalesce("member", "id").alias("id"), "other", "similarity")
