"""Vector features and statistics over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators.order import running
from matchloom.storage import written

FLOOR, SCALE = 1e-10, 0.01
#: Left tokens that are multiplied at once.
BLOCK = 4096
#: Tokens of a block of documents, of right documents that are multiplied at once, and pairs that wait for it.
BLOCK_TOKENS, TOKEN_BUDGET, PAIRS_AT_ONCE = 65_536, 32_768, 1024
#: Queries (as many as reference rows at most, where there are many) and reference rows that meet in one piece of work.
QUERY_ROWS, REFERENCE_ROWS = 1024, 8192
#: Queries of a matrix product, its error as a share of the squared lengths (with much to spare), and errors from zero up to which a root needs the exact value.
QUERIES_AT_ONCE, SLACK, CLOSE = 64, 1e-11, 1e6
STATISTICS = ("mean", "std", "min", "q25", "median", "q75", "max")


def kernels() -> list[tuple[float, float]]:
    """(mean, width): an exact-match kernel and ten evenly spaced soft ones."""
    return [(1.0, 0.001), *(((9 - 2 * i) / 10, 0.1) for i in range(10))]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def chunk_spans(lengths: DataFrame, capacity: int, overlap: int) -> DataFrame:
    """(id, chunk, start, stop) of overlapping spans over n tokens."""
    step = capacity - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n") - capacity) / step)).cast("int"))
    out = lengths.where("n > 0").select("id", "n", F.explode(starts).alias("chunk")).withColumn("start", F.col("chunk") * step)
    return out.select("id", "chunk", "start", F.least(F.col("start") + capacity, F.col("n")).cast("int").alias("stop"))


def mean_pool(chunks: DataFrame) -> DataFrame:
    """(id, dim, value): means of (id, vec) by dimension, scaled to length one; a zero mean is an error."""
    means = chunks.select("id", F.posexplode("vec").alias("dim", "x")).groupBy("id", "dim").agg(F.avg("x").alias("m"))
    length = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("id")))
    return means.withColumn("length", length).select("id", "dim", F.when(F.col("length") > 0, F.col("m") / F.col("length")).otherwise(F.raise_error(F.lit("a mean vector is zero")).cast("double")).alias("value"))


def documents(tokens: DataFrame) -> DataFrame:
    """(grp, n, flat) of token rows (grp, pos, vec): the vectors of a document end to end, in order, as 32-bit floats."""
    listed = tokens.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("vec").cast("array<float>").alias("vec")))).alias("rows"))
    return listed.select("grp", F.size("rows").alias("n"), F.flatten(F.transform("rows", lambda r: r["vec"])).alias("flat"))


def token_batches(sizes: list[int], budget: int) -> Iterator[slice]:
    """Runs of documents whose tokens stay within the budget; a document over it is a run by itself."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > budget:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def dealt(pairs: DataFrame, left: DataFrame, right: DataFrame, block_tokens: int) -> DataFrame:
    """Rows of the work on `pairs` (l, r): for each cell of a block of left and a block of right documents (grp, n, flat)
    the documents that have a pair in it, and its pairs.

    Documents are dealt to blocks of about `block_tokens` tokens by hash. A matrix is sent once for each cell in which it has pairs,
    so at most once for each block of the other side, however many pairs it is in; the pairs of a hot document are
    spread over its cells. Rows have `part` 0 (left document), 1 (right document) or 2 (pair). A pair without one of its
    documents is an error.
    """
    blocks = [max(1, -(-(t.agg(F.sum("n")).first()[0] or 0) // block_tokens)) for t in (left, right)]
    places = [F.pmod(F.xxhash64(k), F.lit(n)).cast("int").alias(f"{k}_block") for k, n in zip("lr", blocks, strict=True)]
    cells = written(pairs.select("l", "r", *places), "pair-cells")
    none = {k: F.lit(None).cast(pairs.schema[k].dataType).alias(k) for k in "lr"}
    parts = []
    for i, (k, docs) in enumerate((("l", left), ("r", right))):
        need = cells.select("l_block", "r_block", k).distinct().join(docs.withColumnRenamed("grp", k), k, "left")
        error = F.raise_error(F.concat(F.lit("a document has no vectors: "), F.col(k).cast("string"))).cast("int")
        keys = [F.col(k), none["r"]] if k == "l" else [none["l"], F.col(k)]
        parts.append(need.select("l_block", "r_block", F.lit(i).alias("part"), *keys, F.when(F.col("n").isNull(), error).otherwise(F.col("n")).alias("n"), "flat"))
    parts.append(cells.select("l_block", "r_block", F.lit(2).alias("part"), "l", "r", F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<float>").alias("flat")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def soft_counts(a: np.ndarray, b: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """(tokens of b x kernels): how often each token of b is met in a, softly; `a` is taken in parts of BLOCK tokens."""
    soft = np.zeros((len(b), len(bank)))
    for lo in range(0, len(a), BLOCK):
        sims = a[lo : lo + BLOCK].astype(np.float64) @ b.T
        for j, (mean, width) in enumerate(bank):
            soft[:, j] += np.exp(-((sims - mean) ** 2) / (2 * width * width)).sum(axis=0)
    return soft


def pooled(pairs: DataFrame, left: DataFrame, right: DataFrame, pool: Callable[[np.ndarray, int], np.ndarray], name: str, block_tokens: int = BLOCK_TOKENS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(l, r, name, value) of what `pool` makes of the soft counts (right tokens x kernels) and the left length of each pair.

    Pairs are worked off in cells of blocks (see dealt()). A task holds the two blocks of a cell; its pairs are read in the order of
    the left document, whose right ones are multiplied together as long as their tokens stay within `budget`.
    """
    bank = np.array(kernels())
    sides = [written(documents(t), "token-documents") for t in (left, right)]
    work = dealt(pairs, *sides, block_tokens).repartition("l_block", "r_block").sortWithinPartitions("l_block", "r_block", "part", "l", "r")

    def products(l, rights: list, held: tuple[dict, dict]) -> Iterator[tuple]:
        a = held[0][l]
        for run in token_batches([len(held[1][r]) for r in rights], budget):
            ends = np.cumsum([len(held[1][r]) for r in rights[run]])
            soft = soft_counts(a, np.concatenate([held[1][r] for r in rights[run]]), bank)
            for r, own in zip(rights[run], np.split(soft, ends[:-1]), strict=True):
                yield l, r, pool(own, len(a)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, at, rights, kinds = None, ({}, {}), None, [], None
        for batch in batches:
            out: list[tuple] = []
            kinds = [batch.schema.field(k).type for k in "lr"]
            flat = batch.column("flat")
            keys = zip(*(batch.column(c).to_pylist() for c in ("l_block", "r_block", "part", "l", "r", "n")), strict=True)
            for i, (lb, rb, part, l, r, n) in enumerate(keys):
                if part != 2 or l != at or (lb, rb) != cell or len(rights) == PAIRS_AT_ONCE:
                    out.extend(products(at, rights, held) if rights else ())
                    at, rights = l, []
                if (lb, rb) != cell:
                    cell, held = (lb, rb), ({}, {})
                if part == 2:
                    rights.append(r)
                else:
                    held[part][r if part else l] = flat[i].values.to_numpy(zero_copy_only=False).reshape(n, -1)
            if out:
                yield _values(out, kinds)
        if rights:
            yield _values(list(products(at, rights, held)), kinds)

    types = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("l", "r"))
    return work.mapInArrow(run, f"{types}, values array<double>").select("l", "r", F.posexplode("values").alias(name, "value"))


def _values(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*kinds, pa.list_(pa.float64())], strict=True)], names=["l", "r", "values"])


def knrm(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, kernel, value): sum over right tokens of log soft counts, scaled."""
    return pooled(pairs, left, right, lambda soft, n: np.log(np.maximum(soft, FLOOR)).sum(axis=0) * SCALE, "kernel")


def _distribution(soft: np.ndarray, n: int) -> np.ndarray:
    x = np.log(np.maximum(soft / n, FLOOR)) * SCALE
    return np.stack([x.mean(axis=0), x.std(axis=0), x.min(axis=0), *np.quantile(x, [0.25, 0.5, 0.75], axis=0), x.max(axis=0)], axis=1).ravel()


def row_distribution(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, feature, value): seven statistics over right tokens of each kernel's log mean soft count; feature = 7 kernel + statistic."""
    return pooled(pairs, left, right, _distribution, "feature")


def pair_delta(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(l, r, vec) of pairs (l, r): the left vector less the right one; a pair without one of them is an error."""
    sides = [vectors.select(F.col("vec_id").alias(k), F.col("vec").alias(f"{k}_vec")) for k in ("l", "r")]
    out = pairs.join(sides[0], "l", "left").join(sides[1], "r", "left")
    error = F.raise_error(F.lit("a pair has no vector")).cast("array<double>")
    delta = F.when(F.col("l_vec").isNull() | F.col("r_vec").isNull(), error).otherwise(F.zip_with("l_vec", "r_vec", lambda x, y: x - y))
    return out.select("l", "r", delta.alias("vec"))


def encoded(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """Adds vec: what an encoder, made once in each worker, makes of the texts of a batch."""
    schema = T.StructType([*docs.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            if batch.num_rows:
                vectors = encode([t or "" for t in batch.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64()))], names=[*batch.schema.names, "vec"])

    return docs.mapInArrow(run, schema)


def fitted_spans(docs: DataFrame, measure: Callable[[list[str]], int], capacity: int, overlap: int) -> DataFrame:
    """(id, chunk, start, stop) of rows (id, tokens): overlapping spans, each shortened until what `measure` says of it fits the capacity."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, tokens in zip(batch.column("id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                start, chunk = 0, 0
                while start < len(tokens or ()):
                    stop = min(start + capacity, len(tokens))
                    while stop > start + 1 and measure(tokens[start:stop]) > capacity:
                        stop -= 1
                    if measure(tokens[start:stop]) > capacity:
                        raise ValueError("a single token doesn't fit the capacity")
                    out.append((i, chunk, start, stop))
                    if stop == len(tokens):
                        break
                    if stop - overlap <= start:
                        raise ValueError("the overlap leaves no progress")
                    start, chunk = stop - overlap, chunk + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [batch.schema.field("id").type, *[pa.int32()] * 3], strict=True)], names=["id", "chunk", "start", "stop"])

    return docs.select("id", "tokens").mapInArrow(run, f"id {kind}, chunk int, start int, stop int")


def long(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "label", F.posexplode("vec").alias("dim", "x"))


def standardised(vectors: DataFrame, train: Column) -> DataFrame:
    """(vec_id, dim, z) with means and population deviations of the training rows; constants are left unscaled."""
    rows = long(vectors).withColumn("train", train)
    stats = rows.where("train").groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return rows.join(F.broadcast(stats), "dim").select("vec_id", "dim", ((F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))


def eta_squared(vectors: DataFrame) -> DataFrame:
    """(dim, eta2): between-class share of each feature's variation; sums of moments only, one pass."""
    per = long(vectors).groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    g = per.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    centre = F.col("s") * F.col("s") / F.col("n")
    total = F.col("ss") - centre
    return g.select("dim", F.when(total > 0, (F.col("between") - centre) / total).otherwise(0.0).alias("eta2"))


COMOMENTS = "i int, n long, mean array<double>, row array<double>"


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means and co-moments of all vectors of a task: a row for each row of the matrix."""
    n, mean, total = 0, None, None
    for batch in batches:
        if batch.num_rows:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            m = x.mean(axis=0)
            own = (x - m).T @ (x - m)
            if n:
                d = m - mean
                total += own + np.outer(d, d) * (n * len(x) / (n + len(x)))
                mean = mean + d * (len(x) / (n + len(x)))
            else:
                mean, total = m, own
            n += len(x)
    if n:
        size, kind = len(mean), pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array([n] * size), pa.array([mean.tolist()] * size, kind), pa.array(total.tolist(), kind)], names=["i", "n", "mean", "row"])


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of the matrix from those of several tasks."""
    i, n = int(rows["i"].iloc[0]), rows["n"].to_numpy()
    means = np.stack(rows["mean"].to_numpy())
    mean = n @ means / n.sum()
    d = means - mean
    row = np.stack(rows["row"].to_numpy()).sum(axis=0) + (n * d[:, i]) @ d
    return pd.DataFrame({"i": [i], "n": [n.sum()], "mean": [mean.tolist()], "row": [row.tolist()]})


def comoments(vectors: DataFrame, parts: int = 64) -> DataFrame:
    """(i, n, mean, row) for each feature i: number of vectors, means of all features, and sums of products of deviations.

    Each task makes a matrix of its own (d x d numbers, whatever its rows); these are merged by feature, first in `parts` parts
    and then those, each by means and deviations so that nothing cancels. What is shuffled are tasks x d rows.
    """
    dealt_out = vectors.select(F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_products, COMOMENTS).withColumn("part", F.spark_partition_id() % parts)
    first = dealt_out.groupBy("part", "i").applyInPandas(_merged, COMOMENTS)
    return first.groupBy("i").applyInPandas(_merged, COMOMENTS)


def moments(vectors: DataFrame) -> DataFrame:
    """(i, j, r): Pearson correlations of all features with i <= j; 0 with a feature that is constant."""
    found = written(comoments(vectors), "comoments")
    spread = found.select(F.col("i").alias("j"), F.col("row")[F.col("i")].alias("vj"))  # a row for each feature
    own = found.select("i", F.col("row")[F.col("i")].alias("vi"), F.posexplode("row").alias("j", "c")).where("i <= j")
    r = F.when((F.col("vi") > 0) & (F.col("vj") > 0), F.col("c") / F.sqrt(F.col("vi") * F.col("vj"))).otherwise(0.0)
    return own.join(F.broadcast(spread), "j").select("i", "j", r.alias("r"))


def effective_dimension(vectors: DataFrame) -> DataFrame:
    """d^2 over the squared Frobenius norm of the correlation matrix, which is (sum of eigenvalues)^2 over their squares' sum."""
    m = moments(vectors)
    size = F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(0))
    frobenius = F.sum(F.when(F.col("i") == F.col("j"), F.col("r") * F.col("r")).otherwise(2 * F.col("r") * F.col("r")))
    return m.agg((size * size / frobenius).alias("effective_dimension"))


def mid_ranks(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Average ranks of `value` within `key`: distinct values are counted first, and counts run within cells of the values."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    ranked = running(counts, [key], value, ["c"]).select(key, value, (F.col("c_upto") - F.col("c") + (F.col("c") + 1) / 2).alias(name))
    return rows.join(ranked, [key, value])


def spearman(vectors: DataFrame, other: Column) -> DataFrame:
    """(dim, rho): rank correlation of each feature with another value of the row."""
    rows = long(vectors.withColumn("vec", F.col("vec"))).join(vectors.select("vec_id", other.alias("o")), "vec_id")
    ranked = mid_ranks(mid_ranks(rows, "dim", "x", "rx"), "dim", "o", "ro")
    return ranked.groupBy("dim").agg(F.corr("rx", "ro").alias("rho"))


def length_residuals(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, residual) of x on one length, from sums by feature."""
    n, x, y = F.count(F.lit(1)), F.col("len"), F.col("x")
    fit = rows.groupBy("dim").agg((F.covar_pop("x", "len") / F.var_pop("len")).alias("slope"), F.avg("x").alias("mx"), F.avg("len").alias("ml"), n.alias("n"))
    return rows.join(F.broadcast(fit), "dim").select("vec_id", "dim", (y - F.col("mx") - F.col("slope") * (x - F.col("ml"))).alias("residual"))


class Distances:
    """Squared distances of one query from rows `y`: `about`, right within `slack`, and exact ones for the places asked for.

    `about` comes from matrix products for many queries at once; the query's own row is infinitely far.
    """

    def __init__(self, y: np.ndarray, x: np.ndarray, about: np.ndarray, slack: float, own: np.ndarray):
        self.y, self.x, self.about, self.slack = y, x, about, slack
        self.about[own] = np.inf
        self.others = np.delete(np.arange(len(y)), own)

    def exact(self, at: np.ndarray) -> np.ndarray:
        return ((self.y[at] - self.x) ** 2).sum(axis=1)

    def nearest(self, k: int) -> np.ndarray:
        """Places of rows that hold the k nearest and all that are as near."""
        if len(self.others) <= k:
            return self.others
        last = np.partition(self.about, k - 1)[k - 1]
        return np.flatnonzero(self.about <= last + 2 * self.slack) if np.isfinite(last) else self.others


def distances(x: np.ndarray, y: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray) -> Iterator[Distances]:
    """For each query of x; values that aren't finite or whose squares aren't are taken exactly from the start."""
    with np.errstate(over="ignore", invalid="ignore"):
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        plain = np.isfinite(yy).all()
        most = yy.max() if plain else np.inf
        for start in range(0, len(x), QUERIES_AT_ONCE):
            at = slice(start, start + QUERIES_AT_ONCE)
            about = yy - 2 * (x[at] @ y.T) + xx[at, None] if plain else None
            for j in range(len(x[at])):
                i = start + j
                good = plain and np.isfinite(xx[i] + most) and np.isfinite(2 * (xx[i] + most))
                row, slack = (about[j], SLACK * (xx[i] + most)) if good else (((y - x[i]) ** 2).sum(axis=1), 0.0)
                yield Distances(y, x[i], row, slack, np.flatnonzero(y_ids == x_ids[i]))


def met_in_cells(queries: DataFrame, reference: DataFrame, run: Callable[..., dict[str, np.ndarray]], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """What `run` makes of each query with each part of the reference: rows of the reference (vec_id, label), their Distances, and the query's `extra` columns. It gives columns; `at` are places of reference rows.

    Blocks hold QUERY_ROWS queries, or an eighth of them up to REFERENCE_ROWS, and parts about REFERENCE_ROWS rows, so that a piece of
    work is bounded and many queries don't have all rows sent to each thousand of them; each pair is met once. Nothing is broadcast.
    """
    n_queries, n_rows = queries.count(), reference.count()
    blocks = max(1, -(-n_queries // min(REFERENCE_ROWS, max(QUERY_ROWS, n_queries // 8))))
    parts = max(1, -(-n_rows // REFERENCE_ROWS))
    named = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  (new columns, as both sides may be one table)
    side = lambda t, own, n, other, m, *more: t.select(*named("vec_id", "vec", "label", *more), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    q, r = side(queries, "block", blocks, "part", parts, *extra), side(reference, "part", parts, "block", blocks)

    def meet(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        out = []
        if len(mine) and len(others):
            others = others.sort_values("vec_id")
            y, x = (np.stack(v["vec"].to_numpy()) for v in (others, mine))
            others = others[["vec_id", "label"]].reset_index(drop=True)
            met = distances(x, y, mine["vec_id"].to_numpy(), others["vec_id"].to_numpy())
            out = [run(others, d, *more) for d, *more in zip(met, *(mine[c] for c in extra), strict=True)]
        if not out:
            return pd.DataFrame(columns=names)
        rows = pd.DataFrame({c: np.concatenate([x[c] for x in out]) for c in out[0]})
        n = [len(next(iter(x.values()))) for x in out]
        if "at" in rows:
            rows = rows.assign(**{c: others[c].take(rows["at"]).reset_index(drop=True) for c in ("vec_id", "label")})
        return rows.assign(**{q: mine[c].repeat(n).reset_index(drop=True) for q, c in (("q", "vec_id"), ("q_label", "label"))})[names]

    return q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInPandas(meet, schema)


def neighbours(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(q, q_label, rank, vec_id, label): the k nearest of each query, ties by id; cut to k in parts of the reference first."""

    def nearest(others: pd.DataFrame, met: Distances) -> dict[str, np.ndarray]:
        at = met.nearest(k)
        d2 = met.exact(at)
        order = np.lexsort((at, d2))[:k]  # rows come by id
        return {"at": at[order], "d2": d2[order]}

    local = met_in_cells(queries, reference, nearest, "q long, q_label int, vec_id long, label int, d2 double")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("q", "q_label", "rank", "vec_id", "label")


def purity(found: DataFrame) -> DataFrame:
    """(q_label, n_queries, purity): mean share of neighbours with the query's label."""
    per = found.groupBy("q", "q_label").agg(F.avg((F.col("label") == F.col("q_label")).cast("double")).alias("share"))
    return per.groupBy("q_label").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("share").alias("purity"))


def composition(found: DataFrame) -> DataFrame:
    return found.groupBy("q_label", "label").agg(F.count(F.lit(1)).alias("n"))


def cosine_separation(vectors: DataFrame) -> DataFrame:
    """Mean cosine within classes, between them, and the difference, over all pairs of unit vectors.

    The sum of all dot products in a set is the squared length of its sum, so sums by class suffice and no pairs are made.
    """
    per = long(vectors).groupBy("label", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    classes = per.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.sum("ss").alias("own"), F.max("n").alias("n"))
    inside = classes.agg(F.sum((F.col("sq") - F.col("own")) / 2).alias("intra_sum"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("intra_n"), F.sum("own").alias("own"), F.sum("n").alias("n"))
    whole = per.groupBy("dim").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    t = inside.crossJoin(whole)
    intra = F.try_divide("intra_sum", "intra_n")
    inter = F.try_divide((F.col("sq") - F.col("own")) / 2 - F.col("intra_sum"), F.col("n") * (F.col("n") - 1) / 2 - F.col("intra_n"))
    return t.select(intra.alias("intra"), inter.alias("inter"), (intra - inter).alias("separation"))


def silhouette(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean silhouette of the query set against all rows, Euclidean; classes of one row count 0."""

    def by_class(others: pd.DataFrame, met: Distances) -> dict[str, np.ndarray]:
        at, d2 = met.others, met.about.copy()
        close = np.flatnonzero(d2 <= CLOSE * met.slack)  # few: a root enlarges what is lost near zero
        d2[close] = met.exact(close)
        at = at[others["label"].notna().to_numpy()[at]]
        labels, code = np.unique(others["label"].to_numpy()[at], return_inverse=True)
        return {"label": labels, "s": np.bincount(code, np.sqrt(d2[at]), len(labels)), "n": np.bincount(code, minlength=len(labels))}

    sums = met_in_cells(queries, reference, by_class, "q long, q_label int, label int, s double, n long")
    means = sums.groupBy("q", "q_label", "label").agg((F.sum("s") / F.sum("n")).alias("m"))
    per = means.groupBy("q", "q_label").agg(F.max(F.when(F.col("label") == F.col("q_label"), F.col("m"))).alias("a"), F.min(F.when(F.col("label") != F.col("q_label"), F.col("m"))).alias("b"))
    return per.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).alias("silhouette"))


#: What lengths do to a feature: constant, both lengths, and their logs.
REGRESSORS = 5


def residuals(rows: DataFrame, train: Column) -> DataFrame:
    """(id, dim, z): features (id, dim, x, len_l, len_r) less what a least-squares fit on the training rows explains by two lengths and their logs, standardised by training residuals.

    The cross products of the five regressors are summed in one pass for each feature; the driver only solves 5 x 5 systems.
    """
    names = ("len_l", "len_r")
    terms = [F.lit(1.0), *(F.col(n).cast("double") for n in names), *(F.log1p(F.col(n)) for n in names)]
    data = rows.withColumn("t", F.array(*terms)).withColumn("train", train)
    products = [F.sum(F.col("t")[i] * F.col("t")[j]).alias(f"p{i}{j}") for i in range(REGRESSORS) for j in range(i, REGRESSORS)]
    sums = data.where("train").groupBy("dim").agg(*products, *(F.sum(F.col("t")[i] * F.col("x")).alias(f"c{i}") for i in range(REGRESSORS)))
    fits = []
    for r in sums.collect():  # a row for each feature
        gram = np.array([[r[f"p{min(i, j)}{max(i, j)}"] for j in range(REGRESSORS)] for i in range(REGRESSORS)])
        unit = np.sqrt(np.diag(gram))
        solved = np.linalg.lstsq(gram / np.outer(unit, unit), np.array([r[f"c{i}"] for i in range(REGRESSORS)]) / unit, rcond=1e-12)[0] / unit
        fits.append((r.dim, solved.tolist()))
    fit = rows.sparkSession.createDataFrame(fits, f"dim {rows.schema['dim'].dataType.simpleString()}, beta array<double>")
    left = data.join(F.broadcast(fit), "dim").withColumn("e", F.col("x") - dot(F.col("t"), F.col("beta")))
    spread = left.where("train").groupBy("dim").agg(F.avg("e").alias("m"), F.stddev_pop("e").alias("s"))
    return left.join(F.broadcast(spread), "dim").select("id", "dim", ((F.col("e") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))
