"""Product codes of vectors in whole numbers.

Every part of a vector is coded by the nearest entry of that part's codebook.  Means and
residual norms of ever finer blocks bound distances from below, so that only entries which
may still be the nearest get an exact distance.  A round of learning sums the parts of
each entry in the tasks; only these sums, a fixed number of them, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sorted_side, stored

#: Whole components are held within this; an error ends at a long's largest value.
EDGE, LONGEST = 2**62, 2**63 - 1
#: Components of whole vectors that a worker looks at together.
SLICE = 1 << 20
#: So many different labels are broadcast at most; more are joined by a shuffle.
LABELS = 20_000


def _blocks(width: int) -> list[np.ndarray]:
    """Where blocks begin, from one block to blocks of two components."""
    out, count = [], 1
    while width and (count == 1 or count <= width // 2):
        out.append(np.arange(count) * width // count)
        count *= 2
    return out


def _sketch(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row and block its mean and the norm of what is left without it; sizes."""
    size = np.diff(np.r_[begin, x.shape[1]])
    mean = np.add.reduceat(x, begin, 1) / size
    rest = x - np.repeat(mean, size, 1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, begin, 1)), size


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the nearest entry of ``book`` (ties: the lower index), its
    squared distance, and the number of exact distances that were needed.

    Both hold whole numbers, as int64 of at most 2**26 or as Python's.  The bounds are
    computed in floats and lowered by more than their rounding errors; a row's first
    exact distance, to the entry of the lowest coarse bound, is what others must beat.
    """
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, x.dtype), 0
    xf, bf = x.astype(np.float64), book.astype(np.float64)
    slack = 1e-9 * ((xf * xf).sum(1)[:, None] + (bf * bf).sum(1)[None, :]) + 1e-6
    exact = lambda i, j: ((x[i] - book[j]) ** 2).sum(1)
    best, code, alive, asked = None, None, None, n
    for begin in _blocks(width):
        (mx, rx, size), (mb, rb, _) = _sketch(xf, begin), _sketch(bf, begin)
        if alive is None:
            low = (size * (mx[:, None] - mb[None]) ** 2 + (rx[:, None] - rb[None]) ** 2).sum(2) - slack
            code = low.argmin(1)
            best = exact(np.arange(n), code)
            alive = low <= best.astype(np.float64)[:, None] * (1 + 1e-12)
            alive[np.arange(n), code] = False
        else:
            i, j = np.nonzero(alive)
            low = (size * (mx[i] - mb[j]) ** 2 + (rx[i] - rb[j]) ** 2).sum(1) - slack[i, j]
            far = low > best[i].astype(np.float64) * (1 + 1e-12)
            alive[i[far], j[far]] = False
    # survivors, entry by entry in ascending order; of equal ones the lower index stays
    for j in range(len(book)):
        i = np.flatnonzero(alive[:, j])
        asked += len(i)
        d = exact(i, np.full(len(i), j))
        wins = (d < best[i]) | ((d == best[i]) & (j < code[i]))
        best[i[wins]], code[i[wins]] = d[wins], j
    return code, best, asked


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles: int64 while all are small, else Python's integers
    held within ``EDGE``."""
    scaled = np.floor(values * scale)
    if not len(values) or np.abs(scaled).max() < 2**26:
        return scaled.astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2**40 else int(v) * scale for v in values.tolist()]
    return np.array([min(max(v, -EDGE), EDGE) for v in exact], object)


def _parts_of(column: pa.Array, width: int, parts: int, scale: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices of a list column: where each begins, its rows, and its whole components as
    (rows, parts, width); shorter vectors have zeros behind."""
    step = max(1, SLICE // max(1, width * parts))
    for a in range(0, len(column), step):
        piece = column.slice(a, step)
        size = np.diff(piece.offsets.to_numpy())
        flat = piece.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out = np.zeros((len(piece), width * parts))
        out[np.arange(width * parts)[None, :] < size[:, None]] = flat
        yield a, len(piece), whole(out.ravel(), scale).reshape(len(piece), parts, width)


def _matching(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if both are small, else both as Python's integers."""
    small = x.dtype != object and all(abs(v) < 2**26 for v in book.ravel().tolist())
    return (x, book.astype(np.int64)) if small else (x.astype(object), book)


def _first_books(rows: DataFrame, entries: int, parts: int, width: int, scale: int) -> np.ndarray:
    """(parts, entries, width) from the vectors of the smallest ids."""
    ids: list = []
    while len(ids) < entries:
        more = rows.where(F.col("vec_id").isNotNull() if not ids else F.col("vec_id") > F.lit(ids[-1]))
        got = sorted({r.vec_id for r in more.select("vec_id").orderBy("vec_id").limit(entries).collect()})
        if not got:
            break
        ids = (ids + got)[:entries]
    first = dict(rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vec").alias("vec")).collect()) if ids else {}
    out = np.zeros((parts, len(ids), width), object)
    for k, i in enumerate(ids):
        column = pa.array([first[i]], pa.list_(pa.float64()))
        out[:, k] = next(_parts_of(column, width, parts, scale))[2][0].astype(object)
    return out


def _round(rows: DataFrame, books: np.ndarray, parts: int, width: int, scale: int) -> np.ndarray:
    """The codebooks after one round: sums and counts come from the tasks, one row for
    each of the ``parts * entries * (width + 1)`` numbers and task."""
    entries = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), object)
        for b in batches:
            for _, _, x in _parts_of(b.column(0), width, parts, scale):
                for p in range(parts):
                    part, book = _matching(x[:, p], books[p])
                    code = nearest(part, book)[0]
                    order = np.argsort(code, kind="stable")
                    used, begin, count = np.unique(code[order], return_index=True, return_counts=True)
                    if width:
                        total[p, used, :width] += np.add.reduceat(part[order], begin, 0).astype(object)
                    total[p, used, width] += count.astype(object)
        flat = total.ravel().tolist()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([Decimal(v) for v in flat], pa.decimal128(38, 0))], ["slot", "total"])

    got = rows.select("vec").mapInArrow(run, "slot int, total decimal(38,0)").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    out = books.copy()
    total = np.zeros(parts * entries * (width + 1), object)
    for r in got:
        total[r.slot] = int(r.total)
    total = total.reshape(parts, entries, width + 1)
    for p, e in np.ndindex(parts, entries):
        if n := total[p, e, width]:
            out[p, e] = [s // n for s in total[p, e, :width]]
    return out


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks (parts, entries, width) for ``rows`` (vec_id, vec) without bad vectors.
    A round that changes nothing ends the learning, as all later ones would too."""
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    width = -(-longest // parts)
    books = _first_books(rows, entries, parts, width, scale)
    for _ in range(rounds if books.shape[1] else 0):
        before, books = books, _round(rows, books, parts, width, scale)
        if (before == books).all():
            break
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every row whose vector is
    not null and has finite components only.

    Components become ``floor(scale * x)``, held within 2**62.  A codebook begins with the
    parts of the ``entries`` smallest different ids (fewer rows: fewer entries); of rows
    with one id the smallest vector counts.  ``code`` has two hex digits a part; ``error``
    is the sum of the squared distances and ``label_error`` its sum over equal labels,
    null ones together; both end at the largest long.  A row with a null id is coded, and
    starts no entry; where all ids are null, code and errors are null.  Rows repeat as
    they are.  Vectors that are shorter than the longest, or than a multiple of ``parts``,
    have zeros behind.  Other columns, whatever their names, play no part.  Empty table:
    empty result.
    """
    rows = pick(vectors, vec_id=id_col, vec=vec_col, label=label_col).withColumn("vec", F.col("vec").cast("array<double>"))
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))
    rows = stored(rows.where(F.col("vec").isNotNull() & F.forall("vec", finite)), "vectors")
    books = codebooks(rows.select("vec_id", "vec"), parts, entries, rounds, scale)
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, n, x in _parts_of(b.column(1), width, parts, scale):
                codes, errors = [None] * n, [None] * n
                if books.shape[1]:
                    found = [nearest(*_matching(x[:, p], books[p]))[:2] for p in range(parts)]
                    codes = [bytes(c).hex() for c in np.stack([c for c, _ in found], 1).astype(np.uint8)]
                    errors = [min(sum(e), LONGEST) for e in zip(*(d.tolist() for _, d in found), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), b.column(2).slice(a, n), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = stored(rows.select("vec_id", "vec", "label").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    whole_sum, most = F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")
    total = F.when(whole_sum > most, most).otherwise(whole_sum).cast("long")
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    side = F.broadcast(sums) if sums.count() <= LABELS else sorted_side(sums)
    out = coded.join(side, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The DuckDB twin for vectors of one length that is a multiple of ``parts``, with
    different ids: every distance is computed."""
    distance = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.c[i]) * (v.x[i] - b.c[i])))"
    near = lambda k: f"SELECT v.id, v.p, v.x, arg_min(b.e, {distance} * {entries} + b.e) AS e, min({distance}) AS d FROM cut v JOIN book{k} b ON v.p = b.p GROUP BY v.id, v.p, v.x"
    steps = []
    for k in range(rounds):
        steps.append(f"near{k} AS MATERIALIZED ({near(k)})")
        steps.append(f"""sums{k} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS i) GROUP BY p, e, i)""")
        steps.append(f"""mean{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sums{k} GROUP BY p, e)""")
        steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)""")
    return f"""
        WITH kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda y: CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        cut AS MATERIALIZED (SELECT id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
        book0 AS (SELECT c.p, f.e, c.x AS c FROM cut c JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM kept QUALIFY e < {entries}) f ON c.id = f.id),
        {", ".join(steps)},
        last AS ({near(rounds)}),
        coded AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY id),
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
        SELECT k.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept k JOIN coded USING (id), digest"""
