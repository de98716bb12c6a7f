"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance is never formed. All that is asked of the vectors is its product with a few columns, a distributed sum of
C^T (C Q) / n over the centred rows C; a task sends the sum of its rows once. On the driver stand only matrices of one row
per dimension: the search space, its image and the eigenvectors already locked. Each round takes the Ritz pairs of the
space, locks the leading ones whose residual is down to rounding, and enlarges the space by approximate solutions of the
correction equations (I - QQ^T)(A - theta I)(I - QQ^T) t = -r, which MINRES solves for all open pairs side by side, so that
a step of all of them is one pass over the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import materialised

COMPONENTS = 32
GUARD = 8  # Ritz pairs kept beyond the wanted ones
INNER = 12  # steps of MINRES in a round, at most
INNER_GAIN = 1e-3  # a correction equation solved this far is solved
ROUNDING = 2.0**-46  # residuals up to this share of the largest eigenvalue are rounding
ROUNDS = 300
LARGEST = 2.0**40  # entries beyond count as not finite: their whole numbers would leave a long when added up
SCALE, SHIFT = 64, 1_000_000  # fixed values of the contract: x = floor(64 c) + 1000000


def whole_numbers(embeddings: DataFrame, vector: str) -> DataFrame:
    """vec_id and x (array<long>) of the usable rows, written.

    Vectors that are null or empty or hold null, NaN or infinite entries drop out, and so do those whose length is not the
    commonest (of equally common ones: the longest).
    """
    c = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > LARGEST))
    sound = embeddings.filter(F.col(vector).isNotNull()).filter(~F.coalesce(bad, F.lit(False)) & (F.size(vector) > 0))
    rows = materialised(
        sound.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform(c, lambda x: F.floor(x * SCALE).cast("long") + SHIFT).alias("x"),
        )
    )
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (length["d"] if length else 0))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The x of a batch, a row per vector."""
    return np.asarray(batch.column("x").flatten(), dtype=np.int64).reshape(batch.num_rows, -1)


def summed(rows: DataFrame, part, dtype=np.float64) -> np.ndarray:
    """The sum over all batches of ``part`` (x matrix -> flat array); one task sends one array, Spark adds them up."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                here = part(matrix(batch))
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["entry", "value"])

    kind = "long" if dtype is np.int64 else "double"
    added = rows.select("x").mapInArrow(run, f"entry long, value {kind}").groupBy("entry").agg(F.sum("value").alias("value"))
    found = sorted((r["entry"], r["value"]) for r in added.collect())
    return np.array([v for _, v in found], dtype=dtype)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the difference n x - S is taken in whole numbers, rounded once."""
    return differences(x, n, sums).astype(np.float64) / n


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, in longs where they suffice and else in Python's whole numbers."""
    if n * max(int(np.abs(x).max()), 1) >= 1 << 62:
        x, sums = x.astype(object), sums.astype(object)
    return n * x - sums


def minres(product, shifts: np.ndarray, space: np.ndarray, right: np.ndarray, steps: int = INNER) -> np.ndarray:
    """Approximate solutions t of P (A - shift_i) P t = right_i, P projecting ``space`` out; one product per step."""

    def projected(m):
        for _ in range(2):
            m = m - space @ (space.T @ m)
        return m

    def divided(m, by):
        return np.divide(m, by, out=np.zeros_like(m), where=by > tiny)

    right = projected(right)
    tiny = 1e-300
    beta = np.linalg.norm(right, axis=0)
    goal, v, v_old = beta * INNER_GAIN, divided(right, beta), np.zeros_like(right)
    w, w_old, t = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, gamma, left = beta.copy(), np.zeros_like(beta), beta.copy()
    scale = np.abs(shifts).max() if len(shifts) else 0.0
    open_ = beta > 0
    for _ in range(steps):
        if not open_.any():
            break
        av = np.zeros_like(v)
        av[:, open_] = product(v[:, open_])
        av = projected(av - v * shifts)
        alpha = (v * av).sum(axis=0)
        v_next = projected(av - v * alpha - v_old * gamma)
        gamma_next = np.linalg.norm(v_next, axis=0)
        delta = c * alpha - c_old * s * gamma
        rho1 = np.hypot(delta, gamma_next)
        rho2, rho3 = s * alpha + c_old * c * gamma, s_old * gamma
        move = open_ & (rho1 > 1e-14 * scale)
        c_next = np.where(move, divided(delta, rho1), c)
        s_next = np.where(move, divided(gamma_next, rho1), s)
        w_next = divided(v - w_old * rho3 - w * rho2, rho1)
        t[:, move] += (w_next * (c_next * eta))[:, move]
        eta, left = -s_next * eta, left * np.abs(s_next)
        w_old, w, c_old, c, s_old, s = w, w_next, c, c_next, s, s_next
        open_ &= move & (left > goal) & (gamma_next > 1e-13 * scale)
        v_old, v, gamma = v, divided(v_next, gamma_next), gamma_next
    return projected(t)


def orthonormal(more: np.ndarray, space: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``more`` adds to the orthonormal ``space``."""
    out = space[:, :0]
    for column in more.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for basis in (space, out):
                column = column - basis @ (basis.T @ column)
        rest = np.linalg.norm(column)
        if size > 0 and rest > 1e-10 * size:
            column = column / rest
            for basis in (space, out):
                column = column - basis @ (basis.T @ column)
            out = np.column_stack((out, column / np.linalg.norm(column)))
    return out


def leading_eigenvectors(product, d: int, wanted: int, guard: int = GUARD, seed: int = 1):
    """(values, vectors, report): the ``wanted`` largest eigenpairs of a symmetric positive operator, by falling value.

    ``product`` multiplies the operator with the columns of a matrix. Every pair ends with a residual of at most ROUNDING
    times the largest eigenvalue. report: rounds and products made.
    """
    made = {"rounds": 0, "products": 0}

    def times(m):
        made["products"] += 1
        return product(m)

    wanted = min(wanted, d)
    block = min(d, wanted + guard)
    most = min(d, 3 * block)
    space = orthonormal(np.random.default_rng(seed).standard_normal((d, block)), np.zeros((d, 0)))
    image = times(space)
    locked, values, before = np.zeros((d, 0)), np.zeros(0), np.inf
    while made["rounds"] < ROUNDS:
        made["rounds"] += 1
        small = space.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz = space @ y
        need = wanted - locked.shape[1]
        residuals = (image @ y - ritz * theta)[:, :need]
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        limit = ROUNDING * max([0.0, theta[0], *values])
        done = int(np.argmax(np.append(sizes, np.inf) > max(limit, np.finfo(float).tiny)))
        whole = space.shape[1] + locked.shape[1] == d
        if whole and done < need and sizes.max() >= before / 2:  # fresh products of a complete space: this is rounding
            if sizes.max() > 64 * limit:
                raise ArithmeticError("the products of the operator are not exact enough")
            done = need
        before = sizes.max() if whole else np.inf
        locked, values = np.column_stack((locked, ritz[:, :done])), np.append(values, theta[:done])
        if done == need:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order], made
        space = orthonormal(ritz[:, done:], locked)
        if not whole:
            near = space[:, : need - done + guard]
            corrections = minres(times, theta[done:need], np.column_stack((locked, near)), -residuals[:, done:])
            if space.shape[1] + 2 * (need - done) > most:
                space = near
            more = orthonormal(np.column_stack((corrections, residuals[:, done:])), np.column_stack((locked, space)))
            space = np.column_stack((space, more[:, : d - locked.shape[1] - space.shape[1]]))
        image = times(space)
    raise ArithmeticError("no convergence")


def whitened(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of another length than the commonest, or holds null or non-finite entries (or one
    beyond LARGEST) drop out. Repeated rows are answered, and counted, each; null ids stay. Components whose eigenvalue is
    zero up to rounding cannot be scaled to one and are left out, so equal vectors, one vector, or an empty table give an
    empty result. Equal eigenvalues leave a choice of vectors, which is made once for all rows. Other columns are left
    behind, clashing ones too. A deviation beyond a long is null.
    """
    schema = "vec_id long, n long, deviation long, whitened array<double>"
    rows = whole_numbers(embeddings, vector)
    head = summed(rows, lambda x: np.concatenate(([len(x)], x.sum(axis=0))), np.int64)
    if not len(head):
        return empty(embeddings)
    n, sums = int(head[0]), head[1:]
    spread = summed(rows, lambda x: (centred(x, n, sums) ** 2).sum(axis=0)) / n
    trace = float(spread.sum())
    if trace <= 0:
        return empty(embeddings)

    def product(q):
        def part(x, q=q):
            c = centred(x, n, sums)
            return (c.T @ (c @ q)).ravel()

        return summed(rows, part).reshape(len(sums), -1) / n

    values, vectors, _ = leading_eigenvectors(product, len(sums), components)
    sound = values > len(sums) * np.finfo(float).eps * values[0]
    values, vectors = values[sound], vectors[:, sound]
    scaled = vectors / np.sqrt(values)

    def moments(x):
        w = centred(x, n, sums) @ scaled
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    found = summed(rows, moments) / n
    k = len(values)
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    error = float(np.abs(covariance - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = differences(matrix(batch), n, sums)
            exact = int(np.abs(whole).max()) ** 2 * whole.shape[1] < 1 << 63
            squares = whole if exact else whole.astype(object)
            deviation = [int(v) if v < 1 << 63 else None for v in (squares * squares).sum(axis=1)]
            out = (whole.astype(np.float64) / n) @ scaled
            ends = pa.array(np.arange(0, out.size + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array(np.full(batch.num_rows, n)),
                    pa.array(deviation, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(out.ravel())),
                ],
                names=["vec_id", "n", "deviation", "whitened"],
            )

    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    answers = rows.mapInArrow(project, schema)
    each = answers.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def empty(embeddings: DataFrame) -> DataFrame:
    return embeddings.sparkSession.createDataFrame(
        [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
