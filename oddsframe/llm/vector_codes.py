"""Vector code compression: product quantisation by Lloyd rounds that prune with Elkan's bounds.

Vectors become integers and are cut into equal parts; each part position has a codebook. A round assigns every part to its nearest entry and moves each entry to the floor of
its parts' mean. Distances are squared and integer, so ties are seen exactly and go to the lower index.

Elkan's bounds: with every vector an upper bound a part (of the distance to its entry) and one lower bound an entry (of the distance to that entry) are stored in the table that a round
writes. When the entries move, the lower bounds fall and the upper bounds rise by the way moved. An entry is left out if its lower bound, or half its distance from the part's own
entry, is strictly over the upper bound; the others' distances are computed as integers. Bounds are rounded outwards (upper ones in 32-bit floats, lower ones in 16-bit floats), so
rounding never prunes a tie.

Spark deals the vectors; tasks work on Arrow batches and return sums by part and entry, which are added up in Spark. Only codebooks (parts x entries x width integers) go
through the driver. Each round's table is in the shared folder, and the one before it is deleted.

Defined results. Rows whose vector is null, or holds null or non-finite components, are dropped. The width is that of the kept vector of least id whose length is a multiple of
parts; vectors of other lengths are dropped. With fewer ids than entries, codebooks have as many entries as there are ids. A repeated id seeds one entry, by its least vector; all its
rows are coded. A null id is coded, but seeds none. Components beyond 2**27 / sqrt(width), as integers, raise a ValueError, since distances would no longer fit a long. An
empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsframe.llm.common import attach, delete_table, materialise

#: Parts of a vector, entries of a codebook, Lloyd rounds; what a component is multiplied by before its floor is taken.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: How far a float64 result is moved outwards, as a share; the largest 16-bit float.
_SLACK, _HALF_MOST = 1e-12, 65504.0


@dataclass(frozen=True)
class Codebooks:
    """entries: integers by part, entry and position within the part."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all components as decimal numbers, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for, in the scale of the input."""
        return np.concatenate([self.entries[p, c] for p, c in enumerate(code)]) / SCALE


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c: exact integers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.clip(x * (1 - _SLACK), 0, _HALF_MOST).astype(np.float16), np.float16(-np.inf)), np.float16(0))


def assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, its upper bound and the lower bounds of all entries, from all distances."""
    d = squared(x, c)
    code = d.argmin(1)
    far = np.sqrt(d.astype(np.float64))
    return code, _up(far[np.arange(len(x)), code]), _down(far)


def reassign(x: np.ndarray, before: np.ndarray, c: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What assign(x, c) gives, from the codes and bounds for the entries before (bounds may be looser), and how many distances it took."""
    moved = np.sqrt(((c - before) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
    apart = np.sqrt(squared(c, c).astype(np.float64)) / 2 * (1 - _SLACK)
    np.fill_diagonal(apart, np.inf)
    upper = _up(upper.astype(np.float64) + moved[code])
    lower = _down(lower.astype(np.float64) - moved[None, :])
    code, rows = code.copy(), np.flatnonzero(upper >= apart.min(1, initial=np.inf)[code])
    if not len(rows):
        return code, upper, lower, 0
    own = code[rows]
    best = ((x[rows] - c[own]) ** 2).sum(1)
    near = _up(np.sqrt(best.astype(np.float64)))
    may = (lower[rows].astype(np.float64) <= near[:, None]) & (apart[own] <= near[:, None])
    may[np.arange(len(rows)), own] = False
    r, j = np.nonzero(may)
    d = ((x[rows[r]] - c[j]) ** 2).sum(1)
    all_d = np.full(may.shape, np.iinfo(np.int64).max)
    all_d[r, j], all_d[np.arange(len(rows)), own] = d, best
    code[rows] = all_d.argmin(1)
    lower[rows[r], j] = _down(np.sqrt(d.astype(np.float64)))
    lower[rows, own] = _down(np.sqrt(best.astype(np.float64)))
    upper[rows] = _up(np.sqrt(all_d.min(1).astype(np.float64)))
    return code, upper, lower, len(rows) + len(r)


def _parts(b: pa.RecordBatch, parts: int) -> np.ndarray:
    """part x row x position."""
    whole = np.asarray(b.column("whole").flatten(), dtype=np.int64).reshape(b.num_rows, parts, -1)
    return np.ascontiguousarray(whole.transpose(1, 0, 2))


def _packed(x: np.ndarray) -> pa.Array:
    """One binary value a row of a two-dimensional array."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _unpacked(b: pa.RecordBatch, name: str, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(name).to_pylist()), dtype=kind).reshape(b.num_rows, *shape)


def _pass(table: DataFrame, schema: str, books: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """A round's codes, with bounds, or in the last one with the squared distance. before: the entries that the bounds of table are for, none the first time."""
    parts, entries = books.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, got = _parts(b, parts), []
            if before is None:
                got = [assign(x[p], books[p]) for p in range(parts)]
            else:
                code, upper, lower = _unpacked(b, "code", np.uint8, parts), _unpacked(b, "upper", np.float32, parts), _unpacked(b, "lower", np.float16, parts, entries)
                got = [reassign(x[p], before[p], books[p], code[:, p].astype(np.int64), upper[:, p], lower[:, p])[:3] for p in range(parts)]
            code = np.stack([g[0] for g in got], 1).astype(np.uint8)
            if last:
                error = sum(((x[p] - books[p][got[p][0]]) ** 2).sum(1) for p in range(parts))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), _packed(code), pa.array(error, pa.int64())], ["id", "label", "code", "error"])
            else:
                bounds = [_packed(np.stack([g[1] for g in got], 1)), _packed(np.stack([g[2] for g in got], 1).reshape(len(code), -1))]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("whole"), _packed(code), *bounds], ["id", "label", "whole", "code", "upper", "lower"])

    return table.mapInArrow(run, f"{schema}, code binary, error long" if last else f"{schema}, whole array<int>, code binary, upper binary, lower binary")


def _moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; entries without parts stay. A task returns at most a row a part and entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                at = _unpacked(b, "code", np.uint8, parts).astype(np.int64) + entries * np.arange(parts)
                np.add.at(sums, at.T.ravel(), _parts(b, parts).reshape(-1, width))
                counts += np.bincount(at.ravel(), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["at", "n", "sums"])

    found = coded.select("whole", "code").mapInArrow(run, "at long, n long, sums array<long>")
    out = books.reshape(-1, width).copy()
    for r in found.groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width))).toLocalIterator():
        out[r["at"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out.reshape(books.shape)


def _integers(vectors: DataFrame, vector: str, id_: str, label: str) -> DataFrame:
    x = F.col(vector)
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))
    return vectors.where(fine).select(F.col(id_).alias("id"), F.col(label).alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("whole"))


def _seeds(kept: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the least ids, ascending."""
    out: list[list[int]] = []
    last = None
    while len(out) < entries:
        rest = kept.where("id is not null") if last is None else kept.where(F.col("id") > last)
        rows = rest.select("id", "whole").orderBy("id", "whole").limit(entries).collect()
        for r in rows:
            if r.id != last and len(out) < entries:
                out.append(r.whole)
                last = r.id
        if len(rows) < entries:
            break
    return out


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", id_: str = "vec_id", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code: binary, error) of each kept vector, and the codebooks; none if no vector is kept. entries: 256 at most."""
    all_kept = _integers(vectors, vector, id_, label)
    schema = f"id {vectors.schema[id_].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}"
    first = all_kept.where((F.size("whole") > 0) & (F.size("whole") % parts == 0)).orderBy(F.col("id").asc_nulls_last(), "whole").limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"{schema}, code binary, error long"), None
    width = len(first[0].whole)
    of_width = all_kept.where(F.size("whole") == width)
    most = of_width.agg(F.greatest(F.max(F.array_max("whole")), -F.min(F.array_min("whole")))).first()[0]
    if most > 2**27 / width**0.5:
        raise ValueError(f"a component is {most} as an integer; squared distances wouldn't fit a long")
    kept = materialise(of_width.withColumn("whole", F.col("whole").cast("array<int>")), "vectors")
    books = np.array(_seeds(kept, entries) or [first[0].whole], dtype=np.int64)
    books = books.reshape(len(books), parts, -1).transpose(1, 0, 2).copy()
    table, before = kept, None
    for _ in range(rounds):
        coded = materialise(_pass(table, schema, books, before, last=False), "codes")
        delete_table(vectors.sparkSession, table.inputFiles()[0].rpartition("/")[0])
        table, before, books = coded, books, _moved(coded, books)
    return materialise(_pass(table, schema, books, before, last=True), "codes"), Codebooks(books)


def compress(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row of embeddings."""
    coded, books = encode(embeddings)
    coded = coded.withColumn("key", F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("")))
    totals = materialise(coded.groupBy("key").agg(F.sum("error").alias("label_error")), "labels")
    return attach(coded, totals, "key").select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256")
    )


ORACLE_SQL = r"""
with e as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select vec_id, label, part, v[part * w + 1 : part * w + w] as x, w from (select *, len(v) // 16 as w, unnest(range(16)) as part from e)),
s as (select row_number() over (order by vec_id) - 1 as entry, vec_id from (select distinct vec_id from e order by vec_id limit 64)),
c0 as (select part, entry, x as c from p join s using (vec_id)),
a0 as (
  select p.vec_id, p.part, any_value(p.x) as x, any_value(p.w) as w, min(cast(list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) as bigint) * 64 + entry) as best
  from p join c0 using (part) group by p.vec_id, p.part),
m0 as (select part, best % 64 as entry, count(*) as n, unnest(range(1, any_value(w) + 1)) as i, list(x) as xs from a0 group by 1, 2),
f0 as (select part, entry, list(cast((t - ((t % n) + n) % n) // n as bigint) order by i) as c from (select part, entry, n, i, cast(list_sum(list_transform(xs, lambda x: x[i])) as bigint) as t from m0) group by 1, 2),
c1 as (select part, entry, coalesce(f0.c, c0.c) as c from c0 left join f0 using (part, entry)),
a1 as (
  select p.vec_id, p.part, any_value(p.x) as x, any_value(p.w) as w, min(cast(list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) as bigint) * 64 + entry) as best
  from p join c1 using (part) group by p.vec_id, p.part),
m1 as (select part, best % 64 as entry, count(*) as n, unnest(range(1, any_value(w) + 1)) as i, list(x) as xs from a1 group by 1, 2),
f1 as (select part, entry, list(cast((t - ((t % n) + n) % n) // n as bigint) order by i) as c from (select part, entry, n, i, cast(list_sum(list_transform(xs, lambda x: x[i])) as bigint) as t from m1) group by 1, 2),
c2 as (select part, entry, coalesce(f1.c, c1.c) as c from c1 left join f1 using (part, entry)),
a2 as (
  select p.vec_id, p.part, any_value(p.label) as label, min(cast(list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) as bigint) * 64 + entry) as best
  from p join c2 using (part) group by p.vec_id, p.part),
r as (select vec_id, any_value(label) as label, string_agg(lower(printf('%02x', best % 64)), '' order by part) as code, cast(sum(best // 64) as bigint) as error from a2 group by vec_id),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from c2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from r, h
"""
