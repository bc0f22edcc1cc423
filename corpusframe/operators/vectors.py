"""Vectors and exact top-k search with metadata filters."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.functions import text as X
from corpusframe.functions.routes import DOMAIN_CODES
from corpusframe.settings import durable, release_shuffles

# The functions run in tasks travel with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Numbers (rows × dimensions) of either side that a task compares at once, and that move to it as one block if more blocks would be made.
QUERY_NUMBERS = 2_000_000
CELL_NUMBERS = 4_000_000
#: Blocks of rows, and of queries, that a smaller table is cut into, so that there are tasks enough; but of so many numbers at least.
ROW_BLOCKS, QUERY_BLOCKS, LEAST_BLOCK = 8, 4, 100_000
#: Numbers of the queries of one round. What a round moves is in proportion to the rows, and is released before the next.
ROUND_NUMBERS = 8_000_000
#: Scores held at once, whatever the dimension.
TILE_SCORES = 2_000_000
#: Rows that a tile should have before it takes more queries.
TILE_ROWS = 4096
#: By how much a score may be off.
SCORE_SLACK = 1e-9
#: Pairs of a row and a cell held at once, whatever the number of cells.
CELL_PAIRS = 500_000


def vectorise(df: DataFrame, col: str, fn=None, dim: int = 256, out: str = "embedding") -> DataFrame:
    """Unit vector of a text: by ``fn`` (a pandas UDF Series[str] → Series[list[float]]) or by hashed word counts.

    A word counts in the place that the first eight hexadecimal digits of its MD5 say, modulo ``dim``. A text without words is the
    zero vector.
    """
    if fn is not None:
        return df.withColumn(out, fn(F.col(col)))
    place = F.transform(X.words(F.lower(F.coalesce(col, F.lit("")))), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    places = df.withColumn("__p", F.array_sort(place))
    # a run of equal places ends where the next one differs
    last = F.transform("__p", lambda p, i: F.when(F.coalesce(F.get("__p", i + 1), F.lit(-1)) != p, F.struct(p.alias("p"), (i + 1).alias("upto"))))
    runs = places.withColumn("__r", F.array_compact(last))
    counts = F.transform("__r", lambda r, i: F.struct(r["p"].alias("key"), (r["upto"] - F.coalesce(F.get("__r", i - 1)["upto"], F.lit(0))).cast("double").alias("value")))
    norm = F.sqrt(F.aggregate("__k", F.lit(0.0), lambda a, x: a + x["value"] * x["value"]))
    # the row number keeps filters on the vector above this step; below it, they would compute every array again for each of its elements
    ready = runs.withColumn("__k", counts).withColumns({"__n": norm, "__m": F.map_from_entries("__k"), "__row": F.monotonically_increasing_id()})
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.coalesce(F.try_element_at("__m", j) / F.col("__n"), F.lit(0.0)).cast("float"))
    return ready.withColumn(out, F.when(F.col("__row") >= 0, value)).drop("__p", "__r", "__k", "__n", "__m", "__row")


def check_vectors(df: DataFrame, dim: int, vector: str = "embedding", text: str | None = None) -> DataFrame:
    """Problems of a vector table: error for NaN/Inf or a wrong dimension, warning for a blank text."""
    bad = F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    tests = [F.when(bad, F.struct(F.lit("error").alias("severity"), F.lit("nan_or_inf").alias("issue"))),
             F.when(F.size(vector) != dim, F.struct(F.lit("error").alias("severity"), F.lit("dimension").alias("issue")))]
    if text:
        tests.append(F.when(X.is_blank(F.col(text)), F.struct(F.lit("warning").alias("severity"), F.lit("empty_text").alias("issue"))))
    return df.select(*[c for c in df.columns if c not in (vector, text)], F.explode(F.array_compact(F.array(*tests))).alias("p")) \
        .select("*", "p.*").drop("p")


def apply_filters(chunks: DataFrame, domain=None, language=None, document_type=None, document=None, codes=DOMAIN_CODES) -> DataFrame:
    """AND of the filters given; a domain may be a list or a user code; ``all`` is no filter."""
    out = chunks
    for name, value in (("domain", domain), ("language", language), ("document_type", document_type), ("document", document)):
        if name == "domain" and value:
            named = [codes.get(v.lower(), v) for v in ([value] if isinstance(value, str) else value)]
            value = None if None in named else named
        if value:
            out = out.filter(F.col(name).isin(list(value) if isinstance(value, (list, tuple)) else [value]))
    return out


# --- exact top-k -------------------------------------------------------------------------------

def _unit(rows) -> np.ndarray:
    m = np.asarray([np.asarray(r, dtype=np.float64) for r in rows], dtype=np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None):
    """(query position, id, score) of the k best of every query; ties by smaller id. Exact.

    ``least``: per query the score to reach, rows below it are passed over; -inf where none is known.
    """
    least = np.full(len(scores), -np.inf) if least is None else least.copy()
    free = np.flatnonzero(least == -np.inf)
    if len(free) and scores.shape[1] > k:
        least[free] = np.partition(scores[free], scores.shape[1] - k, axis=1)[:, -k]
    q, c = np.nonzero(scores >= least[:, None])
    return _first(q, ids[c], scores[q, c], k)


def _first(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int):
    """The k first of every query by score, then id."""
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    near = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[near], i[near], s[near]


def _allowed(query_domains, names) -> np.ndarray:
    """Which of some domains a query may see; a query without a domain list sees all, also rows without a domain."""
    codes, known = pd.factorize(pd.Series(names, dtype="object"))
    table = np.ones((len(query_domains), len(known) + 1), dtype=bool)
    for j, wanted in enumerate(query_domains):
        if wanted is not None and len(wanted):
            chosen = set(wanted)
            table[j, :-1] = [n in chosen for n in known]
            table[j, -1] = False
    return table[:, codes]


def _search(query_ids, qm, part: pd.DataFrame, k: int, tile: int, visits=None, least=None, query_rows: int = sys.maxsize, cell_rows: int = sys.maxsize):
    """The k best rows of ``part`` for every query, by tiles of at most ``tile`` scores, ``query_rows`` queries and ``cell_rows`` rows: query id, row id, score.

    ``visits``: which places (``place`` of a row) each query meets, by default all; ``least``: rows below this score of a query are passed over.
    """
    place = part["place"].to_numpy() if "place" in part.columns else np.zeros(len(part), dtype=int)
    order = np.argsort(place, kind="stable")
    ids, place = part["chunk_id"].to_numpy()[order], place[order]
    rows = _unit(part["embedding"].iloc[order]) if len(part) <= cell_rows else None
    edge = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
    out_q, out_i, out_s = [], [], []
    # tiles are long, not wide: every tile gives k candidates a query, and these are what costs
    wide = max(1, min(len(qm), query_rows, tile // max(1, min(len(part), cell_rows, TILE_ROWS))))
    high = max(1, min(cell_rows, tile // wide))
    for a in range(0, len(qm), wide):
        q_part = qm[a:a + wide]
        best_q, best_i, best_s = np.empty(0, int), ids[:0], np.empty(0)
        reach = np.full(len(q_part), -np.inf) if least is None else least[a:a + wide].copy()
        for start, end in zip(edge[:-1], edge[1:]):
            asks = np.arange(len(q_part)) if visits is None else np.flatnonzero(visits[a:a + wide, place[start]])
            if not len(asks):
                continue
            some = q_part if len(asks) == len(q_part) else q_part[asks]
            for b in range(start, end, high):
                e = min(b + high, end)
                q, i, s = _best(some @ (_unit(part["embedding"].iloc[order[b:e]]) if rows is None else rows[b:e]).T, ids[b:e], k, reach[asks])
                if len(q):
                    best_q, best_i, best_s = _first(np.concatenate([best_q, asks[q]]), np.concatenate([best_i, i]), np.concatenate([best_s, s]), k)
                    full = np.flatnonzero(np.bincount(best_q, minlength=len(q_part)) == k)  # these queries have k rows by now
                    reach[full] = np.maximum(reach[full], best_s[np.searchsorted(best_q, full, side="right") - 1])
        out_q.append(query_ids[a:a + wide][best_q])
        out_i.append(best_i)
        out_s.append(best_s)
    return pd.DataFrame({"query_id": np.concatenate(out_q), "chunk_id": np.concatenate(out_i), "similarity": np.concatenate(out_s)})


def _block(k: int, tile: int, query_rows: int, cell_rows: int):
    """Queries (query_id, embedding, least, cells as bits by place) against the rows of a block (chunk_id, embedding, place)."""
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": q["query_id"].iloc[:0], "chunk_id": c["chunk_id"].iloc[:0], "similarity": pd.Series(dtype="float64")})
        visits = np.unpackbits(np.frombuffer(b"".join(q["cells"]), np.uint8).reshape(len(q), -1), axis=1)
        least = q["least"].to_numpy(dtype=float, na_value=np.nan)
        return _search(q["query_id"].to_numpy(), _unit(q["embedding"]), c, k, tile, visits, np.where(np.isnan(least), -np.inf, least - SCORE_SLACK), query_rows, cell_rows)
    return run


def usable(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has ``dim`` numbers, all finite; ``check_vectors`` lists the others."""
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def common_size(df: DataFrame, dim: int | None = None, vector: str = "embedding") -> tuple[int, int]:
    """(size of a vector, rows of that size): ``dim``, or the most frequent size (ties: the larger); (1, 0) without vectors."""
    sizes = df.filter(F.col(vector).isNotNull() & (F.lit(dim is None) | (F.size(vector) == (dim or 0)))).groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).head()
    return (top["size"], top["n"]) if top else (dim or 1, 0)


def left_out(queries: DataFrame, corpus: DataFrame, dim: int) -> DataFrame:
    """side, n_rows, n_left_out: how many rows of either side a search over vectors of ``dim`` numbers cannot use."""
    fine = F.coalesce((F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    count = lambda df, side: df.agg(F.count("*").alias("n_rows"), F.count_if(~fine).alias("n_left_out")).select(F.lit(side).alias("side"), "n_rows", "n_left_out")
    return count(queries, "queries").unionByName(count(corpus, "corpus"))


#: Radians by which a computed angle may be off.
SLACK = 1e-6
MOST_CELLS = 4096
#: A corpus of no more numbers than this is one cell, unless cells are asked for: to place its rows would cost more than to compare them.
ONE_CELL = 500_000


def _steps(rows: int, cells: int):
    """Ranges of rows that make at most ``CELL_PAIRS`` pairs with the cells, or one row."""
    step = max(1, CELL_PAIRS // max(1, cells))
    return [(a, min(a + step, rows)) for a in range(0, rows, step)]


def _centres(rows: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Unit centres of at most ``cells`` groups of some unit vectors: a few rounds of spherical k-means."""
    centres = np.unique(rows[np.abs(rows).sum(1) > 0], axis=0)
    if len(centres) <= 1:
        return centres
    centres = centres[np.linspace(0, len(centres) - 1, min(cells, len(centres))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(rows[a:b] @ centres.T).argmax(1) for a, b in _steps(len(rows), len(centres))])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _angles(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ centres.T, -1.0, 1.0))


def _assign(centres: np.ndarray):
    """Nearest centre of every row and the angle to it; rows of length zero have no direction and form a cell of their own."""
    def run(parts):
        for part in parts:
            u = _unit(part["embedding"]) if len(part) else np.zeros((0, 1))
            cell, angle = np.full(len(part), len(centres)), np.full(len(part), math.pi)
            some = np.abs(u).sum(1) > 0
            some = np.flatnonzero(some)
            for a, b in _steps(len(some), len(centres)) if len(centres) else []:
                near = _angles(u[some[a:b]], centres)
                cell[some[a:b]], angle[some[a:b]] = near.argmin(1), near.min(1)
            yield part.assign(__cell=cell.astype(np.int32), __angle=angle)
    return run


class Index:
    """A corpus in cells around centres, for exact searches that skip cells.

    A cell (centre and domain) knows how many rows it has and its radius, the largest angle between its centre and a row.
    By the triangle inequality on angles no row of it can be nearer to a query than angle(query, centre) - radius, so
    a cell whose best possible cosine is below a query's k-th score is not visited. Cells without the domain of a query are not
    visited either, before any row is copied.

    Cells move in blocks: neighbours together, a large one in parts by a hash. A query moves once to each block with a cell it visits,
    with the list of these cells, and a task compares it with those only.

    ``dim``: size of the vectors, by default the most frequent one of the corpus. Other rows are left out: see ``left_out``.
    """

    #: Block of each cell, in order, and the parts of each block; without it every cell is a block.
    block = parts = None

    def __init__(self, corpus: DataFrame, dim: int | None = None, cells: int | None = None, numbers: int = CELL_NUMBERS):
        self.by_domain, self.numbers = "domain" in corpus.columns, numbers
        c = corpus.select("chunk_id", "embedding", *(["domain"] if self.by_domain else []))
        self.dim, size = common_size(c, dim)
        c = usable(c, self.dim)
        if cells is None and size * self.dim <= ONE_CELL:
            self.centres = np.zeros((0, self.dim))
            # 0 for every row, but no constant: cells are found by an equi-join
            self.rows = c.withColumns({"__cell": F.pmod(F.size("embedding"), F.lit(1)), "__angle": F.lit(math.pi)})
            stats = [(0, math.pi, size, None)] if size else []
            if self.by_domain:
                stats = [(0, math.pi, r["n"], r["domain"]) for r in c.groupBy("domain").agg(F.count("*").alias("n")).collect()]
        else:
            cells = max(1, min(MOST_CELLS, round(math.sqrt(size) / 4))) if cells is None else cells
            sample = c.select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(max(cells, min(32 * cells, CELL_NUMBERS // self.dim)))
            rows = _unit([r[0] for r in sample.collect()])
            self.centres = _centres(rows, cells) if len(rows) else np.zeros((0, self.dim))
            fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema.fields)
            self.rows = durable(c.mapInPandas(_assign(self.centres), f"{fields}, __cell int, __angle double"))
            key = ["__cell", "domain"] if self.by_domain else ["__cell"]
            found = self.rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("__angle").alias("radius")).collect()
            stats = [(r["__cell"], r["radius"], r["n"], r["domain"] if self.by_domain else None) for r in found]
        stats.sort(key=lambda r: (r[0], str(r[3])))
        self.cell = np.array([r[0] for r in stats], dtype=np.int64)
        self.radius = np.array([r[1] for r in stats])
        self.n = np.array([r[2] for r in stats], dtype=np.int64)
        self.domain = [r[3] for r in stats]
        self.block, self.parts = self._blocks()

    def _blocks(self) -> tuple[np.ndarray, list[int]]:
        """Cells one after another make a block while they fit; a cell that does not fit is a block of several parts."""
        size = self.n * self.dim
        most = min(CELL_NUMBERS, max(LEAST_BLOCK, -(-int(size.sum()) // ROW_BLOCKS)))
        block, parts, held = [], [], most + 1
        for x in size.tolist():
            if held + x > most:
                parts.append(max(1, -(-x // most)))
                held = 0
            held += x
            block.append(len(parts) - 1)
        return np.array(block, dtype=np.int64), parts

    def _visits(self, k: int, later: bool, spread: bool):
        """Tasks' part of one phase: copies of each query for the blocks of the cells it visits (``spread``), or counts per cell.

        First phase: the cells of best bound that hold k rows. Later: all others whose bound reaches the score ``least``.
        """
        centres, cell, domain, n, radius = self.centres, self.cell, self.domain, self.n, self.radius
        none, step = len(centres), max(1, QUERY_NUMBERS // self.dim)
        block = np.arange(len(n)) if self.block is None else self.block
        edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist()
        ranges = [(int(block[s]), s, e) for s, e in zip(edge[:-1], edge[1:]) if s < e]

        def run(parts):
            for part in parts:
                total = np.zeros(len(n), dtype=np.int64)
                for a, b in _steps(len(part), len(n)):
                    rows = part.iloc[a:b]
                    u = _unit(rows["embedding"])
                    bound = np.ones((len(rows), len(n)))
                    directed, pointed = np.flatnonzero(np.abs(u).sum(1) > 0), np.flatnonzero(cell < none)
                    if len(directed) and len(pointed):
                        far = _angles(u[directed], centres)[:, cell[pointed]] - radius[pointed] - SLACK
                        bound[np.ix_(directed, pointed)] = np.cos(np.maximum(far, 0.0))
                    may = _allowed(rows["domains"].to_list(), domain) if "domains" in rows.columns else np.ones(bound.shape, dtype=bool)
                    order = np.argsort(np.where(may, -bound, 9.0), axis=1, kind="stable")
                    held = np.cumsum(np.where(np.take_along_axis(may, order, 1), n[order], 0), axis=1)
                    first = np.zeros(bound.shape, dtype=bool)
                    np.put_along_axis(first, order, (held - n[order] < k) | (not none), axis=1)
                    wanted = first & may
                    if later:
                        least = rows["least"].to_numpy(dtype=float)
                        wanted = may & ~wanted & (bound >= np.where(np.isnan(least), -2.0, least - 1e-9)[:, None])
                    if spread:
                        kept = rows[["query_id", "embedding"]].assign(least=rows["least"] if later else np.nan)
                        for at, s, e in ranges:
                            asks = np.flatnonzero(wanted[:, s:e].any(1))
                            for j in range(0, len(asks), step):  # copies of the vectors are made of some pairs at a time
                                some = asks[j:j + step]
                                yield kept.iloc[some].assign(cells=[x.tobytes() for x in np.packbits(wanted[some, s:e], axis=1)], __block=np.int32(at))
                    else:
                        total += wanted.sum(0)
                if not spread:
                    hit = np.flatnonzero(total)
                    yield pd.DataFrame({"__cid": hit.astype(np.int32), "n": total[hit]})
        return run

    def _phase(self, queries: DataFrame, asked: int, k: int, later: bool, query_numbers: int, tile: int, few: bool) -> tuple[DataFrame | None, dict]:
        """(hits of the cells visited, queries per cell); ``few`` queries make one block everywhere, so they are not counted."""
        spark = queries.sparkSession
        counts = dict.fromkeys(range(len(self.n)), 1) if few else {r["__cid"]: r["n"] for r in queries.mapInPandas(self._visits(k, later, False), "__cid int, n long").groupBy("__cid").agg(F.sum("n").alias("n")).collect()}
        if not counts:
            return None, counts
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields if f.name in ("query_id", "embedding"))
        copies = queries.mapInPandas(self._visits(k, later, True), f"{fields}, least double, cells binary, __block int")
        asks, place = dict.fromkeys(self.block[list(counts)].tolist(), 0), np.arange(len(self.n)) - np.searchsorted(self.block, self.block)
        for c, n in counts.items():
            asks[int(self.block[c])] += n
        for b, n in asks.items():
            n = min(n, asked) * self.dim
            most = min(QUERY_NUMBERS, max(LEAST_BLOCK, -(-asked * self.dim // QUERY_BLOCKS)))
            asks[b] = 1 if few else max(1, -(-n // most))
        blocks = spark.createDataFrame([(b, self.parts[b], n) for b, n in sorted(asks.items())], "__block int, __parts int, __asks int")
        places = spark.createDataFrame([(int(self.cell[c]), self.domain[c], int(place[c]), b, self.parts[b], asks[b]) for c in range(len(self.n)) if c in counts for b in [int(self.block[c])]],
                                       "__at int, __of string, place int, __block int, __parts int, __asks int")
        # cells are at most MOST_CELLS times the domains, whatever the data
        part = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        qg = copies.join(F.broadcast(blocks), "__block").withColumn("__q", part("query_id", "__asks")).select("query_id", "embedding", "least", "cells", "__block", "__q", every("__parts").alias("__c")).groupBy("__block", "__c", "__q")
        same = (F.col("__cell") == F.col("__at")) & (F.col("domain").eqNullSafe(F.col("__of")) if self.by_domain else F.lit(True))
        cg = self.rows.join(F.broadcast(places), same).withColumn("__c", part("chunk_id", "__parts")).select("chunk_id", "embedding", "place", "__block", "__c", every("__asks").alias("__q")).groupBy("__block", "__c", "__q")
        kind = lambda df, col: df.schema[col].dataType.simpleString()
        schema = f"query_id {kind(queries, 'query_id')}, chunk_id {kind(self.rows, 'chunk_id')}, similarity double"
        return qg.cogroup(cg).applyInPandas(_block(k, tile, max(1, query_numbers // self.dim), max(1, self.numbers // self.dim)), schema), counts

    def search(self, queries: DataFrame, k: int = 5, query_numbers: int = QUERY_NUMBERS, tile: int = TILE_SCORES, report: bool = True) -> tuple[DataFrame, dict]:
        """(hits: query_id, chunk_id, rank, score; report: pairs of query and cell, and of query and row, in all and visited).

        First every query meets the cells of best bound that hold k rows, which gives it a score to reach; then it
        meets the cells that may still beat it. Many queries are searched in rounds; the hits of a round are written and what it moved is released.
        """
        spark = queries.sparkSession
        q = usable(queries.select("query_id", "embedding", *(["domains"] if "domains" in queries.columns else [])), self.dim)
        asked = q.count()
        seen = {"queries": asked, "cells": len(self.n), "cell_pairs": asked * len(self.n), "row_pairs": asked * int(self.n.sum()), "cell_pairs_visited": 0, "row_pairs_visited": 0}
        rounds = max(1, -(-asked * self.dim // ROUND_NUMBERS))
        out = None
        for r in range(rounds):
            # another hash than that which deals queries to blocks
            some = q if rounds == 1 else q.filter(F.pmod(F.xxhash64("query_id", F.lit(rounds)), F.lit(rounds)) == r)
            found, visited = self._round(some, -(-asked // rounds), k, query_numbers, tile, not report and asked * self.dim <= query_numbers and asked * self.dim <= LEAST_BLOCK)
            for counts in visited:
                seen["cell_pairs_visited"] += sum(counts.values())
                seen["row_pairs_visited"] += int(sum(int(self.n[c]) * v for c, v in counts.items()))
            if found is not None:
                if len(self.centres) or rounds > 1:
                    found = durable(found)
                    release_shuffles(spark)
                out = found if out is None else out.unionByName(found)
        if out is None:
            kind = lambda df, col: df.schema[col].dataType.simpleString()
            out = spark.createDataFrame([], f"query_id {kind(q, 'query_id')}, chunk_id {kind(self.rows, 'chunk_id')}, rank int, similarity double")
        return out.select("query_id", "chunk_id", "rank", F.round("similarity", 4).alias("score")), seen

    def _round(self, q: DataFrame, asked: int, k: int, query_numbers: int, tile: int, few: bool) -> tuple[DataFrame | None, list[dict]]:
        """(hits with rank and similarity of some queries, queries per cell of each phase that was counted)."""
        near = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
        first_ones = lambda df: df.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
        found, first = self._phase(q, asked, k, False, query_numbers, tile, few)
        if found is None:
            return None, []
        found, second = first_ones(found), {}
        if len(self.centres):
            found = durable(found)
            reached = found.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
            more, second = self._phase(q.join(reached, "query_id", "left"), asked, k, True, query_numbers, tile, few)
            if more is not None:
                found = first_ones(found.drop("rank").unionByName(more))
        return found, [] if few else [first, second]


def knn(queries: DataFrame, corpus: DataFrame, k: int = 5, dim: int | None = None, query_numbers: int = QUERY_NUMBERS, cell_numbers: int = CELL_NUMBERS,
        tile: int = TILE_SCORES, cells: int | None = None) -> DataFrame:
    """The k most similar corpus rows of every query by cosine: query_id, chunk_id, rank, score.

    ``queries``: query_id, embedding[, domains array]; ``corpus``: chunk_id, embedding[, domain].
    Exact, ties by chunk_id; cells that cannot hold a hit are skipped (``Index``). What is visited is cut into blocks of bounded size
    on both sides; a task compares ``query_numbers`` with ``cell_numbers`` and holds one tile of scores at a time, so no task grows with a
    cell, with the queries that visit it or with the dimension. Vectors that do not have ``dim`` finite numbers (by default the corpus's most frequent size) are left out on
    both sides; ``left_out`` counts them.
    """
    if "domains" not in queries.columns:
        corpus = corpus.select("chunk_id", "embedding")
    return Index(corpus, dim, cells, cell_numbers).search(queries, k, query_numbers, tile, report=False)[0]


def search_results(hits: DataFrame, queries: DataFrame, chunks: DataFrame, longest: int = 500) -> DataFrame:
    """Hits with the query, its detected language and the chunk's fields; texts cut for display."""
    from corpusframe.functions.language import query_language
    q = query_language(queries.select("query_id", "query"), "query").withColumnRenamed("language", "query_language")
    cut = F.when(F.length("text") > longest, F.concat(X.at_most(F.col("text"), longest), F.lit("..."))).otherwise(F.col("text"))
    return hits.join(q, "query_id").join(chunks, "chunk_id").withColumn("text", cut)


def confidence_band(queries: DataFrame, hits: DataFrame, bands=R.CONFIDENCE_BANDS) -> DataFrame:
    top = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    j = queries.select("query_id").join(top, "query_id", "left")
    c: Column = F.when(F.col("top_score").isNull(), F.lit("none"))
    for name, least in bands:
        c = c.when(F.col("top_score") >= least, F.lit(name))
    return j.withColumn("band", c.otherwise(F.lit("none")))
