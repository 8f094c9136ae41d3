"""Exact top-k cosine search of many queries against a vector table.

Plan (no cross join, no pair rows):

1. Each corpus row is published under the routing keys the queries can ask
   for (``all``; ``store`` = its store; ``date`` = its date).  A query is
   routed to one key: its store filter, else its date filter, else ``all``.
2. Per routing key, the corpus is cut into ``ceil(n / block_rows)`` blocks
   and the queries into ``ceil(q / qblock_rows)`` blocks (hash of id), so a
   hot key (one store holding a third of the rows) becomes many cells.
3. Queries are copied to every corpus block of their key and corpus rows to
   every query block: a (key, query block, corpus block) cell holds at most
   ``qblock_rows x block_rows`` scores.
4. ``cogroup.applyInPandas`` scores a cell as matrix products over chunks of
   ``SCORE_CHUNK`` queries and emits only each query's local top-k (ties
   broken by id).  The remaining filter
   columns (e.g. the date when routed by store) are applied in the cell.
5. A window per query keeps the global top-k of its candidates (at most
   k x corpus blocks rows per query).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.operators.joins import broadcast_if_small

BLOCK_ROWS = 4096       # corpus rows per cell
QBLOCK_ROWS = 8192      # query rows per cell (corpus rows are copied once per query block)
SCORE_CHUNK = 256       # queries scored at once inside a cell (bounds the score matrix)
ALL = "all"


def _unit_rows(vecs: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(vecs, axis=1)
    out = np.zeros_like(vecs)
    nz = n > 0
    out[nz] = vecs[nz] / n[nz, None]
    return out


def _top_in_cell(k: int, match: Sequence[tuple[str, str]], carry: Sequence[str],
                 chunk: int = SCORE_CHUNK):
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        cols = ["qid", "id", "score", *carry]
        if q.empty or c.empty:
            empty = q[["qid"]].iloc[[]].reset_index(drop=True)
            empty["id"] = c["id"].iloc[[]].reset_index(drop=True) if "id" in c else pd.Series([], dtype=object)
            empty["score"] = pd.Series([], dtype="float64")
            for n in carry:
                empty[n] = c[n].iloc[[]].reset_index(drop=True) if n in c else pd.Series([], dtype=object)
            return empty[cols]
        qv = _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in q["qvec"]]))
        cv = _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in c["values"]]))
        id_rank = np.unique(c["id"].to_numpy().astype(str), return_inverse=True)[1]
        cvals = {ccol: c[ccol].to_numpy() for _, ccol in match}
        kk = min(k, cv.shape[0])
        q_rows, c_rows, out_s = [], [], []
        # Score the cell's queries in chunks, so the score matrix held at once is
        # at most ``chunk`` x corpus block whatever the query block size.
        for lo in range(0, qv.shape[0], chunk):
            scores = qv[lo:lo + chunk] @ cv.T
            for qcol, ccol in match:
                qval = q[qcol].to_numpy()[lo:lo + chunk]
                has = pd.notna(qval)
                if has.any():
                    scores[(qval[:, None] != cvals[ccol][None, :]) & has[:, None]] = -np.inf
            # Everything at or above a query's k-th score, ties included; then
            # order by (query, score desc, id) and keep the first k of each.
            kth = np.partition(scores, scores.shape[1] - kk, axis=1)[:, scores.shape[1] - kk]
            r, at = np.nonzero((scores >= kth[:, None]) & np.isfinite(scores))
            s = scores[r, at]
            order = np.lexsort((id_rank[at], -s, r))
            r, at, s = r[order], at[order], s[order]
            sel = np.arange(len(r)) - np.searchsorted(r, r) < kk
            q_rows.append(lo + r[sel])
            c_rows.append(at[sel])
            out_s.append(s[sel])
        q_rows, c_rows, out_s = (np.concatenate(x) for x in (q_rows, c_rows, out_s))
        # slice the typed inputs so empty results keep their column types
        res = q[["qid"]].iloc[q_rows].reset_index(drop=True)
        picked = c[["id", *carry]].iloc[c_rows].reset_index(drop=True)
        res["id"] = picked["id"]
        res["score"] = pd.Series(out_s, dtype="float64")
        for n in carry:
            res[n] = picked[n]
        return res[cols]
    return fn


def route_corpus(corpus: DataFrame, routes: Sequence[str]) -> DataFrame:
    """Publish each corpus row under ``all`` and under each routing column."""
    keys = [F.struct(F.lit(ALL).alias("rkind"), F.lit("").alias("rval"))]
    keys += [F.struct(F.lit(r).alias("rkind"), F.col(r).cast("string").alias("rval")) for r in routes]
    return corpus.select("*", F.inline(F.array(*keys))).where(F.col("rval").isNotNull())


def route_queries(queries: DataFrame, routes: Sequence[tuple[str, str]]) -> DataFrame:
    """Route each query by its first non-null filter (query column, corpus
    routing column); no filter routes to ``all``."""
    kind = F.lit(ALL)
    val = F.lit("")
    for qcol, rname in reversed(routes):
        kind = F.when(F.col(qcol).isNotNull(), F.lit(rname)).otherwise(kind)
        val = F.when(F.col(qcol).isNotNull(), F.col(qcol).cast("string")).otherwise(val)
    return queries.select("*", kind.alias("rkind"), val.alias("rval"))


def topk(queries: DataFrame, corpus: DataFrame, k: int,
         filters: Sequence[tuple[str, str]] = (), carry: Sequence[str] = (),
         block_rows: int = BLOCK_ROWS, qblock_rows: int = QBLOCK_ROWS,
         score_chunk: int = SCORE_CHUNK) -> DataFrame:
    """Top-``k`` corpus rows per query by cosine similarity.

    queries: ``qid``, ``qvec`` (array) and one nullable column per filter.
    corpus: ``id`` (string), ``values`` (array) and the filtered columns.
    filters: ``(query column, corpus column)`` equality filters, ANDed; null
    in the query means no filter.  The first filter present routes the query.
    A query without a vector has no matches; a corpus row without one is no match.
    Returns ``qid, id, score, rank, *carry`` with rank 1..k.
    """
    fcols = [c for _, c in filters]
    rc = route_corpus(corpus.where(F.col("values").isNotNull()).select("id", "values", *dict.fromkeys([*fcols, *carry])), fcols)
    rq = route_queries(queries.where(F.col("qvec").isNotNull()).select("qid", "qvec", *[q for q, _ in filters]), list(filters))

    key = ["rkind", "rval"]
    ccount = rc.groupBy(*key).agg(F.count(F.lit(1)).alias("_cn"))
    qcount = rq.groupBy(*key).agg(F.count(F.lit(1)).alias("_qn"))
    # One row per filter value that some query asks for.  Cut from its lineage
    # once and broadcast after a size check, so the corpus and the queries go
    # straight to the cell exchange and routes no query uses are never shuffled.
    info = broadcast_if_small(ccount.join(qcount, key).select(
        *key, F.ceil(F.col("_cn") / block_rows).cast("int").alias("_cb_n"),
        F.ceil(F.col("_qn") / qblock_rows).cast("int").alias("_qb_n")).checkpoint(eager=True))

    c = (rc.join(info, key)
           .withColumn("_cb", F.pmod(F.xxhash64("id"), F.col("_cb_n")).cast("int"))
           .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_qb_n") - 1))))
    q = (rq.join(info, key)
           .withColumn("_qb", F.pmod(F.xxhash64("qid"), F.col("_qb_n")).cast("int"))
           .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_cb_n") - 1))))
    cell = [*key, "_qb", "_cb"]

    cschema = {f.name: f.dataType for f in corpus.schema.fields}
    qtype = queries.schema["qid"].dataType
    out_schema = T.StructType(
        [T.StructField("qid", qtype), T.StructField("id", T.StringType()),
         T.StructField("score", T.DoubleType())]
        + [T.StructField(n, cschema[n]) for n in carry])
    fn = _top_in_cell(k, [(qc, cc) for qc, cc in filters], list(carry), score_chunk)
    cand = (q.select(*cell, "qid", "qvec", *[qc for qc, _ in filters]).groupBy(*cell)
             .cogroup(c.select(*cell, "id", "values", *dict.fromkeys([*fcols, *carry])).groupBy(*cell))
             .applyInPandas(fn, out_schema))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
