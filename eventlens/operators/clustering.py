"""Time-ordered event clustering (C-4, C-5, C-7, C-10), exact and distributed.

Sequential rule being reproduced: articles are taken in (published, id)
order; an article joins the active cluster (last update within ``window``
hours, source not yet in the cluster) whose centroid is most similar, when
that cosine is > ``threshold`` (earliest-created cluster wins ties);
otherwise it starts a new cluster.

Distributed plan.  The order is cut into chunks of bounded size (``2 * block_rows`` articles); a chunk takes two steps:

  1. search: its articles meet all live clusters (last update within the window) as they
     stood before the chunk, dealt over up to ``SEARCH_TASKS`` tasks that each work on
     ``block_rows`` states at a time, one matrix product each.  Only the best ``CANDIDATES``
     clusters of an article leave a task.  All the quadratic work is here, and every article
     meets every live cluster once.
  2. resolve: one task applies the rule in order.  An article meets the clusters that the chunk
     has changed so far, with their states of that moment, and of all others, whose states
     stand, the best candidate.  If all candidates have changed and a cluster beyond them could still win, the
     chunk ends before that article, and the next one begins there.  The first
     article of a chunk is always decided.

So the passes over the articles follow their number and not the depth of their decisions, and a task
holds a chunk and its candidates, whatever the length of the archive.

Each chunk's labels and changed states are written as a table in the shared checkpoint folder
(``spark.checkpoint.dir``) and read back; every ``COMPACT`` chunks the live states are written as one
table.  The lineage never grows and a lost executor recomputes at most one chunk.
"""
from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.dates import parse_ntz
from ..session import materialize
from .upserts import next_ids
from .similarity import epoch_us, has_content, to_double, unit_matrix_fn

HOUR_US = 3_600_000_000


def prepare(articles: DataFrame, time_col: str = "published_at", source_col: str = "source_id",
            vec_col: str = "embedding", fmt: str = "yyyy-MM-dd HH:mm:ss") -> tuple[DataFrame, DataFrame]:
    """B-12 + C-5: clusterable rows (id, src, t_us, vec) and the rejects (id, reason).

    Rows without content or without a strictly parseable date are rejected (Q-9)."""
    t = parse_ntz(time_col, fmt)
    base = articles.select(
        F.col("id").cast("long").alias("id"), F.col(source_col).cast("string").alias("src"),
        epoch_us(t).alias("t_us"), to_double(vec_col).alias("vec"),
        has_content("headline", "description").alias("_ok"))
    reason = (F.when(~F.col("_ok"), F.lit("empty content"))
              .when(F.col("t_us").isNull(), F.lit("unparseable date"))
              .when(F.col("vec").isNull(), F.lit("no vector")))
    rejects = base.select("id", reason.alias("reason")).filter(F.col("reason").isNotNull())
    good = base.filter(F.col("_ok") & F.col("t_us").isNotNull() & F.col("vec").isNotNull()).drop("_ok")
    return good, rejects


STATE_SCHEMA = ("label long, first_t long, first_id long, id long, t_us long, next_t long, next_id long, "
                "vec array<double>, srcs array<string>, k int")
BEST_SCHEMA = "id long, label long, cos double, first_t long, first_id long"


def cluster_states(labels: DataFrame, points: DataFrame, buckets: int = 8) -> DataFrame:
    """A row per counting member of each label of given ``labels``, with the cluster's state after it.

    ``srcs`` lists the label's sources in the order of joining; the first ``k`` are in.  Labels are
    dealt to ``buckets`` by a hash; a task works on a bucket's labels together."""
    counting = labels.groupBy("label", "src").agg(F.min(F.struct("t_us", "id")).alias("m")) \
        .select("label", "src", "m.t_us", "m.id").join(points.select("id", "vec"), "id")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "t_us", "id"], kind="stable")
        label, t, i = (pdf[c].to_numpy() for c in ("label", "t_us", "id"))
        starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        sizes = np.diff(np.r_[starts, len(label)])
        sums = np.stack(pdf["vec"].to_list()).astype(np.float64)
        src = pdf["src"].tolist()
        srcs = []
        for s, n in zip(starts.tolist(), sizes.tolist()):
            if n > 1:
                sums[s:s + n] = np.cumsum(sums[s:s + n], axis=0)
            srcs += [src[s:s + n]] * n
        last = np.zeros(len(label), dtype=bool)
        last[starts + sizes - 1] = True
        following = lambda x: pd.Series(pd.arrays.IntegerArray(np.r_[x[1:], 0].astype(np.int64), last))
        return pd.DataFrame({
            "label": label, "first_t": np.repeat(t[starts], sizes), "first_id": np.repeat(i[starts], sizes), "id": i, "t_us": t,
            "next_t": following(t), "next_id": following(i), "vec": list(sums), "srcs": srcs,
            "k": (np.arange(len(label)) - np.repeat(starts, sizes) + 1).astype(np.int32)})

    return counting.groupBy(F.pmod(F.xxhash64("label"), F.lit(buckets)).alias("bucket")).applyInPandas(states, STATE_SCHEMA)


def band_of(window_hours: float) -> Column:
    """Time bands of width W: a state that an article may join lies in its own or the previous band."""
    return F.floor(F.col("t_us") / F.lit(max(int(window_hours * HOUR_US), HOUR_US))).cast("long").alias("band")


RESULT_SCHEMA = "kind string, id long, label long, score double, first_t long, last_t long, vec array<double>, srcs array<string>"
BLOCK_SCHEMA = RESULT_SCHEMA + ", art binary, labels binary, cosines binary, full binary"
#: Candidates that an article brings along from the states before its chunk, tasks that search them, chunks between two compactions.
CANDIDATES, SEARCH_TASKS, COMPACT = 32, 24, 8


def _search(threshold: float, window_us: int, block_rows: int, wanted: int):
    """Step 1, a task: the chunk's articles against a share of the live states, ``block_rows`` at a time.

    Gives the states that are a candidate of any article, and one packed row: (article's place, label, cosine) of each article's
    best ``wanted`` states by (cosine desc, first member asc), and whether the article had more."""
    unit = unit_matrix_fn()

    def run(art: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "id", "label", "score", "first_t", "last_t", "vec", "srcs", "art", "labels", "cosines", "full"]
        if not len(art) or not len(st):
            return pd.DataFrame(columns=columns)
        art = art.sort_values("n", kind="stable")
        st = st.sort_values(["first_t", "label"], kind="stable").reset_index(drop=True)
        u, at = unit(art["vec"]), art["t_us"].to_numpy()[:, None]
        code: dict = {}
        own = np.array([code.setdefault(s, len(code)) for s in art["src"]])
        full = np.zeros(len(art), dtype=bool)
        rows, cols, cosines = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for first in range(0, len(st), block_rows):
            part = st.iloc[first:first + block_rows]
            has = np.zeros((len(code), len(part)), dtype=bool)
            for k, srcs in enumerate(part["srcs"]):
                has[[code[s] for s in srcs if s in code], k] = True
            cos = u @ unit(part["vec"]).T
            with np.errstate(invalid="ignore"):
                ok = (cos > threshold) & (at - part["last_t"].to_numpy()[None, :] <= window_us) & ~has[own]
            r, c = np.nonzero(ok)
            rows, cols, cosines = np.r_[rows, r], np.r_[cols, c + first], np.r_[cosines, cos[r, c]]
            order = np.lexsort((cols, -cosines, rows))  # among equals the first place wins
            rows, cols, cosines = rows[order], cols[order], cosines[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            full[rows[rank >= wanted]] = True
            keep = rank < wanted
            rows, cols, cosines = rows[keep], cols[keep], cosines[keep]
        label = st["label"].to_numpy(dtype=np.int64)
        out = st.iloc[np.unique(cols)][["label", "first_t", "last_t", "vec", "srcs"]].assign(kind="state")
        packed = pd.DataFrame({"kind": ["packed"], "art": [rows.astype(np.int64).tobytes()], "labels": [label[cols].tobytes()],
                               "cosines": [cosines.tobytes()], "full": [full.tobytes()]})
        out = pd.concat([out, packed]).reindex(columns=columns).astype(object)
        return out.where(out.notna(), None)

    return run


def _resolve(threshold: float, window_us: int, wanted: int):
    """Step 2, one task: the sequential rule over a chunk, whose articles meet the clusters that the chunk has changed so far
    and, of the others, the best candidate of step 1.  Ends early at an article whose candidates have all changed, if a
    state that is not among them could win; the next chunk begins there."""
    unit = unit_matrix_fn()

    def run(art: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        art = art.sort_values("n", kind="stable")
        ids, t, src = art["id"].tolist(), art["t_us"].tolist(), art["src"].tolist()
        v, u = np.stack([np.asarray(x, dtype=np.float64) for x in art["vec"]]), unit(art["vec"])
        packed = found[found["kind"] == "packed"]
        states = found[found["kind"] == "state"]
        before = {r[0]: r[1:] for r in zip(states["label"].astype("int64").tolist(), states["first_t"].astype("int64").tolist(),
                                           states["vec"], states["srcs"])}
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in packed[c]]) if len(packed) else np.empty(0, kind)
        rows, labels, cosines = read("art", np.int64), read("labels", np.int64), read("cosines", np.float64)
        full = np.zeros(len(art), dtype=bool)
        for x in packed["full"]:
            full |= np.frombuffer(x, bool)
        first_t = np.array([before[x][0] for x in labels.tolist()], dtype=np.int64)
        order = np.lexsort((labels, first_t, -cosines, rows))
        rows, labels, cosines = rows[order], labels[order], cosines[order]
        starts = np.searchsorted(rows, np.arange(len(art) + 1))
        full |= np.diff(starts) > wanted
        labels = labels.tolist()
        n, d = v.shape
        sums, units, last = np.zeros((n, d)), np.zeros((n, d)), np.zeros(n, dtype=np.int64)
        code: dict = {}
        own = [code.setdefault(s, len(code)) for s in src]
        has = np.zeros((len(code), n), dtype=bool)
        place: dict[int, int] = {}  # label -> row of the changed clusters
        key, members, out = [], [], []
        # the same sums for every row, so equal vectors have equal cosines
        cosine = lambda m, x: np.einsum("ij,j->i", m, x)
        for i in range(n):
            best, where, count = (-np.inf, 0, 0), None, len(key)
            if count:
                cos = cosine(units[:count], u[i])
                with np.errstate(invalid="ignore"):
                    cos = np.where((cos > threshold) & (t[i] - last[:count] <= window_us) & ~has[own[i], :count], cos, -np.inf)
                top = cos.max()
                if top > -np.inf:
                    where = min(np.flatnonzero(cos == top).tolist(), key=key.__getitem__)
                    best = (float(top), -key[where][0], -key[where][1])
            mine = range(starts[i], min(starts[i + 1], starts[i] + wanted))
            fresh = next((k for k in mine if labels[k] not in place), None)
            if fresh is None:
                if full[i] and best[0] <= cosines[mine[-1]] + 1e-9:
                    break  # never the first article: nothing has changed yet
            else:
                label = labels[fresh]
                began, vec, srcs = before[label]
                total = np.asarray(vec, dtype=np.float64)
                cos = float(cosine(unit([total]), u[i])[0])
                if (cos, -began, -label) > best:
                    best, where = (cos, -began, -label), count
                    place[label] = count
                    key.append((began, label)), members.append(list(srcs))
                    sums[count] = total
                    has[[code[s] for s in srcs if s in code], count] = True
            if where is None:  # a cluster of its own
                where, score = count, 1.0
                place[ids[i]] = count
                key.append((t[i], ids[i])), members.append([])
            else:
                score = best[0]
            sums[where] += v[i]
            units[where] = unit([sums[where]])[0]
            last[where] = t[i]
            has[own[i], where] = True
            members[where].append(src[i])
            out.append((ids[i], key[where][1], score))
        decided = pd.DataFrame(out, columns=["id", "label", "score"]).assign(kind="article")
        changed = pd.DataFrame({"kind": "state", "label": [k[1] for k in key], "first_t": [k[0] for k in key], "last_t": last[:len(key)],
                                "vec": list(sums[:len(key)]), "srcs": members})
        done = pd.concat([decided, changed]).reindex(columns=["kind", "id", "label", "score", "first_t", "last_t", "vec", "srcs"]).astype(object)
        return done.where(done.notna(), None)

    return run


def cluster_labels(points: DataFrame, threshold: float = fx.SIMILARITY_THRESHOLD,
                   window_hours: float = fx.TIME_WINDOW_HOURS,
                   block_rows: int = 2048, stats: dict | None = None) -> DataFrame:
    """C-4 over prepared points (id, src, t_us, vec): (id, label, score), label = first member id.

    Rows that repeat an id are one article; a null id stays alone and takes no part."""
    spark, window_us, chunk = points.sparkSession, int(window_hours * HOUR_US), 2 * block_rows
    pts = materialize(points, "c4-points")
    one = pts.filter("id is not null").groupBy("id").agg(F.min(F.struct("t_us", "src", "vec")).alias("p")).select("id", "p.*")
    arts = materialize(next_ids(one, spark.range(0).withColumnRenamed("id", "n"), ["t_us", "id"], col="n"), "c4-order")
    total = arts.count()
    no_states = [F.lit(None).cast(kind).alias(c) for c, kind in (f.split(" ") for f in RESULT_SCHEMA.split(", "))]
    results, base, recent = None, spark.range(0).select(*no_states), []
    done = chunks = 0
    while done < total:
        chunks += 1
        part = arts.filter(F.col("n").between(done + 1, done + chunk))
        begin = part.agg(F.min("t_us")).scalar()
        live = _newest(base, recent).filter(F.col("last_t") >= begin - window_us)
        tasks = min(SEARCH_TASKS, -(-done // block_rows)) or 1  # there are no more states than articles
        dealt = live.withColumn("task", F.pmod(F.xxhash64("label"), F.lit(tasks)).cast("int"))
        asked = part.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        found = asked.groupBy("task").cogroup(dealt.groupBy("task")).applyInPandas(
            _search(threshold, window_us, block_rows, CANDIDATES), BLOCK_SCHEMA)
        one_chunk = F.lit(chunks).alias("chunk")
        made = part.groupBy(one_chunk).cogroup(found.groupBy(one_chunk)).applyInPandas(
            _resolve(threshold, window_us, CANDIDATES), RESULT_SCHEMA)
        made = materialize(made, "c4-chunk")
        recent.append(made)
        done += made.filter("kind = 'article'").count()
        if len(recent) == COMPACT or done == total:
            kept = functools.reduce(DataFrame.unionByName, recent).filter("kind = 'article'")
            results = kept if results is None else results.unionByName(kept)
            if done < total:
                base, recent = materialize(_newest(base, recent).filter(F.col("last_t") >= begin - window_us), "c4-states"), []
    if stats is not None:
        stats["chunks"] = chunks
    own = pts.select("id")
    if results is None:
        return own.select("id", F.col("id").alias("label"), F.lit(1.0).alias("score"))
    return own.join(results.select("id", "label", "score"), "id", "left").select(
        "id", F.coalesce("label", "id").alias("label"), F.coalesce("score", F.lit(1.0)).alias("score"))


def _newest(base: DataFrame, recent: list[DataFrame]) -> DataFrame:
    """The states after the chunks ``recent``: of each label the latest one.  Only the chunks' own states are grouped."""
    if not recent:
        return base
    later = functools.reduce(DataFrame.unionByName, [r.filter("kind = 'state'").withColumn("at", F.lit(k)) for k, r in enumerate(recent)])
    later = later.groupBy("label").agg(F.max_by(F.struct(*[c for c in base.columns if c != "label"]), "at").alias("s")).select("label", "s.*")
    return base.join(later.select("label"), "label", "left_anti").select(*base.columns).unionByName(later.select(*base.columns))


def event_clusters(articles: DataFrame, threshold: float = fx.SIMILARITY_THRESHOLD,
                   window_hours: float = fx.TIME_WINDOW_HOURS,
                   block_rows: int = 2048, **prep) -> DataFrame:
    """C-4 + link rows: (cluster_id, article_id, similarity_score)."""
    pts, _ = prepare(articles, **prep)
    lab = cluster_labels(pts, threshold, window_hours, block_rows)
    return lab.select(F.col("label").alias("cluster_id"), F.col("id").alias("article_id"),
                      F.col("score").alias("similarity_score"))


def materialize_clusters(links: DataFrame, articles: DataFrame, created_at: Column | None = None) -> DataFrame:
    """C-7: cluster rows from links: title and published_at of the first article (the label
    itself), number_of_sources = distinct sources."""
    a = articles.select(F.col("id").alias("article_id"), "headline", "published_at", "source_id")
    j = links.join(a, "article_id")
    first = j.filter(F.col("cluster_id") == F.col("article_id")).select(
        "cluster_id", F.coalesce("headline", F.lit("Event Cluster")).alias("title"), "published_at")
    n = j.groupBy("cluster_id").agg(F.count_distinct("source_id").alias("number_of_sources"))
    out = first.join(n, "cluster_id").withColumnRenamed("cluster_id", "id")
    if created_at is not None:
        out = out.withColumn("created_at", created_at)
    return out
