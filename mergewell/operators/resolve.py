"""Deciding a whole batch at once as if record after record had been handled.

A record is matched against the catalog, the products that earlier records inserted, and products as
earlier records changed them.  The state of a run is which records insert and when products change.
Starting from no state, all records are decided in parallel under the state so far, and the decisions
imply the next state, until it stays the same.  Dependencies only point to earlier records, so a state
that implies itself is the one of the sequential run, and each round settles at least one record more.
Records that are known to fail when they are written are decided too, but change nothing for the others.

All that is searched is searched once for an identity, whatever the number of its records.  The catalog is
searched once, and the rest of it again for identities whose best match was touched.  Of the products that the
run has touched, a round looks at the versions that the last one didn't know; only identities that had one that
is gone look at all of them.  Which version is the best changes with the records' order, so an identity has
spans.  Versions with one identity have one vector, so only the product that comes first among them is compared.

Rounds don't read records.  Those that decide alike (one identity, one offer) are a row with the places that they
have in the order, in bounded chunks, and a span of an identity takes its part of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import text, vectors
from mergewell.operators import links as link_ops
from mergewell.operators import search, similarity, updates
from mergewell.operators.embed import Embedder, embed_distinct
from mergewell.schemas import CHANGES, FLAGS
from mergewell.sources.vector_store import VectorStore
from mergewell.workspace import by_rows, discard, materialize

NEVER = (1 << 62) - 1
#: A row of places spans at most so many records, as a power of two.
CHUNK_BITS = 20
#: The score of no match at all, below every cosine.
NOTHING = -2.0
REJECTED = ("record_index", "seller_name", "seller_product_id", "name", "brand", "category", "identity", "reason", "flags")
TOUCHED = (
    "pid long, name string, base_brand string, base_category string, born long, "
    "brand_at long, brand_new string, category_at long, category_new string"
)


def _versions(touched: DataFrame) -> DataFrame:
    """``pid, after, until, identity``: for which records each version of a touched product counts."""
    never = F.lit(NEVER)
    first = F.least(F.coalesce("brand_at", never), F.coalesce("category_at", never))
    last = F.greatest(F.coalesce("brand_at", F.lit(-1)), F.coalesce("category_at", F.lit(-1)))
    steps = F.array(
        F.struct(F.col("born").alias("after"), first.alias("until")),
        F.when(first < never, F.struct(first.alias("after"), F.when(last > first, last).otherwise(never).alias("until"))),
        F.when((first < never) & (last > first), F.struct(last.alias("after"), never.alias("until"))),
    )
    each = touched.withColumn("_v", F.explode(F.filter(steps, lambda s: s.isNotNull()))).select("*", "_v.after", "_v.until")
    then = lambda f: F.when(F.col(f"{f}_at") <= F.col("after"), F.col(f"{f}_new")).otherwise(F.col(f"base_{f}"))
    return each.select("pid", "after", "until", text.identity(F.col("name"), then("brand"), then("category")).alias("identity"))


def _steps(score: np.ndarray, after: np.ndarray, until: np.ndarray) -> list[tuple[int, int, int]]:
    """``version, after, until``: which version is the best one in which records; of equal ones the first."""
    out, gaps = [], [(-1, NEVER)]
    while gaps:
        low, high = gaps.pop()
        open_ = np.where((after < high) & (until > low), score, -np.inf)
        k = int(open_.argmax()) if len(open_) else 0
        if not len(open_) or open_[k] == -np.inf:
            continue
        a, b = max(low, int(after[k])), min(high, int(until[k]))
        if a < b:
            out.append((k, a, b))
        gaps += [gap for gap in ((low, a), (b, high)) if gap[0] < gap[1]]
    return out


def _first_open(pids: np.ndarray, after: np.ndarray, until: np.ndarray) -> list[tuple[int, int, int]]:
    """``pid, after, until``: the smallest of the open products at any time, of which one may have several versions."""
    order = np.argsort(after, kind="stable")
    bounds = np.unique(np.concatenate([after, until]))
    out, heap, k = [], [], 0
    for t, then in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        while k < len(order) and after[order[k]] <= t:
            heapq.heappush(heap, (int(pids[order[k]]), int(until[order[k]])))
            k += 1
        while heap and heap[0][1] <= t:
            heapq.heappop(heap)
        if heap:
            if out and out[-1][0] == heap[0][0] and out[-1][2] == t:
                out[-1] = (out[-1][0], out[-1][1], then)
            else:
                out.append((heap[0][0], t, then))
    return out


def _distinct_versions(versions: DataFrame, groups: int) -> DataFrame:
    """``versions`` without those that are never the first of their identity; a later one stands behind the first."""

    def run(table: pa.Table) -> pa.Table:
        coded = table.column("identity").combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        pids, after, until = (table.column(c).to_numpy()[order] for c in ("pid", "after", "until"))
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        out, which = [], []
        for c, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            found = _first_open(pids[a:b], after[a:b], until[a:b])
            out += found
            which += [c] * len(found)
        columns = np.array(out, np.int64).reshape(-1, 3)
        return pa.table({"pid": columns[:, 0], "after": columns[:, 1], "until": columns[:, 2], "identity": coded.dictionary.take(pa.array(which, pa.int32()))})

    dealt = versions.select("pid", "after", "until", "identity").withColumn("_group", F.pmod(F.xxhash64("identity"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(lambda table: run(table.drop_columns(["_group"])), "pid long, after long, until long, identity string")


STEP_NAMES, STEP_KINDS = ("uid", "low", "high", "pid", "after", "until", "score"), (np.int64,) * 6 + (np.float32,)
STEPS = "uid long, low long, high long, pid long, after long, until long, score float"


def _best_versions(queries: DataFrame, versions: DataFrame, extents: tuple[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """``STEPS`` of every ``uid, vector``: the best version for records after ``low`` up to ``high``, in each pair of blocks.

    All records of an identity share its steps, so the work doesn't grow with how many there are.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by([("pid", "ascending"), ("after", "ascending")])
            pids, after, until = (right.column(c).to_numpy() for c in ("pid", "after", "until"))
            uids, other, v = left.column("uid").to_numpy(), similarity.matrix(right, "other"), similarity.matrix(left)
            for i in range(0, len(uids), similarity.STEP):
                s = similarity.scores(v[i : i + similarity.STEP], other)
                s = np.where(np.isfinite(s), s, np.float32(-np.inf))
                for uid, row in zip(uids[i : i + similarity.STEP], s):
                    found = _steps(row, after, until)
                    if found:
                        k, low, high = (np.array(c) for c in zip(*found))
                        out.append((np.full(len(k), uid), low, high, pids[k], after[k], until[k], row[k]))
        return similarity._table(out, STEP_NAMES, STEP_KINDS)

    return similarity.paired(queries.select("uid", "vector"), versions.withColumnRenamed("vector", "other"), ("uid", "pid"), run, STEPS, extents)


def _merged(steps: DataFrame, groups: int) -> DataFrame:
    """``STEPS`` of several sources as one for every ``uid``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("uid", "ascending"), ("pid", "ascending"), ("low", "ascending")])
        columns = [table.column(c).to_numpy() for c in STEP_NAMES]
        uids, starts = np.unique(columns[0], return_index=True)
        out = []
        for a, b in zip(starts, [*starts[1:], len(columns[0])]):
            _, low, high, pids, after, until, score = (c[a:b] for c in columns)
            k, low, high = (np.array(c) for c in zip(*_steps(score, low, high)))
            out.append((columns[0][a:b][k], low, high, pids[k], after[k], until[k], score[k]))
        return similarity._table(out, STEP_NAMES, STEP_KINDS)

    dealt = steps.withColumn("_group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(lambda table: run(table.drop_columns(["_group"])), STEPS)


class Resolver:
    """Decides ``records`` against ``products`` and ``links``."""

    def __init__(
        self, records: DataFrame, products: DataFrame, links: DataFrame, embedder: Embedder, threshold: float, mode: str,
        cache: DataFrame | None = None, store: VectorStore | None = None, failing: DataFrame | None = None,
    ):
        self.threshold, self.mode, self.embedder, self.cache, self.store = threshold, updates.check_mode(mode), embedder, cache, store
        self.spark, self.products = records.sparkSession, products
        # inserted products are numbered from here while the run is being decided: after every id in use, in record order
        ids = products.select("id").unionByName(links.select(F.col("product_id").alias("id")))
        self.inserted = max(0, ids.agg(F.max("id")).first()[0] or 0) + 1
        self.rejected = materialize(records.filter("reason is not null").select(*REJECTED), "rejected")  # few, so that the run's results don't need ``records``
        accepted = records.filter("reason is null")
        if failing is None:
            none = F.lit(None).cast("string")
            accepted = accepted.withColumns({"fails": F.lit(False), "err_kind": none, "why": none})
        else:
            marked = by_rows(failing).select("record_index", F.lit(True).alias("fails"), "err_kind", F.col("reason").alias("why"))
            accepted = accepted.join(marked, "record_index", "left").na.fill(False, ["fails"])
        good = link_ops.with_decider(link_ops.existing(accepted, links))  # both by key, so records are moved once for them
        own = F.when(F.col("linked_product").isNull(), F.col("_decider"))  # the identity that is searched for the record
        self.good = materialize(
            updates.mark_vocabulary(good, updates.vocabulary(products)).select(
                "record_index", *link_ops.KEY, "name", "brand", "category", "identity", "flags", "linked_product", "first_index", "in_vocabulary", "fails", "err_kind", "why", own.alias("uid")
            ),
            "accepted",
        )
        self.base = materialize(
            products.select(F.col("id").alias("pid"), "name", F.col("brand").alias("base_brand"), F.col("category").alias("base_category"))
            .withColumn("identity", text.identity(F.col("name"), F.col("base_brand"), F.col("base_category"))),
            "catalog",
        )
        firsts = materialize(self.good.filter("linked_product is null and record_index = first_index").select("identity").distinct(), "identities")
        self.vectors = self._embedded(firsts.unionByName(self.base.select("identity")))
        if store is None:  # a store's vectors are read where they lie
            self.vectors = materialize(self.vectors, "vectors")
        self.catalog = materialize(self._searched(self.base), "catalog-vectors")
        self.identities = materialize(firsts.join(self.vectors, "identity").select(F.xxhash64("identity").alias("uid"), "vector"), "queries")
        static = search.nearest(self.identities.select(F.col("uid").alias("id"), "vector"), self.catalog)
        self.rest_mark = self.rest = self.seen = None
        self.extent = self.identities.count(), embedder.dimension
        self.static = materialize(static.select(F.col("id").alias("uid"), F.col("match_id").alias("pid"), "score"), "static")
        self.places = materialize(self._places(), "places")
        if mode != "none":
            old = self._offers(self.good.filter("linked_product is not null and not fails and size(flags) = 0").withColumn("pid", F.col("linked_product")))
            self.offers_of_old = materialize(self._telling(old.join(self.base.select("pid", "base_brand", "base_category"), "pid")), "offers")

    def _places(self) -> DataFrame:
        """Records that are searched and don't fail, as rows of what they have in common and their ``spots``.

        A spot is the place of the record that decides, ``at``, and how much later the record itself comes.  ``own``:
        it decides for itself.  Flagged records offer nothing, so only those that may insert a product are there.
        """
        own, flagged = F.col("record_index") == F.col("first_index"), F.size("flags") > 0
        rows = self.good.filter("linked_product is null and not fails").withColumns({"own": own, "flagged": flagged})
        rows = rows.filter("own" if self.mode == "none" else "own or not flagged")
        spot = F.struct(F.col("first_index").alias("at"), (F.col("record_index") - F.col("first_index")).alias("later"))
        same = ["uid", F.when(F.col("own"), F.col("name")).alias("name"), "brand", "category", "in_vocabulary", "flagged", "own"]
        return rows.groupBy(*same, F.shiftright("first_index", CHUNK_BITS).alias("chunk")).agg(F.collect_list(spot).alias("spots")).drop("chunk")

    def _searched(self, bases: DataFrame) -> DataFrame:
        """``id, vector`` of the first product of each identity; no other with its vector is ever the best."""
        return bases.groupBy("identity").agg(F.min("pid").alias("id")).join(self.vectors, "identity").select("id", "vector")

    def _embedded(self, identities: DataFrame) -> DataFrame:
        """``identity, vector``: every embedded text carries the task prefix."""
        if self.store is not None:
            self.store.ensure(identities)
            return self.store.vectors(identities)
        texts = identities.select(text.prefixed(F.col("identity")).alias("text"))
        found = embed_distinct(texts, self.embedder, self.cache)
        return found.select(F.substring("text", len(text.TASK_PREFIX) + 1, 1 << 30).alias("identity"), "vector")

    def at_rest(self, touched: DataFrame) -> DataFrame:
        """``uid, pid, score``: the best match of every identity among the products that ``touched`` leaves alone."""
        own = touched.filter(F.col("pid") < self.inserted).select("pid")
        mark = own.agg(F.count("*"), F.sum(F.xxhash64("pid").cast("decimal(38,0)"))).first()
        if mark != self.rest_mark:
            stale = self.static.join(own, "pid", "left_semi").select("uid")
            fresh = self.static.join(own, "pid", "left_anti")
            if mark[0]:
                again = search.nearest(
                    self.identities.join(stale, "uid").select(F.col("uid").alias("id"), "vector"),
                    self._searched(self.base.join(own, "pid", "left_anti")),
                )
                fresh = fresh.unionByName(again.select(F.col("id").alias("uid"), F.col("match_id").alias("pid"), "score"))
            self.rest_mark, self.rest = mark, materialize(fresh, "fresh")
        return self.rest.filter("pid is not null")

    def moving(self, touched: DataFrame) -> DataFrame:
        """``STEPS`` of every identity among the versions of touched products, from what the last round found."""
        key = ["pid", "after", "until", "identity"]
        versions = materialize(_distinct_versions(_versions(touched), 8 + self.extent[0] // 1024), "versions")
        if self.store is not None:
            known = self._embedded(versions.select("identity"))
        else:
            new = versions.join(self.vectors, "identity", "left_anti").select("identity")
            known = self.vectors.unionByName(self._embedded(new))
        placed = materialize(versions.join(known, "identity").select(*key, "vector"), "moving")
        extents = self.extent, (versions.count(), self.embedder.dimension)
        if self.seen is None:
            parts = [_best_versions(self.identities, placed, extents)]
        else:
            before, found = self.seen
            gone = before.join(placed, key, "left_anti").select("pid", "after", "until")
            lost = materialize(found.join(gone, ["pid", "after", "until"], "left_semi").select("uid").distinct(), "lost")
            parts = [found.join(lost, "uid", "left_anti")]
            added = materialize(placed.join(before, key, "left_anti"), "added")
            if not added.isEmpty():
                parts.append(_best_versions(self.identities.join(lost, "uid", "left_anti"), added, extents))
            if not lost.isEmpty():
                parts.append(_best_versions(self.identities.join(lost, "uid", "left_semi"), placed, extents))
        steps = parts[0]
        for part in parts[1:]:
            steps = steps.unionByName(part)
        steps = materialize(_merged(steps, 8 + self.extent[0] // 1024), "steps")
        self.seen = placed.select(*key), steps
        return steps

    def plan(self, touched: DataFrame | None) -> DataFrame:
        """``uid, spans, lead``: what decides an identity's records under ``touched``, or with nothing touched yet.

        Spans ``low, high, pid, score`` cover all records; without any match ``pid`` and ``score`` are NULL.
        """
        always = {"low": F.lit(-1).cast("long"), "high": F.lit(NEVER), "after": F.lit(-1).cast("long"), "until": F.lit(NEVER)}
        rest = self.static.filter("pid is not null") if touched is None else self.at_rest(touched)
        rest = rest.withColumns(always).select(*STEP_NAMES)
        none = self.identities.select("uid").withColumns(always | {"pid": F.lit(NEVER), "score": F.lit(NOTHING).cast("float")}).select(*STEP_NAMES)
        steps = rest.unionByName(none) if touched is None else self.moving(touched).unionByName(rest).unionByName(none)
        best = _merged(steps, 8 + self.extent[0] // 1024)
        some = F.col("score") > NOTHING
        span = F.struct("low", "high", F.when(some, F.col("pid")).alias("pid"), F.when(some, F.col("score")).alias("score"))
        out = best.groupBy("uid").agg(F.collect_list(span).alias("spans"))
        return materialize(out.withColumn("lead", F.lit(None).cast("long")), "plan")

    def _parts(self, plan: DataFrame) -> DataFrame:
        """``places`` by the spans of their identities: ``pid, kind`` of the span and the spots ``inside`` it."""
        each = self.places.join(plan.select("uid", "lead", F.explode("spans").alias("span")), "uid")
        inside = F.filter("spots", lambda s: (s["at"] > F.col("span.low")) & (s["at"] <= F.col("span.high")))
        each = each.withColumns({"inside": inside, "kind": vectors.kind(F.col("span.score"), self.threshold), "pid": F.col("span.pid")})
        return each.filter(F.size("inside") > 0).drop("spots", "span")

    def guess(self, plan: DataFrame) -> DataFrame:
        """``plan`` with novel records of one identity following the first of them, ``lead``.

        A run may start from any state; this one is close to the last and small, however often a new
        product is offered.
        """
        novel = self._parts(plan).filter("own and kind = 'novel'")
        lead = novel.groupBy("uid").agg(F.min(F.array_min("inside.at")).alias("lead"))
        return materialize(plan.drop("lead").join(lead, "uid", "left"), "plan")

    def follow(self, plan: DataFrame) -> DataFrame:
        """Accepted records with their decider's ``score, kind`` and match ``match_pid``, the product ``pid`` that they end up with, and whether they insert it."""
        at = F.col("first_index")
        rows = self.good.join(plan, "uid", "left")
        rows = rows.withColumn("_best", F.get(F.filter("spans", lambda s: (s["low"] < at) & (at <= s["high"])), F.lit(0))).drop("spans")
        searched = F.col("linked_product").isNull()
        rows = rows.withColumn("score", F.col("_best.score")).withColumn("kind", F.when(searched, vectors.kind(F.col("score"), self.threshold)))
        follows = F.coalesce((F.col("kind") == "novel") & (at > F.col("lead")), F.lit(False))
        rows = rows.withColumn("match_pid", F.when(follows, F.col("lead") + self.inserted).otherwise(F.col("_best.pid")))
        rows = rows.withColumn("kind", F.when(follows, "duplicate").otherwise(F.col("kind")))
        rows = rows.withColumn("_pid", F.when(F.col("kind") == "novel", at + self.inserted).otherwise(F.col("match_pid")))
        new = searched & (F.col("kind") == "novel") & (at == F.col("record_index"))
        pid = F.when(~(new & F.col("fails")), F.coalesce("linked_product", "_pid"))
        return rows.withColumns({"pid": pid, "inserts": new & ~F.col("fails")}).drop("_pid", "_best", "lead")

    def _offers(self, matched: DataFrame) -> DataFrame:
        """The first record of all that offer a product the same; the others change nothing."""
        return matched.groupBy("pid", "brand", "category", "in_vocabulary").agg(F.min("record_index").alias("record_index"))

    def _telling(self, offers: DataFrame) -> DataFrame:
        """Those of ``offers``, with their products' fields, that differ from the product; the others change nothing in any mode."""
        differs = [~text.same_folded(F.col(f"base_{f}"), F.col(f)) for f in ("brand", "category")]
        return offers.filter(differs[0] | differs[1]).withColumn("flags", F.array().cast(FLAGS))

    def implied(self, plan: DataFrame) -> DataFrame:
        """The touched products that the records' products imply."""
        blank, changes = text.blank_to_null, {"brand_at": "long", "brand_new": "string", "category_at": "long", "category_new": "string"}
        parts = self._parts(plan)
        if self.mode != "none":
            parts = materialize(parts, "parts")
        alone = lambda s: F.col("lead").isNull() | (s["at"] <= F.col("lead"))
        novel = parts.filter("kind = 'novel'")
        single = novel.withColumn("spot", F.explode(F.filter("inside", alone))).withColumn("pid", F.col("spot.at") + self.inserted)
        born = single.filter("own").select(
            "pid", "name", blank(F.col("brand")).alias("base_brand"), blank(F.col("category")).alias("base_category"), F.col("spot.at").alias("born")
        )
        if self.mode == "none":
            return born.select("*", *[F.lit(None).cast(t).alias(c) for c, t in changes.items()])
        born = materialize(born, "born")
        kept = ["pid", "brand", "category", "in_vocabulary"]
        first = lambda spots: F.array_min(F.transform(spots, lambda s: s["at"] + s["later"])).alias("record_index")
        linked = parts.filter("kind = 'duplicate' and not flagged").select(*kept, first("inside"))
        behind = novel.filter("not flagged").withColumn("pid", F.col("lead") + self.inserted).select(*kept, first(F.filter("inside", lambda s: ~alone(s))))
        repeats = single.filter("not own").select(*kept, (F.col("spot.at") + F.col("spot.later")).alias("record_index"))
        offers = self._offers(linked.unionByName(behind.filter("record_index is not null")).unionByName(repeats))
        bases = self.base.select("pid", "name", "base_brand", "base_category", F.lit(-1).cast("long").alias("born"))
        both = bases.unionByName(born).select("pid", "base_brand", "base_category")
        telling = self._telling(offers.join(both, "pid")).unionByName(self.offers_of_old)
        changed = materialize(updates.changes_of(telling, self.mode), "changed")
        return bases.join(changed, "pid").unionByName(born.join(changed, "pid", "left"))

    def referred(self, touched: DataFrame) -> DataFrame:
        """``pid``: products that a record of the settled run may have come to or been compared with, without reading what records hold."""
        of = lambda frame, pid: frame.select(pid.alias("pid"))
        found = of(self.settled, F.explode("spans.pid")).unionByName(of(self.settled, F.col("lead") + self.inserted))
        found = found.unionByName(of(touched.filter("born >= 0"), F.col("pid"))).unionByName(of(self.good, F.col("linked_product")))
        return found.filter("pid is not null").distinct()

    def run(self) -> tuple[DataFrame, DataFrame]:
        """The records with their settled decisions and products, and the touched products."""
        touched = seen = None
        while True:  # every round settles one record more at least
            plan = self.plan(touched)
            plan = self.guess(plan) if seen is None else plan
            touched = materialize(self.implied(plan), "touched")
            mark = touched.agg(F.count("*"), F.sum(F.xxhash64(*[c.split()[0] for c in TOUCHED.split(", ")]).cast("decimal(38,0)"))).first()
            if mark == seen or (seen is None and mark[0] == 0):
                self.settled = plan
                discard(self.places)  # as large as the records, and read by rounds only
                return self.follow(plan), touched
            seen = mark


def outcomes(resolver: Resolver, followed: DataFrame, touched: DataFrame) -> DataFrame:
    """One row per record: outcome, match, product, changes and notes; products by internal number ``pid``."""
    index = F.col("record_index")
    bases = resolver.base.select("pid", "name", "base_brand", "base_category").join(touched.select("pid"), "pid", "left_anti")
    for column, kind in (("brand_at", "long"), ("brand_new", "string"), ("category_at", "long"), ("category_new", "string")):
        bases = bases.withColumn(column, F.lit(None).cast(kind))
    states = bases.unionByName(touched.drop("born")).withColumnRenamed("name", "product_name")
    decides = F.col("linked_product").isNull() & (F.col("first_index") == index)
    decision = {c: F.when(decides, F.col(c)) for c in ("score", "kind", "match_pid")}
    rows = followed.withColumns(decision | {"decides": decides}).drop("first_index", "uid")
    states = materialize(states.join(resolver.referred(touched), "pid", "left_semi"), "states")
    fields = ("product_name", "base_brand", "base_category", "brand_at", "brand_new", "category_at", "category_new")
    own = states.select("pid", F.struct(*fields).alias("_own"))
    match = states.select(F.col("pid").alias("match_pid"), F.struct(*fields).alias("_match"))
    rows = rows.join(own, "pid", "left").join(match, "match_pid", "left")

    def state(side: str, field: str, at_once: bool = False) -> Column:
        """A field as of the record, or ``at_once`` as the record leaves it."""
        at = F.col(f"{side}.{field}_at")
        return F.when((at <= index) if at_once else (at < index), F.col(f"{side}.{field}_new")).otherwise(F.col(f"{side}.base_{field}"))

    first_change = F.least("_own.brand_at", "_own.category_at")
    rows = rows.withColumns(
        {
            "current_brand": state("_own", "brand"),
            "current_category": state("_own", "category"),
            "updated_by": F.when(first_change < index, first_change),
        }
    )
    # a matched product is described as the record leaves it
    described = F.when(
        F.col("match_pid") == F.col("pid"), text.identity(F.col("_match.product_name"), state("_match", "brand", True), state("_match", "category", True))
    ).otherwise(text.identity(F.col("_match.product_name"), state("_match", "brand"), state("_match", "category")))
    rows = rows.withColumn("match_identity", F.when(F.col("_match").isNotNull(), described))
    ruled = updates.plan_update(rows, resolver.mode)
    applies = ~F.col("inserts") & F.col("_own").isNotNull()  # a link to an unknown product changes nothing
    ruled = ruled.withColumns({"changes": F.when(applies, F.col("changes")), "notes": F.when(applies, F.col("notes"))}).withColumn("reason", F.lit(None).cast("string"))
    columns = [*REJECTED, "pid", "inserts", "fails", "err_kind", "why", "decides", "score", "kind", "match_pid", "match_identity", "changes", "notes"]
    out = ruled.select(*columns).unionByName(resolver.rejected, allowMissingColumns=True)
    # only a record that would write something can fail
    failed = F.coalesce(F.col("fails") & (F.col("decides") | (F.coalesce(F.size("changes"), F.lit(0)) > 0)), F.lit(False))
    outcome = (
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(failed, "failed")
        .when(F.col("inserts"), "inserted")
        .when(F.col("kind") == "duplicate", "linked")
        .otherwise("existing")
    )
    return out.select(
        "record_index", "seller_name", "seller_product_id", "name", "brand", "category", "identity",
        F.when(failed, F.col("why")).otherwise(F.col("reason")).alias("reason"), "flags",
        outcome.alias("outcome"), "kind", "score", "match_pid", "match_identity", F.when(~failed, F.col("pid")).alias("pid"),
        F.when(failed, F.array().cast(CHANGES)).otherwise(F.coalesce("changes", F.array().cast(CHANGES))).alias("changes"),
        F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.when(failed, F.col("err_kind")).alias("err_kind"),
    )
