"""Parent states along chromosomes in families of crosses: a five-state model whose transitions depend on distance.

Calls are told by parent (0 the first parent's, 1 heterozygous, 2 the second's). Hidden states go from 0 (all of the first parent)
over three mixed ones (a quarter, a half, three quarters) to 4. A taxon's calls on a chromosome are one row of arrays, written once. Each round
finds the most probable states of every taxon with its family's model and counts transitions and calls by state; these counts are
summed by family and chromosome and give the next model. Models are a small table beside the sequences, so a family may be
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import materialize, scratch, small

STATES, SEEN = 5, 3
#: The model to begin with.
TRANSITION = [[0.999, 0.0001, 0.0003, 0.0001, 0.0005], [0.0002, 0.999, 0.00005, 0.00005, 0.0002], [0.0002, 0.00005, 0.999, 0.00005, 0.0002], [0.0002, 0.00005, 0.00005, 0.999, 0.0002], [0.0005, 0.0001, 0.0003, 0.0001, 0.999]]
EMISSION = [[0.998, 0.001, 0.001], [0.6, 0.2, 0.2], [0.4, 0.2, 0.4], [0.2, 0.2, 0.6], [0.001, 0.001, 0.998]]
LEAST = 1e-12
MODEL = "transition array<double>, emission array<double>, start array<double>, segment double"


def step_matrices(transition: np.ndarray, length: np.ndarray, segment: float) -> np.ndarray:
    """A matrix for each distance. A change of probability p over the mean segment becomes (1 - (1 - 2 p) ** (length / segment)) / 2."""
    away = (1 - np.maximum(1 - 2 * transition, LEAST)[None] ** (np.asarray(length, float)[:, None, None] / segment)) / 2
    at = np.arange(STATES)
    away[:, at, at] = 0
    away[:, at, at] = np.maximum(1 - away.sum(axis=2), LEAST)
    return np.maximum(away, LEAST)


def best_states(seen: list[np.ndarray], pos: list[np.ndarray], transition: np.ndarray, emission: np.ndarray, start: np.ndarray, segment: float) -> list[np.ndarray]:
    """The most probable states of each sequence, all sequences a step at a time; ties go to the lower state."""
    if not seen:
        return []
    n = np.array([len(s) for s in seen])
    order = np.argsort(-n, kind="stable")  # the longest first, so that those that go on are the first rows
    longest = int(n.max())
    obs, at = np.zeros((len(seen), longest), np.int64), np.zeros((len(seen), longest))
    for i, o in enumerate(order):
        obs[i, : n[o]], at[i, : n[o]] = seen[o], pos[o]
    n = n[order]
    e, score = np.log(np.maximum(emission, LEAST)), np.log(np.maximum(start, LEAST))
    score = score + e[:, obs[:, 0]].T if longest else np.zeros((len(seen), STATES))
    back = np.zeros((longest, len(seen), STATES), np.int8)
    for i in range(1, longest):
        live = int(np.searchsorted(-n, -i, "left"))  # sequences with more than i observations
        t = np.log(step_matrices(transition, np.abs(at[:live, i] - at[:live, i - 1]), segment))
        every = score[:live, :, None] + t
        back[i, :live] = every.argmax(axis=1)
        score[:live] = every.max(axis=1) + e[:, obs[:live, i]].T
    out = np.zeros((len(seen), longest), np.int64)
    state = score.argmax(axis=1)
    rows = np.arange(len(seen))
    for i in range(longest - 1, -1, -1):
        live = rows[: int(np.searchsorted(-n, -i, "left"))]
        out[live, i] = state[live]
        state[live] = back[i, live, state[live]]
    told: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seen)
    for i, o in enumerate(order):
        told[o] = out[i, : n[i]]
    return told


def _states(b: pd.DataFrame, least: int) -> pd.Series:
    """Of rows with seen, pos and the columns of their model. Sequences of fewer than `least` calls keep what they show."""
    out = pd.Series([None] * len(b), index=b.index, dtype=object)
    for _, g in b.groupby(["family", "chrom"], sort=False):
        m = g.iloc[0]
        long = [i for i in g.index if len(b.at[i, "seen"]) >= least]
        found = best_states([b.at[i, "seen"] for i in long], [b.at[i, "pos"] for i in long], np.reshape(m["transition"], (STATES, STATES)), np.reshape(m["emission"], (STATES, SEEN)), np.asarray(m["start"]), m["segment"])
        for i, s in zip(long, found, strict=True):
            out[i] = s
    for i in b.index:
        if out[i] is None:
            out[i] = 2 * np.asarray(b.at[i, "seen"])
    return out


def _counted(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """family, chrom, changes (5 x 5), shown (5 x 3), summed over the task's rows."""
    sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for f, c, seen, states in zip(b["family"], b["chrom"], b["seen"], _states(b, least), strict=True):
            changes, shown = sums.setdefault((f, c), (np.zeros((STATES, STATES), np.int64), np.zeros((STATES, SEEN), np.int64)))
            np.add.at(changes, (states[:-1], states[1:]), 1)
            np.add.at(shown, (states, np.asarray(seen)), 1)
    yield pd.DataFrame([(f, c, a.ravel(), s.ravel()) for (f, c), (a, s) in sums.items()], columns=["family", "chrom", "changes", "shown"])


def _estimated(b: pd.DataFrame) -> pd.DataFrame:
    """The next model of each row (model, changes, shown, before, taxa, span): a state that never occurs keeps its probabilities."""
    out = []
    for r in b.itertuples():
        changes, shown = np.reshape(r.changes, (STATES, STATES)).astype(float), np.reshape(r.shown, (STATES, SEEN)).astype(float)
        t, e = np.reshape(r.transition, (STATES, STATES)).copy(), np.reshape(r.emission, (STATES, SEEN)).copy()
        for counts, of in ((changes, t), (shown, e)):
            some = counts.sum(axis=1) > 0
            of[some] = counts[some] / counts[some].sum(axis=1, keepdims=True)
        total = changes.sum()
        out.append((t.ravel(), e.ravel(), shown.sum(axis=1) / max(1.0, shown.sum()), r.span * r.taxa / total if total and r.span else r.segment))
    return pd.DataFrame(out, columns=["transition", "emission", "start", "segment"], index=b.index)


def sequences(calls: DataFrame, positions: DataFrame, families: DataFrame) -> DataFrame:
    """family, chrom, taxon_id, site_ids, pos, seen: a row a taxon and chromosome. calls: taxon_id, site_id, state (0, 1, 2 or null)."""
    c = calls.where("state IS NOT NULL").join(positions.select("site_id", "chrom", "pos"), "site_id").join(families.select("taxon_id", "family"), "taxon_id")
    g = c.groupBy("family", "chrom", "taxon_id").agg(F.array_sort(F.collect_list(F.struct("pos", "site_id", F.col("state").cast("int").alias("state")))).alias("x"))
    return g.select("family", "chrom", "taxon_id", F.col("x.site_id").alias("site_ids"), F.col("x.pos").alias("pos"), F.col("x.state").alias("seen"))


def five_state_impute(calls: DataFrame, positions: DataFrame, families: DataFrame, heterozygous: float = 0.07, rounds: int = 50, least: int = 20) -> DataFrame:
    """taxon_id, site_id, family, state (0 to 4) of every known call; 0 and 4 are the parents' homozygotes, those between heterozygous.

    families: taxon_id, family. heterozygous is the expected share at the start. A family's chromosome is done when the calls counted by
    state are those of the round before, or after `rounds`.
    """
    spark = calls.sparkSession
    with scratch(spark):
        every = seqs = materialize(sequences(calls, positions, families), "family-sequences")
        hom = (1 - heterozygous) / 2
        first = [hom, 0.25 * heterozygous, 0.5 * heterozygous, 0.25 * heterozygous, hom]
        whole = lambda x: F.array(*[F.lit(float(v)) for v in np.ravel(x)])
        per = seqs.groupBy("family", "chrom").agg(F.count(F.lit(1)).alias("taxa"), (F.max(F.array_max("pos")) - F.min(F.array_min("pos"))).cast("double").alias("span"))
        at = positions.groupBy("chrom").agg(F.count(F.lit(1)).alias("sites"))
        model = per.join(at, "chrom").select("family", "chrom", "taxa", "span", whole(TRANSITION).alias("transition"), whole(EMISSION).alias("emission"), whole(first).alias("start"), F.greatest(F.lit(1.0), F.floor(F.col("span") / F.col("sites"))).cast("double").alias("segment"), F.lit(None).cast("array<bigint>").alias("before"))
        model, done = materialize(model, "family-model"), None
        names = ["transition", "emission", "start", "segment"]
        for i in range(rounds):
            own = seqs.join(small(model.select("family", "chrom", *names), 500), ["family", "chrom"])
            told = own.mapInPandas(lambda b: _counted(b, least), "family int, chrom int, changes array<bigint>, shown array<bigint>")
            total = lambda c, n: F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(c)
            counts = told.groupBy("family", "chrom").agg(total("changes", STATES * STATES), total("shown", STATES * SEEN))
            now = materialize(model.join(counts, ["family", "chrom"]), "family-counts")  # a row a family and chromosome
            same = F.col("shown").eqNullSafe(F.col("before")) if i + 1 < rounds else F.lit(True)
            ended = now.where(same).select("family", "chrom", *names)
            done = ended if done is None else done.union(ended)
            left = now.where(~same)
            if left.isEmpty():
                break
            model = left.withColumn("m", F.pandas_udf(_estimated, MODEL)(F.struct(*names, "changes", "shown", "taxa", "span")))
            model = materialize(model.select("family", "chrom", "taxa", "span", *[F.col(f"m.{n}").alias(n) for n in names], F.col("shown").alias("before")), "family-model")
            seqs = seqs.join(small(model.select("family", "chrom"), 16), ["family", "chrom"], "leftsemi") if i % 8 == 7 else seqs
        own = every.join(small(materialize(done, "family-models"), 500), ["family", "chrom"])

        def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"family": b["family"], "taxon_id": b["taxon_id"], "site_ids": b["site_ids"], "states": _states(b, least)})

        told = own.mapInPandas(last, "family int, taxon_id int, site_ids array<int>, states array<int>")
        told = told.select("family", "taxon_id", F.explode(F.arrays_zip("site_ids", "states")).alias("x"))
        return materialize(told.select("taxon_id", F.col("x.site_ids").alias("site_id"), "family", F.col("x.states").alias("state")), "family-states", keep=True)


def map_positions(positions: DataFrame, rates: DataFrame) -> DataFrame:
    """positions with pos on a genetic scale, for recombination that varies along a chromosome. rates: chrom, pos, rate from that place on.

    The rate before the first place of a chromosome is that of the first. Distances between the new places are sums of rate times length.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("chrom").orderBy("pos")
    r = rates.select("chrom", "pos", "rate").withColumns({"next": F.lead("pos").over(order), "first": F.row_number().over(order) == 1})
    upto = F.sum(F.col("rate") * (F.col("next") - F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("before", F.coalesce(upto, F.lit(0.0))).select("chrom", F.col("pos").alias("from"), "next", "rate", "before", "first")
    low = F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("from"))
    high = F.coalesce("next", F.lit(float("inf")))
    j = positions.join(small(r, 48), "chrom").where((F.col("pos") >= low) & (F.col("pos") < high))
    return j.select(*[c for c in positions.columns if c != "pos"], (F.col("before") + F.col("rate") * (F.col("pos") - F.col("from"))).alias("pos"))


def parent_calls(states: DataFrame, parents: DataFrame) -> DataFrame:
    """taxon_id, site_id, a1, a2: states as alleles of the family's parents. parents: family, site_id, first, second (alleles)."""
    j = states.join(parents, ["family", "site_id"])
    return j.select("taxon_id", "site_id", F.when(F.col("state") == 4, F.col("second")).otherwise(F.col("first")).alias("a1"), F.when(F.col("state") == 0, F.col("first")).otherwise(F.col("second")).alias("a2"))
