"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size, between 0 and the cap. Its
whole part is taken at once; the fractional parts are rounded together: two documents meet, mass (in words) moves at
random from one to the other until one of them is a whole number, and the other goes on. Buckets of bounded size do
this in an array fold, and the residual of each bucket meets others one level up, in a tree whose fan-in is bounded,
until one document of each source is left and goes to the nearer whole number. Expected copies are kept (but for that
last document) and a source's words differ from its target by at most half its last document.

Rows that agree in all that is read of them are counted first and then numbered, so that each has a hash of its own: buckets
are bounded whatever is repeated. Sources are ranked and filled up to the water level by sums over ranges, not in one task.

Defined results: a null or blank text has size 0 and takes nothing; the null source comes last; repeated rows are
rounded one by one, null ids like others; an empty table gives an empty result; extra columns are ignored. Random numbers are
hashes of the rows' values, so reruns agree, in whatever order the rows come.
Only DataFrame and SQL functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_numbers, running, small

#: Fixed value: what separates words is ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

ITEM = "struct<k:bigint,id:bigint,row:bigint,size:bigint,x:double>"
DONE = "array<struct<id:bigint,row:bigint,size:bigint,up:int>>"
#: Repeated rows are numbered in runs of so many.
RUN = 1000


def targets(sizes: DataFrame, weights=(5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    The level L with target = min(cap * size, L * weight) is found in closed form: sources in the order in which they reach
    their cap, running sums of caps before and of weights after.
    """
    named = row_numbers(sizes, [F.col("source").asc_nulls_last()], "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    t = named.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    t = running(t, [(F.col("most") / F.col("w")).asc(), F.col("place").asc()], {"caps": F.col("most"), "weights": F.col("w")})
    t = materialize(t, "levels")
    whole = t.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(float(whole[0] or 0)) - (F.col("caps") - F.col("most"))) / (F.lit(float(whole[1] or 1)) - (F.col("weights") - F.col("w")))
    # The first source that the level of its own place leaves under its cap fixes the level; later places give lower ones.
    top = t.agg(F.max(F.when(level * F.col("w") <= F.col("most"), level))).first()[0]
    target = F.col("most") if top is None else F.least("most", F.lit(top) * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def _fold(seed: int) -> str:
    """SQL that folds the array `items` pairwise into (c: the document left over, d: those decided)."""
    unit = f"shiftrightunsigned(xxhash64(s.c.k, e.k, {seed}L), 11) / 9007199254740992D"
    moves = (
        "named_struct('up', least(s.c.size * (1D - s.c.x), e.size * e.x),"
        f" 'down', least(s.c.size * s.c.x, e.size * (1D - e.x)), 'u', {unit})"
    )
    to = lambda v, x: f"named_struct('k', {v}.k, 'id', {v}.id, 'row', {v}.row, 'size', {v}.size, 'x', {x})"
    one = lambda v, up: f"named_struct('id', {v}.id, 'row', {v}.row, 'size', {v}.size, 'up', {up})"
    pair = lambda rest, done: f"named_struct('c', {rest}, 'd', {done})"
    step = (
        "CASE WHEN m.u * (m.up + m.down) < m.down THEN"
        f" CASE WHEN s.c.size * (1D - s.c.x) <= e.size * e.x THEN {pair(to('e', 'e.x - m.up / e.size'), one('s.c', 1))}"
        f" ELSE {pair(to('s.c', 's.c.x + m.up / s.c.size'), one('e', 0))} END"
        f" ELSE CASE WHEN s.c.size * s.c.x <= e.size * (1D - e.x) THEN {pair(to('e', 'e.x + m.down / e.size'), one('s.c', 0))}"
        f" ELSE {pair(to('s.c', 's.c.x - m.down / s.c.size'), one('e', 1))} END END"
    )
    settle = (
        f"CASE WHEN r.c.x > 1e-12 AND r.c.x < 1D - 1e-12 THEN named_struct('c', r.c, 'd', array_append(s.d, r.d))"
        f" ELSE named_struct('c', CAST(NULL AS {ITEM}), 'd', array_append(array_append(s.d, r.d), {one('r.c', 'CAST(round(r.c.x) AS INT)')})) END"
    )
    return (
        f"aggregate(items, named_struct('c', CAST(NULL AS {ITEM}), 'd', CAST(array() AS {DONE})), (s, e) ->"
        " CASE WHEN s.c IS NULL THEN named_struct('c', e, 'd', s.d) ELSE"
        f" element_at(transform(transform(array({moves}), m -> {step}), r -> {settle}), 1) END)"
    )


def _sized(docs: DataFrame, row_col: str | None) -> DataFrame:
    """doc_id, source, size, row, key: one row per row of docs. key hashes the row's values and, of rows with equal ones, its number among them."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row.alias("row"), F.xxhash64("text").alias("h"))
    rows = materialize(rows.withColumn("key", F.xxhash64("doc_id", "source", "size", "h")).drop("h"), "sizes")
    times = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")
    met = rows.join(small(times, 24), "key", "left").withColumn("run", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / RUN)))
    per = materialize(met.where("n is not null").groupBy("key", "run").agg(F.count(F.lit(1)).alias("m")), "runs")
    before = per.select("key", "run", (F.sum("m").over(Window.partitionBy("key").orderBy("run")) - F.col("m")).alias("before"))
    own = Window.partitionBy("key", "run").orderBy("row")
    nth = met.where("n is not null").withColumn("at", F.row_number().over(own)).join(small(before, 32), ["key", "run"]).withColumn("nth", F.col("before") + F.col("at"))
    told = ["doc_id", "source", "size", "row"]
    return met.where("n is null").select(*told, "key").union(nth.select(*told, F.xxhash64("key", "nth").alias("key")))


def mix(docs: DataFrame, weights=(5, 2, 1), cap: float = 3.0, seed: int = 17, fan_in: int = 64, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies (and row, if row_col names a unique row number): one row per row of docs."""
    sized = _sized(docs, row_col)
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "source-sums")
    plan = targets(sums.select("source", "source_size"), weights, cap).join(sums.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = materialize(
        plan.withColumn("r", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)).select(
            F.col("source").alias("of"), "source_size", "target", F.floor("r").alias("whole"), (F.col("r") - F.floor("r")).alias("x"),
            F.ceil(F.col("n") / fan_in).alias("buckets"),
        ),
        "mixing-plan",
    )
    most = plan.agg(F.max("buckets")).first()[0] or 0
    rows = sized.join(small(plan, 200), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    keys = ["source", "source_size", "target", "whole"]
    open_ = (F.col("size") > 0) & (F.col("x") > 1e-12) & (F.col("x") < 1 - 1e-12)
    settled = [rows.where(~open_).select("doc_id", "row", *keys, "size", F.round("x").cast("int").alias("up"))]
    key = F.xxhash64("key", F.lit(seed))
    level = rows.where(open_).select(*keys, F.pmod(key, F.col("buckets")).alias("bucket"), key.alias("k"), F.col("doc_id").alias("id"), "row", "size", "x")
    while most > 0:
        folded = (
            level.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(F.struct("k", "id", "row", "size", "x"))).alias("items"))
            .select(*keys, "bucket", F.expr(_fold(seed)).alias("f"))
        )
        none = F.lit(None)
        left = F.when(F.isnotnull("f.c"), F.array(F.struct(*[F.col(f"f.c.{n}").alias(n) for n in ("id", "row", "size")], none.cast("int").alias("up"), F.col("f.c.x").alias("x"), F.col("f.c.k").alias("k"))))
        done = F.transform("f.d", lambda d: F.struct(d["id"].alias("id"), d["row"].alias("row"), d["size"].alias("size"), d["up"].alias("up"), none.cast("double").alias("x"), none.cast("long").alias("k")))
        nothing = F.array().cast("array<struct<id:bigint,row:bigint,size:bigint,up:int,x:double,k:bigint>>")
        both = folded.select(*keys, "bucket", F.explode(F.concat(done, F.coalesce(left, nothing))).alias("o"))
        told = materialize(both.select(*keys, "bucket", "o.*"), "pivots")
        settled.append(told.where("up is not null").select(F.col("id").alias("doc_id"), "row", *keys, "size", "up"))
        level = told.where("up is null").select(*keys, F.floor(F.col("bucket") / fan_in).alias("bucket"), "k", "id", "row", "size", "x")
        if most == 1:
            settled.append(level.select(F.col("id").alias("doc_id"), "row", *keys, "size", F.round("x").cast("int").alias("up")))
            break
        most = -(-most // fan_in)
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("up")).otherwise(0).cast("long")
    told = ["doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")]
    return out.select(*told, "row") if row_col else out.select(*told)
