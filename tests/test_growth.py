"""Steps whose cost must not outgrow their input: rows that meet, rows handed on, and joins of tables that grow."""

from random import Random

import pytest
from pyspark.sql import functions as F

from varcohort.operators import genotype as G
from varcohort.operators import intervals as I


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_intervals_do_not_meet_in_coarse_bins(spark):
    """2,000 points and 2,000 short intervals on a contig, and one interval over half of it."""
    r = Random(5)
    points = [("1", p, p + 1) for p in (r.randrange(1 << 26) for _ in range(2000))]
    beds = [("1", p, p + r.choice((0, 300, 900, 20000))) for p in (r.randrange(1 << 26) for _ in range(1999))] + [("1", 0, 1 << 25)]
    a, b = (spark.createDataFrame(x, "contig string, start0 long, end0 long") for x in (points, beds))
    want = sorted((p[1], q[1], q[2]) for p in points for q in beds if p[1] < max(q[2], q[1]) and q[1] < p[2])
    for x, y, turned in ((a, b, False), (b, a, True)):
        got = I.overlaps(x, y)
        bed = "a" if turned else "b"
        assert sorted((t["b" if turned else "a"]["start0"], t[bed]["start0"], t[bed]["end0"]) for t in got.collect()) == want
        assert I.near(x, y).count() < 4 * len(points)
        assert "Broadcast" not in plan(got)


def test_samples_are_not_broadcast(spark):
    """genotype counts by group join a table that grows with the samples."""
    gt = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (2, 2, None)], "v int, s int, gt int")
    out = G.genotype_counts(gt, spark.createDataFrame([(1, "a"), (2, "b")], "s int, cohort string"), "cohort")
    assert {(r["v"], r["cohort"]): tuple(r)[2:] for r in out.collect()} == {(1, "a"): (1, 0, 0, 0), (1, "b"): (0, 0, 1, 0), (1, None): (1, 0, 1, 0), (2, "b"): (0, 0, 0, 1), (2, None): (0, 0, 0, 1)}
    assert "Broadcast" not in plan(out)


@pytest.mark.parametrize("most,room,kind", [(2048, 1 << 22, int), (4, 16, int), (3, 1, str)])
def test_pairs_of_sites(spark, most, room, kind):
    """sites of some cells and one of very many, in chunks and slices of any size, against each pair by itself."""
    r = Random(8)
    cells = [(v, kind(s), r.randrange(3)) for v in range(60) for s in range(40) if v == 7 or r.random() < 0.1]
    want = {}
    for v, s, g in cells:
        for w, t, h in cells:
            if v == w and s <= t:
                n, x = want.get((s, t), (0, 0))
                want[s, t] = (n + 1, x + g * (h + 1))
    g = spark.createDataFrame(cells, f"v int, s {'int' if kind is int else 'string'}, g int").select(F.xxhash64("v").alias("__v"), "s", "g")
    got = {(x["s1"], x["s2"]): (x["n"], x["x"]) for x in G.pairs_of_sites(g, ["g"], {"n": [(1, 1)], "x": [(0, 0), (0, 1)]}, "long", True, 3, most, room).collect()}
    assert got == want
    none = {(x["s1"], x["s2"]) for x in G.pairs_of_sites(g, ["g"], {"n": [(1, 1)]}, "double", False, 3, most, room).collect()}
    assert none == {k for k in want if k[0] != k[1]}


def test_sparse_cells_are_not_dealt_to_every_block_of_samples(spark):
    """20,000 samples of two cells each; no cell is copied for other blocks of samples."""
    gt = spark.range(40_000).select((F.col("id") % 4000).alias("v"), (F.col("id") % 20_000 + F.floor(F.col("id") / 20_000) * 7 % 20_000).cast("int").alias("s"), F.lit(1).alias("gt"))
    out = G.king_kinship(gt)
    assert out.count() > 0 and "FlatMapGroupsInPandas" not in plan(out)


def test_linkage_bins_follow_the_cells(spark):
    """ten times the samples, sites and bases leave bins and blocks as they are; bins of any width give the same."""
    assert G.ld_blocks(3_600_000, 120_000, 200_000_000, 1024, 1 << 15) == G.ld_blocks(36_000_000, 1_200_000, 2_000_000_000, 1024, 1 << 15) == (1820444, 1)
    assert G.ld_blocks(4_000_000, 1000, 10_000_000, 1024, 1 << 15)[1] == 4
    r = Random(2)
    v = [(i, "1", r.randrange(1 << 20)) for i in range(400)]
    gt = spark.createDataFrame([(i, r.randrange(60), r.randrange(3)) for i in range(400) for _ in range(12)], "v int, s int, gt int").dropDuplicates(["v", "s"]).localCheckpoint()
    sites = spark.createDataFrame(v, "v int, contig string, pos int")
    got = [sorted((x["v1"], x["v2"], x["n"], x["sign"], round(x["r2"], 9)) for x in G.ld_r2(gt, sites, 20000, fill=fill, least=least).collect()) for fill, least in ((1 << 15, None), (300, None), (1, 5000))]
    assert got[0] and got[0] == got[1] == got[2]


def test_ties_of_first_rows(spark):
    """of rows that the order leaves tied the same one comes first, whatever the order of the input."""
    from varcohort.operators import alleles as L

    rows = [(k, 1, 10 * k + x) for k in range(20) for x in (3, 1, 2)]
    for data in (rows, rows[::-1]):
        got = L.first_rows(spark.createDataFrame(data, "k int, i int, x int").coalesce(1), ["k"], ["i"]).collect()
        assert sorted(tuple(r) for r in got) == [(k, 1, 10 * k + 1) for k in range(20)]


def test_likelihoods_move_as_a_row_a_sample(spark):
    """candidates of three windows are tried without a row for each window, candidate and state; windows of any size give what each gives alone."""
    import numpy as np

    from varcohort.operators import copynumber as C

    r = np.random.default_rng(4)
    d1, d2, mu = r.poisson(12, 90).astype(float), r.poisson(9, 90).astype(float), r.uniform(8, 12, 90)
    starts, points = np.array([0, 10, 70]), [(0.3, 0.0), (0.8, 0.0), (0.8, 0.05)]
    got = C.window_likelihoods(d1, d2, mu, starts, points, C.pairs(2))
    for w, (a, b) in enumerate(zip(starts, [10, 70, 90])):
        want = [[C.log_likelihood(d1[a:b], d2[a:b], mu[a:b], *k, *p) for k in C.pairs(2)] for p in points]
        assert np.allclose(got[w], want)
    rows = [(1, "1", int(w), i, int(d1[i] + d2[i]), int(d2[i]), float(mu[i])) for w, (a, b) in enumerate(zip(starts, [10, 70, 90])) for i in range(a, b)]
    df = spark.createDataFrame(rows, "s int, contig string, first long, pos long, dp long, ad long, lambda double")
    first = spark.createDataFrame([(1, *C.listed([(2, 0, points), (1, 1, [(0.0, 0.0)])]))], f"s int, {C.LIST}")
    for size in (4096, 20):
        out = C.evaluate(C.chunks(df, "s", 3, size), first, "s").collect()
        assert len(out) == 1
        null = C.window_likelihoods(d1, d2, mu, starts, [(0.0, 0.0)], [(1, 1)]).sum()
        assert np.allclose(np.sum(out[0]["ll"], axis=0), [*got.max(-1).sum(0), null])


def test_equal_counts_are_drawn_together(spark):
    """a hundred times the variants with the same counts and coefficients make no more draws, and scores keep their moments."""
    import numpy as np

    from varcohort.operators import stress as T

    counts = spark.range(400).selectExpr("id AS v", "'a' AS cohort", "3L AS n_rr", "4L AS n_ra", "3L AS n_aa")
    models = spark.range(400).selectExpr("'m' AS id", "id AS v", "0.25D AS aaf", "CASE WHEN id % 2 = 0 THEN 1.0D ELSE -0.5D END AS coef")
    scores = T.boot_scores(counts, models, 3000, 5)
    x = np.array([r["score"] for r in scores.collect()])
    var = 200 * (1 + 0.25) * (0.4 + 4 * 0.3 - 1) / 10 / 400**2
    assert len(x) == 3000 and abs(x.mean() - 200 * 0.5 / 400) < 4 * np.sqrt(var / 3000) and abs(x.var() / var - 1) < 0.15
    one = T.boot_scores(counts.where("v < 2"), models.where("v < 2"), 10, 5)
    assert len(one.collect()) == 10
    seen = T.boot_scores(counts.where("v % 2 = 0"), models.where("v % 2 = 0"), 50, 5).collect()
    # 200 equal variants are one draw of 2,000 people: a multiple of the coefficient over the people of one
    assert all(abs((r["score"] * 200 * 10) - round(r["score"] * 200 * 10)) < 1e-6 for r in seen)
    assert drawn_rows(T.boot_scores, counts, models) == 2


def drawn_rows(f, *tables) -> int:
    """How many rows reach the function that draws."""
    from unittest.mock import patch

    from varcohort.operators import stress as T

    seen = []
    with patch.object(T, "keep", lambda df: seen.append(df) or df):
        f(*tables, 5, 1)
    return seen[0].count()


def test_drift_draws_once(spark):
    """six times the variants and differences make six times the draws, not 36 times; blocks of any size give scores alike."""
    from varcohort.operators import stress as T

    assert T.block_numbers(20_000, 20_000, 1 << 18, 1 << 22, 32) == (19, 1)
    for n in (1_200_000, 3_600_000):
        n_m, n_d = T.block_numbers(n, n, 1 << 18, 1 << 22, 32)
        assert n_m == 32 and n_d == 1  # draws made are rows times blocks of differences
    r = Random(3)
    af = spark.createDataFrame([(v, r.random(), r.uniform(0.1, 0.9), r.uniform(0.1, 0.9)) for v in range(300)], "v int, t double, a double, b double")
    models = spark.createDataFrame([(f"m{v % 3}", v, r.uniform(-1, 1)) for v in range(300)], "id string, v int, coef double")
    diffs = T.normalised_differences(af, "t", ["a", "b"])
    got = [{(x["id"], x["source"], x["rep"]): x["score"] for x in T.drift_scores(af, diffs, models, ["a", "b"], 30, 9, rows=rows, drawn=100, strip=strip).collect()} for rows, strip in ((1 << 18, 256), (40, 7))]
    assert len(got[0]) == 3 * 2 * 30 and got[0].keys() == got[1].keys() and all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])


def test_equal_counts_share_a_generator(spark):
    """F16: 4,000 loci of the same counts in 30 replicates make one generator, not 120,000; their means are those of the draw."""
    from unittest.mock import patch

    import numpy as np

    from varcohort.operators import resample as R

    df = spark.range(4000).selectExpr("id AS v", "explode(array('a', 'b')) AS cohort", "3L AS n_rr", "2L AS n_ra", "1L AS n_aa", "0L AS n_missing")
    with patch.object(R, "replicates", side_effect=AssertionError("a row for each locus and replicate")):
        got = {r["kind"]: r for r in R.subsampled_burden(df, ("a", "b"), 2, 30, 7).collect()}
    sd = np.sqrt(2 * 1 / 3 * 2 / 3 * 4 / 5) / 2 * np.sqrt(4000 / 30)
    assert abs(got["dominant"]["mean_a"] - 4000 / 3) < 4 * sd and abs(got["recessive"]["mean_b"] - 4000 / 6) < 4 * sd


def test_small_multinomials_are_drawn_together():
    """rows of few counts need no generator of their own, and follow the law of the draw."""
    from unittest.mock import patch

    import numpy as np

    from varcohort.operators import resample as R

    n = np.array([[3, 2, 1, 0], [0, 0, 0, 0], [0, 5, 0, 0], [10, 20, 30, 4]])
    rows, seeds = np.repeat(n, 20_000, axis=0), np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 80_000)
    with patch.object(np.random, "default_rng", side_effect=AssertionError("a generator for a row")):
        out = R.multinomials(rows, seeds)
    assert (out.sum(1) == rows.sum(1)).all() and (out >= 0).all() and (out[rows == 0] == 0).all()
    for i, total in ((0, 6), (3, 64)):
        x, p = out[i * 20_000 : (i + 1) * 20_000], n[i] / total
        assert np.allclose(x.mean(0), n[i], atol=5 * np.sqrt(total / 4 / 20_000))
        assert np.allclose(np.cov(x.T), total * (np.diag(p) - np.outer(p, p)), atol=0.06 * total * 0.25 + 0.05)
    assert (R.multinomials(np.array([[500, 500, 0, 0]]), np.array([7])).sum(1) == 1000).all()


def test_rows_are_permuted_once_a_replicate(spark):
    """200,000 rows are one block of permuted columns, not four; blocks of any size give the same p."""
    import inspect

    from varcohort.operators import smooth as S

    assert inspect.signature(S.smooth_perm_test).parameters["held"].default >= 1 << 21
    df = spark.range(240).selectExpr("id AS k", "id % 2 AS g", "sin(id * 7.0D) AS x", "cos(id * 3.0D) AS m", "sin(id * 7.0D) + 0.1D * cos(id * 3.0D) + 0.3D * sin(id * 11.0D) AS y")
    got = [sorted((r["g"], r["n"], round(r["deviance"], 9), r["below"]) for r in S.smooth_perm_test(df, "g", "k", "y", ["x"], ["m"], 30, 5, pieces=4, chunk=7, **size).collect()) for size in ({}, {"block": 50, "held": 33, "strip": 16}, {"held": 64})]
    assert len(got[0]) == 2 and got[0] == got[1] == got[2]


@pytest.mark.parametrize("kind", [int, str])
def test_components_of_few_samples_are_one_pass(spark, kind):
    """few samples' cells are multiplied once, not in every round, and components are those of the rounds of joins."""
    from unittest.mock import patch

    import numpy as np

    from varcohort.operators import models as M

    r = Random(4)
    cells = [(v, kind(s), None if r.random() < 0.1 else 0 if v % 13 == 0 else min(2, int(r.random() * 3 * (1 + (s % 2 == v % 2)) / 2))) for v in range(300) for s in range(14) if r.random() < 0.8] + [(13, kind(99), 0), (301, kind(98), None)]
    gt = spark.createDataFrame(cells, f"v int, s {'int' if kind is int else 'string'}, gt int")
    (s1, l1, e1), (s2, l2, e2), (s3, l3, e3) = (M.pca(gt, 2, rounds=3, **x) for x in ({}, {"few": 0}, {"few": 0, "fill": 500}))
    assert np.allclose(e1, e2) and np.allclose(e1, e3)
    for a, b in ((s1, s2), (l1, l2), (s1, s3), (l1, l3)):
        assert a.dtypes == b.dtypes
        x, y = ({t[0]: t[1:] for t in map(tuple, df.collect())} for df in (a, b))
        assert x.keys() == y.keys() and len(x) > 13 and all(np.allclose(x[k], y[k], atol=1e-9) for k in x)
    kept = []
    with patch.object(M, "keep", lambda df: kept.append(df) or df.localCheckpoint()):
        M.pca(gt, 2, rounds=30)
    assert len(kept) == 1
    none = M.pca(gt.limit(0), 2)
    assert none[0].count() == none[1].count() == 0


def test_relatedness_forms_its_cells_once(spark):
    """the cells that pair up are written, not made anew for their count and for their pairs."""
    from unittest.mock import patch

    from varcohort.operators import models as M

    gt = spark.createDataFrame([(v, s, (v * s) % 3) for v in range(40) for s in range(6)], "v int, s int, gt int")
    seen, real = [], M.pair_sums
    with patch.object(M, "pair_sums", lambda cells, *a, **k: seen.append(cells) or real(cells, *a, **k)):
        assert M.pc_relate(gt, spark.createDataFrame([(s, s / 6.0) for s in range(6)], "s int, pc1 double"), ["pc1"]).count() > 0
    assert "Join" not in plan(seen[0]) and "Exchange" not in plan(seen[0])


def test_components_move_no_row_a_cell(spark):
    """in a round a sample's columns go once to each block of variants with its cells, and blocks keep to their cells."""
    from unittest.mock import patch

    from varcohort.operators import models as M

    gt = spark.createDataFrame([(v, v // 100 * 50 + s, (v * s + s) % 3) for v in range(300) for s in range(50)], "v int, s int, gt int")
    blocks = M.variant_blocks(gt, "v", 5000).collect()
    assert 3 <= len(blocks) <= 40 and sum(len(b["at"]) for b in blocks) == gt.join(M.standardised(gt), ["v", "s"]).count()
    assert sum(len(b["s"]) for b in blocks) <= 50 * (len(blocks) + 2)  # ranges of variants have their own samples
    kept = []
    with patch.object(M, "keep", lambda df: kept.append(df.localCheckpoint()) or kept[-1]):
        M.pca(gt, 2, rounds=1, few=0, fill=1 << 14)
    assert max(df.count() for df in kept[1:]) <= 300  # rows of variants or samples, after the cells themselves


def test_fits_take_batches_of_samples(spark):
    """rows of many samples are designed in one batch and the fits of many solved in one, none by a call of its own; curves are evaluated without Python; a sample of several blocks is fitted whole."""
    from varcohort.operators import smooth as S

    rows = spark.range(4000).select((F.col("id") % 40).cast("string").alias("s"), F.col("id").alias("v"), F.rand(3).alias("a")).withColumn("y", F.sin(5 * F.col("a")) * F.length("s"))
    fits, out = S.smooth_fit(rows, "s", "v", "y", ["a"], 5)
    assert "Python" not in plan(out)
    parted, again = S.smooth_fit(rows, "s", "v", "y", ["a"], 5, block=30)
    one, two = ({r["s"]: r for r in x.collect()} for x in (fits, parted))
    assert len(one) == 40 and all(one[s]["n"] == two[s]["n"] == 100 and abs(one[s]["rss"] - two[s]["rss"]) < 1e-6 and one[s]["strength"] == two[s]["strength"] for s in one)
    at = {r["v"]: r["fitted"] for r in again.collect()}
    got = out.collect()
    assert len(got) == 4000 and all(abs(r["fitted"] - at[r["v"]]) < 1e-5 and abs(r["fitted"] - r["y"]) < 0.1 for r in got)


def test_batches_of_fits_are_those_alone():
    """neighbours of one key are summed across batches, and stacked fits equal single ones."""
    import numpy as np

    from varcohort.operators import smooth as S

    r = np.random.default_rng(4)
    rows = [("a", r.normal(size=3)), ("a", r.normal(size=3)), ("b", r.normal(size=3)), ("c", r.normal(size=3)), ("c", r.normal(size=3))]
    got = [(list(k), x) for k, x in S.totals(iter(rows), "s", 2)]
    assert [k for k, _ in got] == [["a", "b"], ["c"]] and np.allclose(got[0][1][0], rows[0][1] + rows[1][1]) and np.allclose(got[1][1][0], rows[3][1] + rows[4][1])
    x = [np.column_stack([np.ones(n), S.spline(r.uniform(0, 1, n), 0, 1, 4)]) for n in (30, 200, 9)]
    y = [r.normal(size=len(a)) for a in x]
    many = S.penalised_many(np.stack([a.T @ a for a in x]), np.stack([a.T @ b for a, b in zip(x, y)]), np.array([b @ b for b in y]), np.array([len(b) for b in y]), S.roughness(1, 4))
    for i, (a, b) in enumerate(zip(x, y)):
        one = S.penalised(a.T @ a, a.T @ b, b @ b, len(b), S.roughness(1, 4))
        assert np.allclose(many[0][i], one[0]) and np.isclose(many[1][i], one[1]) and many[2][i] == one[2]


def test_cells_are_dealt_by_their_number(spark):
    """Tasks over cells get a bounded number of order lines, not a fixed share of them."""
    from varcohort.plans import fixtures as X

    at = "/root/testdata/sf0.01"
    n = X.read(spark, at, "lineitem").count()
    assert X.parts(spark, at, 1000) == n // 1000 + 1 and X.parts(spark, "/root/testdata/sf0.001") == 1
    for cells in (X.called(X.lines(spark, at), F.col("l_suppkey"), 37), G.genotype_counts(spark.createDataFrame([(1, 1, 0)], "v int, s int, gt int"), spark.createDataFrame([(1, "a")], "s int, cohort string"), "cohort", parts=37)):
        assert ", 37), REPARTITION_BY_NUM" in plan(cells)


def test_sites_are_not_broadcast_to_calls(spark):
    """calls meet alternates, which grow with them, in one join without a broadcast."""
    from varcohort.operators import alleles as L

    sites = spark.createDataFrame([(1, "A", ["C", "G"]), (2, "A", ["T"])], "v int, ref string, alts array<string>")
    calls = spark.createDataFrame([(1, 7, 1, 2, [3, 4, 5]), (2, 7, 0, 1, [6, 1])], "v int, s int, a1 int, a2 int, ads array<long>")
    out = L.split_calls(sites, calls)
    assert "Broadcast" not in plan(out) and plan(out).count("SortMergeJoin") == 1
    assert sorted((r["v"], r["a_index"], r["alt"], r["gt"], r["ad"], r["ref_ad"]) for r in out.collect()) == [(1, 1, "C", 1, 4, 8), (1, 2, "G", 1, 5, 7), (2, 1, "T", 1, 1, 6)]


def test_cells_are_formed_once_without_singletons(spark):
    """what doesn't ask for singletons doesn't sum the cells by variant, and is the same otherwise."""
    gt = spark.createDataFrame([(1, 1, 0, 9), (1, 2, 2, 8), (2, 2, None, 3), (3, 2, 1, 6)], "v int, s int, gt int, dp int")
    sites = spark.createDataFrame([(1, "A", "C"), (2, "A", "G")], "v int, ref string, alt string")
    whole, less = G.sample_qc(gt, sites, 2), G.sample_qc(gt, sites, 2, singletons=False)
    assert sorted(whole.drop("n_singleton").collect()) == sorted(less.select(whole.drop("n_singleton").columns).collect())
    assert plan(less).count("Join") == 1 and plan(whole).count("Join") == 2


def test_states_are_columns_of_a_window(spark):
    """a locus is not repeated for each state, and the best state needs no window over rows; ties go to the first."""
    from varcohort.operators import models as M

    rows = spark.createDataFrame([("a", 10, 100), ("a", 8, 100), ("b", 50, 100), ("c", None, None)], "w string, ad long, dp long")
    out = M.copy_number(rows, ["w"], [(1, 1, 0.0), (0, 1, 0.9), (1, 1, 0.5)])
    assert "Generate" not in plan(out) and "Window" not in plan(out)
    got = {r["w"]: (r["state"], r["k1"], r["k2"], r["f"], r["n"]) for r in out.collect()}
    assert got == {"a": (1, 0, 1, 0.9, 2), "b": (0, 1, 1, 0.0, 1), "c": (0, 1, 1, 0.0, 1)}


def test_containment_asks_for_the_first_base(spark):
    """a deletion whose first base is the last of a region counts, as in the SQL; where the whole allele is asked for it doesn't."""
    from unittest.mock import patch

    from varcohort.plans import fixtures as X
    from varcohort.plans import registry

    v = spark.createDataFrame([(1, "1", 10, "ATG"), (2, "1", 8, "ATG"), (3, "1", 11, "A"), (4, "1", 5, "C"), (5, "2", 9, "C")], "v int, contig string, pos long, ref string")
    bed = spark.createDataFrame([("1", 5, 10), ("1", 6, 7)], "contig string, start0 long, end0 long")
    gt = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (3, 1, 1)], "v int, s int, gt int")
    people = spark.createDataFrame([(1, "A"), (2, "Z")], "s int, cohort string")
    with patch.object(X, "variants", lambda *a: v), patch.object(X, "regions", lambda *a: bed), patch.object(X, "genotypes", lambda *a: gt), patch.object(X, "samples", lambda *a: people):
        run = lambda name: registry.QUERIES[name].__wrapped__(spark, "")
        assert sorted(r["v"] for r in run("contained_in").collect()) == [1, 2]
        assert [(r["v"], r["cohort"], r["n_rr"], r["n_missing"]) for r in run("cohort_count_tables").collect()] == [(1, "A", 1, 0)]
    assert [r["v"] for r in I.contained_in(v, bed).collect()] == [2]


def test_means_do_not_follow_the_tasks(spark, tmp_path):
    """sums go in the order of events, and differences are cut to six digits as the SQL does, so that ties fall alike."""
    import duckdb
    import numpy as np

    from varcohort.operators import stats as S
    from varcohort.plans import registry

    r = np.random.default_rng(5)
    value = np.round(r.exponential(50, 64 * 400), 2)  # means of 32 values end in half a millionth for every second user
    rows = [(i, i // 64, float(x)) for i, x in enumerate(value)] + [(90_000, 1, None), (90_001, 9_999, 3.0), (-3, 2, 7.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("*", "'a' AS event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = c.execute(registry.ORACLES["wilcoxon"]).fetchall()
    assert [tuple(x) for x in registry.QUERIES["wilcoxon"].__wrapped__(spark, str(tmp_path)).collect()] == want
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate((1e16, 1.0, 1.0, -1e16, None))] + [(2, 9, None)], "k int, i int, x double")
    assert [tuple(x) for x in S.mean_in_order(df.repartition(4), ["k"], "x", "i", "m").collect()] == [(1, 0.0)]


def test_first_rows_take_nulls_last(spark):
    """a row without a place in the order comes after all others, as in the SQL."""
    from varcohort.operators import alleles as L

    rows = [(1, None, 1, 5), (1, 2, None, 6), (1, 2, 3, 7), (2, None, None, 8), (2, None, 1, 9), (3, None, None, None)]
    got = L.first_rows(spark.createDataFrame(rows, "k int, i int, j int, x int"), ["k"], ["i", "j"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 3, 7), (2, None, 1, 9), (3, None, None, None)]


def test_rows_reach_pair_tasks_as_bytes(spark):
    """a strip of rows is one row of bytes, within one block of either side, so that no task forms a frame of its rows."""
    import numpy as np

    from varcohort.operators import smooth as S

    df = spark.range(100).selectExpr("id % 2 AS g", "id DIV 2 AS i", "CAST(id AS double) AS y", "CAST(id AS double) AS x", "1D AS m")
    got = S.strips(df, "g", "y", ["x"], ["m"], 4, 30, 40, 16).orderBy("g", "first").collect()
    assert [(r["a"], r["b"], r["first"], r["n"], r["of"]) for r in got[:6]] == [(0, 0, 0, 16, 50), (0, 0, 16, 14, 50), (1, 0, 30, 2, 50), (1, 0, 32, 8, 50), (1, 1, 40, 8, 50), (1, 1, 48, 2, 50)]
    u, y = np.frombuffer(got[1]["fixed"]).reshape(2, 14)
    assert y.tolist() == [2.0 * i for i in range(16, 30)] and np.allclose(u, y / 98 * 4) and not np.frombuffer(got[1]["permuted"]).any()


def test_permutations_are_as_many_as_the_reference_makes(spark, small):
    """ten thousand, not one."""
    from varcohort.plans import registry

    rows = registry.QUERIES["smooth_perm_test"](spark, small).collect()
    assert rows and {r["reps"] for r in rows} == {10_000} and all(0 <= r["below"] <= 10_000 for r in rows)


def test_tags_are_sought_as_far_as_the_reference_does(spark):
    """F8: 250 kb, not 3: most variants get a tag; and pairs of one block of samples, met in one task, are not moved to be summed."""
    from varcohort.plans import registry

    rows = registry.QUERIES["rescue_with_tags"](spark, "/root/testdata/sf0.01").count()
    assert rows > 300  # 22 within 3 kb
    gt = spark.createDataFrame([(i, s, (i * s) % 3) for i in range(30) for s in range(8)], "v int, s int, gt int")
    sites = spark.createDataFrame([(i, "1", 10 * i) for i in range(30)], "v int, contig string, pos int")
    one, several = G.ld_r2(gt, sites, 200), G.ld_r2(gt, sites, 200, people=2)
    assert "HashAggregate" not in plan(one) and "HashAggregate" in plan(several)
    assert sorted(one.collect()) == sorted(several.collect())


def test_samples_rows_are_dealt_once(spark):
    """what is written dealt by sample is joined and summed by sample without moving; the session's plans stay adaptive."""
    from varcohort.operators.shared import keep_dealt

    rows = keep_dealt(spark.range(100).selectExpr("id % 7 AS s", "id AS v"), "s", 9)
    sums = rows.groupBy("s").agg(F.max("v").alias("most")).hint("merge")
    out = rows.join(sums, "s")
    assert rows.rdd.getNumPartitions() == 9 and "Exchange" not in plan(out) and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert out.count() == 100 and out.where("most < v").count() == 0


def test_blocks_of_components_are_bounded():
    """a block has some two million cells at most, whatever the tables; a task's memory follows it."""
    import inspect

    from varcohort.operators import models as M

    assert inspect.signature(M.pca).parameters["fill"].default <= 1 << 21
