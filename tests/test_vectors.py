"""Fixed vectors, invariants and file round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varcohort.functions import variant as V
from varcohort.operators import genotype as G
from varcohort.operators import intervals as I
from varcohort.operators import models as M
from varcohort.operators import resample as R
from varcohort.operators import series as S
from varcohort.operators import stats as T
from varcohort.sources import readers, writers
from varcohort.streaming import ingest


@pytest.mark.parametrize("k,n,p,want", [(2, 4, 0.5, 0.6875), (2, 10, 0.5, 0.0546875), (10, 10, 0.9, 1.0), (0, 10, 0.1, 0.34867844)])
def test_binomial_cdf(k, n, p, want):
    assert abs(T.binomial_cdf(k, n, p) - want) < 1e-6


def test_exact_tests():
    assert abs(T.hardy_weinberg(3, 5, 2) - 1.0) < 1e-9 and T.hardy_weinberg(50, 0, 50) < 1e-20
    assert abs(T.fisher_exact(3, 1, 1, 3) - 0.4857142857) < 1e-9
    assert abs(T.binomial_test(1, 10) - 0.021484375) < 1e-9 and T.binomial_test(0, 0) == 1.0


def bed(spark, *rows):
    return spark.createDataFrame(list(rows), "contig string, start0 long, end0 long")


def spans(df):
    return sorted((r["contig"], r["start0"], r["end0"]) for r in df.select("contig", "start0", "end0").collect())


def test_touching_intervals_do_not_overlap(spark):
    a, b = bed(spark, ("1", 0, 10)), bed(spark, ("1", 10, 20), ("2", 0, 5))
    assert I.overlaps(a, b).count() == 0
    assert spans(I.merge(a.union(b))) == [("1", 0, 20), ("2", 0, 5)]
    assert spans(I.merge(bed(spark, ("1", 0, 10), ("1", 14, 20)), 4)) == [("1", 0, 20)]


def test_intervals_against_bases(spark):
    rng = np.random.default_rng(4)
    for scale in (60, 3_000_000):
        make = lambda n: [(str(rng.integers(1, 3)), int(s), int(s + rng.integers(1, scale))) for s in rng.integers(0, 4 * scale, n)]  # noqa: E731, B023
        ra, rb = make(25), make(25)
        a, b = bed(spark, *ra), bed(spark, *rb)
        want = sorted((x[0], max(x[1], y[1]), min(x[2], y[2])) for x in ra for y in rb if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
        assert spans(I.intersect(a, b)) == want
        if scale == 60:
            inside = lambda rows: {(c, i) for c, s, e in rows for i in range(s, e)}
            sa, sb = inside(ra), inside(rb)
            assert inside(spans(I.subtract(a, b))) == sa - sb and inside(spans(I.common(a, b))) == sa & sb
            for c, s, e, d in [tuple(r) for r in I.coverage(a).collect()]:
                assert all(sum(x[0] == c and x[1] <= i < x[2] for x in ra) == d for i in (s, e - 1))


def test_blocks_do_not_change_results(spark):
    from varcohort.operators import blocked

    rows = spark.createDataFrame([("1", i * 7, (i * 5) % 11 - 5) for i in range(200)], "contig string, pos long, d long")
    for f in (lambda n: blocked.running_sum(rows, "contig", "pos", ["d"], n), lambda n: blocked.neighbour(rows, "contig", "pos", "d", "x", True, n), lambda n: blocked.neighbour(rows, "contig", "pos", "d", "x", False, n)):
        assert sorted(map(tuple, f(64).collect()), key=str) == sorted(map(tuple, f(1 << 40).collect()), key=str)


def test_mode_base(spark):
    rows = [("a", "A", 10), ("a", "C", 5), ("b", "A", 10), ("b", "C", 20), ("c", "A", 10), ("c", "C", 10), ("d", "T", 10), ("d", "C", 10), ("d", "A", 20)]
    got = {r["k"]: r["base"] for r in S.mode_base(spark.createDataFrame(rows, "k string, base string, n int"), "k").collect()}
    assert got == {"a": "A", "b": "C", "c": "A", "d": "A"}


def test_min_rep_and_kinship(spark):
    rows = spark.createDataFrame([(100, "CAAT", "CAT"), (5, "A", "G"), (7, "GCC", "GCCCC"), (9, "TTA", "CTA")], "pos long, ref string, alt string")
    assert [tuple(r) for r in rows.select(V.min_rep(F.col("pos"), F.col("ref"), F.col("alt")).alias("m")).select("m.*").collect()] == [(100, "CA", "C"), (5, "A", "G"), (7, "G", "GCC"), (9, "T", "C")]
    kin = spark.createDataFrame([(0.5,), (0.25,), (0.125,), (0.06,), (0.03,), (0.001,)], "k double").select(V.kin_degree(F.col("k")).alias("d"))
    assert [r["d"] for r in kin.collect()] == [0, 1, 2, 3, 4, 5]


def test_prune_leaves_no_linked_pair(spark):
    spark.sparkContext.setCheckpointDir("/tmp/spark-varcohort-tests")
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b), float(r)) for a, b, r in zip(rng.integers(0, 40, 120), rng.integers(40, 80, 120), rng.random(120))]
    r2 = spark.createDataFrame(pairs, "v1 int, v2 int, r2 double")
    v = spark.range(80).select(F.col("id").cast("int").alias("v"))
    kept = {r["v"] for r in M.ld_prune(r2, v, 0.3).collect()}
    linked = [(a, b) for a, b, r in pairs if r > 0.3]
    assert not any(a in kept and b in kept for a, b in linked)
    assert all(x in kept or any((x == a and b in kept) or (x == b and a in kept) for a, b in linked) for x in range(80))


def test_draws_do_not_depend_on_partitioning(spark):
    rows = spark.createDataFrame([(i, "p", 10 + i, 5, 2, 1) for i in range(20)], "v int, cohort string, n_rr int, n_ra int, n_aa int, n_missing int")
    one = sorted(map(tuple, R.multinomial_draw(rows.repartition(1), 4, 9, "v", "cohort").collect()))
    many = sorted(map(tuple, R.multinomial_draw(rows.repartition(7), 4, 9, "v", "cohort").collect()))
    assert one == many and all(sum(r[2:6]) == 18 + r[0] for r in one)
    vb = spark.createDataFrame([(1, "syn", 5, 40, 3, 60), (2, "nonsyn", 0, 40, 9, 60)], "v int, class string, ac_a long, an_a long, ac_b long, an_b long")
    assert {r["t"] for r in R.burden_permutations(vb, 50, 1).groupBy("rep").agg(F.sum(F.col("ac_a") + F.col("ac_b")).alias("t")).collect()} == {17}


def test_copy_number_finds_loss(spark):
    rng = np.random.default_rng(2)
    rows = [("s", 0, 60, int(rng.binomial(60, 0.5))) for _ in range(80)] + [("s", 1, 60, int(rng.binomial(60, rng.choice([1 / 3, 2 / 3])))) for _ in range(80)]
    out = M.copy_number(spark.createDataFrame(rows, "s string, w int, dp int, ad int"), ["s", "w"], [(1, 1, 0.0), (0, 1, 0.5), (0, 1, 0.9)])
    assert {r["w"]: (r["k1"], r["f"]) for r in out.collect()} == {0: (1, 0.0), 1: (0, 0.5)}


def test_pileup(spark):
    lines = spark.createDataFrame([("1\t5\tA\t6\t..,+2ACc-1TG^I.$*\tIIIIIII\tIIIIIII",), ("1\t6\tC\t2\t.T\t#I\tII",)], "value string")
    got = [tuple(r) for r in readers.parse_pileup(lines).orderBy("pos").collect()]
    assert got == [("1", 5, "A", 4, 1, 1, 0), ("1", 6, "C", 0, 0, 0, 1)]


def test_round_trips(spark, tmp_path):
    b = bed(spark, ("2", 5, 9), ("1", 30, 40), ("1", 3, 4))
    writers.write_bed(b, f"{tmp_path}/bed")
    assert spans(readers.read_bed(spark, f"{tmp_path}/bed")) == spans(b)
    (tmp_path / "g.bedgraph").write_text("track x\nchr1\t0\t10\t0.5\nchrM\t4\t6\t1\n")
    assert [tuple(r) for r in readers.read_bedgraph(spark, f"{tmp_path}/g.bedgraph").orderBy("contig").collect()] == [("1", 0, 10, 0.5), ("MT", 4, 6, 1.0)]
    (tmp_path / "t.tsv").write_text("## note\nid\tx\na\t1\nb\tNA\n")
    assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/t.tsv", "id string, x int", comment="##").orderBy("id").collect()] == [("a", 1), ("b", None)]
    (tmp_path / "ids").write_text("a\n\n b \na\n")
    assert sorted(r["s"] for r in readers.read_sample_list(spark, f"{tmp_path}/ids").collect()) == ["a", "b"]
    (tmp_path / "c.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t9\trs1\tA\tC,*\t50\tq10;x\tAC=3;DB\tGT:AD:DP:GQ\t0/2:3,0,4:7:20\t./.\n")
    v, gt = readers.read_vcf(spark, f"{tmp_path}/c.vcf")
    assert (r := v.first())["alts"] == ["C", "*"] and r["filters"] == ["q10", "x"] and r["info"]["AC"] == "3"
    calls = {x["s"]: x for x in gt.collect()}
    assert (calls["s1"]["a1"], calls["s1"]["a2"], calls["s1"]["ads"], calls["s1"]["gq"]) == (0, 2, [3, 0, 4], 20) and calls["s2"]["a1"] is None
    table = spark.createDataFrame([("1", 1, "A", "C", 1)], "contig string, pos long, ref string, alt string, n int")
    writers.write_af(table, f"{tmp_path}/af")
    with pytest.raises(ValueError):
        writers.write_af(table.union(table), f"{tmp_path}/af2")
    (tmp_path / "d").write_text("vid\ts1\ts2\nx\t0.\n")
    assert [tuple(r) for r in readers.read_dosages(spark, f"{tmp_path}/d").orderBy("s").collect()] == [("x", "s1", 0), ("x", "s2", None)]
    (tmp_path / "e").write_text("vid\ts1\ts2\nx\t03\n")
    with pytest.raises(Exception, match="bad dosage row"):
        readers.read_dosages(spark, f"{tmp_path}/e").collect()


def test_stream_counts_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "v int, s int, gt int")
    rows((1, 1, 0), (1, 2, 1), (2, 1, None)).write.parquet(f"{tmp_path}/in", mode="append")
    ingest.ingest_counts(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    rows((1, 3, 2), (2, 2, 1)).write.parquet(f"{tmp_path}/in", mode="append")
    ingest.ingest_counts(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {r["v"]: tuple(r)[1:] for r in ingest.read_counts(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (1, 1, 1, 0), 2: (0, 1, 0, 1)}


def test_split_and_downcode(spark):
    v = spark.createDataFrame([(1, "1", 5, "A", ["C", "G"])], "v int, contig string, pos long, ref string, alts array<string>")
    gt = spark.createDataFrame([(1, "s", 1, 2, [3, 4, 5]), (1, "t", None, None, [0, 0, 0])], "v int, s string, a1 int, a2 int, ads array<long>")
    got = {(r["s"], r["a_index"]): (r["gt"], r["ad"], r["ref_ad"]) for r in G.downcode(gt, G.split_multi(v)).collect()}
    assert got == {("s", 1): (1, 4, 8), ("s", 2): (1, 5, 7), ("t", 1): (None, 0, 0), ("t", 2): (None, 0, 0)}


def test_subclonal_thresholds():
    """Fixed vectors; they were recorded with a spread of one."""
    from varcohort.operators.models import snr_thresholds

    got = snr_thresholds([40, 100, 135], spread=1)
    assert got[40] is None
    assert got[100][:2] == (10, 28) and abs(got[100][2] - 0.6601016080599246) < 1e-6 and abs(got[100][3] - 18.0580053085918) < 1e-3
    assert got[135][:2] == (11, 43) and abs(got[135][2] - 0.8803333325220946) < 1e-6 and abs(got[135][3] - 11.584716396883863) < 1e-3
    assert [t and t[:2] for t in snr_thresholds([40, 100, 135]).values()] == [None, (10, 28), (11, 43)]


def test_tails_at_any_depth(spark):
    """Least counts against exact integer sums, and at a depth whose terms are below the smallest double."""
    from math import comb

    from varcohort.operators.calling import mark_fixed

    def least(n, top, bottom):
        k, tail, whole = n + 1, 0, bottom**n
        while k and (tail + comb(n, k - 1) * top ** (k - 1) * (bottom - top) ** (n - k + 1)) * 20 < whole:
            k -= 1
            tail += comb(n, k) * top**k * (bottom - top) ** (n - k)
        return k

    rows = []
    for n in (1, 10, 100, 401):
        alt, ref = least(n, 1, 300), least(n, 1, 100)
        rows += [(n, ad, ad >= alt and n - ad >= ref) for ad in range(n + 1)]
    got = mark_fixed(spark.createDataFrame(rows, "dp long, ad long, want boolean")).collect()
    assert len(got) == len(rows) and all(r["het"] == r["want"] for r in got)
    deep = mark_fixed(spark.createDataFrame([(3_000_000, 10_100), (3_000_000, 10_200)], "dp long, ad long")).collect()
    assert sorted((r["ad"], r["het"]) for r in deep) == [(10_100, False), (10_200, True)]


def test_tails(spark):
    """Five per cent points of the distributions."""
    from pyspark.sql import functions as F

    from varcohort.operators import stats as S

    d = lambda x: F.lit(float(x))
    row = spark.range(1).select(
        S.normal_tail(d(1.959964)), S.t_tail(d(2.228139), d(10)), S.t_tail(d(12.706205), d(1)), S.f_tail(d(4.964603), d(1), d(10)), S.f_tail(d(2.978237), d(10), d(10)),
        S.chisq_tail(d(3.841459), d(1)), S.chisq_tail(d(18.307038), d(10)), S.chisq_tail(d(124.342113), d(100)), S.kolmogorov(d(1.358099)),
    ).first()
    assert all(abs(x - 0.05) < 2e-6 for x in row), row
    z, p = S.two_proportions(d(30), d(100), d(45), d(100))
    row = spark.range(1).select(z, p, S.t_tail(d(0), d(5)), S.chisq_tail(d(0), d(3))).first()
    assert abs(row[0] + 2.190890) < 1e-6 and abs(row[1] - 0.028460) < 1e-5 and row[2] == 1 and row[3] == 1


def test_logistic_regression(spark):
    """Coefficients of grouped rows, of which the closed form is known; too few cases give no row."""
    from math import log

    from varcohort.operators import stats as S

    rows = [(1, 0.0)] * 40 + [(0, 0.0)] * 60 + [(1, 1.0)] * 70 + [(0, 1.0)] * 30
    r = S.score_logit(spark.createDataFrame(rows, "y int, x double"), "y", "x").first()
    beta, se = log(70 / 30) - log(40 / 60), (1 / 70 + 1 / 30 + 1 / 40 + 1 / 60) ** 0.5
    assert abs(r["beta"] - beta) < 1e-9 and abs(r["se"] - se) < 1e-9 and r["n"] == 200 and r["cases"] == 110
    assert S.score_logit(spark.createDataFrame(rows[:60], "y int, x double"), "y", "x").count() == 0


def test_global_ranks_against_sorting(spark):
    import random

    from pyspark.sql import functions as F

    from varcohort.operators import stats as S

    rng = random.Random(1)
    xs = [rng.choice([rng.random(), 0.5, rng.randint(0, 9)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)] + [(9999, None)], "k int, x double")
    order = sorted(xs)
    got = {r["k"]: r["rank"] for r in S.avg_rank(df, "x").collect()}
    assert got[9999] is None
    for i, x in enumerate(xs):
        n = xs.count(x)
        assert got[i] == order.index(x) + (n + 1) / 2
    ps = [x / 10 for x in xs]
    m = len(ps)
    ranked = sorted(ps)
    bh, low = {}, 1.0
    for i in range(m, 0, -1):
        low = min(low, ranked[i - 1] * m / i)
        bh[ranked[i - 1]] = min(bh.get(ranked[i - 1], 1.0), low)
    out = S.p_adjust(df.withColumn("p", F.col("x") / 10), "p", "bh", "k").where("k < 9999").collect()
    assert all(abs(r["p_adj"] - bh[r["p"]]) < 1e-12 for r in out)
    w = S.wilcoxon_signed_rank(df.withColumn("d", F.col("x") - 0.55), "d").first()
    assert w["n"] == m and w["w_plus"] + w["w_minus"] == m * (m + 1) / 2


def test_pruning_of_a_chain(spark):
    """A path of 500 linked variants and a clique: nothing kept is linked, and nothing else could be kept."""
    import random

    keys = list(range(500))
    random.Random(3).shuffle(keys)
    pairs = [(a, b, 0.9) for a, b in zip(keys, keys[1:])] + [(600 + i, 600 + j, 0.5) for i in range(12) for j in range(i + 1, 12)] + [(700, 701, 0.1)]
    v = spark.createDataFrame([(i,) for i in [*range(500), *range(600, 612), 700, 701, 702]], "v int")
    kept = [r["v"] for r in M.ld_prune(spark.createDataFrame(pairs, "v1 int, v2 int, r2 double"), v, 0.2).collect()]
    linked = {(a, b) for a, b, r in pairs if r > 0.2} | {(b, a) for a, b, r in pairs if r > 0.2}
    assert len(kept) == len(set(kept)) and {700, 701, 702} <= set(kept)
    assert not [1 for a in kept for b in kept if (a, b) in linked]
    assert all(any((x, k) in linked for k in kept) for x in {r["v"] for r in v.collect()} - set(kept))


def test_components_against_dense_algebra(spark):
    rng = np.random.default_rng(5)
    freq = rng.uniform(0.2, 0.8, (2, 400))
    g = rng.binomial(2, freq[np.repeat([0, 1], 15)])
    rows = [(v, s, int(g[s, v])) for s in range(30) for v in range(400) if rng.random() < 0.9]
    gt = spark.createDataFrame(rows, "v int, s int, gt int")
    z = np.zeros((30, 400))
    for v in range(400):
        own = [(s, x) for w, s, x in rows if w == v]
        p = sum(x for _, x in own) / (2 * len(own))
        if 0 < p < 1:
            for s, x in own:
                z[s, v] = (x - 2 * p) / (2 * p * (1 - p)) ** 0.5
    left, sing, right = np.linalg.svd(z, full_matrices=False)
    scores, loadings, values = M.pca(gt, 1)
    assert abs(values[0] / sing[0] ** 2 - 1) < 1e-6
    one = np.array([r["pc1"] for r in scores.orderBy("s").collect()])
    assert abs(abs(one @ left[:, 0]) / sing[0] - 1) < 1e-6 and one[np.abs(one).argmax()] > 0
    load = np.array([r["l1"] for r in loadings.orderBy("v").collect()])
    assert abs(abs(load @ right[0]) - 1) < 1e-6


def test_kinship_in_blocks(spark):
    """Whatever the blocks, the sums of all pairs are those of looking at each site."""
    rng = np.random.default_rng(6)
    rows = [(v, s, None if rng.random() < 0.1 else int(rng.integers(0, 3))) for v in range(50) for s in range(9) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "v int, s int, gt int")
    want = {}
    for a in range(9):
        for b in range(a + 1, 9):
            x, y = ({v: g for v, s, g in rows if s == t and g is not None} for t in (a, b))
            both = [(x[v], y[v]) for v in x.keys() & y.keys()]
            want[a, b] = (sum(p == (1, 1) for p in both), sum(abs(p[0] - p[1]) == 2 for p in both), sum(p[0] == 1 for p in both), sum(p[1] == 1 for p in both), len(both))
    for sites, people in ((4096, 512), (10, 3), (7, 2)):
        got = {(r["s1"], r["s2"]): tuple(r)[2:7] for r in G.king_kinship(df, sites=sites, people=people).collect()}
        assert got == want


def test_vcf_files(spark, tmp_path):
    """Sites and genotypes through a folder of files, each whole; files of different samples keep their own names."""
    v = spark.createDataFrame([(i, str(1 + i % 3), 10 * i, "A", ["C", "G"] if i % 4 == 0 else ["C"], f"x{i}") for i in range(1, 40)], "v int, contig string, pos long, ref string, alts array<string>, note string")
    gt = spark.createDataFrame([(i, s, (i + len(s)) % 3, i, 2 * i) for i in range(1, 40) for s in ("s1", "s22")], "v int, s string, gt int, ad long, dp long")
    writers.write_vcf(v, ["note"], f"{tmp_path}/out", gt, ("s1", "s22", "s3"))
    files = list((tmp_path / "out").glob("part-*"))
    assert files and all(f.read_text().startswith("##fileformat") for f in files)
    sites, calls = readers.read_vcf(spark, f"{tmp_path}/out")
    assert {(r["contig"], r["pos"], tuple(r["alts"]), r["info"]["NOTE"]) for r in sites.collect()} == {(r["contig"], r["pos"], tuple(r["alts"]), r["note"]) for r in v.collect()}
    got = {(r["pos"], r["s"]): (r["a1"], r["a2"], r["ads"], r["dp"]) for r in calls.collect()}
    assert len(got) == 39 * 3 and got[50, "s3"][:2] == (None, None) and got[50, "s1"] == (0, 1, [5, 5], 10) if (5 + 2) % 3 == 1 else True
    for name, sample in (("a", "one"), ("b", "two")):
        (tmp_path / f"{name}.vcf").write_text(f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\n")
    _, calls = readers.read_vcf(spark, f"{tmp_path}/*.vcf")
    assert sorted(r["s"] for r in calls.collect()) == ["one", "two"]


def test_small_functions(spark, tmp_path):
    """Functions that no query needs."""
    from varcohort.functions import consequence as C
    from varcohort.functions import variant as V
    from varcohort.operators import af as AF
    from varcohort.operators import alleles as L
    from varcohort.operators import series as SE

    row = spark.range(1).select(
        V.in_par(F.lit("X"), F.lit(60001)), V.in_par(F.lit("X"), F.lit(60000)), V.parse_vid(F.lit("1:5:A:C")).alias("vid"), SE.folded_vaf(F.lit(10), F.lit(7)).alias("vaf"), SE.folded_vaf(F.lit(0), F.lit(0)).alias("none"),
    ).first()
    assert row[0] and not row[1] and tuple(row["vid"]) == ("1", 5, "A", "C") and abs(row["vaf"] - 0.3) < 1e-12 and row["none"] is None
    t = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "c", 1)], "k int, x string, n int")
    assert sorted(r["x"] for r in G.top1(t, ["k"], F.desc("n")).collect()) == ["b", "c"]
    for i, rows in enumerate(([(1, "a")], [(2, "b")])):
        spark.createDataFrame(rows, "k int, x string").write.parquet(f"{tmp_path}/p{i}")
    assert readers.read_union(spark, [f"{tmp_path}/p0", f"{tmp_path}/p1"]).count() == 2
    writers.export(t, ["k", "x"], f"{tmp_path}/tsv")
    assert readers.read_many_tsv(spark, f"{tmp_path}/tsv", "k int, x string").where("file LIKE 'part%'").count() == 3
    g = spark.createDataFrame([("1", "s1", 0, 3, 10), ("1", "s2", 2, 4, 9), ("2", "s1", None, 0, 5)], "contig string, s string, gt int, ad int, dp int")
    writers.export_genotypes(g, ["s", "gt"], f"{tmp_path}/gt")
    assert spark.read.csv(f"{tmp_path}/gt", sep="\t", header=True).count() == 1
    writers.write_by_sample(g, f"{tmp_path}/by")
    assert sorted(p.name for p in (tmp_path / "by").glob("s=*")) == ["s=s1", "s=s2"]
    writers.write_ds(g, f"{tmp_path}/ds")
    assert sorted(p.name for p in (tmp_path / "ds").glob("contig=*")) == ["contig=1", "contig=2"]
    writers.export_dosage_set(g, t, t, f"{tmp_path}/set")
    assert spark.read.parquet(f"{tmp_path}/set/variants").count() == 3
    rows = spark.createDataFrame([(3, 7)], "ad int, ref_ad int")
    assert abs(L.with_balance(rows).first()["p_ab"] - 0.34375) < 1e-9
    counts = AF.counts_from_ac(spark.createDataFrame([(10, 3, 50)], "ac int, hom int, n int"), F.col("n")).first()
    assert (counts["n_rr"], counts["n_ra"], counts["n_aa"]) == (43, 4, 3)
    tags = spark.createDataFrame([("YES", "HGNC", "protein_coding", 1), ("YES", "HGNC", "lncRNA", 2), ("-", "HGNC", "protein_coding", 3), ("YES", "Clone", "protein_coding", 4)], "c string, s string, b string, i int")
    assert [r["i"] for r in tags.where(C.vep_canonical(F.col("c"), F.col("s"), F.col("b"))).collect()] == [1]
    depth = spark.createDataFrame([(20, 30, 35, 60, 1), (20, 31, 35, 60, 2), (10, 15, 19, 40, 3), (30, 35, 40, 101, 4), (20, 25, 20, 56, 5)], "h1 int, h2 int, m int, most int, i int")
    assert [r["i"] for r in depth.where(C.good_depth(F.col("h1"), F.col("h2"), F.col("m"), F.col("most"))).collect()] == [1]
    alleles = spark.createDataFrame([("A", "C"), ("A", "G"), ("A", "AT")], "ref string, alt string")
    assert sum(r["n"] for r in L.category_counts(alleles).collect()) == 3 and L.category_counts(alleles).count() == 2
    draws = spark.createDataFrame([("a", -1.0), ("a", 2.0), ("a", 3.0), ("a", 0.0), ("b", 1.0)], "t string, d double")
    assert {r["t"]: round(r["p"], 9) for r in R.two_sided(draws, "d", "t").collect()} == {"a": 0.6, "b": 0.5}


def test_relatedness_allows_for_ancestry(spark):
    """Two populations far apart, a pair of identical samples: only that pair is related, and a sample with itself is one half."""
    rng = np.random.default_rng(7)
    freq = np.clip(np.stack([rng.uniform(0.1, 0.9, 1500)] * 2) + rng.normal(0, 0.15, (2, 1500)), 0.05, 0.95)
    g = rng.binomial(2, freq[np.repeat([0, 1], 12)])
    g[5] = g[4]
    gt = spark.createDataFrame([(v, s, int(g[s, v])) for s in range(24) for v in range(1500)], "v int, s int, gt int")
    pcs = spark.createDataFrame([(s, float(s >= 12)) for s in range(24)], "s int, pc1 double")
    one = {(r["s1"], r["s2"]): r["kin"] for r in M.pc_relate(gt, pcs, ["pc1"]).collect()}
    many = {(r["s1"], r["s2"]): r["kin"] for r in M.pc_relate(gt, pcs, ["pc1"], sites=400, people=7).collect()}
    assert one.keys() == many.keys() and all(abs(one[p] - many[p]) < 1e-9 for p in one)
    assert len(one) == 24 * 25 / 2 and one[4, 5] > 0.35
    assert max(abs(k) for (a, b), k in one.items() if a != b and (a, b) != (4, 5)) < 0.12
    assert 0.3 < np.mean([one[s, s] for s in range(24)]) < 0.6


def test_corrected_intervals(spark):
    """An unbiased bootstrap gives plain percentiles; bias and acceleration move them as by the formula."""
    from statistics import NormalDist

    values = [float(x) for x in range(1001)]
    reps = spark.createDataFrame([("a", x) for x in values], "g string, x double")
    nd = NormalDist()
    for seen in (500.0, 600.0):
        r = R.corrected_interval(reps, spark.createDataFrame([("a", seen)], "g string, x double"), ["g"], "x").first()
        z = nd.inv_cdf((seen + 0.5) / 1001)
        assert abs(r["low"] - 1000 * nd.cdf(2 * z + nd.inv_cdf(0.025))) < 1e-6 and abs(r["high"] - 1000 * nd.cdf(2 * z + nd.inv_cdf(0.975))) < 1e-6
    jack = [1.0, 2.0, 3.0, 10.0]
    d = [4.0 - x for x in jack]
    acc = sum(x**3 for x in d) / (6 * sum(x**2 for x in d) ** 1.5)
    r = R.corrected_interval(reps, spark.createDataFrame([("a", 500.0)], "g string, x double"), ["g"], "x", jackknife=spark.createDataFrame([("a", x) for x in jack], "g string, x double")).first()
    t = nd.inv_cdf(0.025)
    assert abs(r["low"] - 1000 * nd.cdf(t / (1 - acc * t))) < 1e-6
    w = R.poisson_weights(spark.range(3000), 4, 1, "id").groupBy("rep").agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).collect()
    assert all(abs(x["m"] - 1) < 0.08 and abs(x["v"] - 1) < 0.15 for x in w)


def test_subsampling_to_equal_size(spark):
    rows = [(v, c, 30, 8 if c == "a" else 2, 2, 0) for v in range(20) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "v int, cohort string, n_rr int, n_ra int, n_aa int, n_missing int")
    got = {r["kind"]: r for r in R.subsampled_burden(df, ("a", "b"), 20, 40, 1).collect()}
    assert abs(got["dominant"]["mean_a"] - 20 * 8 / 40) < 0.4 and got["dominant"]["p"] < 0.1
    whole = {r["kind"]: r for r in R.subsampled_burden(df, ("a", "b"), 1000, 3, 1).collect()}
    assert abs(whole["recessive"]["mean_a"] - 20 * 2 / 40) < 1e-9


def test_callers_table(spark):
    info = {n.upper(): "1" for n in readers.CALLER_INFO}
    v = spark.createDataFrame([("1", 5, "A", ["C"], info), ("1", 9, "A", ["C", "G"], info)], "contig string, pos long, ref string, alts array<string>, info map<string,string>")
    gt = spark.createDataFrame([("1", 5, "A", "C", "s", 20, 10, 8, 400, 300), ("1", 9, "A", "C", "s", 20, 10, 8, 400, 300)], "contig string, pos long, ref string, alt string, s string, dp int, rd int, ad int, qr int, qa int")
    r = readers.caller_vcf_to_table(v, gt).collect()
    assert len(r) == 1 and r[0]["ado"] == 2 and r[0]["vaf"] == 0.4 and abs(r[0]["vafo"] - 8 / 18) < 1e-12 and r[0]["rppr"] == 1.0


def test_quality_tiers(spark):
    """One sample of each tier under both profiles, and what an unclear sex does."""
    names = "call_rate double, dp_mean double, dp_stdev double, gq_stdev double, het_ratio_sd double, r_het_hom double, r_ti_tv double, n_singleton long, n_snp long, n_insertion long, n_deletion long, f double"
    exome = (0.999, 40.0, 5.0, 5.0, 0.5, 1.5, 4.0, 0, 1000, 10, 10, 0.1)
    rows = [exome, (0.99, *exome[1:]), (0.97, *exome[1:]), (0.9, *exome[1:]), (*exome[:-1], 0.5), (*exome[:7], 5, *exome[8:]), (*exome[:3], 20.0, *exome[4:]), (*exome[:6], 2.1, *exome[7:])]
    df = spark.createDataFrame(rows, names)
    assert [r[0] for r in df.select(G.quality_tier("autosomes")).collect()] == [1, 2, 3, 4, 4, 4, 2, 2]
    assert [r[0] for r in df.select(G.quality_tier("genomes")).collect()] == [2, 2, 3, 4, 2, 2, 2, 1]
    sexes = spark.createDataFrame([("female", True), ("male", True), (None, True)], "sex string, female boolean")
    assert [r[0] for r in sexes.select(G.sex_match(F.col("sex"), F.col("female"))).collect()] == [True, False, False]


def test_projection_and_permutation(spark):
    z = spark.createDataFrame([(1, 7, 2.0), (2, 7, -1.0), (3, 7, 9.0), (1, 8, 1.0)], "v int, s int, z double")
    load = spark.createDataFrame([(1, 0.5), (2, 1.0)], "v int, l1 double")
    assert {r["s"]: r["l1"] for r in M.project(z, load, ["l1"]).collect()} == {7: 0.0, 8: 0.5}
    nulls = spark.createDataFrame([("t", 3.0, float(i)) for i in range(19)], "k string, seen double, x double")
    assert R.permutation_two_sided(nulls, "seen", "x", "k").first()["p"] == 2 * 5 / 20
    from varcohort.operators import scores as SC

    vids = spark.createDataFrame([("m", i, 1.0 if i % 2 else -1.0) for i in range(20)], "id string, v int, coef double")
    af = spark.createDataFrame([(i, 0.4 if i % 2 else 0.1, 0.2) for i in range(20)], "v int, a double, b double")
    r = SC.depletion_test(vids, af, "a", "b").first()
    assert (r["up_pos"], r["up_neg"], r["down_pos"], r["down_neg"]) == (10, 0, 0, 10) and r["p"] < 1e-4


@pytest.mark.parametrize("parts,people,strip,least,dense", [(1, 7, 3, 1, 1.0), (3, 1000, 512, 1, 1.0), (1, 50, 4, 4000, 1.0), (2, 9, 100, 1, 0.08), (1, 1000, 512, 1 << 16, 0.08)])
def test_ld_r2_against_dense_algebra(spark, parts, people, strip, least, dense):
    """Every pair of variants near each other, over matrices and over few cells, whatever the blocks."""
    rng = np.random.default_rng(int(100 * dense) + parts)
    pos = {c: np.sort(rng.choice(5000, 40, replace=False)) for c in ("1", "2")}
    sites = [(f"{c}:{p}", c, int(p)) for c in pos for p in pos[c]]
    g = {(v, s): int(rng.integers(0, 3)) for v, _, _ in sites for s in range(60) if rng.random() < dense * 0.9}
    gt = spark.createDataFrame([(v, s, x) for (v, s), x in g.items()] + [(sites[0][0], 99, None)], "v string, s int, gt int")
    got = {(r["v1"], r["v2"]): r for r in G.ld_r2(gt, spark.createDataFrame(sites, "v string, contig string, pos int"), 700, parts=parts, people=people, strip=strip, least=least).collect()}
    want = {}
    for a, ca, pa in sites:
        for b, cb, pb in sites:
            if ca == cb and 0 < pb - pa <= 700:
                both = np.array([(g[a, s], g[b, s]) for s in range(60) if (a, s) in g and (b, s) in g], dtype=float)
                if len(both) and both.std(0).min() > 0:
                    want[a, b] = (len(both), np.corrcoef(both.T)[0, 1])
    assert set(got) == set(want) and len(want) > (20 if dense == 1 else 1)
    for k, (n, r) in want.items():
        assert got[k]["n"] == n and abs(got[k]["r2"] - r * r) < 1e-9 and (abs(r) < 1e-9 or got[k]["sign"] == np.sign(r))


def test_runs_cross_blocks(spark):
    """Runs, segments and low stretches over the ends of blocks of positions."""
    from varcohort.operators import series as S

    edge = 1 << 20
    rows = [("a", p, 9.0) for p in range(edge - 3, edge + 4)] + [("a", edge + 6, 9.0), ("a", edge + 5, 1.0), ("b", 5, 9.0)]
    runs = S.coverage_runs(spark.createDataFrame(rows, "contig string, pos long, n double"), "n", 5.0).collect()
    assert sorted(tuple(r) for r in runs) == [("a", edge - 4, edge + 3, 7), ("a", edge + 5, edge + 6, 1), ("b", 4, 5, 1)]
    w = spark.createDataFrame([("a", edge - 2, 1, 10), ("a", edge - 1, 2, 1), ("a", edge + 1, 2, 2), ("a", edge + 9, 1, 3)], "by string, at long, state int, total long")
    got = sorted(tuple(r) for r in S.merge_segments(w, "by", "at", "state", "total").collect())
    assert got == [("a", 1, 1, edge - 2, edge - 2, 1, 10), ("a", 2, 2, edge - 1, edge + 1, 2, 3), ("a", 3, 1, edge + 9, edge + 9, 1, 3)]
    t = spark.createDataFrame([("s", edge + i, 0.5 if not -3 <= i < 3 else 0.1) for i in range(-20, 20)], "s string, pos long, vaf double")
    from varcohort.operators import calling as K

    low = K.loh_runs(t, "s", "pos", "vaf", 3, 0.5).collect()
    assert [(r["first"], r["last"], r["n"]) for r in low] == [(edge - 3, edge + 2, 6)]
    d = spark.createDataFrame([("s", i, 10, i % 7) for i in range(100)], "s string, pos long, dp int, ad int")
    one = {r["pos"]: r["smooth"] for r in K.loh_trace(d, "s", "pos", 3).collect()}
    assert {r["pos"]: r["smooth"] for r in K.loh_trace(d, "s", "pos", 3, block=8).collect()} == one and len(one) == 100


def test_logit_of_separable_scores(spark):
    rows = [(int(i >= 50), float(i)) for i in range(100)]
    r = T.score_logit(spark.createDataFrame(rows, "y int, x double"), "y", "x").first()
    assert (r["n"], r["cases"], r["beta"], r["se"], r["p"]) == (100, 50, None, None, None)


def test_strangers_of_few_sites_are_kept(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5, 2), (3, 4, 0.5, 200)], "s1 int, s2 int, kin double, n_sites long")
    cohort = spark.createDataFrame([(i, "A") for i in range(1, 5)], "s int, cohort string")
    assert sorted(r["s"] for r in G.related_to_drop(pairs, cohort, 100).collect()) == [3, 4]
