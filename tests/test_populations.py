"""Replicates shared by cohorts, ancestry in two levels, and tables laid out by position, against dense algebra and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varcohort.operators import ancestry as A
from varcohort.operators import stress as T
from varcohort.plans import registry
from varcohort.sources import layout as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def drifting(spark):
    rng = random.Random(3)
    af = [(v, rng.random(), None if v % 17 == 0 else 0.0 if v % 11 == 0 else rng.random(), rng.random()) for v in range(200)]
    models = [(f"m{v % 3}", v, 0.0 if v % 7 == 0 else rng.uniform(-1, 1)) for v in range(0, 220, 2)] + [("m0", 1, 0.5), ("m1", None, 2.0), ("zero", 4, 0.0)]
    return spark.createDataFrame(af, "v long, t double, a double, b double"), spark.createDataFrame(models, "id string, v long, coef double")


def dense(spark, af, models, reps, seed, drawn):
    d = T.normalised_differences(af, "t", ["a", "b"])
    parts = max(1, -(-d.count() // drawn))
    d = d.select("d_a", "d_b", F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(parts)).alias("part"), F.xxhash64("v").alias("k")).orderBy("part", "k").toPandas()
    rows = models.join(af.dropna(), "v").withColumn("h", F.xxhash64(F.lit(seed), "v")).toPandas()
    at = np.floor(T.uniforms(rows["h"].to_numpy(), np.arange(reps)) * len(d)).astype(int)
    out = {}
    for s in ("a", "b"):
        f = rows[s].to_numpy()[:, None]
        x = 2 * rows["coef"].to_numpy()[:, None] * np.clip(f + d[f"d_{s}"].to_numpy()[at] * np.sqrt(f * (1 - f)), 0, 1)
        for i in set(rows["id"]):
            own = (rows["id"] == i).to_numpy()
            n = (rows["coef"][own] != 0).sum()
            out[i, s] = x[own].sum(axis=0) / n if n else None
    return out


@pytest.mark.parametrize("blocks", [{}, {"rows": 16, "drawn": 32, "strip": 7}])
def test_drift_is_the_dense_one_whatever_the_blocks(spark, drifting, blocks):
    af, models = drifting
    known = af.dropna()
    got = {(r["id"], r["source"], r["rep"]): r["score"] for r in T.drift_scores(known, T.normalised_differences(af, "t", ["a", "b"]), models, ["a", "b"], 40, 9, **blocks).collect()}
    want = dense(spark, af, models, 40, 9, blocks.get("drawn", 1 << 16))
    assert len(got) == 40 * len(want)
    for (i, s, rep), x in got.items():
        y = want[i, s]
        assert (x is None) if y is None else x == pytest.approx(y[rep - 1], abs=1e-12)


def test_cohorts_share_their_draws(spark, drifting):
    af, models = drifting
    same = af.withColumn("b", F.col("a"))
    got = T.drift_scores(same, T.normalised_differences(same, "t", ["a", "b"]), models, ["a", "b"], 20, 1).where("score IS NOT NULL")
    wide = got.groupBy("id", "rep").pivot("source").agg(F.first("score"))
    assert wide.where("abs(a - b) > 1e-12").count() == 0 and got.select("score").distinct().count() > 20


def test_stress_test_counts_and_p(spark, drifting):
    af, models = drifting
    got = {(r["id"], r["source"]): r for r in T.stress_test(af, models, "t", ["a", "b"], 60, 2).collect()}
    sim = dense(spark, af, models, 60, 2, 1 << 16)
    rows = models.join(af.dropna(), "v").where("coef <> 0").toPandas()
    assert set(got) == {k for k, x in sim.items() if x is not None}
    for (i, s), r in got.items():
        own = rows[rows["id"] == i]
        rel = sim[i, s] - 2 * (own["coef"] * own["t"]).sum() / len(own)
        below, above = (rel < 0).sum(), (rel > 0).sum()
        assert (r["below"], r["above"], r["n_reps"]) == (below, above, 60)
        assert r["p"] == pytest.approx(min(1, (0.5 + min(below, above)) * 2 / 61)) and r["p_holm"] >= r["p_bh"] >= r["p"]
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(rel, [0.025, 0.975]))) and r["mean"] == pytest.approx(rel.mean())


def test_no_differences_no_scores(spark, drifting):
    af, models = drifting
    none = T.normalised_differences(af, "t", ["a", "b"]).limit(0)
    assert T.drift_scores(af, none, models, ["a", "b"], 5, 1).count() == 0
    assert T.stress_test(af.limit(0), models, "t", ["a", "b"], 5, 1).count() == 0


COUNTS = "v long, cohort string, n_rr long, n_ra long, n_aa long"


def test_bootstrap_scores_have_the_moments_of_the_draw(spark):
    counts = [(1, "a", 30, 50, 20), (2, "a", 90, 10, 0), (3, "a", 0, 0, 0), (1, "b", 10, 0, 0), (9, "b", 5, 5, 5), (2, "b", None, 1, 1)]
    models = spark.createDataFrame([("m", 1, 0.2, 1.0), ("m", 2, 0.3, -2.0), ("m", 3, 0.5, 3.0), ("m", None, None, 4.0)], "id string, v long, aaf double, coef double")
    df = spark.createDataFrame(counts, COUNTS)
    scores = T.boot_scores(df, models, 4000, 5)
    got = {c: np.array([r["score"] for r in scores.where(F.col("cohort") == c).orderBy("rep").collect()]) for c in "ab"}
    assert len(got["a"]) == 4000
    mean = (1.0 * 0.9 - 2.0 * 0.1 + 3.0 * 1.0) / 4
    var = (1.0 * (0.5 + 4 * 0.2 - 0.9**2) + 4.0 * (0.1 - 0.1**2)) / 100 / 16
    assert got["a"].mean() == pytest.approx(mean, abs=4 * np.sqrt(var / 4000)) and got["a"].var() == pytest.approx(var, rel=0.15)
    assert got["b"] == pytest.approx(np.full(4000, (-2.0 * 0.6 + 3.0) / 4))  # the one locus that b knows never varies
    again = T.boot_scores(df.repartition(3), models.repartition(5), 4000, 5).where("cohort = 'a'").orderBy("rep").collect()
    assert np.array([r["score"] for r in again]) == pytest.approx(got["a"])
    assert T.boot_scores(df.limit(0), models, 10, 5).count() == 0


def test_cohorts_compared(spark):
    rows = [("m", "a", r, float(r)) for r in range(1, 101)] + [("m", "b", r, 1000.0) for r in range(1, 101)] + [("m", "c", r, 1000.0) for r in range(1, 101)] + [("n", "a", 1, 0.0)]
    got = {(r["cohort1"], r["cohort2"]): r for r in T.boot_compare(spark.createDataFrame(rows, "id string, cohort string, rep int, score double"), 999, 3).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    ab, bc = got["a", "b"], got["b", "c"]
    assert (ab["below"], ab["above"]) == (999, 0) and ab["p"] == pytest.approx(0.001)
    assert ab["median"] == pytest.approx(50.5 - 1000, abs=6) and ab["low"] == pytest.approx(3 - 1000, abs=3)
    assert (bc["below"], bc["above"], bc["median"]) == (0, 0, 0.0) and bc["p"] == pytest.approx(0.001)  # no difference either way counts as the formula has it


def people(n, seed, spread):
    rng = np.random.default_rng(seed)
    at = {"E": (0, 0), "F": (9, 0), "G": (0, 9)}
    out = []
    for i in range(n):
        up = "EFG"[i % 3]
        low = f"{up}{i // 3 % 2}"
        x = np.array(at[up]) + rng.normal(0, spread, 2) + (3 * (i // 3 % 2) if up == "E" else 0)
        out.append((i, up if i % 4 else None, low if i % 4 else None, up, low, float(x[0]), float(x[1])))
    return out


SCHEMA = "s int, upper string, lower string, true_upper string, true_lower string, pc1 double, pc2 double"
PCS = ["pc1", "pc2"]


def test_posteriors_are_the_dense_ones(spark):
    rows = people(300, 1, 1.5)
    df = spark.createDataFrame(rows, SCHEMA)
    for form in A.FORMS:
        model = A.fit_classes(df, "upper", PCS, (form,))
        known = [r for r in rows if r[1]]
        n = np.array([sum(r[1] == k for r in known) for k in "EFG"])
        x = {k: np.array([r[5:] for r in known if r[1] == k]) for k in "EFG"}
        scatter = np.array([np.cov(x[k].T, bias=True) for k in "EFG"])
        pooled = (n[:, None, None] * scatter).sum(axis=0) / n.sum()
        base = scatter if form[0] == "V" else np.repeat(pooled[None], 3, 0)
        cov = {"VV": base, "EE": base}.get(form[1:], base * np.eye(2)) if form[1:] != "II" else np.trace(base, axis1=1, axis2=2)[:, None, None] / 2 * np.eye(2)
        assert model.covariances == pytest.approx(cov, rel=1e-6) and list(model.names) == list("EFG")
        got = {r["s"]: r["p_probabilities"] for r in A.classify(df, model, PCS, "p").collect()}
        for r in rows[:60]:
            z = np.array(r[5:])
            d = np.array([m / n.sum() * np.exp(-0.5 * (z - x[k].mean(0)) @ np.linalg.inv(c) @ (z - x[k].mean(0))) / np.sqrt(np.linalg.det(c)) for k, m, c in zip("EFG", n, cov)])
            assert [got[r[0]][k] for k in "EFG"] == pytest.approx(list(d / d.sum()), abs=1e-6)


def test_criterion_takes_the_form_that_drew_the_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(a), float(b)) for k, s in (("x", 1.0), ("y", 5.0)) for a, b in rng.normal(0, s, (800, 2)) + (0 if k == "x" else 30)]
    assert A.fit_classes(spark.createDataFrame(rows, "k string, pc1 double, pc2 double"), "k", PCS).form == "VII"
    rows = [(k, float(a), float(b)) for k in "xy" for a, b in rng.multivariate_normal([0, 0] if k == "x" else [20, 5], [[4, 3], [3, 4]], 800)]
    assert A.fit_classes(spark.createDataFrame(rows, "k string, pc1 double, pc2 double"), "k", PCS).form == "EEE"


def test_two_levels(spark):
    df = spark.createDataFrame(people(600, 4, 0.6) + [(900, None, None, None, None, None, 1.0)], SCHEMA)
    got = {r["s"]: r for r in A.ancestry_levels(df, "upper", "lower", "E", "E1", PCS).collect()}
    assert len(got) == 601 and got[900]["predicted_upper"] is None and got[900]["flag"] is None
    held = [r for r in got.values() if r["upper"] is None and r["s"] != 900]
    assert np.mean([r["predicted_upper"] == r["true_upper"] for r in held]) > 0.99
    inside = [r for r in held if r["true_upper"] == "E"]
    assert np.mean([r["predicted_lower"] == r["true_lower"] for r in inside]) > 0.97
    for r in got.values():
        if r["predicted_upper"] != "E":
            assert r["predicted_lower"] is None and r["flag_probability"] is None and not r["flag"]
        else:
            assert r["flag"] == (r["predicted_lower"] != "E1") and r["flag_probability"] == pytest.approx(r["predicted_lower_probabilities"]["E0"])


def test_panels_that_tell_little(spark):
    df = spark.createDataFrame(people(30, 1, 1.0), SCHEMA)
    none = A.ancestry_levels(df.withColumns({"upper": F.lit(None).cast("string"), "lower": F.lit(None).cast("string")}), "upper", "lower", "E", "E1", PCS)
    assert none.where("predicted_upper IS NOT NULL").count() == 0 and none.count() == 30
    one = df.withColumn("upper", F.when(F.col("s") == 1, "E")).withColumn("lower", F.when(F.col("s") == 1, "E0"))
    assert {(r["predicted_upper"], r["predicted_lower"]) for r in A.ancestry_levels(one, "upper", "lower", "E", "E1", PCS).collect()} == {("E", "E0")}


def test_ancestry_of_people_that_the_panel_lacks(spark):
    got = registry.QUERIES["ancestry"](spark, SF).where("s % 3 = 0").collect()
    assert np.mean([r["predicted_upper"] == r["region"] for r in got]) > 0.7
    inside = [r for r in got if r["region"] == r["predicted_upper"] == "EUROPE"]
    assert np.mean([r["predicted_lower"] == r["nation"] for r in inside]) > 0.5


def test_files_outside_the_intervals_are_not_opened(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "1").when(F.col("id") == 19_999, None).otherwise("2").alias("contig"), (F.col("id") * 7919 % 100_000).alias("pos"), "id").repartition(7)
    L.write_clustered(df, at, 500)
    every = spark.read.parquet(at)
    assert every.count() == 20_000
    asked = [("2", 40_000, 42_000), ("1", None, 100), ("9", 1, 2)]
    got = L.read_intervals(spark, at, asked)
    want = df.where("contig = '2' AND pos BETWEEN 40000 AND 42000 OR contig = '1' AND pos <= 100")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()) and want.count() > 100
    assert len(every.inputFiles()) >= 35 and len(got.inputFiles()) <= 5
    whole = L.read_intervals(spark, at, [("1", None, None)])
    assert whole.count() == df.where("contig = '1'").count() and len(whole.inputFiles()) < 20
    assert L.read_intervals(spark, at, []).count() == 0 and L.read_intervals(spark, at, [("9", None, None)]).columns == df.columns


def test_an_empty_table_is_laid_out_too(spark, tmp_path):
    df = spark.createDataFrame([], "contig string, pos long")
    L.write_clustered(df, str(tmp_path / "t"), 10)
    assert L.read_intervals(spark, str(tmp_path / "t"), [("1", None, None)]).count() == 0


def test_databases_join_where_they_lie(spark, tmp_path):
    sites = spark.createDataFrame([(1, "1", 10, "A", ["C", "G"]), (2, "1", 10, "AT", ["A"]), (3, "2", 10, "A", ["C"]), (4, "2", 99, "A", []), (5, None, 10, "A", ["C"])], "v int, contig string, pos int, ref string, alts array<string>")
    one = spark.createDataFrame([("1", 10, "A", "G", 0.5, "x"), ("1", 10, "A", "G", 0.25, "y"), ("1", 10, "AT", "A", None, "z"), (None, 10, "A", "C", 0.1, "n"), ("2", 10, "A", "T", 0.9, "w")], "contig string, pos int, ref string, alt string, af double, name string")
    two = one.limit(0)
    tables = {"sites": sites, "one": L.by_position(one, ["af", "name"]), "two": L.by_position(two, ["af"])}
    lie = {n: L.write_bucketed(t, f"lie_{n}", str(tmp_path / n), 4) for n, t in tables.items()}
    try:
        out = L.annotate_sites(lie["sites"], {"one": lie["one"], "two": lie["two"]})
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r["v"]: r for r in out.collect()}
        assert [x and tuple(x) for x in got[1]["one"]] == [None, (0.25, "y")] and [tuple(x) for x in got[2]["one"]] == [(None, "z")]
        assert got[3]["one"] in ([None], None) and got[4]["two"] in ([], None) and len(got) == 5
        assert all(x is None for r in got.values() for x in r["two"] or [])
    finally:
        for n in tables:
            spark.sql(f"DROP TABLE lie_{n}")


def test_queries_leave_no_tables_or_folders(spark, small):
    assert registry.QUERIES["annotated_sites"](spark, small).count() > 0 and registry.QUERIES["clustered_intervals"](spark, small).count() > 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(tuple(f"{n}_" for n, *_ in registry.populations.DATABASES))]
