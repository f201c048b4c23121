"""Registries as data: the fragment index against plain containment, designs, and thousands of experiments."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from splitscope import LANDING_PAGE, Arm, Experiment, Study
from splitscope.operators import registry
from splitscope.operators.events import ga4_events
from splitscope.operators.exposure import exposed_views, exposures
from tests.ga4rows import V1, V2, event, frame
from tests.test_plans import plan, scans

PIECES = ["/landing-v1", "/landing-v2", "/l", "/", "x", "?variant=", "it's", "a\\b", "é漢", "-", "1", "checkout"]


def random_registry(rnd, n):
    def fragment():
        return "".join(rnd.choices(PIECES, k=rnd.randint(1, 3)))

    made = []
    for i in range(n):
        arms = rnd.sample(sorted({fragment() for _ in range(12)}), rnd.randint(2, 4))
        made.append(Experiment(f"e{i}", tuple(Arm(f"v{j}", f) for j, f in enumerate(arms))))
    return made


@pytest.mark.parametrize("direct", [registry.DIRECT, 0])
@pytest.mark.parametrize("keep", [False, True])
def test_views_find_the_arms_that_plain_comparison_finds(spark, direct, keep, monkeypatch):
    monkeypatch.setattr(registry, "DIRECT", direct)
    rnd = random.Random(5)
    experiments = [*random_registry(rnd, 20), Experiment("all", (Arm("none", "no such page"), Arm("any", "")))]
    urls = [None, "", "/l", *("".join(rnd.choices(PIECES, k=rnd.randint(0, 6))) for _ in range(60))]
    rows = spark.createDataFrame([(i, u, i % 5 > 0) for i, u in enumerate(urls)], "i int, page_location string, is_view boolean")
    got = registry.exposed_rows(rows, experiments, F.col("is_view"), keep=keep).collect()
    want = [
        (i, e.experiment_id, next(a.variant for a in e.arms if a.url_contains in u))
        for i, u in enumerate(urls)
        if u is not None and i % 5
        for e in experiments
        if any(a.url_contains in u for a in e.arms)
    ]
    want += [(i, None, None) for i in range(len(urls))] if keep else []
    assert sorted(map(repr, ((r.i, r.experiment_id, r.variant) for r in got))) == sorted(map(repr, want))


def test_a_fragment_goes_by_a_gram_of_its_own_where_it_has_one():
    fragments = [f"/landing-{i}" for i in range(100, 300)] + ["/v", "", "/landing-100-b"]
    grams = registry.rarest_grams(fragments)
    assert all(g in f for f, g in grams.items()) and grams[""] == ""
    assert len(set(grams.values())) >= len(fragments) - 1


def _events():
    rows = []
    for i in range(40):
        rows.append(event(f"u{i}", "page_view", i, V1 if i % 2 else V2, session=i % 3))
        if i % 5 == 0:
            rows.append(event(f"u{i}", "purchase", 100 + i))
    return rows


@pytest.mark.parametrize("labels", ["shared", "distinct", "pages"])
def test_thousands_of_experiments(spark, labels):
    def experiment(i):
        name = "" if labels == "shared" else i
        pages = ("/landing-v1", "/landing-v2") if labels != "pages" or i == 7 else (f"/page-{i}-a", f"/page-{i}-b")
        return Experiment(f"e{i}", tuple(Arm(f"{v}{name}", p) for v, p in zip("AB", pages, strict=True)))

    many = Study(frame(spark, _events()), experiments=[experiment(i) for i in range(2000)])
    plain = tuple(Study(frame(spark, _events())).z_test().drop("control_name", "variant_name").first())
    rows = many.z_test().drop("control_name", "variant_name").collect()
    assert len(rows) == (1 if labels == "pages" else 2000)
    assert {tuple(r)[1:] for r in rows} == {plain}
    assert many.launch_decision().count() == 2000
    assert many.guardrails().count() == len(rows)


def test_the_plan_is_the_same_for_any_number_of_experiments(spark):
    def nodes(n):
        experiments = [Experiment(f"e{i}", (Arm("A", f"/a{i}/"), Arm("B", f"/b{i}/"))) for i in range(n)]
        text = plan(Study(frame(spark, _events()), experiments=experiments).z_test())
        return [line.strip(" :+-").split(" ")[0].split("(")[0] for line in text.splitlines()]

    assert nodes(20) == nodes(600)


def test_designs_are_measured_once_and_named_apart(spark):
    other = Experiment("other", (Arm("Old", "/landing-v1", 0.9), Arm("New", "/landing-v2", 0.1)))
    turned = Experiment("turned", (Arm("X", "/landing-v2"), Arm("Y", "/landing-v1")))
    assert len(registry.designs([LANDING_PAGE, other, turned])) == 2
    study = Study(frame(spark, _events()), experiments=[LANDING_PAGE, other, turned])
    stats = {(r.experiment_id, r.variant): r.visitors for r in study.variant_stats.collect()}
    assert stats == {(e.experiment_id, a.variant): 20 for e in (LANDING_PAGE, other, turned) for a in e.arms}
    verdicts = {r.experiment_id: r.srm_result for r in study.srm_test().collect()}
    assert "DETECTED" in verdicts["other"] and "No SRM" in verdicts["turned"]
    assert {r.experiment_id for r in study.conversions().collect()} == {"landing_page", "other", "turned"}
    flat = ga4_events(frame(spark, _events()))
    alone = exposures(flat, [LANDING_PAGE, other, turned])
    assert sorted(map(str, alone.select("experiment_id", "variant", "user_pseudo_id").collect())) == sorted(
        map(str, study.exposures().select("experiment_id", "variant", "user_pseudo_id").collect())
    )


def test_views_of_a_stream_can_be_tagged(spark, tmp_path):
    frame(spark, _events()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(tmp_path / "in"))
    views = exposed_views(ga4_events(stream), [LANDING_PAGE, *random_registry(random.Random(1), 30)])
    job = views.writeStream.format("memory").queryName("tagged").trigger(availableNow=True)
    job = job.option("checkpointLocation", str(tmp_path / "state")).start()
    job.awaitTermination()
    assert spark.table("tagged").where("experiment_id = 'landing_page'").count() == 40


def test_reports_read_the_events_once(spark, tmp_path):
    path = str(tmp_path / "flat")
    for experiments in (LANDING_PAGE, [LANDING_PAGE, Experiment("home", (Arm("H", "/home"), Arm("V", "/landing")))]):
        study = Study(frame(spark, _events()), experiments=experiments)
        study = study.flattened(f"{path}-{len(str(experiments))}")
        reports = [
            study.session_metrics, study.guardrails(), study.launch_decision(), study.launch_decision(by_channel=True),
            study.z_test(by_channel=True), study.bayes_test(by_channel=True), study.sample_size(by_channel=True),
            study.guardrails(by_channel=True), study.srm_test(by_channel=True), study.test_pages(),
        ]
        assert [len(scans(r)) for r in reports] == [1] * len(reports)
