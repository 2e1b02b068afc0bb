"""Hand-made cases for engagement, cohorts and funnels."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from earshot import CohortAnalyzer, DashboardGenerator, FunnelAnalyzer
from earshot.operators import cohorts as co, engagement as eng, funnels as fu


def signups(rows, **users):
    return rows(list(users.items()), "user_id string, s string").select("user_id", F.to_timestamp("s").alias("signup_date"))


def test_dau_counts_a_user_once(plays):
    got = eng.stickiness(plays(("a", "2024-01-01 10:00"), ("a", "2024-01-01 11:00"), ("b", "2024-01-31 10:00"))).collect()
    assert [(r.date, r.dau, r.mau, r.stickiness_ratio) for r in got] == [
        (date(2024, 1, 1), 1, 2, 50.0), (date(2024, 1, 31), 1, 2, 50.0)]


def test_segment_bounds(plays):
    p = plays(*[("p", "2024-01-01 10:00")] * 100, *[("a", "2024-01-01 10:00")] * 30,
              *[("c", "2024-01-01 10:00")] * 10, *[("l", "2024-01-01 10:00")] * 9)
    assert {r.user_segment: r.user_count for r in eng.engagement_segments(p).collect()} == {
        "Power User": 1, "Active": 1, "Casual": 1, "Light": 1}


def test_unset_skip_flag(plays):
    """No skip in the percent reports, left out of the fractions."""
    p = plays(("a", "2024-01-01 10:00", {"skipped": True}), ("a", "2024-01-01 10:30", {"skipped": None}))
    assert eng.skip_report_by_hour(p).head().skip_rate == 50.0
    assert eng.skip_rate_by(p, "context").head().skip_rate == 1.0


def test_unknown_energy(plays, rows):
    p = plays(*(("a", "2024-01-01 10:00", {"track_id": t}) for t in "xyz"))
    t = rows([("x", None), ("y", 0.0), ("z", 0.33)], "track_id string, energy double")
    assert {r.energy_level: r.plays for r in eng.skip_report_by_energy(p, t).collect()} == {"High Energy": 1, "Low Energy": 1, "Medium Energy": 1}
    assert [r.energy_level for r in eng.skip_percent_by_energy(p, t).collect()] == ["Low"]


def test_retention_curve_has_every_day(plays, rows):
    got = DashboardGenerator().calculate_retention_curve(
        signups(rows, a="2024-01-01 12:00:00", b="2024-01-01 00:00:00"),
        plays(("a", "2024-01-01 13:00"), ("b", "2024-01-03 01:00")), 3).collect()
    # a signed up at noon: its first day starts before that, day -1.
    assert [(r.day, r.users, r.retention_rate) for r in got] == [(0, 0, 0.0), (1, 0, 0.0), (2, 1, 0.5), (3, 0, 0.0)]


def test_thirteen_months(plays, rows):
    got = co.monthly_retention_report(signups(rows, a="2023-01-15 00:00:00"), plays(("a", "2024-02-01 00:00"))).head()
    assert (got.months_since_signup, got.retention_rate) == (13, 100.0)


def test_activity_before_signup_is_left_out(plays, rows):
    analyzer = CohortAnalyzer()
    matrix = analyzer.calculate_retention(signups(rows, a="2024-03-15 00:00:00", b="2024-04-02 00:00:00"),
                                          plays(("a", "2024-01-01 00:00"), ("a", "2024-03-01 00:00")), 3).collect()
    assert [(r.period_0, r.period_1) for r in matrix] == [(100.0, None)]
    stats = {r.cohort: r for r in analyzer.cohort_stats.collect()}
    assert stats[date(2024, 4, 1)].initial_retention is None and stats[date(2024, 4, 1)].cohort_size == 1
    summary = analyzer.get_retention_summary().head()
    assert summary.num_cohorts == 1 and summary.best_cohort is None and summary.avg_period_6_retention == 0


def test_best_and_worst_cohort_tie(plays, rows):
    users = signups(rows, a="2024-01-01 00:00:00", b="2024-02-01 00:00:00")
    p = plays(("a", "2024-02-05 00:00"), ("b", "2024-03-05 00:00"))
    got = co.retention_summary(co.retention(users, p)).head()
    assert got.best_cohort == got.worst_cohort == "2024-01"


def test_summary_needs_retention():
    with pytest.raises(ValueError):
        CohortAnalyzer().get_retention_summary()


def test_churn(plays, rows):
    users = signups(rows, a="2024-01-01 00:00:00", b="2024-01-01 00:00:00", never="2024-01-01 00:00:00")
    p = plays(("a", "2024-01-31 12:00"), ("b", "2024-01-01 13:00"))
    risk = {r.user_id: (r.days_inactive, r.churn_risk) for r in co.churn_risk(users, p).collect()}
    assert risk == {"a": (0, False), "b": (29, False), "never": (999, True)}
    churned = {r.user_id: (r.days_inactive, r.is_churned) for r in co.churned_users(users, p).collect()}
    assert churned == {"a": (0, False), "b": (30, True), "never": (None, True)}


def test_user_metrics_upsert_keeps_and_replaces(plays):
    before, after = plays(("a", "2024-01-01 10:00"), ("b", "2024-01-01 10:00")), None
    after = before.unionByName(plays(("b", "2024-01-02 10:00"), ("c", "2024-01-02 10:00")))
    got = eng.upsert_user_metrics(eng.user_metrics(before), after, plays(("b", ""), ("c", "")).select("user_id"))
    assert {r.user_id: r.total_sessions for r in got.collect()} == {"a": 1, "b": 2, "c": 1}


def test_stage_table_and_growth(rows):
    counts = rows([(10, 5, 8)], "a bigint, b bigint, c bigint")
    got = fu.stage_table(counts, ["a", "b", "c"]).orderBy("stage_no").collect()
    assert [r.drop_off_rate for r in got] == pytest.approx([0, .5, -.6])
    assert counts.select(fu.biggest_drop(["a", "b", "c"])).head()[0] == "b"
    growing = rows([(5, 6)], "a bigint, b bigint")
    assert growing.select(fu.biggest_drop(["a", "b"])).head()[0] == "unknown"
    assert fu.recommendations(growing, ["a", "b"]).head().recommendation == fu.HEALTHY_ADVICE
    empty = rows([(0, 0)], "a bigint, b bigint")
    assert [r.conversion_rate for r in fu.stage_table(empty, ["a", "b"]).collect()] == [0, 0]


def test_activation(plays, rows):
    analyzer = FunnelAnalyzer()
    users = signups(rows, a="2024-01-01 12:00:00", b="2024-01-01 00:00:00", c="2024-01-01 00:00:00")
    p = plays(("a", "2024-01-01 11:00"), ("a", "2024-01-08 11:00"), ("a", "2024-01-15 11:00"), ("a", "2024-01-22 11:01"),
              ("b", "2024-01-05 10:00"), ("b", "2024-01-12 10:01"), ("b", "2024-01-12 10:02"))
    rates = analyzer.analyze_user_activation(users, p).head()
    stages = {s.name: s.users for s in analyzer.funnel_stages}
    # a: signup after the first play; the 7th and 14th day count to the minute. b: a minute late.
    assert stages == {"signed_up": 3, "first_session": 2, "activated_day_1": 1, "active_week_1": 1,
                      "retained_week_2": 2, "weekly_active": 1}
    assert rates.day_1_activation_rate == pytest.approx(1 / 3)


def test_earliest_plays_are_limited_before_the_shuffle(plays, rows):
    df = fu.activation_counts(signups(rows, a="2024-01-01 00:00:00"), plays(("a", "2024-01-01 11:00")))
    plan = df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_week_numbers_without_year(plays, rows):
    users = signups(rows, a="2023-01-01 00:00:00")
    p = plays(*(("a", t) for t in ("2023-01-09 10:00", "2024-01-10 10:00", "2023-02-06 10:00", "2023-03-06 10:00")))
    def weekly(**kw):
        return fu.activation_counts(users, p, **kw).head().weekly_active
    assert weekly() == 1 and weekly(iso_week_only=True) == 0


def test_playlists_by_their_own_length(plays, rows):
    p = plays(*[("a", "2024-01-01 10:00")] * 2).withColumn("playlist_id", F.lit("p"))
    contents = rows([("p", "x"), ("p", "y"), ("q", "x")], "playlist_id string, track_id string")
    analyzer = FunnelAnalyzer()
    assert analyzer.analyze_playlist_completion(p, None, contents).head().overall_completion_rate == 1.0
    assert analyzer.get_recommendations()[0].startswith("High drop-off (100.0%) at 'track_3_complete'")
    assert FunnelAnalyzer().get_recommendations() == ["Nothing to advise yet: analyse a funnel first."]


def test_event_order(rows):
    df = rows([("a", "x", 1), ("a", "y", 2), ("b", "y", 1), ("b", "x", 2), ("b", "y", 2), ("c", "y", 3)],
              "user_id string, event_type string, n int").withColumn("ts", F.timestamp_seconds("n"))
    got = FunnelAnalyzer().analyze_events(df, ["x", "y"]).orderBy("stage_no").collect()
    assert [r.users for r in got] == [2, 2]
