"""Registered queries over whole routes and whole model comparisons."""

from collections import defaultdict
from datetime import datetime, timedelta

from fairlead.operators import models
from fairlead.plans import analytics, proxies


def test_route_weather_asks_along_the_whole_route(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 2, start + timedelta(minutes=17 * i), "view", float(i * 31 % 97), "{}") for i in range(130)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    fixes = proxies.fixes(spark, str(tmp_path)).collect()
    forecast, tracks = defaultdict(dict), defaultdict(list)
    cell = lambda f: (f.lat // 2, f.lon // 2)
    for f in fixes:
        hour = f.event_time.replace(minute=0, second=0, microsecond=0)
        forecast[cell(f)][hour] = max(f.speed, forecast[cell(f)].get(hour, 0.0))
        tracks[f.mmsi].append(f)
    want = {}
    for mmsi, track in tracks.items():
        track.sort(key=lambda f: f.event_time)
        asked = [round(k * (len(track) - 1) / 5) for k in range(6)]
        for place in range(len(track)):
            at = min(asked, key=lambda k: (abs(k - place), k))
            gap, _, wave = min((abs(track[at].event_time - hour), hour, wave) for hour, wave in forecast[cell(track[at])].items())
            want[mmsi, place + 1] = (at, round(wave, 4) if gap <= timedelta(hours=6) else None)
    assert min(map(len, tracks.values())) > 20
    got = {(r.route_id, r.idx): (r.source_place, r.wave_height) for r in analytics.route_weather(spark, str(tmp_path)).collect()}
    assert got == want


def test_folds_are_balanced_by_label_and_empty_ones_are_reported(spark):
    rows = [(f"g{g}", int(g < 12), float(g * 7 % 11 + r)) for g in range(20) for r in range(4)]
    d = spark.createDataFrame(rows, "source string, quality int, x double")
    dealt = models.with_folds(d, "source", "quality").select("source", "fold", "quality").distinct().collect()
    sizes = lambda keep: [sum(r.fold == k and keep(r) for r in dealt) for k in range(models.FOLDS)]
    assert len(dealt) == 20 and sizes(lambda r: True) == [2] * 10
    assert set(sizes(lambda r: r.quality == 1)) == {1, 2} and set(sizes(lambda r: r.quality == 0)) == {0, 1}
    only = {"logistic_regression": models.candidates()["logistic_regression"]}
    few = d.where("source in ('g1', 'g2', 'g15')")
    got = {r.fold: r for r in models.grouped_cv(few, ["x"], "quality", "source", folds=4, models=only).collect()}
    assert sorted(got) == [0, 1, 2, 3] and sum(r.reason == "no test rows" and r.auc is None for r in got.values()) == 1
    assert sum(r.reason == "training rows of one class" for r in got.values()) == 1 and sum(r.reason is None and r.auc is not None for r in got.values()) == 2


def test_grouped_cv_is_registered_over_the_whole_comparison(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(models, "grouped_cv", lambda *a, folds=models.FOLDS, models=None: asked.update(folds=folds, models=models))
    analytics.grouped_cv(spark, "/root/testdata/sf0.001")
    assert asked == {"folds": 10, "models": None}
