from __future__ import annotations

from splitscope.operators.events import ga4_events
from splitscope.operators.srm import srm_counts, srm_split, srm_test
from splitscope.sources.ga4 import read_events, write_events
from splitscope.streaming.split_monitor import checkpoint_dir, monitor_split, read_event_stream
from tests.ga4rows import V1, V2, event, frame


def rows(users, date):
    pages = [V1, V2, V2]
    return [event(f"u{i}", "page_view", i, pages[i % 3], date=date) for i in users]


def test_split_is_kept_up_to_date_and_survives_a_restart(spark, tmp_path):
    path, seen = str(tmp_path / "events"), []

    def keep(split, test, batch_id):
        seen.append((sorted(map(tuple, split.collect())), tuple(test.first())))

    def run():
        stream = read_event_stream(spark, path)
        query = monitor_split(stream, keep).trigger(availableNow=True).start()
        query.awaitTermination()

    write_events(frame(spark, [*rows(range(9), "20240101"), event(None, "page_view", 1, V1)]), path)
    run()
    # The second day brings some users back: they must not count again.
    write_events(frame(spark, rows(range(6, 30), "20240102")), path, mode="append")
    run()

    counts = srm_counts(ga4_events(read_events(spark, path)))
    whole = (sorted(map(tuple, srm_split(counts).collect())), tuple(srm_test(counts).first()))
    assert len(seen) >= 2
    assert [r[1] for r in seen[0][0]] == [3, 6]
    assert seen[-1] == whole


def test_state_lies_in_the_folder_of_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark, "x") == f"{root}/x"
