import datetime as dt

import pytest

from foliant.functions.fuzzy import near_window
from foliant.streaming import replay as St

AT = dt.datetime(2024, 1, 1, 10, 0)


def minute(m):
    return AT + dt.timedelta(minutes=m)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_changed_configuration_raises(spark, tmp_path):
    src, out, check = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/check"
    write(spark, src, [(i, "a", 1.0) for i in range(5)], "event_id long, kind string, value double")
    stream = lambda: spark.readStream.schema("event_id long, kind string, value double").parquet(src)
    run = lambda config: St.run_resumable(stream(), lambda b: b, "event_id", out, check, config)
    run({"methods": ["x", "y"], "limit": None})
    write(spark, src, [(i, "b", 2.0) for i in range(3, 9)], "event_id long, kind string, value double")
    with pytest.raises(ValueError, match="another configuration"):
        run({"methods": ["x"], "limit": None})
    assert spark.read.parquet(out).count() == 5
    run({"limit": None, "methods": ["x", "y"]})  # the same, in another order
    assert spark.read.parquet(out).count() == 11


def test_progress_counts_items_once_and_closes_idle_runs(spark, tmp_path):
    src, check = f"{tmp_path}/src", f"{tmp_path}/check"
    schema = "run string, item long, failed boolean, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []

    def step(rows):
        write(spark, src, rows, schema)
        found = []
        q = St.progress(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").foreachBatch(lambda b, _: found.extend(tuple(r) for r in b.collect()))
        q.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted((r[0], r[1], r[2], r[4]) for r in found))

    try:
        step([("a", 1, False, minute(0)), ("a", 2, True, minute(1)), ("a", 1, False, minute(1)), ("b", 7, None, minute(2)), ("b", None, True, minute(2))])
        assert got[-1] == [("a", 2, 1, "running"), ("b", 1, 0, "running")]
        step([("a", 2, True, minute(3)), ("a", 3, False, minute(5))])  # a repeated item from before the restart
        assert got[-1] == [("a", 3, 1, "running")]
        step([("c", 1, False, minute(120))])
        assert ("c", 1, 0, "running") in got[-1] and ("a", 3, 1, "idle") in got[-1] and ("b", 1, 0, "idle") in got[-1]
        step([("a", 9, False, minute(20)), ("c", 2, False, minute(121))])  # later than the watermark: left out
        assert got[-1] == [("c", 2, 0, "running")]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_replies_join_their_questions(spark, tmp_path):
    a, b, check = f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/check"
    ask, reply = "question_id long, ts timestamp", "question_id long, ts timestamp, reply string"
    write(spark, a, [(1, minute(0)), (2, minute(1)), (3, minute(2))], ask)
    write(spark, b, [(1, minute(5), "in time"), (2, minute(90), "too late"), (3, minute(1), "too early"), (9, minute(5), "no question")], reply)
    q = St.answered(spark.readStream.schema(ask).parquet(a), spark.readStream.schema(reply).parquet(b))
    q.writeStream.format("memory").queryName("answered_rows").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert [(r["question_id"], r["reply"]) for r in spark.table("answered_rows").collect()] == [(1, "in time")]


def test_bounds_rule_out_no_window():
    import random
    from difflib import SequenceMatcher

    rng, compared, total = random.Random(4), 0, 0
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 7)))
    for _ in range(300):
        words = [word() for _ in range(rng.randint(0, 60))]
        answer = " ".join(words[5:8]).replace("a", "b", 1) if rng.random() < 0.4 and len(words) > 9 else " ".join(word() for _ in range(rng.randint(1, 4)))
        n = len(answer.split())
        if not n:
            continue
        windows = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
        found, tried = near_window(answer, words, 0.82)
        assert found == any(SequenceMatcher(None, answer, w).ratio() >= 0.82 for w in windows)
        compared, total = compared + tried, total + len(windows)
    assert compared < 0.1 * total
