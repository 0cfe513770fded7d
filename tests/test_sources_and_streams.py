"""Files in, streams through: what SQL can't hold the queries against."""

import json
import time
from datetime import timedelta

from pyspark.sql import functions as F

from colloquy.operators import detectors as D
from colloquy.sources import turns as S
from colloquy.streaming import sessions as W


def test_snapshots_skip_and_count_bad_lines(spark, tmp_path):
    good = {"entry_id": "a", "input": {"turns": [{"turn_number": 1, "speaker": "user", "raw_text": "hi"}, {"speaker": "assistant"}]}, "expected": [{"finding_type": "SCOPE_DRIFT"}]}
    (tmp_path / "x.ndjson").write_text(json.dumps(good) + "\nnot json\n" + json.dumps({"entry_id": "b"}) + "\n")
    turns, counts = S.read_snapshots(spark, str(tmp_path))
    assert [tuple(r) for r in turns.orderBy("turn_number").collect()] == [("a", 1, "user", "hi"), ("a", 2, "assistant", "")]
    assert tuple(counts.first()) == (1, 2)
    assert [tuple(r) for r in S.read_labeled_corpus(spark, str(tmp_path))[1].collect()] == [("a", "SCOPE_DRIFT")]


def test_records_lose_fences_and_get_defaults(spark):
    raw = spark.createDataFrame([("e", '```json\n{"topic": "t", "turns": [{"text": "a"}, {"speaker": "B", "content": "b"}]}\n```')], "entry_id string, value string")
    rows = S.normalize_records(raw).orderBy("turn_number").collect()
    assert [tuple(r) for r in rows] == [("e", "t", 1, "unknown", "a"), ("e", "t", 2, "B", "b")]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\n\n one \ntwo words\n")
    assert sorted(r.phrase for r in S.load_lexicon(spark, str(tmp_path / "l.txt")).collect()) == ["one", "two words"]


def test_centroid_drift_follows_the_fold(spark):
    on, off = "alpha beta gamma delta", "omega sigma kappa lambda"
    rows = [(1, i, "user", on if i <= 3 else off) for i in range(1, 12)] + [(2, i, "user", on) for i in range(1, 12)]
    turns = spark.createDataFrame(rows, "conv_id long, turn_number int, speaker string, raw_text string")
    goal = spark.createDataFrame([(1, on), (2, on)], "conv_id long, objective string")
    found = D.scope_drift_centroid(turns, goal, sustained=3).collect()
    assert [(r.conv_id, list(r.relevant_turns)) for r in found] == [(1, [6, 7, 8, 9, 10, 11])]


def test_a_user_detector_joins_the_union(spark):
    turns = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn_number int, speaker string, raw_text string")
    D.register("mine", lambda t: D.of_rows(t, D.finding("SCOPE_DRIFT", 1, 0.5, "mine", F.array("turn_number"))))
    try:
        assert [r.finding_id for r in D.detect(turns, ("mine",)).collect()] == ["mine:[1]"]
    finally:
        del D.REGISTRY["mine"]


EVENT = "session long, event_id long, ts string, kind string, value double, root string, text string"


def _events(spark, rows, path):
    frame = spark.createDataFrame(rows, EVENT)
    frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_alerts_rest_for_some_interactions_and_a_new_root_clears(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", "k", 1.0, "a" if i < 8 else "b", "") for i in range(1, 10)]
    out = W.run_once(W.alert_cooldown(_events(spark, rows, str(tmp_path / "in")), gap=5, ttl=None), str(tmp_path / "ck"), "alerts")
    assert sorted(r.event_id for r in out.collect()) == [1, 6, 8]


def test_session_turns_keep_the_last_and_renumber(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", "stop" if i == 25 else "say", 1.0, "", f"t{i}") for i in range(1, 26)]
    out = W.run_once(W.session_turns(_events(spark, rows, str(tmp_path / "in")), "stop", ttl=None), str(tmp_path / "ck"), "turns")
    got = sorted((r.turn_number, r.raw_text) for r in out.collect())
    assert got == [(i, f"t{i + 5}") for i in range(1, 21)]


def test_a_silent_session_is_forgotten(spark, tmp_path):
    """Alerts of one kind three seconds apart, with state that ends after one: none is held back."""
    path = str(tmp_path / "in")
    (tmp_path / "in").mkdir()

    def put(i):
        spark.createDataFrame([(1, i, f"2024-01-01 00:00:{i:02d}", "k", 1.0, "a", "")], EVENT).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)

    put(1)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = W.alert_cooldown(stream, gap=5, ttl=timedelta(seconds=1)).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for n in (1, 2):
            began = time.time()
            while spark.table("forgotten").count() < n and time.time() - began < 60:
                time.sleep(0.5)
            assert sorted(r.event_id for r in spark.table("forgotten").collect()) == list(range(1, n + 1))
            if n == 1:
                time.sleep(3)
                put(2)
    finally:
        query.stop()


def test_stops_are_evaluated_once_a_batch(spark, tmp_path):
    fields = "session long, event_id long, ts string, kind string, speaker string, tool string, text string"
    said = [(1, "say", "user", None, "We have already invested three months and 4000 dollars."), (2, "tool", None, "grep", "y" * 1500), (3, "stop", None, None, "We must continue, we should keep going."), (4, "stop", None, None, "done")]
    rows = [(s, i, f"2024-01-01 00:00:{i:02d}", k, who, tool, text) for s in (1, 2) for i, k, who, tool, text in said if s == 1 or i > 3]
    spark.createDataFrame(rows, fields).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    seen = lambda turns: turns.select("conv_id", "turn_number", "speaker", F.length("raw_text").alias("n"), F.left("raw_text", F.lit(11)).alias("begin"))
    W.evaluate_at_stops(stream, "stop", seen, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    got = {(r.conv_id, r.turn_number): (r.speaker, r.n, r.begin) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # Session 2 has one interaction only, which is too few.
    assert {c for c, _ in got} == {"1:3", "1:4"} and len(got) == 3 + 4
    assert got["1:3", 2] == ("assistant", 1012, "[tool:grep]") and got["1:3", 1][0] == "user" and got["1:4", 4] == ("assistant", 4, "done")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    W.evaluate_at_stops(stream, "stop", lambda t: D.sunk_cost(t), str(tmp_path / "found"), str(tmp_path / "ck2"), once=True).awaitTermination()
    assert {r.conv_id for r in spark.read.parquet(str(tmp_path / "found")).collect()} == {"1:3", "1:4"}


def test_thresholds_and_routes_of_one_conversation(spark):
    rows = [(c, i, "user", t) for c in (1, 2, 3) for i, t in ((1, "The budget was 100 dollars."), (2, "Perhaps it takes 110 dollars then."), (3, "We have invested so much already that we must continue."))]
    turns = spark.createDataFrame(rows, "conv_id long, turn_number int, speaker string, raw_text string")
    own = spark.createDataFrame([(1, "anchoring", "threshold", 0.05), (2, "anchoring", "threshold", 0.5)], "conv_id long, detector string, parameter string, value double")
    plain = {r.conv_id for r in D.detect(turns, ("anchoring",)).collect()}
    moved = {r.conv_id: r.confidence for r in D.detect(turns, ("anchoring",), thresholds=own).collect()}
    assert plain == {1, 2, 3} and set(moved) == {2, 3} and abs(moved[2] - 0.8) < 1e-9 and abs(moved[3] - (1 - 0.1 / 0.15)) < 1e-9
    routes = spark.createDataFrame([(1, "sunk_cost"), (3, "contradiction")], "conv_id long, detector string")
    assert {r.conv_id for r in D.detect(turns, ("sunk_cost", "contradiction"), routes=routes).collect()} <= {1}
    assert {r.conv_id for r in D.detect(turns, ("sunk_cost",), routes=routes).collect()} == {r.conv_id for r in D.sunk_cost(turns).collect()} & {1}


def test_stream_of_runs_equals_the_batch(spark, tmp_path):
    rows = [(i % 3, i, f"2024-01-01 00:{i:02d}:00", "error" if i % 4 == 0 else "ok", float(i), "", "") for i in range(30)]
    stream = _events(spark, rows, str(tmp_path / "in"))
    out = W.run_once(W.recent_runs(stream), str(tmp_path / "ck"), "runs", "complete")
    batch = W.recent_runs(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_entries_pause_and_end(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:{i // 2:02d}:{30 * (i % 2):02d}", "k", 1.0, "", "") for i in range(40)]
    out = W.run_once(W.memory_rate_limit(_events(spark, rows, str(tmp_path / "in")), ttl=None), str(tmp_path / "ck"), "entries")
    assert sorted(r.event_id for r in out.collect()) == [2 * i for i in range(10)]


def test_repeated_alerts_go(spark, tmp_path):
    rows = [(1, i % 5, f"2024-01-01 00:00:{i:02d}", "k", 1.0, "", "") for i in range(20)]
    out = W.run_once(W.distinct_alerts(_events(spark, rows, str(tmp_path / "in"))), str(tmp_path / "ck"), "distinct")
    assert sorted(r.event_id for r in out.collect()) == [0, 1, 2, 3, 4]


def test_ledgers_and_sinks_keep_all_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "SCOPE_DRIFT", 0.5), ("b", "CONTRADICTION", 0.7)], "entry_id string, finding_type string, confidence double")
    for _ in range(2):
        S.write_findings(rows, str(tmp_path / "f"))
        S.append_ledger(rows.withColumn("at", F.lit(1)), str(tmp_path / "l"), "001")  # a repeated run counts once
    S.append_ledger(rows.limit(1).withColumns({"at": F.lit(2), "confidence": F.lit(0.9)}), str(tmp_path / "l"), "002")
    S.compact_ledger(spark, str(tmp_path / "l"), str(tmp_path / "m"), "entry_id")
    for path, runs in (("l", {"001", "002"}), ("m", {"compacted"})):
        read = S.read_ledger(spark, str(tmp_path / path))
        assert sorted((r.entry_id, r.at, r.confidence) for r in S.latest(read, "entry_id").collect()) == [("a", 2, 0.9), ("b", 1, 0.7)]
        assert {r.run for r in read.collect()} == runs and read.count() == (3 if path == "l" else 2)
    assert spark.read.parquet(str(tmp_path / "f")).where("finding_type = 'SCOPE_DRIFT'").count() == 2
    S.write_annotations(rows, rows.select("entry_id").union(spark.createDataFrame([("c",)], "entry_id string")), str(tmp_path / "a"))
    assert sorted((r.entry_id, r.types) for r in spark.read.json(str(tmp_path / "a")).collect()) == [("a", '["SCOPE_DRIFT"]'), ("b", '["CONTRADICTION"]'), ("c", None)]


def test_a_list_from_a_file_reaches_a_detector(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# ours\nthrown away\n")
    turns = spark.createDataFrame([(1, 1, "user", "Much was thrown away."), (1, 2, "user", "We must continue.")], "conv_id long, turn_number int, speaker string, raw_text string")
    own = S.phrases_of(S.load_lexicon(spark, str(tmp_path / "l.txt")))
    assert D.sunk_cost(turns).count() == 0 and [list(r.relevant_turns) for r in D.sunk_cost(turns, costs=own).collect()] == [[1, 2]]


def test_clusters_follow_long_chains(spark):
    from colloquy.operators import findings as P

    kinds = ["SYCOPHANCY", "CONTRADICTION"]
    rows = [(1, f"f{i:02d}", kinds[i % 2], 0.5) for i in range(12)]
    frame = spark.createDataFrame(rows, "conv_id long, finding_id string, finding_type string, confidence double")
    assert {r.cluster for r in P.conflict_clusters(frame).collect()} == {"f00"}
    chain = [(2, f"g{i}", "SCOPE_DRIFT", 0.9 if i % 2 else 0.1) for i in range(9)]
    frame = spark.createDataFrame(chain, "conv_id long, finding_id string, finding_type string, confidence double")
    assert {r.cluster for r in P.conflict_clusters(frame).collect()} == {"g0"}
