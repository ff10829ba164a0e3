"""Listeners: order, isolation of errors, ends of subscriptions; and those of a stream that runs."""

import json

import pytest

from cairnfield.streaming.incremental import events
from cairnfield.streaming.listeners import Listeners


def test_listeners_are_called_in_order_and_apart(caplog):
    heard, bus = [], Listeners()
    bus.subscribe("done", lambda x: heard.append(("a", x)))
    bus.subscribe("done", lambda x: 1 / 0)
    end = bus.subscribe("done", lambda x: heard.append(("b", x)))
    assert bus.publish("done", 1) == 1 and heard == [("a", 1), ("b", 1)]
    end()
    end()
    assert bus.count("done") == 2 and bus.count("other") == 0
    bus.publish("done", 2)
    assert heard[2:] == [("a", 2)] and bus.publish("other") == 0
    with pytest.raises(TypeError):
        bus.subscribe("done", None)


def test_a_listener_may_end_itself_while_called():
    heard, bus = [], Listeners()
    ends = [bus.subscribe("x", lambda: (heard.append(1), ends[0]()))]
    bus.subscribe("x", lambda: heard.append(2))
    bus.publish("x")
    bus.publish("x")
    assert heard == [1, 2, 2]


def test_listeners_hear_a_stream(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"ts": "2024-01-01T00:00:00", "path": "a.py", "op": "upsert"}))
    heard, bus = [], Listeners()
    bus.subscribe("started", lambda e: heard.append(str(e.runId)))
    spark.streams.addListener(bus)
    try:
        q = events(spark, str(folder)).writeStream.foreachBatch(lambda df, _: df.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert str(q.runId) in heard
    finally:
        spark.streams.removeListener(bus)
