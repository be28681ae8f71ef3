"""Turns from the driver: the summed rate of uneven tasks, pauses for all, workers that can't reach it."""

import socket
import time
import urllib.error
from concurrent.futures import ThreadPoolExecutor

import pytest

from oddsframe.sources import api
from oddsframe.sources.pace import Pace, Turns, turns

GAP = 0.05


@pytest.fixture
def pace():
    made = Pace({"trades": GAP, "events": GAP})
    yield made
    made.close()


def test_uneven_tasks_use_the_whole_rate_and_no_more(spark, tmp_path, pace):
    given, folder = pace.turns, str(tmp_path)

    def run(frames):
        for f in frames:
            for task, n in zip(f["task"], f["n"], strict=True):

                def transport(url, task=task):
                    with open(f"{folder}/{task}", "a") as out:
                        out.write(f"{time.time()}\n")
                    return "[]"

                client = api.Client("trades", transport=transport, share=4, turns=given)
                for k in range(n):
                    client.get_json("http://x", {"k": k})
                yield f[["task"]].head(1)

    tasks = spark.createDataFrame([(0, 40), (1, 1), (2, 1), (3, 1)], "task int, n int").repartitionByRange(4, "task")
    tasks.mapInPandas(run, "task int").collect()
    asked = sorted(float(x) for p in tmp_path.iterdir() for x in p.read_text().split())
    alone = sorted(float(x) for x in (tmp_path / "0").read_text().split())
    assert len(asked) == 43
    for a, b in zip(asked, asked[10:], strict=False):  # ten turns take ten intervals, but for the time a request needs to start
        assert b - a > 10 * GAP - 0.03
    assert alone[-1] - alone[0] < 2 * 39 * GAP  # a fixed share would take four times as long


def test_turns_are_apart_whoever_takes_them(pace):
    began = time.monotonic()
    with ThreadPoolExecutor(8) as pool:
        due = sorted(pool.map(lambda _: (wait := pace.turns.ask("trades")) + time.monotonic() - began, range(16)))
    assert all(b - a > GAP * 0.5 for a, b in zip(due, due[1:], strict=False)) and 15 * GAP * 0.9 < due[-1] - due[0] < 15 * GAP + 0.5
    assert pace.turns.ask("events") < GAP  # kinds don't wait for each other


def test_a_pause_holds_all(pace):
    answers, slept = [urllib.error.HTTPError("http://x", 429, "slow down", {}, None), "[]"], []

    def transport(url):
        if isinstance(a := answers.pop(0), Exception):
            raise a
        return a

    assert api.Client("trades", transport=transport, turns=pace.turns, sleep=slept.append).get_json("http://x") == []
    assert slept[1] == 1.0 and slept[2] > 0.8  # its own pause, then a turn after the pause of all
    assert pace.turns.ask("trades") > 0.8 and pace.turns.ask("events") < GAP


def test_without_the_driver_a_share_is_kept():
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    slept = []
    client = api.Client("trades", transport=lambda url: "[]", share=4, turns=Turns("127.0.0.1", port, "k"), sleep=slept.append)
    for k in range(3):
        client.get_json("http://x", {"k": k})
    assert slept[0] == 0 and slept[2] == pytest.approx(8 * api.MIN_INTERVAL["trades"], abs=0.05)


def test_strangers_get_no_turn(pace):
    assert Turns(pace.turns.host, pace.turns.port, "wrong").ask("trades") is None
    assert Turns.parse(str(pace.turns)) == pace.turns and Turns.parse(None) is None and pace.turns.ask("trades") is not None


def test_one_pace_an_application(spark):
    assert turns(spark, api.MIN_INTERVAL) is turns(spark, api.MIN_INTERVAL) and turns(spark, api.MIN_INTERVAL).ask("events") == 0
